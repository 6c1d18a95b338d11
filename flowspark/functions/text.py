"""Name normalisation and string similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Affixes of station and stop names.
STATION_SUFFIXES = ["站", "地铁站"]
STATION_PREFIX = "地铁"
STOP_NOISE = ["公交站", "站", "路口"]


def station_name(name: Column) -> Column:
    """Trim, then drop each suffix once in order, then the prefix once."""
    s = F.trim(name)
    for suffix in STATION_SUFFIXES:
        s = F.regexp_replace(s, f"{suffix}$", "")
    return F.regexp_replace(s, f"^{STATION_PREFIX}", "")


def stop_name(name: Column) -> Column:
    """Drop bracketed text and noise words."""
    s = F.regexp_replace(F.trim(name), r"[（(][^）)]*[）)]", "")
    for word in STOP_NOISE:
        s = F.replace(s, F.lit(word), F.lit(""))
    return F.trim(s)


def levenshtein_score(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


@F.pandas_udf(DoubleType())
def ratio_score(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio; used on candidate pairs only."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])
