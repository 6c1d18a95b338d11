"""Weather cleaning, merging and alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes
from flowspark.functions import time as tm
from flowspark.operators import series


def clean_hourly(raw: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Parse, de-duplicate, keep known columns, fill rain and snow, encode, fill the rest.

    ``hour`` counts hours since 1970. Coded columns are carried forward and never interpolated.
    """
    d = raw.withColumn("hour", F.floor(F.unix_seconds(tm.parse_utc_suffix(F.col("dt_iso"))) / 3600))
    keep = [c for c in codes.WEATHER_KEEP if c in d.columns]
    d = series.first_by(d.select(*keys, "hour", seq, *keep), [*keys, "hour"], [seq]).drop(seq)
    d = d.fillna(0.0, subset=[c for c in ("rain_1h", "snow_1h") if c in keep])
    coded = [c for c in ("weather_id",) if c in keep]
    if "weather_main" in keep:
        d = d.withColumn("weather_code", codes.weather_code(F.col("weather_main"))).drop("weather_main")
        coded.append("weather_code")
    numeric = [c for c in keep if c not in ("weather_id", "weather_main")]
    d = series.ffill_bfill(d, keys, "hour", [*numeric, *coded])
    full = series.reindex(d, keys, "hour")
    full = series.interpolate(full, keys, "hour", numeric)
    return series.ffill_bfill(full, keys, "hour", coded) if coded else full


def upsample(hourly: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Hourly rows to half-hour steps by the last known value; ends at the last hour (W-06)."""
    d = hourly.withColumn("step", F.col("hour") * 2).drop("hour")
    return series.ffill_bfill(series.reindex(d, keys, "step"), keys, "step", cols, backward=False)


def outer_merge(primary: DataFrame, secondary: DataFrame, keys: list[str], order: str, drop: list[str] = ()) -> DataFrame:
    """Full outer join where the primary owns shared columns; the rest is filled both ways (J-03)."""
    shared = [c for c in secondary.columns if c in primary.columns and c not in [*keys, order]]
    extra = secondary.drop(*shared, *drop)
    d = primary.join(extra, [*keys, order], "full_outer")
    return series.ffill_bfill(d, keys, order, [c for c in d.columns if c not in [*keys, order]])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Last right row at or before each left row (J-17).

    The carry runs over the distinct left times only, so it stays small however many left
    rows share a time; they meet it again in an equi join.
    """
    times = left.select(*keys, order).distinct()
    both = times.withColumns(
        {"_o": F.col(order) * 2 + 1} | {c: F.lit(None).cast(right.schema[c].dataType) for c in cols}
    ).unionByName(right.select(*keys, order, (F.col(order) * 2).alias("_o"), *cols))
    filled = series.ffill_bfill(both, keys, "_o", cols, backward=False).where(F.col("_o") % 2 == 1).drop("_o")
    return left.join(filled, [*keys, order])


def resample_forecast(fc: DataFrame, keys: list[str], order: str, numeric: list[str], coded: list[str], every: int) -> DataFrame:
    """Coarse forecast to half-hour steps: time-linear numbers, carried codes (W-07)."""
    target = series.calendar(fc, keys, order, every).withColumn("_want", F.lit(True))
    d = target.join(fc, [*keys, order], "full_outer")
    d = series.interpolate(d, keys, order, numeric)
    d = series.ffill_bfill(d, keys, order, coded, backward=False)
    return d.where("_want").drop("_want")


def mark_holidays(df: DataFrame, keys: list[str], tz_hours: int, holidays: DataFrame | None = None) -> DataFrame:
    """Add ``is_holiday`` (P-14): by the list (``keys``, d) of a city, or by the US rule without one."""
    day = tm.local_date(F.col("step"), tz_hours)
    if holidays is None:
        return df.withColumn("is_holiday", tm.is_us_holiday(day).cast("int"))
    listed = holidays.select(*keys, F.col("d").alias("_d"), F.lit(1).alias("is_holiday")).distinct()
    return df.withColumn("_d", day).join(listed, [*keys, "_d"], "left").drop("_d").fillna(0, subset=["is_holiday"])


def covariates(flow: DataFrame, weather: DataFrame, keys: list[str], tz_hours: int, holidays: DataFrame | None = None) -> DataFrame:
    """Flow with weather and calendar columns on the UTC step (J-18)."""
    local = tm.step_ts(tm.local_step(F.col("step"), tz_hours))
    d = flow.join(weather, [*keys, "step"], "left").withColumns(tm.temporal_columns(local))
    return mark_holidays(d, keys, tz_hours, holidays)
