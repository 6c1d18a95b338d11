"""Encoding and decoding with a SentencePiece model, by a distinct-chunk table.

``encode`` gives exactly the library's ids: no begin or end ids, no sampling. The model's pieces
hold white-space markers in front only (checked when it is loaded), so every distinct marked word
is segmented once per worker and the ids join back by position. ``decode`` is the library's.

Null text counts as empty and has no ids; null ids decode to an empty text. Repeated rows give
repeated rows, an empty table gives an empty table, and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.chunktable import encoder


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices, so that a worker holds the ids of few documents at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id and ``ids``, an array of ints."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("piece", model)
        for b in sliced(batches):
            found = list(enc.encode(t or "" for t in b.column(1).to_pylist()))
            ends = np.cumsum([0] + [len(x) // 4 for x in found])
            ids = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, f"doc_id {picked.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """The rows of ``encode`` with ``text``, as the library's decode gives it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("piece", model)
        for b in sliced(batches):
            ids = b.column(1)
            flat = ids.values.to_numpy(zero_copy_only=False)
            ends = ids.offsets.to_numpy()
            texts = enc.decode([flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
