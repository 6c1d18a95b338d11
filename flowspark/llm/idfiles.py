"""Token-id files with a minimal perfect hash index.

A shard is a pair of files: ``.ids``, the raw ids of its documents in ascending order of their
keys, as little-endian unsigned integers of 2 bytes where the vocabulary allows it and of 4 where
not, and ``.idx``, the index: the width of an id, the keys' hash function, and per slot a 32-bit fingerprint of the key, the first id and the number of ids. The
function maps the shard's n keys to the slots 0..n-1 without a collision: keys go through levels
of bit vectors; a key that alone falls on its bit is placed there, the others go on to the next
level, and the slot is the bit's rank. A lookup reads a few bits, one rank and one slot. The index
ends with the keys themselves, which only a scan of a whole shard reads.

Keys are document ids, and for a repeated id its number among the equal ids, in the order of their
texts. Ids are null-safe: null sorts first. Null text counts as empty; every document gets the end
id. An empty table gives a table of no shards. Further columns are not read. Files are named by
attempt, and the manifest, which Spark commits, lists those of the attempts that succeeded.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.chunktable import encoder

MAGIC = b"IDX1"
SHARD_IDS = 4_000_000
GAMMA = 2.0
MAX_LEVELS = 64


def hashes(keys: list[str], seed: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(k.encode(), seed) for k in keys], np.uint64)


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """A hash of the hash, other for every level (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Maps n different keys to 0..n-1; other keys to any slot or -1."""

    def __init__(self, seed: int, sizes: np.ndarray, bits: np.ndarray):
        self.seed, self.sizes, self.bits = seed, sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(words)])

    @classmethod
    def build(cls, keys: list[str]) -> PerfectHash:
        for seed in range(100):
            left = hashes(keys, seed)
            if len(np.unique(left)) < len(left):
                continue  # two keys with one hash: another seed
            sizes, placed, start = [], [], 0
            for level in range(MAX_LEVELS):
                if not len(left):
                    break
                size = max(64, int(GAMMA * len(left)) + 63 & ~63)
                at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
                alone = np.bincount(at, minlength=size)[at] == 1
                placed.append(at[alone] + start)
                left = left[~alone]
                sizes.append(size)
                start += size
            if len(left):
                continue
            flags = np.zeros(start, np.uint8)
            if placed:
                flags[np.concatenate(placed)] = 1
            return cls(seed, np.array(sizes, np.int64), np.packbits(flags, bitorder="little").view("<u8"))
        raise ValueError("keys are not different from each other")

    def slots(self, keys: list[str]) -> np.ndarray:
        h = hashes(keys, self.seed)
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(h[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.bits[word] >> bit) & np.uint64(1) == 1
            hit = open_[here]
            below = self.bits[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[hit] = self.before[word[here]] + np.bitwise_count(below)
            open_ = open_[~here]
        return out


def fingerprint(keys: list[str]) -> np.ndarray:
    return (hashes(keys, 0xF1F1F1F1) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: list[str], first: np.ndarray, count: np.ndarray, width: int) -> bytes:
    """The index of a shard whose key i owns ``count[i]`` ids from ``first[i]`` on."""
    f = PerfectHash.build(keys)
    slot = f.slots(keys)
    marks, at, n = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u8"), np.empty(len(keys), "<u8")
    marks[slot], at[slot], n[slot] = fingerprint(keys), first, count
    names = "\n".join(keys).encode()
    head = struct.pack("<4sIQIIQ", MAGIC, f.seed, len(keys), len(f.sizes), width, len(names))
    return b"".join([head, f.sizes.astype("<u8").tobytes(), f.bits.astype("<u8").tobytes(), at.tobytes(), n.tobytes(), marks.tobytes(), names])


class Shard:
    """An opened shard: keyed access by the index."""

    def __init__(self, store: fs.FileSystem, base: str):
        self.store, self.base = store, base
        with store.open_input_file(base + ".idx") as f:
            raw = f.read()
        magic, seed, n, levels, self.width, names = struct.unpack_from("<4sIQIIQ", raw)
        if magic != MAGIC:
            raise ValueError(f"{base}.idx is not an index")
        at = struct.calcsize("<4sIQIIQ")

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, k, at)
            at += out.nbytes
            return out

        sizes = take("<u8", levels).astype(np.int64)
        self.hash = PerfectHash(seed, sizes, take("<u8", int(sizes.sum()) // 64))
        self.first, self.count, self.marks = take("<u8", n), take("<u8", n), take("<u4", n)
        self.keys = raw[at : at + names].decode().split("\n") if n else []

    def find(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each key; -1 for keys that the shard does not hold."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.marks[slot[known]] == fingerprint(keys)[known] if known.any() else False
        first, count = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        first[known], count[known] = self.first[slot[known]], self.count[slot[known]]
        return first, count

    def read(self, keys: list[str]) -> Iterator[bytes | None]:
        """The packed ids of each key, None if the shard does not hold it."""
        first, count = self.find(keys)
        with self.store.open_input_file(self.base + ".ids") as f:
            for a, n in zip(first.tolist(), count.tolist(), strict=True):
                yield None if a < 0 else np.frombuffer(f.read_at(n * self.width, a * self.width), f"<u{self.width}").astype("<u4").tobytes()


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def key_of(doc_id, number: int) -> str:
    """The key of the ``number``-th document with this id."""
    return f"{json.dumps(None if doc_id is None else str(doc_id))}\t{number}"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode the documents and write shards and the manifest under ``path``."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("word", vocabulary)
        store, root = store_of(path)
        store.create_dir(root, recursive=True)
        part, made = TaskContext.get().partitionId(), 0
        width = 2 if max(enc.whole.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        keys: list[str] = []
        body: list[bytes] = []
        last, number, held = object(), 0, 0

        def close() -> pa.RecordBatch:
            nonlocal keys, body, held, made
            base = f"shard-{part:06d}-{made:05d}-{uuid.uuid4().hex}"
            count = np.array([len(x) // 4 for x in body], np.int64)
            with store.open_output_stream(f"{root}/{base}.ids") as f:
                f.write(np.frombuffer(b"".join(body), "<u4").astype(f"<u{width}").tobytes())
            with store.open_output_stream(f"{root}/{base}.idx") as f:
                f.write(index_bytes(keys, np.cumsum(count) - count, count, width))
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [made], "file": [base], "n_docs": [len(keys)], "n_ids": [int(count.sum())]})
            made += 1
            keys, body, held = [], [], 0
            return row

        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            ids = b.column(0).to_pylist()
            for doc, found in zip(ids, enc.encode(b.column(1).to_pylist()), strict=True):
                number = number + 1 if doc == last else 0
                last = doc
                keys.append(key_of(doc, number))
                body.append(found + tail)
                held += len(found) // 4 + 1
                if held >= shard_ids:
                    yield close()
        if keys:
            yield close()

    shards = picked.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    shards.mapInArrow(run, "part long, number long, file string, n_docs long, n_ids long").write.parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard, with ``start``: the ids of all shards before it."""
    kind = "part long, number long, file string, n_docs long, n_ids long"
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(kind).parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def scan(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Read all documents back through the index: doc_id, start, n_tokens, ids (packed)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(path)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(store, f"{root}/{file}")
                first, count = shard.find(shard.keys)
                step = 4096
                for i in range(0, len(shard.keys), step):
                    keys = shard.keys[i : i + step]
                    names = [json.loads(k.rpartition("\t")[0]) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()), pa.array(first[i : i + step] + start), pa.array(count[i : i + step]), pa.array(list(shard.read(keys)), pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = manifest(spark, path).select("file", "start").repartition(n, "file")
    return shards.mapInArrow(run, "doc_id string, start long, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast(id_type))
