"""Order-preserving packing of documents into sequences by dynamic programming.

Documents keep the order of the rows of each input partition. Their ids, each document followed by
one end id, form a stream that is cut into sequences of at most ``capacity`` ids. The cuts lie at
ends of documents or sentences where these are near enough, and minimise

    padding + a penalty per sequence + a penalty per cut inside a document,

where a sequence is padded to ``capacity`` unless its length is a power of two. The best cost of a
cut needs the least of ``cost + position`` over the cuts at most ``capacity`` ids before it, which
a monotone queue keeps; the at most eleven cuts at distances that are powers of two are looked up.

Every input partition is packed by itself, block by block, without a shuffle and in bounded
memory: the last, open sequence of a block moves on to the next block. A lost task is run again
on the same rows and gives the same result.

Null or empty text: the document is its end id alone. A null ``doc_id`` is kept. Repeated rows are
packed as often as they occur. An empty table gives an empty table. A text longer than a block
spans several blocks. Further columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.chunktable import encoder


@dataclass(frozen=True)
class Costs:
    capacity: int = 1024
    sequence: int = 256  # per sequence, so that short ones need a reason
    sentence: int = 8  # cut inside a document at the end of a sentence
    inside: int = 64  # cut inside a sentence; only where a sentence is longer than ``capacity``
    grid: int = 64  # distance of the cuts that are offered inside such a sentence


def offered(ends: np.ndarray, doc_ends: np.ndarray, c: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may lie, ascending, and their penalties. ``doc_ends`` is part of ``ends``."""
    pos = np.union1d(ends, doc_ends)
    gaps = np.diff(pos, prepend=0)
    long = np.flatnonzero(gaps > c.capacity)
    more = [np.arange(pos[i] - gaps[i] + c.grid, pos[i], c.grid) for i in long]
    inside = np.concatenate(more) if more else np.empty(0, pos.dtype)
    every = np.concatenate([pos, inside])
    penalty = np.concatenate([np.where(np.isin(pos, doc_ends), 0, c.sentence), np.full(len(inside), c.inside)])
    order = np.argsort(every, kind="stable")
    return every[order], penalty[order]


def best_cuts(pos: np.ndarray, penalty: np.ndarray, c: Costs) -> list[int]:
    """Indices into ``pos`` of the cheapest ends of sequences; the last position is always one.

    Ties go to the earlier cut.
    """
    at = np.concatenate([[0], pos])
    n = len(at)
    exact_j, exact_i = [], []
    for k in range(c.capacity.bit_length()):
        want = at - (1 << k)
        i = np.searchsorted(at, want)
        hit = np.flatnonzero((want >= 0) & (at[np.minimum(i, n - 1)] == want))
        exact_j.append(hit)
        exact_i.append(i[hit])
    js, ks = np.concatenate(exact_j), np.concatenate(exact_i)
    order = np.argsort(js, kind="stable")
    js, ks = js[order].tolist() + [n], ks[order].tolist()
    p, pen = at.tolist(), [0, *(penalty + c.sequence).tolist()]
    cost, back, e = [0] * n, [0] * n, 0
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + position, index), costs ascending
    capacity = c.capacity
    for j in range(1, n):
        here = p[j]
        low = here - capacity
        while p[queue[0][1]] < low:
            queue.popleft()
        best, i = queue[0]
        best += capacity - here
        while js[e] == j:
            if cost[ks[e]] < best:
                i = ks[e]
                best = cost[i]
            e += 1
        best += pen[j]
        cost[j], back[j] = best, i
        g = best + here
        while queue and queue[-1][0] > g:
            queue.pop()
        queue.append((g, j))
    cuts, j = [], n - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


class Packer:
    """Turns a stream of documents into pieces; holds one block of ids."""

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def __init__(self, first: int, c: Costs, ends_sentence: np.ndarray, kind: pa.DataType, block: int):
        self.c, self.is_end, self.kind, self.block = c, ends_sentence, kind, block
        self.next_id = first
        self.segments: list[tuple] = []  # (document id, its ids from ``start`` on, start, all its ids)
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(ids), self.block):
            part = ids[start : start + self.block]
            self.segments.append((key, part, start, len(ids)))
            self.held += len(part)
            if self.held >= self.block:
                yield self.flush(last=False)

    def flush(self, last: bool) -> pa.RecordBatch:
        stream = np.concatenate([s[1] for s in self.segments])
        lengths = np.array([len(s[1]) for s in self.segments])
        begins = np.cumsum(lengths) - lengths
        closes = np.array([s[2] + len(s[1]) == s[3] for s in self.segments])
        doc_ends = (begins + lengths)[closes]
        sentences = np.flatnonzero(self.is_end[stream]) + 1
        if len(doc_ends) == 0 or doc_ends[-1] != len(stream):
            sentences = np.union1d(sentences, [len(stream)])  # the block ends inside a document
        pos, penalty = offered(sentences, doc_ends, self.c)
        ends = pos[best_cuts(pos, penalty, self.c)]
        if not last:
            ends = ends[:-1]
        taken = int(ends[-1]) if len(ends) else 0
        edges = np.union1d(np.concatenate([[0], ends]), begins[begins < taken])
        edges = edges[edges < taken]
        size = np.diff(np.append(edges, taken))
        seq = np.searchsorted(ends, edges, "right")
        seg = np.searchsorted(begins, edges, "right") - 1
        seq_begin = np.concatenate([[0], ends])[seq] if taken else edges
        first = np.array([s[2] for s in self.segments], np.int64)
        total = np.array([s[3] for s in self.segments], np.int64)
        data = stream[:taken].astype("<u4").tobytes()
        offsets = np.append(edges, taken).astype(np.int32) * 4 if taken else np.zeros(1, np.int32)
        binary = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
        out = [
            pa.array([self.segments[i][0] for i in seg], self.kind),
            pa.array(first[seg] + edges - begins[seg], pa.int64()),
            pa.array(size, pa.int64()),
            pa.array(total[seg], pa.int64()),
            pa.array(self.next_id + seq, pa.int64()),
            pa.array(edges - seq_begin, pa.int64()),
            binary,
        ]
        self.next_id += len(ends)
        rest = []
        for (key, ids, start, n), b in zip(self.segments, begins.tolist(), strict=True):
            if b + len(ids) > taken:
                skip = max(0, taken - b)
                rest.append((key, ids[skip:].copy(), start + skip, n))
        self.segments, self.held = rest, len(stream) - taken
        return pa.RecordBatch.from_arrays(out, self.names)


def sentence_ends(model) -> np.ndarray:
    """For every id whether a sentence ends behind it: a full stop, other end mark or line end."""
    n = model.n_vocab
    marks = (".", "!", "?", "\n", "。")
    out = np.zeros(n, bool)
    for i in range(n):
        try:
            out[i] = model.decode([i]).rstrip(" ").endswith(marks)
        except KeyError:
            pass
    return out


def pack(docs: DataFrame, ranks: str, costs: Costs | None = None, end_id: int = 0, block: int = 1 << 18, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ranks`` is the path of a byte-level vocabulary. ``ids`` holds the piece's ids as packed
    little-endian unsigned 32-bit integers. ``sequence_id`` counts up from the partition's number
    times 2**40.
    """
    c = costs or Costs()
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder("byte", ranks)
        if not hasattr(enc, "sentence_ends"):
            enc.sentence_ends = sentence_ends(enc.model)
        packer = None
        for b in batches:
            if packer is None:
                packer = Packer(TaskContext.get().partitionId() << 40, c, enc.sentence_ends, b.column(0).type, block)
            for i in range(b.num_rows):
                found = next(enc.encode([b.column(1)[i].as_py() or ""]))
                ids = np.empty(len(found) + 1, np.uint32)
                ids[:-1] = found
                ids[-1] = end_id
                yield from packer.add(b.column(0)[i].as_py(), ids)
        if packer is not None and packer.segments:
            yield packer.flush(last=True)

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
