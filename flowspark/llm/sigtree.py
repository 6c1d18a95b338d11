"""Documents linked by the Jaccard similarity of their word shingles, by signature trees.

Two documents link when ``den * intersection >= num * union`` of their shingle sets. Sets, not
documents, are compared: equal sets form one class. A class has its size and a signature, a bitmap
of its shingles. The work runs in these steps, each a Spark job over written tables.

1. Profiles: size, class and signature of every text, and a bounded sketch of how common shingles are.
2. Blocks: of each set the shingles that any linked set must share one of, rarest first after the
   sketch (n - ceil(num n / den) + 1 of them; any total order keeps every link). Classes that share
   one form a block. Shingles that the sketch calls very common are left out of the blocks that one task
   builds: their entries are dealt out one by one, and what such a block needs as a whole, two of its
   members and a name for its set of classes, are sums and minima that Spark merges.
3. A block is joined with itself by a signature tree. Its nodes hold the bitwise or of their
   members' bitmaps and the range of their sizes; two nodes are traversed together while the bits
   in common and the sizes allow some pair of members the overlap a link needs; what a set has
   behind the shared shingle in its order bounds the overlap as well. A block of up to ``LEAF``
   classes is one leaf. Larger ones, such as families of near copies, are first compared with two
   of their members only, those with the fewest rarer shingles; once these links have merged
   classes, the trees of the blocks that still hold several components are traversed, leaving out
   nodes of one component.
4. Pairs that the signatures allow are compared exactly, on the shingles of their whole texts.
5. Links become components by alternating star contractions.

No step builds all pairs of a family, and no family that is larger than ``hot_above`` meets in one
task. Nothing is capped: every pair of classes that could link is compared or already connected. Sets are told
apart by 64-bit names.

A null or empty text, or one without words, has an empty set and is linked with nothing. A null
``doc_id`` counts as larger than all others. Repeated rows give repeated results. An empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shingles import class_of, mix, sets
from flowspark.session import cut_lineage

BITS = 2048  # of a signature
CELLS = 1 << 19  # of the sketch
CELL_ROW = 1 << 14
LEAF = 32
NODE = 1024  # classes of a block that travel together
BLOCK_ENTRIES = 100_000
SEEN = 300_000
HOT = 50_000  # documents of a shingle from which on its block is built by all tasks
HOT_PARTS = 256
SALTS = 64
HUB_PAIRS = 64  # pairs that one copy of a compared text serves, about


def signature(s: np.ndarray) -> bytes:
    flags = np.zeros(BITS, np.uint8)
    flags[(s >> np.uint64(50)).astype(np.int64) % BITS] = 1
    return np.packbits(flags).tobytes()


def cells_of(s: np.ndarray) -> np.ndarray:
    return (s & np.uint64(CELLS - 1)).astype(np.int64)


def profiles(docs: DataFrame, words: int) -> DataFrame:
    """Rows of documents (doc_id, hash of the text, n, class, sig) and, with ``row`` set, rows of the sketch (row, cells)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = np.zeros(CELLS, np.uint32), pa.int64()
        for b in batches:
            id_type = b.column(0).type
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                n, name, sig = [], [], []
                for s in sets(part.column(1).to_pylist(), words):
                    n.append(len(s))
                    name.append(class_of(s) if len(s) else None)
                    sig.append(signature(s) if len(s) else None)
                    np.add.at(sketch, cells_of(s), np.uint32(1))
                size = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(sig, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        rows = [r for r in range(CELLS // CELL_ROW) if sketch[r * CELL_ROW : (r + 1) * CELL_ROW].any()]
        cells = [sketch[r * CELL_ROW : (r + 1) * CELL_ROW].tobytes() for r in rows]
        size = len(rows)
        yield pa.RecordBatch.from_arrays([pa.nulls(size, id_type), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.array(rows, pa.int32()), pa.array(cells, pa.binary())], names)

    names = ["doc_id", "hash", "n", "class", "sig", "row", "cells"]
    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, hash long, n long, class long, sig binary, row int, cells binary")


def merged_sketch(profile: DataFrame) -> np.ndarray:
    """The sketch of all rows: a fixed number of cells, whatever the table holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[r] = total.get(r, 0) + np.frombuffer(c, np.uint32).astype(np.uint64)
        cells = [np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(cells, pa.binary())], ["row", "cells"])

    rows = profile.where("row IS NOT NULL").select("row", "cells").repartition("row").mapInArrow(run, "row int, cells binary")
    out = np.zeros(CELLS, np.uint32)
    for r, c in rows.collect():
        out[r * CELL_ROW : (r + 1) * CELL_ROW] = np.frombuffer(c, np.uint32)
    return out


def hot_above(sketch: np.ndarray) -> float:
    """Count of a cell from which on its shingles are dealt out: well above what unrelated shingles add up to."""
    return max(HOT, 2 * float(sketch.mean()))


def entries(docs: DataFrame, sketch: np.ndarray, words: int, num: int, den: int, blocks: int) -> DataFrame:
    """Per task and ``part``: packed shingles (key), classes, sizes and places of the shingles in their set's order.

    Parts below 0 hold the entries of very common shingles, dealt by shingle and class.
    """
    limit = hot_above(sketch)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = shared.value, set()
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            key, name, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            part = (key % np.uint64(blocks)).astype(np.int64)
            hot = common[cells_of(key)] > limit
            part[hot] = -1 - (mix(key[hot] ^ name[hot].view(np.uint64)) % np.uint64(HOT_PARTS)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            edge = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            cols = [np.split(x[order], edge[1:]) for x in (key, name, n, place)]
            packed = [pa.array([x.tobytes() for x in c], pa.binary()) for c in cols]
            return pa.RecordBatch.from_arrays([pa.array(part[edge]), *packed], ["part", "key", "class", "n", "place"])

        for b in batches:
            for i in range(0, b.num_rows, 2000):
                for s in sets(b.column(0).slice(i, 2000).to_pylist(), words):
                    if not len(s):
                        continue
                    name = class_of(s)
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    n = len(s)
                    p = n + (-num * n) // den + 1
                    key = s[np.argsort(common[cells_of(s)], kind="stable")[:p]]
                    held.append((key, np.full(p, name, np.int64), np.full(p, n, np.uint32), np.arange(p, dtype=np.uint32)))
                    size += p
                if size >= 1_000_000:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return docs.select("text").mapInArrow(run, "part long, key binary, class binary, n binary, place binary")


def may_link(n_a: np.ndarray, n_b: np.ndarray, overlap: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes with at most this overlap can link."""
    return overlap * (num + den) >= num * (n_a + n_b)


def blocks_of(packed: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of small blocks, and of larger ones with two of their classes; larger blocks
    themselves as rows of (block, class, n, place); and entries of very common shingles as (key, class, n, place)."""

    def work(part: int, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(r["key"], np.uint64) for r in rows])
        name = np.concatenate([np.frombuffer(r["class"], np.int64) for r in rows])
        n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows]).astype(np.int64)
        place = np.concatenate([np.frombuffer(r["place"], np.uint32) for r in rows]).astype(np.int64)
        order = np.lexsort((name, key))
        key, name, n, place = key[order], name[order], n[order], place[order]
        once = np.ones(len(key), bool)
        once[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
        key, name, n, place = key[once], name[once], n[once], place[once]
        if part < 0:
            blank = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, blank, pa.array(name), pa.array(n), pa.array(place), pa.array(key.view(np.int64))], names)
            return
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        size = np.repeat(count, count)
        left, right = [], []

        def offer(i: np.ndarray, j: np.ndarray) -> None:
            """Pairs whose first shared shingle this may be: what lies behind it bounds the overlap."""
            good = may_link(n[i], n[j], np.minimum(n[i] - place[i], n[j] - place[j]), num, den)
            left.append(np.minimum(name[i[good]], name[j[good]]))
            right.append(np.maximum(name[i[good]], name[j[good]]))

        leaf = np.flatnonzero((size >= 2) & (size <= LEAF))
        for d in range(1, LEAF):
            i = leaf[leaf + d < len(key)]
            i = i[key[i] == key[i + d]]
            if not len(i):
                break
            offer(i, i + d)
        for f, c in zip(first[count > LEAF].tolist(), count[count > LEAF].tolist(), strict=True):
            for hub in f + np.lexsort((name[f : f + c], place[f : f + c]))[:2]:
                others = np.arange(f, f + c)
                offer(np.full(c - 1, hub), others[others != hub])
            members = name[f : f + c]
            blank = pa.nulls(c, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, pa.array(np.full(c, class_of(members.view(np.uint64)))), pa.array(members), pa.array(n[f : f + c]), pa.array(place[f : f + c]), blank], names)
        if left:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            blank = pa.nulls(len(both), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), blank, blank, blank, blank, blank], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part and rows:
                    yield from work(part, rows)
                    rows = []
                part = r["part"]
                rows.append(r)
        if rows:
            yield from work(part, rows)

    names = ["a", "b", "block", "class", "n", "place", "key"]
    dealt = packed.repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "a long, b long, block long, class long, n long, place long, key long")


def dealt_blocks(hot: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) with two classes of each block, and rows (block, class, n, place), of entries (key, class, n, place).

    The two are those with the fewest rarer shingles among the classes of either parity.
    """
    rows = hot.withColumns({"h": F.xxhash64("class"), "salt": F.pmod(F.xxhash64("class", "key"), F.lit(SALTS)).cast("int")})
    member = F.struct("place", "class", "n")
    least = lambda odd: F.min(F.when(F.pmod("h", F.lit(2)) == odd, member)).alias(f"hub{odd}")
    names = F.xxhash64(F.sum(F.col("h").cast("decimal(38,0)")), F.count("*")).alias("block")
    of_key = rows.groupBy("key").agg(least(0), least(1), names)
    met = rows.join(of_key.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"])
    hubs = met.withColumn("hub", F.explode(F.array("hub0", "hub1"))).where("hub IS NOT NULL AND hub.class <> class")
    overlap = F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place"))
    hubs = hubs.where(overlap * (num + den) >= num * (F.col("n") + F.col("hub.n")))
    return hubs.select(F.least("class", "hub.class").alias("a"), F.greatest("class", "hub.class").alias("b")), met.select("block", "class", "n", "place")


def bits(column: pa.Array) -> np.ndarray:
    """Packed signatures as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def allowed(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(classes.select(F.col("class").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"s_{side}")), side)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                n_a, n_b = b.column(2).to_numpy(), b.column(3).to_numpy()
                s_a, s_b = bits(b.column(4)), bits(b.column(5))
                spare = np.minimum(n_a - ones(s_a), n_b - ones(s_b))
                good = pa.array(may_link(n_a, n_b, np.minimum(ones(s_a & s_b) + spare, np.minimum(n_a, n_b)), num, den))
                yield b.select([0, 1]).filter(good)

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def ones(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(-1).astype(np.int64)


def links_of(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by the shingles of whole texts. ``texts``: class, text."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).alias("copies"))
    spread = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("copies")).alias("copy"), "b")
    hubs = spread.select("a", "copy").distinct().join(texts.withColumnRenamed("class", "a"), "a").select("a", "copy", F.lit(None).cast("long").alias("b"), "text")
    others = spread.join(texts.withColumnRenamed("class", "b"), "b").select("a", "copy", "b", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = [], []
            for x, y, s in zip(a, b, sets(batch.column(2).to_pylist(), words), strict=True):
                if y is None:
                    hub, own = x, s
                    continue
                assert x == hub
                both = len(np.intersect1d(own, s, assume_unique=True))
                if den * both >= num * (len(own) + len(s) - both):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    dealt = hubs.unionByName(others).repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first())
    return dealt.select("a", "b", "text").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(class, root) of every class in a link, by alternating large and small stars."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: a node's larger neighbours go to the smallest node around it
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = cut_lineage(moved.distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("class"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("class"), F.col("v").alias("root")).distinct())


class Tree:
    """Binary signature tree over classes in the order given; a node is a range of them."""

    def __init__(self, name: np.ndarray, n: np.ndarray, label: np.ndarray, reach: np.ndarray, sig: np.ndarray):
        """``reach``: the most shingles that a member can share with another one of its block."""
        self.name, self.n, self.label, self.reach, self.sig = name, n, label, reach, sig
        self.spare = n - ones(sig)
        self.nodes: list[tuple] = []  # begin, end, children, bitmap, least and most n, most spare, label or None, most reach
        self.grow(0, len(name))

    def grow(self, s: int, e: int) -> int:
        own = slice(s, e)
        labels = self.label[own]
        at = len(self.nodes)
        self.nodes.append(())
        kids = ()
        if e - s > LEAF:
            mid = (s + e) // 2
            kids = (self.grow(s, mid), self.grow(mid, e))
            bitmap = self.nodes[kids[0]][3] | self.nodes[kids[1]][3]
        else:
            bitmap = np.bitwise_or.reduce(self.sig[own], axis=0)
        only = int(labels[0]) if (labels == labels[0]).all() else None
        self.nodes[at] = (s, e, kids, bitmap, int(self.n[own].min()), int(self.n[own].max()), int(self.spare[own].max()), only, int(self.reach[own].max()))
        return at


def open_pair(x: tuple, y: tuple, num: int, den: int) -> bool:
    """Whether some members of two nodes may link and are not of one component yet."""
    if x[7] is not None and x[7] == y[7]:
        return False
    # of members with sizes p and q the overlap is at most min(p, q), and p + q is least at the ranges' lower ends
    least_x, least_y = max(x[4], -(-num * y[4] // den)), max(y[4], -(-num * x[4] // den))
    if least_x > x[5] or least_y > y[5]:
        return False
    overlap = min(int(np.bitwise_count(x[3] & y[3]).sum()) + min(x[6], y[6]), x[8], y[8])
    return overlap * (num + den) >= num * (least_x + least_y)


def traverse(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of classes, one of each tree, that may link and are not of one component yet."""
    todo = [(0, 0)]
    same = x is y
    while todo:
        i, j = todo.pop()
        p, q = x.nodes[i], y.nodes[j]
        if not open_pair(p, q, num, den):
            continue
        if p[2] and (not q[2] or p[1] - p[0] >= q[1] - q[0]):
            if same and i == j:
                a, b = p[2]
                todo += [(a, a), (b, b), (a, b)]
            else:
                todo += [(k, j) for k in p[2]]
        elif q[2]:
            todo += [(i, k) for k in q[2]]
        else:
            a, b = np.arange(p[0], p[1])[:, None], np.arange(q[0], q[1])[None, :]
            overlap = ones(x.sig[a] & y.sig[b]) + np.minimum(x.spare[a], y.spare[b])
            overlap = np.minimum(overlap, np.minimum(x.reach[a], y.reach[b]))
            good = may_link(x.n[a], y.n[b], overlap, num, den) & (x.label[a] != y.label[b])
            if same and i == j:
                good &= a < b
            r, c = np.nonzero(good)
            yield x.name[r + p[0]], y.name[c + q[0]]


def open_pairs(blocks: DataFrame, roots: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes in one block, of different components, that the signature trees leave over."""
    rows = blocks.join(roots, "class", "left").select("block", "class", "n", (F.col("n") - F.col("place")).alias("reach"), F.coalesce("root", "class").alias("label"))
    mixed = rows.groupBy("block").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("block")
    rows = rows.join(mixed, "block").join(classes.select("class", "sig"), "class")

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of up to NODE classes of one block, as the upper nodes of its tree."""
        block, held, number = None, [], TaskContext.get().partitionId() << 32  # a block may cover several tasks

        def close() -> pa.RecordBatch:
            name, n, label, reach = (np.array([r[k] for r in held], np.int64) for k in ("class", "n", "label", "reach"))
            sig = np.frombuffer(b"".join(r["sig"] for r in held), np.uint64).reshape(len(held), -1)
            only = int(label[0]) if (label == label[0]).all() else None
            body = [name.tobytes(), n.tobytes(), label.tobytes(), reach.tobytes(), sig.tobytes()]
            top = [np.bitwise_or.reduce(sig, axis=0).tobytes(), int(n.min()), int(n.max()), int((n - ones(sig)).max()), only, int(reach.max())]
            return pa.RecordBatch.from_pydict({k: [v] for k, v in zip(node_names, [block, number, *body, *top], strict=True)}, node_schema)

        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block or len(held) == NODE:
                    if held:
                        yield close()
                    number += 1
                    block, held = r["block"], []
                held.append(r)
        if held:
            yield close()

    node_names = ["block", "number", "class", "n", "label", "reach", "sig", "top", "least", "most", "spare", "only", "far"]
    binary, long = pa.binary(), pa.int64()
    node_schema = pa.schema(list(zip(node_names, [long, long, binary, binary, binary, binary, binary, binary, long, long, long, long, long], strict=True)))
    ddl = "block long, number long, class binary, n binary, label binary, reach binary, sig binary, top binary, least long, most long, spare long, only long, far long"
    made = cut_lineage(rows.repartitionByRange("block", "label", "n", "class").sortWithinPartitions("block", "label", "n", "class").mapInArrow(nodes, ddl))
    top = ["block", "number", "top", "least", "most", "spare", "only", "far"]
    x, y = (made.select("block", *[F.col(c).alias(f"{c}_{s}") for c in top[1:]]) for s in "xy")
    salts = made.groupBy("block").agg(F.ceil(F.count("*") / SALTS).cast("int").alias("salts"))
    x = x.join(salts, "block").withColumn("salt", F.pmod(F.xxhash64("number_x"), F.col("salts")).cast("int")).drop("salts")
    y = y.join(salts, "block").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    pairs = x.join(y, ["block", "salt"]).where("number_x <= number_y AND NOT only_x <=> only_y OR number_x <= number_y AND only_x IS NULL")

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for r in b.to_pylist():
                p, q = ((0, 0, (), np.frombuffer(r[f"top_{s}"], np.uint64), r[f"least_{s}"], r[f"most_{s}"], r[f"spare_{s}"], r[f"only_{s}"], r[f"far_{s}"]) for s in "xy")
                keep.append(open_pair(p, q, num, den))
            yield b.select(["block", "number_x", "number_y"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.mapInArrow(prune, "block long, number_x long, number_y long")
    body = ["class", "n", "label", "reach", "sig"]
    for s in "xy":
        left = left.join(made.select("block", F.col("number").alias(f"number_{s}"), F.struct(*body).alias(s)), ["block", f"number_{s}"])

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(r: dict) -> Tree:
            return Tree(*(np.frombuffer(r[k], np.int64) for k in body[:4]), np.frombuffer(r["sig"], np.uint64).reshape(-1, BITS // 64))

        for b in batches:
            for r in b.to_pylist():
                p = tree(r["x"])
                q = p if r["number_x"] == r["number_y"] else tree(r["y"])
                for u, v in traverse(p, q, num, den):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    return left.select("number_x", "number_y", "x", "y").mapInArrow(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    own, named = linked(docs, words, num, den, doc_id, text)
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(lowest, "root").select("class", "component_id")
    return own.join(names, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and hash (xxhash64 of the text) of what stays: of each component the row with the
    smallest id, nulls last, then class and hash; and every row without a class, as it has no links."""
    own, named = linked(docs, words, num, den, doc_id, text)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "class", "hash")
    best = own.where("class IS NOT NULL").join(named.select("class", "root"), "class").groupBy("root").agg(F.min(place).alias("p"))
    return best.select("p.doc_id", "p.hash").unionByName(own.where("class IS NULL").select("doc_id", "hash").distinct())


def linked(docs: DataFrame, words: int, num: int, den: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, hash, n, class, sig), and the classes with their first id and component's root."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    profile = cut_lineage(profiles(docs, words))
    own = profile.where("row IS NULL").select("doc_id", "hash", "n", "class", "sig")
    classes = cut_lineage(
        own.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("sig").alias("sig"))
    )
    total = own.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).collect()[0][0] or 0
    sketch = merged_sketch(profile)
    found = cut_lineage(blocks_of(entries(docs, sketch, words, num, den, max(1, -(-int(total) // BLOCK_ENTRIES))), num, den))
    met, dealt = dealt_blocks(found.where("key IS NOT NULL").select("key", "class", "n", "place"), num, den)
    pairs = found.where("a IS NOT NULL").select("a", "b").unionByName(met)
    pairs = cut_lineage(allowed(pairs.distinct(), classes, num, den))
    # blocks of the same classes are one, with the smallest place that a class has in any of them
    blocks = found.where("block IS NOT NULL").select("block", "class", "n", "place").unionByName(dealt).groupBy("block", "class", "n").agg(F.min("place").alias("place"))

    # the texts that any comparison needs, fetched once
    wanted = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("class")).unionByName(blocks.select("class")).distinct())
    firsts = wanted.join(classes.select("class", "first"), "class").select("first").distinct()
    # rows of one id may have different texts: each row goes on once, with its own class
    own_class = of_class(docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["first"]), "left_semi"), words)
    texts = cut_lineage(own_class.join(wanted, "class", "left_semi"))

    links = cut_lineage(links_of(pairs, texts, words, num, den))
    roots = cut_lineage(components(links))
    rest = cut_lineage(open_pairs(blocks, roots, classes, num, den).join(pairs, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(cut_lineage(links_of(rest, texts, words, num, den)))
        roots = cut_lineage(components(links))
    return own, classes.join(roots, "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))


def of_class(texts: DataFrame, words: int) -> DataFrame:
    """Class and text, one text per class; texts without words go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            name = pa.array([class_of(s) if len(s) else None for s in sets(b.column(0).to_pylist(), words)], pa.int64())
            yield pa.RecordBatch.from_arrays([name, b.column(0)], ["class", "text"]).filter(name.is_valid())

    return texts.select("text").mapInArrow(run, "class long, text string").dropDuplicates(["class"])
