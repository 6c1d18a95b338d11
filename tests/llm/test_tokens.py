"""Packing, id files and pieces against the libraries and brute force."""

import os
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowspark.llm import idfiles, packing, pieces
from flowspark.llm.chunktable import ByteRanks, PieceBpe, WordBpe

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "sequence_id string, doc_id long, ids string, text string, start long"


def texts():
    rnd = random.Random(5)
    signs = [*" \n\t ab.é1Á ▁\x1c日'sJ̌Σ<|>", "  ", "<|endoftext|>", "word, ", "Öß! "]
    odd = ["", " ", "a  b", " a", "a ", "\n", "a \n b", "x <|endoftext|> y", "it's  we'll", "a" * 3000 + " b" * 3000, "▁▁a▁ b"]
    return odd + ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]


def frame(spark, body):
    """Documents with clashing extra columns, a null text, a null id and a repeated row."""
    rows = [("s", i, "x", t, 7) for i, t in enumerate(body)] + [("s", None, "x", "no id. here", 7), ("s", 10_000, "x", None, 7), ("s", 0, "x", body[0] if body else "", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_chunk_tables_equal_the_libraries():
    body = texts()
    byte = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() for x in ByteRanks(RANKS).encode(body)] == [x.ids for x in byte.encode_batch(body, add_special_tokens=False)]
    word = WordBpe(WORDS)
    assert [np.frombuffer(x, "<u4").tolist() for x in word.encode(body)] == [x.ids for x in word.whole.encode_batch(body, add_special_tokens=False)]
    piece = PieceBpe(PIECES)
    assert [np.frombuffer(x, "<u4").tolist() for x in piece.encode(body)] == piece.model.encode(body)


def test_pieces_round_trip(spark):
    body = texts()[:300]
    got = {r.doc_id: r for r in pieces.decode(pieces.encode(frame(spark, body), PIECES), PIECES).collect()}
    model = PieceBpe(PIECES).model
    for i, t in enumerate(body):
        assert got[i].ids == model.encode(t)
        assert got[i].text == model.decode(model.encode(t))
    assert got[10_000].ids == [] and got[10_000].text == ""
    assert pieces.decode(pieces.encode(frame(spark, []).limit(0), PIECES), PIECES).count() == 0


def total(length, c):
    return c.sequence + (0 if length & (length - 1) == 0 else c.capacity - length)


def cheapest(pos, penalty, c):
    """Quadratic programme over all pairs of cuts."""
    at, cost = [0, *pos], [0]
    for j in range(1, len(at)):
        cost.append(min(cost[i] + total(at[j] - at[i], c) + penalty[j - 1] for i in range(j) if at[j] - at[i] <= c.capacity))
    return cost[-1]


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_the_cheapest(seed):
    rnd = random.Random(seed)
    c = packing.Costs(capacity=64, sequence=rnd.choice([0, 3]), sentence=5, inside=20, grid=8)
    pos = np.array(sorted(rnd.sample(range(1, 900), rnd.choice([1, 5, 60, 200]))))
    doc_ends = np.array(sorted({int(pos[-1]), *rnd.sample(pos.tolist(), max(1, len(pos) // 5))}))
    at, penalty = packing.offered(pos, doc_ends, c)
    ends = packing.best_cuts(at, penalty, c)
    cost, last = 0, 0
    for e in ends:
        assert at[e] - last <= c.capacity
        cost += total(int(at[e]) - last, c) + int(penalty[e])
        last = int(at[e])
    assert last == pos[-1] and cost == cheapest(at.tolist(), penalty.tolist(), c)


def test_packing_keeps_every_id_once(spark):
    body = texts()[:200] + ["Some words here. " * 4000, "word" * 3000]
    got = packing.pack(frame(spark, body), RANKS, block=4096).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    enc = ByteRanks(RANKS)
    for i, t in enumerate(body):
        if i == 0:
            continue  # stands twice
        parts = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == [*next(enc.encode([t])).tolist(), 0]
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert {r.doc_tokens for r in parts} == {len(ids)}
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 1024
    assert len(by_doc[0]) == 2 and by_doc[10_000][0].doc_tokens == 1 and None in by_doc
    assert packing.pack(frame(spark, []).limit(0), RANKS).count() == 0


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 100, 5000):
        keys = [idfiles.key_of(i * 7, 0) for i in range(n)]
        f = idfiles.PerfectHash.build(keys)
        assert sorted(f.slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        idfiles.PerfectHash.build(["a", "a"])


def test_id_files_round_trip(spark, tmp_path):
    body = texts()[:400]
    docs = frame(spark, body)
    path = f"file://{tmp_path}/ids"
    idfiles.write(docs, path, WORDS, shard_ids=500)
    got = sorted(idfiles.scan(spark, path).collect(), key=lambda r: r.start)
    word = WordBpe(WORDS)
    order = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in docs.collect())
    start = 0
    for r, (doc, t) in zip(got, order, strict=True):
        ids = [*word.whole.encode(t, add_special_tokens=False).ids, 1]
        assert (r.doc_id if r.doc_id is not None else -1) == doc and r.start == start
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        start += len(ids)
    shards = idfiles.manifest(spark, path).collect()
    assert len(shards) > 2
    store, root = idfiles.store_of(path)
    shard = idfiles.Shard(store, f"{root}/{shards[0].file}")
    raw = open(f"{tmp_path}/ids/{shards[0].file}.ids", "rb").read()
    assert shard.width == 2 and b"".join(shard.read(shard.keys)) == np.frombuffer(raw, "<u2").astype("<u4").tobytes()
    strange = [f"strange {i}" for i in range(1000)]
    assert sum(x is not None for x in shard.read(strange)) <= 1  # 32-bit fingerprints
    empty = f"file://{tmp_path}/none"
    idfiles.write(docs.limit(0), empty, WORDS)
    assert idfiles.scan(spark, empty).count() == 0
