"""Language identification by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a whole text are read in windows of fixed length, from both ends of each window.
At every position the two states give a probability for each learned language; the text's
probability of a language is the mean over all its positions. Windows of many texts are computed
together, so a long text costs no more memory than many short ones.

The network is trained in numpy by back-propagation through time on a bounded sample: of each
language about ``Plan.docs`` rows, chosen by a hash of the document id, and ``Plan.windows``
windows of each, at hashed places. Everything else covers all rows and all bytes.

A null text, or one without a letter, gets the language ``und`` and score 0; so does every row when
there is no training row. A row with a null ``doc_id`` is predicted, not learned from, and not held
out. Repeated rows are predicted alike. The padding of a last window is not pooled. An empty table
gives an empty table, and further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class Plan:
    hidden: int = 8
    window: int = 128  # bytes
    docs: int = 400  # sampled rows a language, about
    windows: int = 4  # sampled windows a row
    steps: int = 220
    batch: int = 192
    rate: float = 0.03
    seed: int = 7


class Gru:
    """One direction: byte inputs, ``hidden`` states; r and z gate, c is the candidate state.

    The first 2 * hidden rows of the weights belong to r and z, the last ones to c.
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        h = hidden
        self.inputs = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
        self.inputs[:, h : 2 * h] -= 1.0  # states change slowly at first
        self.states = rng.normal(0, 0.3, (3 * h, h)).astype(np.float32)

    def forward(self, x: np.ndarray) -> list[tuple]:
        h = self.states.shape[1]
        now = np.zeros((h, x.shape[1]), np.float32)
        kept = []
        for row in x:
            e = self.inputs[row].T
            gates = 1 / (1 + np.exp(-(e[: 2 * h] + self.states[: 2 * h] @ now)))
            r, z = gates[:h], gates[h:]
            c = np.tanh(e[2 * h :] + self.states[2 * h :] @ (r * now))
            after = now + z * (c - now)
            kept.append((now, r, z, c, after))
            now = after
        return kept

    def backward(self, x: np.ndarray, kept: list[tuple], d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights; ``d_out`` is the gradient at each position's state."""
        h = self.states.shape[1]
        d_states = np.zeros_like(self.states)
        d_pre = np.zeros((len(x), 3 * h, x.shape[1]), np.float32)
        d = np.zeros_like(kept[0][0])
        for t in range(len(x) - 1, -1, -1):
            before, r, z, c, _ = kept[t]
            d = d + d_out[t]
            p = d_pre[t]
            p[2 * h :] = d * z * (1 - c * c)
            p[h : 2 * h] = d * (c - before) * z * (1 - z)
            through = self.states[2 * h :].T @ p[2 * h :]
            p[:h] = through * before * r * (1 - r)
            d_states[2 * h :] += p[2 * h :] @ (r * before).T
            d_states[: 2 * h] += p[: 2 * h] @ before.T
            d = d * (1 - z) + through * r + self.states[: 2 * h].T @ p[: 2 * h]
        flat = d_pre.transpose(1, 0, 2).reshape(3 * h, -1)
        d_inputs = np.stack([np.bincount(x.ravel(), weights=g, minlength=256) for g in flat], 1).astype(np.float32)
        return d_inputs, d_states


class Network:
    def __init__(self, langs: list[str], plan: Plan):
        rng = np.random.default_rng(plan.seed)
        self.langs, self.plan = langs, plan
        self.cells = [Gru(plan.hidden, rng), Gru(plan.hidden, rng)]
        self.out = rng.normal(0, 0.3, (len(langs), 2 * plan.hidden)).astype(np.float32)
        self.bias = np.zeros((len(langs), 1), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy over all positions; ``x`` is (positions, windows)."""
        h = self.plan.hidden
        kept = [self.cells[0].forward(x), self.cells[1].forward(x[::-1])]
        states = np.concatenate([np.stack([k[4] for k in kept[0]]), np.stack([k[4] for k in kept[1]])[::-1]], 1)
        logits = self.out @ states + self.bias
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(len(y))] -= 1
        p /= p.shape[0] * p.shape[2]
        d_states = self.out.T @ p
        d_out = np.einsum("tkn,thn->kh", p, states)
        d_bias = p.sum((0, 2))[:, None]
        a = self.cells[0].backward(x, kept[0], d_states[:, :h])
        b = self.cells[1].backward(x[::-1], kept[1], d_states[::-1, h:])
        return [*a, *b, d_out, d_bias]

    def weights(self) -> list[np.ndarray]:
        return [w for c in self.cells for w in (c.inputs, c.states)] + [self.out, self.bias]

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over random batches with as many windows of each language; ``x`` is (windows, bytes)."""
        plan, rng = self.plan, np.random.default_rng(self.plan.seed + 1)
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        for step in range(1, plan.steps + 1):
            pick = np.concatenate([rng.choice(i, max(1, plan.batch // len(by_lang))) for i in by_lang])
            rate = plan.rate * min(1.0, 2 * (1 - step / (plan.steps + 1)))
            for w, g, m, v in zip(self.weights(), self.gradients(x[pick].T, y[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (positions, languages, windows) for bytes (positions, windows)."""
        h, n = self.plan.hidden, x.shape[1]
        logits = np.empty((len(x), len(self.langs), n), np.float32)
        logits[:] = self.bias
        for k, cell in enumerate(self.cells):
            # 1 / (1 + exp(-a)) = tanh(a / 2) / 2 + 1 / 2: the half goes into the weights
            inputs, states = cell.inputs.T.copy(), cell.states.copy()
            inputs[: 2 * h] /= 2
            states[: 2 * h] /= 2
            gate, cand, out = states[: 2 * h], states[2 * h :], np.ascontiguousarray(self.out[:, k * h : (k + 1) * h])
            now = np.zeros((h, n), np.float32)
            for t in range(len(x)) if k == 0 else range(len(x) - 1, -1, -1):
                e = inputs[:, x[t]]
                g = gate @ now
                g += e[: 2 * h]
                np.tanh(g, out=g)
                g *= 0.5
                g += 0.5
                c = cand @ (g[:h] * now)
                c += e[2 * h :]
                np.tanh(c, out=c)
                c -= now
                c *= g[h:]
                now = now + c
                logits[t] += out @ now
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes], together: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Per text: mean probabilities, and the number of positions labelled with each language."""
        size = self.plan.window
        count = np.array([-(-len(t) // size) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(t.ljust(n * size) for t, n in zip(texts, count.tolist(), strict=True)), np.uint8)
        windows = flat.reshape(-1, size)
        owner = np.repeat(np.arange(len(texts)), count)
        length = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(count) - count
        valid = np.minimum(size, length[owner] - (np.arange(len(owner)) - begin[owner]) * size)
        sums = np.zeros((len(texts), len(self.langs)))
        labels = np.zeros((len(texts), len(self.langs)), np.int64)
        for i in range(0, len(windows), together):
            x = np.ascontiguousarray(windows[i : i + together].T)
            p = self.label(x)
            inside = np.arange(size)[:, None] < valid[i : i + together]
            best = p >= p.max(1, keepdims=True)
            p *= inside[:, None]
            best &= inside[:, None]
            np.add.at(sums, owner[i : i + together], p.sum(0, dtype=np.float64).T)
            np.add.at(labels, owner[i : i + together], best.sum(0).T)
        return sums / np.maximum(length, 1)[:, None], labels


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the checksum of the id falls on the part kept for tests; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, plan: Plan, label: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages and a bounded sample of windows (rows of bytes) with their languages."""
    found = {r[0]: r[1] for r in docs.groupBy(label).count().collect()}
    langs = sorted(found)
    if not langs:
        return [], np.empty((0, plan.window), np.uint8), np.empty(0, np.int64)
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col(label) == k, min(1.0, plan.docs / found[k])).otherwise(share)
    place = F.abs(F.xxhash64("doc_id", F.lit(plan.seed))) / float(2**63)
    size = plan.window
    windows = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - size, F.lit(1))) + 1).cast("int"), F.lit(size)) for i in range(plan.windows)]
    rows = docs.where(place < share).select(label, F.array(*windows).alias("w")).collect()
    cut = [(langs.index(r[0]), w.encode()[:size]) for r in rows for w in r[1] if w]
    cut.sort()
    x = np.frombuffer(b"".join(w.ljust(size) for _, w in cut), np.uint8).reshape(-1, size)
    y = np.array([k for k, _ in cut], np.int64)
    keep = sorted(set(y.tolist()))
    return [langs[k] for k in keep], x, np.searchsorted(keep, y)


def fit(docs: DataFrame, plan: Plan | None = None, label: str = "lang") -> Network | None:
    """Train on rows (doc_id, text, ``label``) with text and label; None where there are none."""
    plan = plan or Plan()
    langs, x, y = sample(docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("doc_id", "text", label), plan, label)
    if not langs:
        return None
    net = Network(langs, plan)
    net.train(x, y)
    return net


def lettered(text: Column) -> Column:
    """The text, or null where it has no letter."""
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), text)


def judged(net: Network | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[dict], list[dict]]:
    """Language, score, shares and labelled positions of each text."""
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    shares: list[dict] = [{}] * len(texts)
    positions: list[dict] = [{}] * len(texts)
    at = 0
    while net is not None and at < len(texts):
        run, size = [], 0
        while at < len(texts) and size < 2_000_000:
            if texts[at] is not None:
                run.append(at)
                size += len(texts[at])
            at += 1
        if not run:
            continue
        p, labels = net.pooled([texts[i].encode() for i in run])
        for i, row, n in zip(run, p.tolist(), labels.tolist(), strict=True):
            k = int(np.argmax(row))
            pred[i], score[i] = net.langs[k], min(1.0, row[k])
            shares[i] = dict(zip(net.langs, row, strict=True))
            positions[i] = dict(zip(net.langs, n, strict=True))
    return pred, score, shares, positions


def predictor(net: Network | None) -> Callable[[Column], Column]:
    """A column function from text to a struct of lang_pred and score, for rows that keep their columns."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        pred, score, _, _ = judged(net, [t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return lambda text: predicted(lettered(text))


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row: doc_id, lang_pred, score, shares, positions.

    ``shares`` has the pooled probability and ``positions`` the number of labelled bytes of each
    language; both are empty for ``und``.
    """
    picked = docs.select("doc_id", lettered(F.col("text")).alias("text"))
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score, shares, positions = judged(net, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred), pa.array(score), pa.array([list(d.items()) for d in shares], pa.map_(pa.string(), pa.float64())), pa.array([list(d.items()) for d in positions], pa.map_(pa.string(), pa.int64()))],
                ["doc_id", "lang_pred", "score", "shares", "positions"],
            )

    return picked.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>, positions map<string,bigint>")
