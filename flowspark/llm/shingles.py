"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at a time in numpy.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z lower-cased. A
word's hash is a polynomial in its bytes, taken as a difference of running sums; a shingle's hash
mixes those of its words. A text of fewer words than a shingle has the whole sequence as its one
shingle; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SLICE = 1_000_000  # bytes worked on together; a longer text is worked on by itself
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(z: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, the same for both cases of a letter, and which bytes are white space."""
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return value, space


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n-1 and their inverses modulo 2**64."""

    def up(base: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done = 1
        with np.errstate(over="ignore"):
            while done < n:
                step = np.uint64(pow(base, done, 2**64))
                out[done : 2 * done] = out[: min(done, n - done)] * step
                done *= 2
        return out

    return up(_BASE), up(pow(_BASE, -1, 2**64))


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    value, space = tables()
    lengths = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    size = SLICE + 1 if len(data) <= SLICE + 1 else 1 << len(data).bit_length()
    power, inverse = powers(size)
    with np.errstate(over="ignore"):
        blank = space[data]
        inside = ~blank
        starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
        ends = np.flatnonzero(blank & np.concatenate([[False], inside[:-1]]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * power[: len(data)])])
        words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        begins = np.searchsorted(starts, np.cumsum(lengths) - lengths)
        count = np.diff(np.append(begins, len(starts)))
        odd = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 2**64)) for j in range(k)]
        padded = np.concatenate([words, np.zeros(k, np.uint64)])
        every = np.zeros(len(words), np.uint64)
        for j in range(k):
            every += padded[j : j + len(words)] * odd[j]
        every = mix(every)
        for b, n in zip(begins.tolist(), count.tolist(), strict=True):
            if n >= k:
                s = np.sort(every[b : b + n - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif n:
                whole = sum((words[b + j] * odd[j] for j in range(n)), np.uint64(n))
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text, ascending; null counts as empty."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if run and size + len(data) + 1 > SLICE:
            yield from _sets(run, k)
            run, size = [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield from _sets(run, k)


def class_of(s: np.ndarray) -> int:
    """A 64-bit name of a set that is not empty, as a signed number."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(s + np.uint64(0x632BE59BD9B4E019)))
        name = mix(np.array([total ^ (np.uint64(len(s)) * np.uint64(0xDB4F0B9175AE2165))], np.uint64))
    return int(name.view(np.int64)[0])
