"""Distinct-chunk tables: each distinct chunk of a text is encoded once, ids join back by position.

A chunk is a stretch of text whose ends no token crosses, so encoding chunks one by one gives
exactly the ids of the whole text. The tables live in a Python worker and are bounded: each has two
generations, a full one is kept to be read while the next is filled, and what is read moves on with it. They only
save work, results never depend on what they hold.
"""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import compress, pairwise, repeat
from operator import is_

import numpy as np

MAX_CHUNKS = 300_000  # of one generation of a table
MAX_CHARS = 6_000_000
SPLIT = object()  # value of a chunk that cannot stand alone


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "little" and array("I").itemsize == 4:
        return array("I", ids).tobytes()
    return np.array(ids, "<u4").tobytes()


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(rest)}


def runs(texts: Iterable[str], most: int = 400_000) -> Iterator[list[str]]:
    """The texts in runs of about ``most`` characters, at least one text each."""
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


class ChunkTable:
    """chunk -> packed ids, filled by ``encode`` for many chunks at a time."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes | object]]):
        self.encode = encode
        self.now: dict[str, bytes | object] = {}
        self.before: dict[str, bytes | object] = {}
        self.chars = 0

    def lookup(self, keys: list[str]) -> list:
        """The value of every key; those that the table lacks are encoded together."""
        values = list(map(self.now.get, keys))
        at = list(compress(range(len(keys)), map(is_, values, repeat(None))))
        if at:
            lacking = dict.fromkeys([keys[i] for i in at])
            found = {k: v for k in lacking if (v := self.before.get(k)) is not None}
            fresh = [k for k in lacking if k not in found]
            found.update(zip(fresh, self.encode(fresh), strict=True))
            for i in at:
                values[i] = found[keys[i]]
            chars = sum(map(len, found))
            if len(self.now) + len(found) > MAX_CHUNKS or self.chars + chars > MAX_CHARS:
                self.now, self.before, self.chars = {}, self.now, 0
            self.now.update(found)
            self.chars += chars
        return values


def spans(lists: Iterable[list[str]], into: list[str]) -> list[int]:
    """Put the lists one after the other ``into`` a list; where each begins, and the end."""
    edges = [0]
    for x in lists:
        into += x
        edges.append(len(into))
    return edges


class Chunked:
    """Encodes texts by chunks. Texts are cut at every space where that is safe, else by ``recut``."""

    def __init__(self):
        self.by_space = ChunkTable(self._checked)
        self.by_rule = ChunkTable(self.values)

    def _checked(self, keys: list[str]) -> list[bytes | object]:
        good = list(filter(self.alone, keys))
        found = dict(zip(good, self.values(good), strict=True))
        return [found.get(k, SPLIT) for k in keys]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        for run in runs(texts):
            chunks: list[str] = []
            edges = spans(map(self.cut, run), chunks)
            values = self.by_space.lookup(chunks)
            for text, (a, b) in zip(run, pairwise(edges), strict=True):
                try:
                    yield b"".join(values[a:b])
                except TypeError:  # a chunk that cannot stand alone
                    yield b"".join(self.by_rule.lookup(self.recut(text)))

    def cut(self, text: str) -> list[str]:
        return text.split(" ")

    def alone(self, key: str) -> bool:
        """Whether a chunk cut at a space may be encoded by itself."""
        return True

    def recut(self, text: str) -> list[str]:
        raise NotImplementedError

    def values(self, keys: list[str]) -> list[bytes]:
        """Packed ids of chunks."""
        raise NotImplementedError


class WordBpe(Chunked):
    """Lower-case BPE with word ends that drops white space: a text may be cut at every space.

    The vocabulary's pattern goes on to cut a chunk into words, digits and runs of marks, which are
    encoded one by one. For chunks of common letters and marks that cut is made here, so that a word
    is encoded once whatever marks it is met with; every other chunk goes through the whole library.
    """

    # The letters, digits, marks and endings that the vocabulary's pattern knows.
    common = re.compile("[\t\n\r -@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
    no_space = re.compile("[\x1c-\x1f]")  # white space to Python only
    part = re.compile(r"[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+")
    letters = byte_letters()

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.parts = ChunkTable(lambda keys: map(self.word, keys))

    def cut(self, text: str) -> list[str]:
        if "<|" not in text:  # not a special token, which is matched before letters are folded
            try:
                text.encode("latin-1")  # among these characters, lower case and composition commute
                if self.no_space.search(text) is None:
                    return text.lower().split()
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split(" ")

    def word(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.model.tokenize(text)])

    def values(self, keys: list[str]) -> list[bytes]:
        plain = [self.common.fullmatch(k) is not None and "<|" not in k for k in keys]
        parts: list[str] = []
        edges = spans(map(self.part.findall, compress(keys, plain)), parts)
        values = self.parts.lookup(parts)
        own = (b"".join(values[a:b]) for a, b in pairwise(edges))
        rest = iter(self.whole.encode_batch_fast([k for k, p in zip(keys, plain, strict=True) if not p], add_special_tokens=False))
        return [next(own) if p else packed(next(rest).ids) for p in plain]


class PieceBpe(Chunked):
    """SentencePiece model whose pieces hold white-space markers in front only.

    A space becomes the marker, and one marker is put before the text. A chunk is a run of markers
    and what follows up to the next one; its key leaves out the first marker, which the library
    adds again. A key that is empty stands for a lone marker.
    """

    mark = "\u2581"
    rule = re.compile("[ \u2581]*[^ \u2581]+|[ \u2581]+")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        if any(self.mark in p.lstrip(self.mark) for p in pieces):
            raise ValueError("a piece crosses a white-space marker: chunks cannot stand alone")
        self.lone = packed([self.model.piece_to_id(self.mark)])

    def alone(self, key: str) -> bool:
        return bool(key) and key[0] != self.mark and key[-1] != self.mark

    def recut(self, text: str) -> list[str]:
        return [c[1:] for c in self.rule.findall(" " + text)] if text else []

    def values(self, keys: list[str]) -> list[bytes]:
        return [packed(x) if k else self.lone for k, x in zip(keys, self.model.encode(keys), strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.model.decode([x.tolist() for x in ids])


class ByteRanks:
    """Byte-level BPE given as ranks: the ids of the tokenizers library for the same vocabulary."""

    def __init__(self, path: str, end: str = "<|endoftext|>"):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={end: len(ranks)})

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for t in texts:
            yield self.model.encode_to_numpy(t, allowed_special="all")


KINDS = {"byte": ByteRanks, "word": WordBpe, "piece": PieceBpe}


@lru_cache(maxsize=4)
def encoder(kind: str, path: str):
    """One encoder per Python worker, so that its tables serve all of the worker's tasks."""
    return KINDS[kind](path)
