"""Byte-level BPE in Arrow batches, by pieces that can be encoded apart.

The pre-tokenizer of the byte-level vocabulary never lets a token cross from a character into a single
space that a non-space follows: ` ?\\p{L}+` and its relatives take the space with what follows it. A text
may therefore be cut before each such space, encoded piece by piece, and the ids joined. Texts repeat
most of their pieces, so each piece is encoded once per worker and then looked up, by the worker's later tasks
too. That also bounds what the encoder gets at once, but for a text without spaces, which is one piece.
"""

from __future__ import annotations

import gc
import os
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at once.
BATCH_BYTES = 2 << 20
#: Pieces, and characters of pieces, that a worker remembers; the memory is emptied when it is full.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 24_000_000
#: A space before another white space or at the end: the pieces between plain spaces aren't safe there.
UNSAFE = re.compile(r" (?:\s|\Z)")
SAFE_CUT = re.compile(r" (?=\S)")
# The pre-tokenizer's pattern, with its letter and number classes spelled out below U+0250.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9²³¹¼½¾]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+|\s+(?!\S)|\s+")
#: How the vocabulary writes a space.
SPACE = "\u0120"
#: What PARTS doesn't split as the pre-tokenizer does, or what may hold a special token.
OTHER = re.compile(r"[^\x00-\x1b\x20-\u024f]|<\|")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def balanced(batch: pa.RecordBatch, text: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batch of about `limit` bytes in the column `text`; one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    bins = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(bins)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))


def cut(text: str) -> list[str]:
    """Pieces of text: the first as it stands, each other one without the space before it."""
    return SAFE_CUT.split(text) if UNSAFE.search(text) else text.split(" ")


def ids_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def runs(kept: Callable[[list[int]], object], ids: np.ndarray, starts: np.ndarray) -> Iterator[object]:
    """kept of the runs of ids that begin at these places."""
    a, b = starts.tolist(), [*starts[1:].tolist(), len(ids)]
    if kept is len:
        return iter((np.append(starts[1:], len(ids)) - starts).tolist())
    if kept is ids_bytes:
        data = ids.tobytes()
        return (data[4 * x : 4 * y] for x, y in zip(a, b, strict=True))
    every = ids.tolist()
    return (kept(every[x:y]) for x, y in zip(a, b, strict=True))


class PieceEncoder:
    """Looks pieces up in what was encoded before.

    A new piece is put together from its pre-tokens, which are rarer than pieces (`word`, `word,` and `word.` share
    one) and are encoded once each. `kept` makes the stored value of some ids, `joined` that of several values.
    """

    def __init__(self, path: str, kept: Callable[[list[int]], object], joined: Callable[[Iterator], object]):
        gc.set_threshold(1_000_000)  # many small lists are made here, none in a cycle
        self.encoder, self.kept, self.joined = tokenizer(path), kept, joined
        self.inner: dict[str, object] = {}
        self.heads: dict[str, object] = {}
        self.parts: dict[str, object] = {}
        self.chars = 0
        vocabulary = self.encoder.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for x, i in vocabulary.items() if x.startswith(SPACE)]] = True

    def _kept(self, parts: list[str], led: bool) -> Iterator[object]:
        """Values of parts. Those with one space, before a non-space, are encoded as one text and told apart by the tokens that start with a space."""
        for at in range(0, len(parts), 2048):
            some = parts[at : at + 2048]
            if led:
                ids = np.array(self.encoder.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
                cuts = np.flatnonzero(self.starts[ids])
                if len(cuts) == len(some):
                    yield from runs(self.kept, ids, cuts)
                    continue
            yield from (self.kept(x.ids) for x in self.encoder.encode_batch_fast(some, add_special_tokens=False))

    def _words(self, words: list[str]) -> None:
        """Learns pieces of ASCII letters, each of which is one pre-token after its space."""
        self.inner.update(zip(words, self._kept([" " + x for x in words], True), strict=True))
        self.chars += sum(map(len, words))

    def _learn(self, known: dict, pieces: set[str], lead: str) -> None:
        new = pieces.difference(known)
        if lead:
            words = [x for x in new if x.isalpha() and x.isascii()]
            self._words(words)
            new.difference_update(words)
        cuts = [(x, [lead + x] if OTHER.search(x) else PARTS.findall(lead + x)) for x in new]
        parts = set(chain.from_iterable(x for _, x in cuts)).difference(self.parts)
        # Parts that are such a word after a space share its value.
        words = [x for x in parts if x[:1] == " " and x[1:].isalpha() and x.isascii()]
        self._words([x[1:] for x in words if x[1:] not in self.inner])
        self.parts.update([(x, self.inner[x[1:]]) for x in words])
        parts.difference_update(words)
        led = [x for x in parts if x[:1] == " " and not x[1:2].isspace() and x.count(" ") == 1 and len(x) > 1]
        for some in (led, list(parts.difference(led))):
            self.parts.update(zip(some, self._kept(some, some is led), strict=True))
        self.chars += sum(map(len, parts)) + sum(map(len, words)) + sum(len(x) for x, _ in cuts)
        look, joined = self.parts.__getitem__, self.joined
        known.update([(x, look(y[0]) if len(y) == 1 else joined(map(look, y))) for x, y in cuts])

    def values(self, texts: list[str]) -> Iterator[list[object]]:
        """For each text the stored values of its pieces, in order."""
        memories = (self.inner, self.heads, self.parts)
        if self.chars > REMEMBERED_CHARS or sum(map(len, memories)) > REMEMBERED:
            for known in memories:
                known.clear()
            self.chars = 0
        cuts = [cut(x) for x in texts]
        heads = [x.pop(0) for x in cuts]
        self._learn(self.heads, set(heads), "")
        found = list(map(self.inner.get, chain.from_iterable(cuts)))
        if None in found:
            self._learn(self.inner, set(compress(chain.from_iterable(cuts), [x is None for x in found])), " ")
            found = list(map(self.inner.__getitem__, chain.from_iterable(cuts)))
        at = 0
        for head, rest in zip(heads, cuts, strict=True):
            some = found[at : at + len(rest)]
            at += len(rest)
            some.insert(0, self.heads[head])
            yield some


@lru_cache(maxsize=2)
def remembering(path: str, kept: Callable[[list[int]], object], joined: Callable[[Iterator], object]) -> PieceEncoder:
    """The process's encoder of this kind: what one task has learnt, the worker's next one knows."""
    return PieceEncoder(path, kept, joined)
