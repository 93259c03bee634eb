"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary's split pattern never joins characters across the place where a
non-space character is followed by white space. A text is cut there, and the
tokenizers library encodes each distinct chunk once; chunks are remembered in a
table of bounded size. A text that holds an added token of the vocabulary is one
chunk. The ids are those of the whole text by the library's defaults, without
special tokens of its own.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from terraflow.llm.common import cache, enter, offsets_of

END_ID = 0
#: Python counts these as white space, the split pattern does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
_CHUNK = re.compile(r"\s*\S+|\s+")
_WIDE_GAP = re.compile(r"\s\s")


class _Slots(dict):
    """Slot of each chunk met so far; ``chunk_of`` makes the chunk from its name."""

    def __init__(self, owner: ChunkEncoder, chunk_of: Callable[[str], str]):
        super().__init__()
        self.owner, self.chunk_of = owner, chunk_of

    def __missing__(self, name: str) -> int:
        self.owner.fresh.append(self.chunk_of(name))
        slot = self[name] = self.owner.known + len(self.owner.fresh)
        return slot


def _behind_blank(piece: str) -> str:
    return piece if piece[:1] == "\n" else " " + piece


class ChunkEncoder:
    """Ids of texts, each followed by the end id. Slot 0 of the table is the end."""

    def __init__(self, path: str, chunks: int = 600_000, ids: int = 6_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = (*_ODD, *added)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token)  # one character of the vocabulary stands for one byte
        self.limits = chunks, ids
        self._reset()

    def _reset(self) -> None:
        self.fresh: list[str] = []
        self.alone: set[str] = set()
        self.chunks, self.pieces = _Slots(self, str), _Slots(self, _behind_blank)
        self.known, self.used = 0, 1  # chunks and ids in the table; arrays are longer
        self.flat = np.full(1 << 16, END_ID, np.uint32)
        self.start, self.size = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def _slots_of(self, text: str) -> list[int]:
        """Slots of a text's chunks.

        Where no white space follows white space, the chunks are the pieces between
        blanks and line ends, which is quicker to cut than by expression.
        """
        if any(x in text for x in self.whole):
            self.alone.add(text)
            return [self.chunks[text]]
        if _WIDE_GAP.search(text):
            return list(map(self.chunks.__getitem__, _CHUNK.findall(text)))
        first, *pieces = text.replace("\n", " \n").split(" ")
        return [*([self.chunks[first]] if first else ()), *map(self.pieces.__getitem__, pieces)]

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for k in range(0, len(texts), 256):  # what the library returns is large
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts[k : k + 256], add_special_tokens=False)]
        return out

    def _learn(self) -> None:
        """Adds the fresh chunks to the table."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return
        # Chunks that begin with white space and end without it can stand in one text.
        bound = np.array([c[0].isspace() and not c[-1].isspace() and c not in self.alone for c in fresh])
        order = np.argsort(bound, kind="stable")
        chunks, lone = [fresh[i] for i in order.tolist()], len(fresh) - int(bound.sum())
        ids = self._ids_of(chunks[:lone])
        joined = np.concatenate([np.empty(0, np.uint32), *self._ids_of(["".join(chunks[k : k + 64]) for k in range(lone, len(chunks), 64)])])
        # Ids of each joined chunk, found by the bytes that each id stands for.
        ends = np.cumsum([len(c.encode()) for c in chunks[lone:]])
        stops = np.searchsorted(np.cumsum(self.width[joined]), ends) + 1
        size = np.concatenate([np.array([len(i) for i in ids], np.int64), np.diff(stops, prepend=0)])
        flat = np.concatenate([*ids, joined])
        first, last = self.known + 1, self.known + len(fresh) + 1
        self.flat = _grown(self.flat, self.used + len(flat))
        self.start, self.size = _grown(self.start, last), _grown(self.size, last)
        self.flat[self.used : self.used + len(flat)] = flat
        self.start[first + order], self.size[first + order] = self.used + offsets_of(size)[:-1], size
        self.known, self.used = last - 1, self.used + len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text starts (one entry more than texts)."""
        if self.known > self.limits[0] or self.used > self.limits[1]:
            self._reset()
        slots, counts = [], []
        for text in texts:
            found = self._slots_of(text) if text else []
            slots += found
            slots.append(0)
            counts.append(len(found) + 1)
        self._learn()
        slot = np.array(slots, np.int64)
        size = self.size[slot]
        ends = offsets_of(size)
        at = np.repeat(self.start[slot] - ends[:-1], size)
        at += np.arange(len(at))
        return self.flat[at], ends[offsets_of(np.array(counts, np.int64))]


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one twice as long until ``size`` fits."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


cache(_encoder.cache_clear, task=False)


def encoder(path: str) -> ChunkEncoder:
    """One encoder per vocabulary and worker process; other operators' caches make room for it."""
    enter("encoder")
    return _encoder(path)
