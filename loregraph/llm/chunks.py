"""Token ids of whole columns of text, by way of the different chunks in them.

A chunk is a run of blanks and what follows it up to the next one.  No pretoken of a
byte-level tokenizer reaches over the start of a chunk, and a chunk's pretokens don't depend
on its neighbours, if all white space is of the three kinds blank, tab and line feed.  So a
piece of a column is cut into chunks by numpy, Arrow finds the different ones, each of which
is encoded once, and the ids are gathered by offsets.  Texts with other white space or with a
special token's string are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loregraph.llm.common import return_memory
from loregraph.llm.shingles import texts_of

#: White space that a pretoken may reach over: all but blank, tab and line feed.
OTHER_SPACE = "[\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]"
#: Bytes of text that are cut at once; a longer text is a piece of its own.
PIECE = 4 << 20
#: Strings that are encoded at once: a list of Python's numbers takes many times its ids' room.
STRINGS = 1 << 14
#: Bytes of a chunk that is remembered, at most.
LONGEST = 40
BLANK = np.zeros(256, bool)
BLANK[[0x09, 0x0A, 0x20]] = True


#: Encodes an array of strings: (ids, starts, sizes); string ``i`` has ``ids[starts[i] : starts[i] + sizes[i]]``.
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def by_strings(encode: Callable[[list[str]], list[list[int]]]) -> Encoder:
    """An encoder of arrays from one of lists of strings."""

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), STRINGS):
            found = encode(texts.slice(at, STRINGS).to_pylist())
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.fromiter((i for x in found for i in x), np.uint32, int(sizes[-1].sum())))
        every = np.concatenate(sizes)
        return np.concatenate(ids), np.cumsum(every) - every, every

    return run


class Chunks:
    """Ids of texts by an encoder of strings.

    Short chunks are remembered, at most ``room`` of them: when the room is taken, those that
    were not met again since the last time go.
    """

    def __init__(self, encode: Encoder, specials: list[str], room: int = 400_000):
        self.encode = encode
        self.whole = "|".join([OTHER_SPACE, *map(re.escape, specials)])
        self.room = room
        self.forget()

    def forget(self) -> None:
        self.names = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met = np.zeros(0, bool)

    def ids(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, bounds) of pieces: text ``first + i`` has ``ids[bounds[i] : bounds[i + 1]]``. Null is empty."""
        data, offsets = texts_of(column)
        whole = pc.match_substring_regex(column.cast(pa.large_string()), self.whole).fill_null(False).to_numpy(zero_copy_only=False)
        at, count = 0, len(column)
        while at < count:
            upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
            own = offsets[at : upto + 1] - offsets[at]
            piece = data[offsets[at] : offsets[upto]]
            blank = BLANK[piece]
            starts = blank.copy()
            starts[1:] &= ~blank[:-1]
            for i in np.flatnonzero(whole[at:upto]):
                starts[own[i] : own[i + 1]] = False
            starts[own[:-1][own[:-1] < own[1:]]] = True
            cuts = np.append(np.flatnonzero(starts), len(piece))
            ids, ends = self._gathered(piece, cuts)
            yield at, ids, ends[np.searchsorted(cuts, own)]
            at = upto
            return_memory()  # a piece's arrays are many times its text

    def _gathered(self, piece: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks side by side, where each chunk's ids start and the last ones end)."""
        if len(cuts) == 1:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        buffers = [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(piece))]
        coded = pa.Array.from_buffers(pa.string(), len(cuts) - 1, buffers).dictionary_encode()
        which, names = coded.indices.to_numpy(), coded.dictionary
        at = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy()
        known = at >= 0
        new = names.filter(pa.array(~known))
        found, new_starts, new_sizes = self.encode(new)
        flat = np.concatenate([self.flat, found])
        starts, sizes = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        starts[known], sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        starts[~known], sizes[~known] = new_starts + len(self.flat), new_sizes
        self.met[at[known]] = True
        ids, ends = runs(flat, starts[which], sizes[which])
        self._remember(new, found, new_starts, new_sizes)
        return ids, ends

    def _remember(self, new: pa.Array, found: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(new).to_numpy() <= LONGEST)[: self.room]
        if len(self.names) + len(short) > self.room:
            kept = np.flatnonzero(self.met)[: self.room - len(short)]
            self.names = self.names.take(pa.array(kept))
            self.flat, ends = runs(self.flat, self.starts[kept], self.sizes[kept])
            self.starts, self.sizes = ends[:-1], self.sizes[kept]
            self.met = np.zeros(len(kept), bool)
        own, ends = runs(found, starts[short], sizes[short])
        self.names = pa.concat_arrays([self.names, new.take(pa.array(short))])
        self.starts = np.concatenate([self.starts, ends[:-1] + len(self.flat)])
        self.sizes = np.concatenate([self.sizes, sizes[short]])
        self.flat = np.concatenate([self.flat, own])
        self.met = np.concatenate([self.met, np.zeros(len(short), bool)])


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of ``flat`` side by side, where each starts and the last one ends)."""
    ends = np.append(0, np.cumsum(sizes))
    kind = np.int32 if max(len(flat), ends[-1]) < 1 << 31 else np.int64
    places = np.repeat((starts - ends[:-1]).astype(kind), sizes)
    places += np.arange(ends[-1], dtype=kind)
    return flat[places], ends
