"""Word shingles of whole texts as 64-bit hashes, by numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once, whatever the texts' lengths.
PIECE = 1 << 20
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random number for each byte, A-Z as a-z.
_BYTE = splitmix(_LOWER.astype(U) + U(1 << 20))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes that aren't blanks, A-Z lower-cased."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    places = np.flatnonzero(~_SPACE[data])
    if not len(places):
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = np.empty(len(places), bool)
    first[0] = True
    np.not_equal(places[1:], places[:-1] + 1, out=first[1:])
    return _hash_runs(data[places], first, places)


def _hash_runs(used: np.ndarray, first: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(first)
    sizes = np.diff(starts, append=len(used))
    inside = np.arange(len(used)) - np.repeat(starts, sizes)
    weights = splitmix(np.arange(int(sizes.max()), dtype=U)) | U(1)
    sums = np.add.reduceat(_BYTE[used] * weights[inside], starts)
    return splitmix(sums + sizes.astype(U)), places[starts]


def words_by_text(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, word hashes) of each text, in order; works on pieces of bounded size."""
    at, count = 0, len(offsets) - 1
    while at < count:
        upto = int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1
        if upto <= at:  # one long text: cut it between words
            yield at, _long(data[offsets[at] : offsets[at + 1]])
            at += 1
            continue
        base, stop = int(offsets[at]), int(offsets[upto])
        piece = data[base:stop]
        places = np.flatnonzero(~_SPACE[piece])
        cuts = np.searchsorted(places, offsets[at : upto + 1] - base)
        if len(places):
            first = np.empty(len(places), bool)
            first[0] = True
            np.not_equal(places[1:], places[:-1] + 1, out=first[1:])
            first[cuts[:-1][cuts[:-1] < len(places)]] = True  # a text's first word starts anew
            hashes, starts = _hash_runs(piece[places], first, places)
        else:
            hashes, starts = np.zeros(0, U), np.zeros(0, np.int64)
        bounds = np.searchsorted(starts, offsets[at : upto + 1] - base)
        for i in range(upto - at):
            yield at + i, hashes[bounds[i] : bounds[i + 1]]
        at = upto


def _long(data: np.ndarray) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        while stop < len(data) and not _SPACE[data[stop]]:
            ahead = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
            stop = stop + int(ahead[0]) if len(ahead) else min(stop + PIECE, len(data))
        parts.append(word_hashes(data[at:stop])[0])
        at = stop
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; of all words where there are fewer."""
    count = len(words)
    if not count:
        return words
    size = min(width, count)
    n = count - size + 1
    mixed = np.full(n, U(size))
    for k in range(size):
        mixed = (mixed ^ words[k : k + n]) * U(0x9FB21C651E98DF25) + U(2 * k + 1)
        mixed ^= mixed >> U(29)
    return np.unique(splitmix(mixed))


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a shingle set."""
    import hashlib

    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, shingle set) of each text of a string column."""
    for at, words in words_by_text(*texts_of(column)):
        yield at, shingle_set(words, width)
