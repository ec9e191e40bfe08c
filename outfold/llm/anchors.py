"""Content-chosen sample positions (minimizers) and the runs of windows they stand for.

A *window* is ``width`` consecutive symbols of one document (bytes or words).
Its *anchor* is the position of the smallest hash among its ``gram``-symbol
substrings, the leftmost of equal ones. Equal windows have their anchor at the
same offset, wherever they stand, so windows only need to be compared with
windows whose anchor substring has the same hash (``key``). Neighbouring
windows mostly share their anchor: a *run* is a maximal row of windows of one
document with one anchor. On random text there is about one run in
``(width - gram + 2) / 2`` symbols, which is what goes through a shuffle
instead of every position.

All hashes are polynomial sums modulo 2**64 over symbols that are first mapped
to 64 random-looking bits, computed for a whole batch with a few numpy passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Fixed odd multipliers; their inverses exist modulo 2**64.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
_POSITION_BITS = 21
MAX_SYMBOLS = (1 << _POSITION_BITS) - 1
_cache: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: One random-looking 64-bit value per byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) (or of its inverse) modulo 2**64."""
    have = _cache.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(12, int(n - 1).bit_length())
        out = np.empty(size, dtype=np.uint64)
        out[0], done = 1, 1
        while done < size:
            take = min(done, size - done)
            out[done:done + take] = out[:take] * np.uint64(pow(step, done, 1 << 64))
            done += take
        _cache[(base, inverse)] = have = out
    return have[:n]


class Rolling:
    """Hashes of any substring of ``symbols`` (uint64), after one pass."""

    def __init__(self, symbols: np.ndarray, base: int):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(base, n), out=self.sums[1:])
        self.inverse = powers(base, n + 1, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, size: int) -> np.ndarray:
        """Hash of every substring of ``size`` symbols."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values (two block-wise passes)."""
    n = len(values)
    if width == 1:
        return values
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[:n - width + 1], behind[width - 1:n])


@dataclass
class Runs:
    doc: np.ndarray      # index of the document in the batch
    start: np.ndarray    # first window, counted from the start of its document
    windows: np.ndarray  # how many windows
    key: np.ndarray      # hash of the anchor's substring
    content: np.ndarray  # hash of all symbols of the run and the anchor's place in it
    anchor: np.ndarray   # the anchor, counted from the start of the document


def find_runs(symbols: np.ndarray, ends: np.ndarray, width: int, gram: int) -> Runs | None:
    """Runs of a batch of documents laid end to end; ``ends`` are their ends in
    ``symbols``. At most MAX_SYMBOLS symbols (longer ones: see ``pieces``)."""
    n = len(symbols)
    if n < width:
        return None
    if n > MAX_SYMBOLS:
        raise ValueError(f"a batch has at most {MAX_SYMBOLS} symbols")
    starts = np.concatenate([[0], ends[:-1]])
    room = ends - starts - width + 1  # windows of each document
    docs = np.flatnonzero(room > 0)
    if not len(docs):
        return None
    roll = Rolling(symbols, BASE_A)
    grams = roll.all_of(gram)
    position = np.uint64(MAX_SYMBOLS)
    order = (grams & ~position) | np.arange(len(grams), dtype=np.uint64)
    first = sliding_min(order, width - gram + 1)
    doc_of = np.repeat(docs, room[docs])
    within = np.arange(len(doc_of)) - np.repeat(np.cumsum(room[docs]) - room[docs], room[docs])
    at = starts[doc_of] + within
    anchor = (first[at] & position).astype(np.int64)
    new = np.empty(len(at), dtype=bool)
    new[0] = True
    # an anchor belongs to one document, so it also changes between documents
    np.not_equal(anchor[1:], anchor[:-1], out=new[1:])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(at)))
    lo, place = at[head], anchor[head]
    other = Rolling(symbols, BASE_B)
    offset = (place - lo).astype(np.uint64)
    content = mix(other.of(lo, lo + count - 1 + width) + offset * np.uint64(BASE_A))
    doc = doc_of[head]
    return Runs(doc, within[head], count, grams[place], content, place - starts[doc])


def pieces(n: int, width: int, limit: int) -> list[tuple[int, int]]:
    """Cut a document of ``n`` symbols into pieces of at most ``limit`` symbols
    that overlap by ``width - 1``, so that every window lies in exactly one."""
    step = limit - width + 1
    return [(lo, min(n, lo + limit)) for lo in range(0, max(1, n - width + 1), step)]


def union_of(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open intervals (touching ones join)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] > e[:-1]
    head = np.flatnonzero(new)
    return s[head], e[np.append(head[1:], len(s)) - 1]
