"""Vectorised byte and word kernels shared by the text operators.

Every kernel works on one *slice* of an Arrow string column: a ``uint8`` array holding the
UTF-8 bytes of several documents back to back, and ``offsets`` (one more than there are
documents).  ``slices`` cuts a column of any size into slices of about ``SLICE_BYTES``, never
inside a document, so that the working arrays stay small however long the batch is.

Hashes of bytes fold eight bytes at a time, and those of runs of words a word at a time, through a
step that cannot be undone (``fold``); only the contexts of repeats.py are hashed as polynomials of
such hashes.  Hashes select candidates and name words; what must be exact is compared byte for byte
(``same_spans``, ``exact_ids``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

SLICE_BYTES = 1 << 20
SLICE_DOCS = 4096

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A second base, for hashes that are independent of the first.
OTHER = np.uint64(0xD6E8FEB86659FD93)
OTHER_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Whitespace bytes of the contract's class [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=np.uint64)
        out[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            step = base
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * step
                step = step * step
                done += take
        _powers[int(base)] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def fold(state: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``state`` with ``x`` folded in; as ``x`` also goes around the avalanche, no ``x`` can be worked out that leads to a wanted state."""
    return mix(state ^ x) ^ x


def text_arrays(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    off = off[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(data: np.ndarray, off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last document + 1, bytes, offsets) for runs of at most SLICE_DOCS documents of about ``size`` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + size, "right")) - 1
        j = min(n, max(j, i + 1), i + SLICE_DOCS)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one little-endian number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


#: The lowest 0 to 8 bytes of a lane.
_LOWEST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)

#: Bytes of a span that are taken in lanes of eight; what is behind them goes through xxh3 as a whole.
NEAR = 64


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends).

    Each eight bytes are folded in, so there is no algebra by which the hash of one text could be
    carried over to another; bytes beyond the first NEAR count by their xxh3.
    """
    lanes, size = _lanes(data), ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * BASE + np.uint64(seed))
    live = np.arange(len(starts))
    for k in range(0, NEAR, 8):
        left = size[live] - k
        if len(left) and left.min() <= 0:
            live, left = live[left > 0], left[left > 0]
        if len(live) == 0:
            break
        out[live] = fold(out[live], lanes[starts[live] + k] & _LOWEST[np.minimum(left, 8)])
    far = np.flatnonzero(size > NEAR)
    if len(far):
        raw = memoryview(np.ascontiguousarray(data))
        rest = [xxh3_64_intdigest(raw[a:b], seed) for a, b in zip((starts[far] + NEAR).tolist(), ends[far].tolist(), strict=True)]
        out[far] = fold(out[far], np.array(rest, dtype=np.uint64))
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Is the i-th span of ``data`` equal, byte for byte, to the i-th span of ``other``?"""
    size = ends - starts
    same = size == stops - begins
    a, b = _lanes(data), _lanes(other)
    live = np.flatnonzero(same)
    for k in range(0, NEAR, 8):
        live = live[size[live] > k]
        if len(live) == 0:
            break
        differ = ((a[starts[live] + k] ^ b[begins[live] + k]) & _LOWEST[np.minimum(size[live] - k, 8)]) != 0
        same[live[differ]] = False
        live = live[~differ]
    x, y = memoryview(np.ascontiguousarray(data)), memoryview(np.ascontiguousarray(other))
    for i in live[size[live] > NEAR].tolist():
        same[i] = x[starts[i] + NEAR : ends[i]] == y[begins[i] + NEAR : stops[i]]
    return same


def exact_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each span, the same for spans with the same bytes and no others; and a span of each number.

    Hashes propose which spans are equal, bytes decide.
    """
    _, first, back = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(data, starts, ends, data, starts[first][back], ends[first][back]))
    if len(odd):  # spans that share a hash with others: numbered by their bytes
        raw, own, more = data.tobytes(), {}, []
        for i in odd.tolist():
            text = raw[starts[i] : ends[i]]
            if text not in own:
                own[text] = len(first) + len(more)
                more.append(i)
            back[i] = own[text]
        first = np.concatenate([first, np.array(more, dtype=first.dtype)])
    return back, first


def prefix_hash(hashes: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """P with P[j] - P[i] a polynomial hash of elements i..j-1, still scaled by base**i; for elements that are hashes, not for bytes."""
    out = np.zeros(len(hashes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((hashes + np.uint64(1)) * powers(base, len(hashes)), out=out[1:])
    return out


def prefix_span(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: np.uint64 = INVERSE) -> np.ndarray:
    """Position-independent hashes of the runs of elements [starts, ends)."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * powers(inverse, len(prefix))[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document plus the total) of words [^\\x20\\x09-\\x0D]+."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    gap = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:n]
    stop = ~gap
    stop[:-1] &= gap[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def run_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive word hashes (runs over document borders included)."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    m = len(words) - n + 1
    out = np.full(m, BASE)
    for i in range(n):
        out = fold(out, words[i : i + m])
    return mix(out)


def inside(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """For each of the ``total`` word positions: does a run of ``n`` words starting there stay in its document?"""
    ok = np.ones(total, dtype=bool)
    ok[max(0, total - n + 1) :] = False
    for back in range(1, n):
        at = first[1:-1] - back
        ok[at[at >= 0]] = False
    return ok


def owner(first: np.ndarray) -> np.ndarray:
    """Document of each word, from ``word_spans``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost smallest value in each window of ``width`` values, in O(n).

    The values are cut into blocks of ``width``; a window is the end of one block and the
    beginning of the next, so its minimum is the smaller of two running minima.
    """
    n = len(values)
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    blocks = -(-n // width)
    size = blocks * width
    flat = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    flat[:n] = values
    grid, index = flat.reshape(blocks, width), np.arange(size).reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1)
    last = np.maximum.accumulate(np.where(grid == ahead, index, 0), axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    new = np.ones(grid.shape, dtype=bool)
    new[:, :-1] = grid[:, :-1] < back[:, 1:]
    first = np.where(new, index, size)
    first = np.minimum.accumulate(first[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = first[:m], last[width - 1 : width - 1 + m]
    return np.where(flat[right] <= flat[left], right, left)


#: Windows of up to so many values are searched by comparing neighbours.
NARROW = 12


def window_minima(values: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the rightmost smallest value of some window of ``width`` values inside a document.

    ``off`` cuts ``values`` into documents.  Most windows hold a value below a threshold that
    about eight values in a window pass.  Among these few, a position qualifies when the stretch
    around it, without a smaller value to the left or one as small to the right, is at least
    ``width`` long.  Stretches without such a value are searched in full.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    if width <= NARROW:
        return _narrow_minima(values, off, width)
    few = np.flatnonzero(values < np.uint64(min(8 * (1 << 64) // width, (1 << 64) - 1)))
    doc = np.searchsorted(off, few, "right")
    low, high, v = off[doc - 1] - 1, off[doc], values[few]
    low, high = np.maximum(low, few - width), np.minimum(high, few + width)
    left, right = low.copy(), high.copy()
    for side, bound, sign in ((left, low, -1), (right, high, 1)):
        live, r = np.arange(len(few)), 1
        while len(live):
            at = live + sign * r
            live = live[(at >= 0) & (at < len(few))]
            at = live + sign * r
            near = few[at] > bound[live] if sign < 0 else few[at] < bound[live]
            live, at = live[near], at[near]
            hit = v[at] < v[live] if sign < 0 else v[at] <= v[live]
            side[live[hit]] = few[at[hit]]
            live, r = live[~hit], r + 1
    found = [few[right - left > width]]
    # what bounds a stretch: a small value, before it also the place ahead of its document, behind it the document's end
    before, behind = np.sort(np.concatenate([few, off[:-1] - 1])), np.sort(np.concatenate([few, off[1:]]))
    for i in np.flatnonzero(behind - before > width):
        x, y = int(before[i]) + 1, int(behind[i])
        found.append(np.unique(window_argmin(values[x:y], width)) + x)
    return found[0] if len(found) == 1 else np.sort(np.concatenate(found))


def _narrow_minima(values: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
    """``window_minima`` for narrow windows: each value against its neighbours, one distance after another."""
    n, size = len(values), np.diff(off)
    place = np.arange(n) - np.repeat(off[:-1], size)
    before = np.minimum(place, width).astype(np.int8)  # values on either side in the same document
    after = np.minimum(np.repeat(size, size) - 1 - place, width).astype(np.int8)
    reach = np.ones(n, dtype=np.int8)
    for room, forward in ((before, False), (after, True)):
        ok = np.ones(n, dtype=bool)
        for k in range(1, width):
            ok &= room >= k
            if forward:
                ok[: n - k] &= values[k:] > values[: n - k]
            else:
                ok[k:] &= values[: n - k] >= values[k:]
            reach += ok
    return np.flatnonzero(reach >= width)


def rejoin(parts: list[np.ndarray], dtype=np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=dtype)
