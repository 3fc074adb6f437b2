"""Vectorised views of text columns inside a task: byte buffers, word spans, rolling hashes.

Everything works on one Arrow batch at a time as flat arrays, so a very long text costs its own
bytes and nothing is done per character in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def slices(
    batch: pa.RecordBatch, *columns: str, limit: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts have about ``limit`` bytes together; one row at least."""
    lengths = sum(
        np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), np.int64) for c in columns
    )
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each begins (one more for the end)."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    flat = pa.concat_arrays([filled])
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0])


def is_space(raw: np.ndarray) -> np.ndarray:
    return _IS_SPACE[raw]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def spans(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and text number of every run of bytes without a break byte."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~breaks[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    begins[firsts] = inside[firsts]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    lasts = offsets[1:][offsets[1:] > 0] - 1
    stops[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    return spans(raw, offsets, _IS_SPACE)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a public finaliser of xor-shifts and products)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes have equal hashes. Eight bytes a step."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at, left, rows = start, end - start, None
    while len(at):
        low = _LOW_BYTES[np.minimum(left, 8)]
        value = (words[at] & low) * np.uint64(0x9E3779B97F4A7C15)
        if rows is None:
            out = mix(out ^ value)
        else:
            out[rows] = mix(out[rows] ^ value)
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Like ``range_hashes``, with other values: all words of all ranges at once, then sums.

    Faster where a few ranges are very long, as those need no step for each of their words.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    words = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    blocks = np.maximum(-(-(end - start) // 8), 1)
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + number * 8
    low = _LOW_BYTES[np.minimum(np.repeat(end, blocks) - at, 8)]
    place = mix((number + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.add.reduceat(mix((words[at] & low) ^ place), first)
    return mix(sums + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(
    hashes: np.ndarray, owner: np.ndarray, owners: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive items of one owner, and their owner.

    An owner with fewer items, but one at least, gets its whole sequence as one shingle.
    """
    counts = np.bincount(owner, minlength=owners)
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    left = (first + counts)[owner] - np.arange(n)  # items from here to the owner's end
    short = counts < size
    takes = (left >= size) | (short[owner] & (left == counts[owner]))
    for k in range(size):
        here = takes & (left > k)
        at = np.flatnonzero(here)
        out[at] = mix(out[at] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at + k] + np.uint64(k + 1))
    return out[takes], owner[takes]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every range, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total) + shift


def order_of(values: np.ndarray) -> np.ndarray:
    """Stable order of unsigned 64-bit values, several times as fast as ``argsort`` on hashes.

    High bits and places are sorted as one number; the few values that differ in low bits only
    are put right afterwards.
    """
    low = np.uint64(max(1, len(values).bit_length()))
    places = np.arange(len(values), dtype=np.uint64)
    order = (np.sort(values >> low << low | places) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    high = values[order]
    wrong = np.flatnonzero(high[1:] < high[:-1])
    if len(wrong) > 1000:  # no hashes
        return np.argsort(values, kind="stable")
    high >>= low
    for k in wrong:
        start, stop = np.searchsorted(high, high[k]), np.searchsorted(high, high[k], "right")
        part = order[start:stop]
        order[start:stop] = part[np.argsort(values[part], kind="stable")]
    return order
