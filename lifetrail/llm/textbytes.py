"""Vectorised splitting of UTF-8 text held in Arrow buffers.

The functions work on the bytes of a whole batch at once: ``data`` holds
the bytes of all texts one after the other and ``offsets`` (one more
entry than texts) says where each of them starts.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White_Space of Unicode (fixed values).
WHITE_SPACE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Endings that follow an apostrophe as a piece of their own (fixed values).
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
LONG_PIECE = 1024
#: Bytes and pieces that are worked on at a time (they bound the temporary arrays).
PART_BYTES, PART_PIECES = 2 << 20, 1 << 18


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, raw = column.buffers()
    if not len(column) or raw is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(raw, np.uint8, offsets[-1] - offsets[0], offsets[0])
    return data, offsets - offsets[0]


@functools.cache
def char_classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[list(WHITE_SPACE)] = SPACE
    return out


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = char_classes()
    ascii_table = np.full(256, OTHER, np.uint8)
    ascii_table[:128] = table[:128]
    out = ascii_table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        first = data[lead].astype(np.int32)
        width = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        code = first & (0x7F >> width)
        for k in (1, 2, 3):
            has = width > k
            code[has] = code[has] << 6 | (data[lead[has] + k] & 0x3F)
        kind = table[code]
        for k in range(4):
            has = width > k
            out[lead[has] + k] = kind[has]
    return out


def by_parts(offsets: np.ndarray):
    """Ranges of texts (first, behind the last) of at most ``PART_BYTES`` or one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + PART_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def bpe_piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of byte-level BPE pre-tokenisation start.

    A piece is a contraction ending, or a run of letters, of numbers or
    of other characters with one blank before it, or white space (whose
    last character stands alone or goes to the next piece).
    """
    found = [np.zeros(0, np.int64)]
    for i, j in by_parts(offsets):
        a, b = offsets[i], offsets[j]
        found.append(_piece_starts(data[a:b], offsets[i:j + 1] - a) + a)
    return np.concatenate(found)


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    change = text_start[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    inner = change & ~text_start[:n]
    space = kind == SPACE
    starts = change.copy()
    starts[1:] &= ~(inner[1:] & (data[:-1] == 0x20) & ~space[1:])
    last = np.flatnonzero(inner[1:] & ~space[1:] & space[:-1])  # the last byte of white space before something else
    wide = data[last] >= 0x80
    while wide.any():
        last[wide] -= 1
        wide = (data[last] & 0xC0) == 0x80
    starts[last] = True
    quote = np.flatnonzero(starts & (data == 0x27))
    if quote.size:
        text_end = offsets[np.searchsorted(offsets, quote, side="right")]
        for ending in CONTRACTIONS:
            ok = quote + len(ending) < text_end
            for k, c in enumerate(ending):
                at = np.minimum(quote + 1 + k, n - 1)
                ok &= data[at] == c
            found = quote[ok]
            starts[found + 1] = False
            after = found + 1 + len(ending)
            after = after[after < text_end[ok]]
            keep = kind[after] == LETTER
            starts[after[keep]] = True
    return np.flatnonzero(starts)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs of ASCII letters, digits and any characters beyond ASCII."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
    table[128:] = True
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = table[data]
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | text_start[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | text_start[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes that start at each byte, as one integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def piece_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece of text."""
    window = _windows(data)
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), PART_PIECES):
        part = slice(k, k + PART_PIECES)
        out[part] = _keys(data, window, starts[part], ends[part])
    return out


def _keys(data: np.ndarray, window: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    mask = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
    length = ends - starts
    out = mix((window[starts] & mask[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    for i in np.flatnonzero(length > LONG_PIECE):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes())
    more = np.flatnonzero((length > 8) & (length <= LONG_PIECE))
    at, left = starts[more] + 8, length[more] - 8
    while more.size:
        out[more] = mix(out[more] * np.uint64(0x9DDFEA08EB382D69) + (window[at] & mask[np.minimum(left, 8)]))
        on = left > 8
        more, at, left = more[on], at[on] + 8, left[on] - 8
    return out


def _same(data, starts, ends, first, codes) -> bool:
    """Whether all pieces of a number have the same length, first and last eight bytes."""
    window = _windows(data)
    mask = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)

    def look(at):
        a, b = starts[at], ends[at]
        bits = mask[np.minimum(b - a, 8)]
        return b - a, window[a] & bits, window[np.maximum(b - 8, a)] & bits

    for k in range(0, len(codes), PART_PIECES):
        part = slice(k, k + PART_PIECES)
        if not all((x == y).all() for x, y in zip(look(part), look(first[codes[part]]))):
            return False
    return True


def factorise(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number equal pieces alike.

    Returns each piece's number and, by number, the place in ``starts``
    of its first piece.  Pieces of up to 16 bytes are compared exactly;
    should a hash meet two of them, the bytes themselves decide.
    """
    codes, distinct = pd.factorize(piece_keys(data, starts, ends))
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if not _same(data, starts, ends, first, codes):
        codes, distinct = pd.factorize(np.array([data[a:b].tobytes() for a, b in zip(starts, ends)], object))
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return base + np.arange(total)
