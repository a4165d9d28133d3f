"""Hashed features of texts, computed for a whole Arrow batch at once on its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(42)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SECOND, _MIX, _REPEAT, _AGAIN = (np.uint64(int(x) | 1) for x in _RNG.integers(1, 1 << 63, 4, dtype=np.uint64))

SPACE, WORD, SIGN = 0, 1, 2
_CLASS = np.full(256, SIGN, dtype=np.uint8)
_CLASS[0x80:] = WORD
_CLASS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = WORD
_CLASS[: 0x21] = SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX
    return h ^ (h >> np.uint64(32))


def tokens(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first byte of every token: a run of letters and digits (all non-ASCII bytes count as
    letters) or a run of other signs. Tokens end at white space and at the end of a row."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    kind = _CLASS[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), 63)
    h = np.add.reduceat(_BYTE[data] * _POWER[place], starts)
    real = kind[starts] != SPACE
    starts = starts[real]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return _spread(h[real]), rows, starts


def word_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of the 1- and 2-grams of tokens; a token that repeats its predecessor is one shared
    2-gram, whatever the token, and so is one that repeats the last but one."""
    h, rows, _ = tokens(data, offsets, lower)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = rows[1:] == rows[:-1]
    pair = _spread(h[:-1] * _SECOND + h[1:])
    pair = np.where(h[1:] == h[:-1], _REPEAT, pair)[same]
    again = np.flatnonzero((h[2:] == h[:-2]) & (h[2:] != h[1:-1]) & (rows[2:] == rows[:-2])) + 2
    features = np.concatenate([h, pair, np.full(len(again), _AGAIN)]) >> np.uint64(64 - bits)
    return features.astype(np.int64), np.concatenate([rows, rows[1:][same], rows[again]])


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, bits: int, orders: tuple[int, ...] = (1, 2, 3, 4),
                ) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of n-grams of bytes of lower-cased letters; anything else is one word end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letters = _LETTER[data]
    blank = letters == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # of several blanks the first stays
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    letters, row_of = letters[keep].astype(np.uint64), row_of[keep]
    found, rows = [], []
    for n in orders:
        if len(letters) < n:
            continue
        code = np.full(len(letters) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + letters[k: len(letters) - n + 1 + k]
        inside = row_of[n - 1:] == row_of[: len(row_of) - n + 1]
        found.append((_spread(code * _SECOND) >> np.uint64(64 - bits))[inside])
        rows.append(row_of[n - 1:][inside])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows)


def word_heads(data: np.ndarray, offsets: np.ndarray, bits: int, sizes: tuple[int, ...] = (4, 5, 6, 7),
               ) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of lower-cased tokens and of their first bytes, so that inflected forms share features."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = _LOWER[data]
    h, rows, starts = tokens(data, offsets)
    ends = np.append(starts[1:], len(data))
    parts, owners = [h], [rows]
    padded = np.append(data, np.zeros(max(sizes), np.uint8)).astype(np.uint64)
    for n in sizes:
        inside = (starts + n <= ends) & np.all(
            np.stack([_CLASS[padded[starts + k].astype(np.uint8)] == WORD for k in range(n)]), axis=0)
        at = starts[inside]
        code = np.full(len(at), n, dtype=np.uint64)
        for k in range(n):
            code = code * np.uint64(257) + padded[at + k]
        parts.append(_spread(code * _SECOND))
        owners.append(rows[inside])
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owners)


def counted(features: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count), sorted by row and feature."""
    both, counts = np.unique((rows.astype(np.int64) << bits) | features, return_counts=True)
    return both >> bits, both & ((1 << bits) - 1), counts
