"""Anchors: positions that equal windows choose alike.

A window of ``width`` symbols holds width - gram + 1 grams; its anchor is the gram of the
least hash (its upper 32 bits), leftmost on ties. Equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share theirs, so a repeated window always shows as a repeated
anchor gram while there are far fewer anchors than windows.
"""

from __future__ import annotations

import numpy as np

from .minhash import _ODD, mix64


#: Bits of a place among the symbols that are looked at together; a text has less than 2 GB.
PLACE_BITS = 32


def running_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    m, s = v, 1
    while 2 * s <= width:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[: len(v) - width + 1], m[width - s :]) if s < width else m


def window_hash(symbols: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the windows that start ``at`` the given places."""
    total = np.zeros(len(at), np.uint64)
    step = _ODD[1]
    for j in range(width):
        total = (total + symbols[at + j]) * step
    return mix64(total)


def gram_hash(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams; where ``gram`` is a power of two, by doubling."""
    step = int(_ODD[2])
    if gram & (gram - 1) == 0:
        out, s = symbols, 1
        while s < gram:
            out = out[:-s] * np.uint64(pow(step, s, 1 << 64)) + out[s:]
            s *= 2
        return mix64(out)
    n = len(symbols) - gram + 1
    out = np.zeros(n, np.uint64)
    for j in range(gram):
        out = out * np.uint64(step) + symbols[j : n + j]
    return mix64(out)


def anchors(symbols: np.ndarray, lengths: np.ndarray, width: int, gram: int):
    """Anchors of texts that lie one after another in ``symbols`` (uint64).

    Returns the starts of all windows within texts, the index of each one's anchor, and of
    each anchor its place and gram hash. An anchor's windows are neighbours.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < width:
        return none, none, none, np.zeros(0, np.uint64)
    # as many bits of the hash for every text, so equal windows choose alike wherever they stand
    bits = np.uint64(PLACE_BITS)
    hashes = gram_hash(symbols, gram)
    order = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    least = running_min(order, width - gram + 1)
    ends = np.cumsum(lengths)
    valid = np.zeros(len(symbols) + 1, np.int32)
    long = lengths >= width
    valid[(ends - lengths)[long]] += 1
    valid[(ends - width + 1)[long]] -= 1
    at = np.flatnonzero(np.cumsum(valid[: len(least)]) > 0)
    place = (least[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    if not len(at):
        return none, none, none, np.zeros(0, np.uint64)
    new = np.concatenate([[True], place[1:] != place[:-1]])
    own = place[new]
    return at, np.cumsum(new) - 1, own, hashes[own]
