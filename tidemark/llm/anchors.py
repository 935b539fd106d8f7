"""Segments of a text by anchors: how strings of one length are named so that equal ones meet.

The anchor of a string is the gram inside it whose hash is least, of equals the last, so equal strings
have equal anchors. A segment is a run of string starts that share an anchor.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from tidemark.llm.common import ships

ships(__name__)

BLOCK, CHUNK = 1 << 17, 1 << 20
LOW = (1 << 24) - 1
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the run of `gram` values that starts at each position."""
    done, length, power = None, 0, 1
    now = values
    while True:
        if gram & power:
            if done is None:
                done, length = now, power
            else:
                n = len(values) - length - power + 1
                done = done[:n] * np.uint64(pow(BASE, power, 1 << 64)) + now[length : length + n]
                length += power
        if length == gram:
            break
        n = len(now) - power
        now = now[:n] * np.uint64(pow(BASE, power, 1 << 64)) + now[power : power + n]
        power *= 2
    done = done ^ (done >> np.uint64(32))
    done *= np.uint64(0xD6E8FEB86659FD93)
    done ^= done >> np.uint64(29)
    return done


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    step, now = 1, values
    while 2 * step <= width:
        now = np.minimum(now[: len(now) - step], now[step:])
        step *= 2
    rest = width - step
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def anchors(values: np.ndarray, firsts: np.ndarray, counts: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of the starts firsts[k] .. firsts[k]+counts[k]-1: first start, number of starts, anchor less first start, anchor's hash."""
    h = gram_hashes(values, gram)
    marked = (h & np.uint64(MASK ^ LOW)) | (np.uint64(LOW) - np.arange(len(h), dtype=np.uint64))
    at = LOW - (least_of(marked, length - gram + 1) & np.uint64(LOW)).astype(np.int64)
    flag = np.zeros(len(at) + 1, bool)
    flag[1:-1] = at[1:] != at[:-1]
    flag[firsts] = flag[firsts + counts] = True
    live = np.zeros(len(at) + 1, np.int8)
    np.add.at(live, firsts, 1)
    np.add.at(live, firsts + counts, -1)
    cuts = np.flatnonzero(flag)
    keep = np.cumsum(live)[cuts[:-1]] > 0
    first, count = cuts[:-1][keep], np.diff(cuts)[keep]
    return first, count, at[first] - first, h[at[first]]


def segments(texts: Iterable[np.ndarray], length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """The segments of each text, in order; a text is an array of 64-bit values of its elements."""
    found: list[list] = []
    held: list[tuple[int, int, int, np.ndarray]] = []

    def run() -> None:
        sizes = np.array([len(p[3]) for p in held])
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        first, count, off, key = anchors(np.concatenate([p[3] for p in held]), firsts, np.array([p[2] for p in held]), length, gram)
        owner = np.searchsorted(firsts, first, side="right") - 1
        edge = np.searchsorted(owner, np.arange(len(held) + 1))
        for k, (doc, base, _, _) in enumerate(held):
            s = slice(edge[k], edge[k + 1])
            found[doc].append((first[s] - firsts[k] + base, count[s], off[s], key[s]))
        held.clear()

    size = 0
    for doc, text in enumerate(texts):
        found.append([])
        for base in range(0, len(text) - length + 1, CHUNK):
            starts = min(CHUNK, len(text) - length + 1 - base)
            held.append((doc, base, starts, text[base : base + starts + length - 1]))
            size += starts + length
            if size >= BLOCK:
                run()
                size = 0
    if held:
        run()
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return [tuple(np.concatenate(c) for c in zip(*parts)) if parts else none for parts in found]


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(parts) if parts else [], kind))


def packed_cuts(found: tuple[np.ndarray, ...]) -> np.ndarray:
    """start, count and off of each segment in one number; segments hold under 1024 starts."""
    first, count, off, _ = found
    return first << 20 | count << 10 | off


def unpacked(cut: int) -> tuple[int, int, int]:
    return cut >> 20, cut >> 10 & 1023, cut & 1023


SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True


def word_values(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit value of each word between ASCII whitespace."""
    data = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], SPACE[data], [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    table = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
    table[SPACE] = 0
    powers = np.full(len(data), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    back = np.full(len(data), pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    values = np.add.reduceat(table[data] * powers, starts) * np.cumprod(back)[starts]
    values ^= values >> np.uint64(32)
    return starts, ends, values * np.uint64(0xD6E8FEB86659FD93)
