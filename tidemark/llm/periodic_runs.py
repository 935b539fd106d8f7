"""Runs of repeated words, caught by dyadic square catching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least
max(LEAST, TIMES * q) words long, that no neighbouring word extends.

1. Level k has a catcher for each completed block of B = 2**k words. It holds the name of its block;
   equal blocks have equal names (a level's names are made of pairs of the names below).
2. An appended word advances the catcher B to 2B - 1 words before it by one comparison: the B words it
   begins against the caught block. A period of B to 2B - 1 words is caught at this level and at no
   other. The comparisons of a level are one array operation for all appended words of all texts of a
   batch; words that stand between two texts are equal to nothing.
3. Two neighbouring catchers that meet their blocks again at one distance d have caught a square of
   period d (2B + d words with period d). Every run contains such a pair, since it holds 4q >= 4B words.
4. Squares of one period from neighbouring catchers merge into one stretch, whose ends are moved by
   comparing words to the left and to the right. Squares inside a run of a smaller period, which are
   multiples of it, are not followed.

Words are numbered within a batch, so comparisons are exact; names only select. A text takes
O(n log n) array steps and nothing is shuffled.

Defined results: null and empty texts have no words and no runs; the digests are then those of the
empty string. Rows are judged one by one, so repeated rows agree. A null id is never rewritten by
`rewritten`. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, record, ships

LEAST, TIMES = 6, 4
BATCH_WORDS = 1 << 17
MIXERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
RUNS = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def reaches(codes: np.ndarray, at: int, d: int, step: int) -> int:
    """Last place from `at` on, going by step (1 or -1), up to which all words equal those d places later."""
    width, end = 16, len(codes) - d if step > 0 else -1
    while at != end:
        lo, hi = (at, min(end, at + width)) if step > 0 else (max(0, at - width + 1), at + 1)
        differ = np.flatnonzero(codes[lo:hi] != codes[lo + d : hi + d])
        if len(differ):
            return int(lo + differ[0]) if step > 0 else int(lo + differ[-1])
        at, width = (hi, 2 * width) if step > 0 else (lo - 1, 2 * width)
    return at


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of the blocks of 2 * size words at each place, from those of size words."""
    both = names[:-size] * MIXERS[0] + (names[size:] ^ MIXERS[1])
    both ^= both >> np.uint64(31)
    return both * MIXERS[2]


def caught(codes: np.ndarray, ends: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, period) of each run in codes. ends: falling text lengths and where the text ends, in the order of codes."""
    longest = ends[0][0] if ends else 0
    pad = max(4, longest)
    codes = np.concatenate([codes, np.arange(-(1 << 40) - pad, -(1 << 40))])
    names = codes.astype(np.uint64) * MIXERS[2]
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(len(codes), np.int64)  # the furthest end of the runs that start here or before
    size = 1
    while TIMES * size <= longest:
        used = max((end for n, end in ends if n >= TIMES * size), default=0)  # shorter texts have no such period
        names = names[: used + pad]
        rows = len(names) // size
        blocks = names[: rows * size].reshape(rows, size)
        again = blocks[1:] == blocks[:-1, :1]
        j, t = np.nonzero(again[:-1] & again[1:])
        at, d = j * size, t + size
        fresh = reach[at] < at + 2 * size + d
        order = np.lexsort((at[fresh], d[fresh]))
        at, d = at[fresh][order], d[fresh][order]
        breaks = np.flatnonzero((np.diff(d) != 0) | (np.diff(at) != size)) + 1
        for lo, hi in zip([0, *breaks], [*breaks, len(d)]):
            if lo == hi:
                continue
            period, first, last = int(d[lo]), int(at[lo]), int(at[hi - 1]) + 2 * size
            cuts = [(first, last)] if np.array_equal(codes[first:last], codes[first + period : last + period]) else [(int(a), int(a) + 2 * size) for a in at[lo:hi]]
            for a, b in cuts:
                if np.array_equal(codes[a:b], codes[a + period : b + period]):  # else two blocks share a name by chance
                    start, end = reaches(codes, a - 1, period, -1) + 1, reaches(codes, b, period, 1) + period
                    if end - start >= max(LEAST, TIMES * period):
                        found.setdefault((start, end), period)
        if found:
            reach[:] = 0
            for start, end in found:
                reach[start] = max(reach[start], end)
            reach = np.maximum.accumulate(reach)
        if TIMES * 2 * size <= longest:
            names = doubled(names, size)
        size *= 2
    return [(start, end, period) for (start, end), period in found.items()]


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start, then period."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    parts, ends, starts, at = [], [], [], 0
    for mark, k in enumerate(order, 1):
        n = len(texts[k])
        parts += [np.fromiter(map(ids.__getitem__, texts[k]), np.int64, n), np.array([-mark])]
        starts.append(at)
        ends.append((n, at + n))
        at += n + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = caught(np.concatenate(parts), ends) if parts else []
    for place, (start, end, period) in zip(np.searchsorted(starts, [f[0] for f in found], "right") - 1, found):
        out[order[place]].append((start - starts[place], end - start, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(depth).tolist()) if not n]


def rewritten(doc: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by their id's checksum, with a period planted from some word on."""
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(doc: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of RUNS."""
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(collapsed(words, runs))
    return doc, len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _by_text(docs: DataFrame, id_col: str, text_col: str, schema: str, planted: bool, rows_of) -> DataFrame:
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held, size = [], [], 0, batch.num_rows
            for k, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                words = (text.as_py() or b"").split()  # bytes are split at \x20 and \x09 to \x0D only
                ids.append(doc)
                texts.append(rewritten(doc, words) if planted else words)
                held += len(words)
                if held >= BATCH_WORDS or k == size - 1:
                    yield record([row for doc, words, runs in zip(ids, texts, runs_of(texts)) for row in rows_of(doc, words, runs)], schema)
                    ids, texts, held = [], [], 0

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, start, length, period: one row per run."""
    return _by_text(docs, id_col, text_col, "doc_id bigint, start bigint, length bigint, period bigint", False, lambda doc, words, runs: [(doc, *r) for r in runs])


def collapsed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text: each text with its runs cut to their first period; words joined by one blank."""
    return _by_text(docs, id_col, text_col, "doc_id bigint, text string", False, lambda doc, words, runs: [(doc, b" ".join(collapsed(words, runs)).decode())]).withColumnRenamed("text", text_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document in the columns of RUNS, of its text with planted periods (`rewritten`)."""
    return _by_text(docs, id_col, text_col, RUNS, True, lambda doc, words, runs: [digests(doc, words, runs)])


ships(__name__)
