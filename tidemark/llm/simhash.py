"""SimHash near-duplicates found by bit-sliced comparison.

Fingerprints are grouped by value first, so copies cost nothing later. Two fingerprints within three
bits agree on two of five bit blocks; each of the ten pairs of blocks deals the fingerprints into
buckets. A bucket that is too large is dealt again by a quarter of the bits that are still free, which
loses no pair and ends after four rounds. Within a bucket the bits stand as planes, 64 fingerprints to
a word; carry-save counters add the differing planes for a word at once, and a word is abandoned when
all its fingerprints are past the radius. A bucket yields a spanning forest, never its pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other. Repeated
rows are copies. A null id is never a component's id unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, ships, written
from tidemark.llm.components import components

ships(__name__)

BITS, RADIUS = 64, 3
BUCKET_ROWS = 8192
SLICE = 1 << 14


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the hashes of all shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(width, len(words))
    cuts = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in cuts], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints, "id bigint, fp bigint")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks() -> list[int]:
    """The ten pairs of five bit blocks."""
    edges = [0, 13, 26, 39, 52, 64]
    blocks = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(5)]
    return [blocks[i] | blocks[j] for i in range(5) for j in range(i + 1, 5)]


def finer_masks(mask: int) -> list[int]:
    """mask with one of four parts of the free bits: three differences leave one part untouched."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::4]) for k in range(RADIUS + 1)]


def near_pairs(prints: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j < ends[i] within the radius. Row i is compared with whole words of 64 rows."""
    n = len(prints)
    words = -(-n // 64)
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(np.concatenate([bits, np.zeros((words * 64 - n, BITS), np.uint8)]).T, axis=1, bitorder="little").copy().view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    first = np.arange(n) + 1
    rows = np.flatnonzero(first < ends)
    for d in range(int(((ends - 1) // 64 - np.arange(n) // 64).max(initial=-1)) + 1):
        rows = rows[(rows // 64 + d) * 64 < ends[rows]]
        for k in range(0, len(rows), SLICE):
            q = rows[k : k + SLICE]
            w = q // 64 + d
            low = np.clip(first[q] - w * 64, 0, 64)
            high = np.minimum(ends[q] - w * 64, 64)
            at_least = np.where(low < 64, full << np.minimum(low, 63).astype(np.uint64), np.uint64(0))
            open_ = at_least & (full >> (64 - high).astype(np.uint64))
            one, two, past = (np.zeros(len(q), np.uint64) for _ in range(3))
            for b in range(BITS):
                x = planes[b][w] ^ (np.uint64(0) - (prints[q] >> np.uint64(b) & np.uint64(1)))
                carry = one & x
                one ^= x
                past |= two & carry
                two ^= carry
                if b % 8 == 7:
                    open_ &= ~past
                    live = open_ != 0
                    if not live.all():
                        q, w, one, two, past, open_ = (a[live] for a in (q, w, one, two, past, open_))
                    if not len(q):
                        break
            if len(q):
                hit = np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, c = np.nonzero(hit)
                yield q[r], w[r] * 64 + c


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: those that join two trees."""
    root, left, right = np.arange(n), [], []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in pairs:
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            x, y = top(a), top(b)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(a)
                right.append(b)
        while (root[root] != root).any():
            root = root[root]
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; whole buckets are compared, the last one waits for its rest."""
    held: list[np.ndarray] = []

    def run(part: np.ndarray) -> pa.RecordBatch:
        prints = np.ascontiguousarray(part[:, 2]).view(np.uint64)
        change = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(axis=1)) + 1
        ends = np.repeat(np.append(change, len(part)), np.diff(np.concatenate(([0], change, [len(part)]))))
        shared = (ends - np.arange(len(part)) > 1) | np.concatenate(([False], ends[1:] == ends[:-1]))
        keep = np.flatnonzero(shared)
        prints, ends = prints[keep], np.searchsorted(keep, ends[keep])
        i, j = spanning(len(prints), near_pairs(prints, ends)) if len(keep) else (keep, keep)
        return pa.RecordBatch.from_arrays([pa.array(prints[i].view(np.int64)), pa.array(prints[j].view(np.int64))], ["u", "v"])

    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        if sum(map(len, held)) < 4 * BUCKET_ROWS:
            continue
        rows = np.concatenate(held)
        edge = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        cut = int(edge[-1]) + 1 if len(edge) else 0
        if cut:
            yield run(rows[:cut])
        held = [rows[cut:]]
    if held and sum(map(len, held)):
        yield run(np.concatenate(held))


def near_links(prints: DataFrame) -> DataFrame:
    """(u, v) pairs of distinct fingerprints within the radius that connect all that can be connected."""
    arrow_rows(prints.sparkSession, 10_000)
    masks = block_masks()
    live = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("bigint") for m in masks])).alias("mask"))
    links = None
    while True:
        live = live.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        hot = written(live.groupBy("mask", "key").count().where(F.col("count") > BUCKET_ROWS).select("mask", "key"), "hot")
        crowded = bool(hot.limit(1).count())
        calm = live.join(hot, ["mask", "key"], "left_anti") if crowded else live
        dealt = calm.select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = dealt.mapInArrow(_links, "u bigint, v bigint")
        links = found if links is None else links.union(found)
        if not crowded:
            return links
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)).cast("bigint"), F.array(*[F.lit(_signed(f)).cast("bigint") for f in finer_masks(m)]))])
        live = live.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
        masks = sorted({f for m in masks for f in finer_masks(m)})


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, fingerprint, component_id: one row per row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "prints")
    prints = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = components(near_links(prints))
    # Written, so that the joins meet plain tables and the rows of a hot class can be split.
    classes = written(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    lows = written(classes.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    classes = written(classes.join(lows, "root").select("fp", "component_id"), "members")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
