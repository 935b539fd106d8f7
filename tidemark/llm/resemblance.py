"""Near copies by SimHash, decided by the Jaccard resemblance of word shingles.

Each text has a SimHash fingerprint of its distinct shingles. A pair is looked at when its fingerprints are
near, and linked when the shingle sets are alike; the sets alone decide.

1. Fingerprints within three bits are found by `simhash.near_links` (blocks, bit planes, carry-save counters). The
   texts of each class of near fingerprints are compared with its first one.
2. At resemblance 0.8 two fingerprints differ in about ten bits, too many for equal blocks. Wider pairs are dealt
   into buckets by BANDS keys of HASHES minima each; at 0.8 a pair shares none of 24 keys of four minima with
   chance (1 - 0.8^4)^24, about 3 in a million. In a bucket only fingerprints within WIDE bits are looked at, which a
   pair at 0.8 misses with chance below one in a million.
   a. In each bucket all are compared with the first one, so a large group of near copies costs one
      comparison a member and key.
   b. A bucket of three or more whose members are not all in one component is open: its members are compared
      across components until one link joins them. Nothing near that shares a key is left uncompared unless
      it is linked already.

Words are split at ASCII whitespace and A-Z is lowered. A text of fewer words than the width is one shingle.

Defined results: a null text counts as empty where the caller says so (`numbered` does); texts without words
are near to each other. Repeated rows are near copies of each other. A row without a near copy has no class,
and an empty table has none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import BASE, gram_hashes, list_column, word_values
from tidemark.llm.common import arrow_rows, record, ships, written
from tidemark.llm.components import components
from tidemark.llm.simhash import BITS, near_links

ships(__name__)

WIDTH, LEAST = 5, 0.8
BANDS, HASHES = 24, 4
WIDE = 28
CHUNK = 1 << 12
LINKS = "u bigint, v bigint"


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words."""
    values = word_values(text.lower())[2]
    return np.unique(gram_hashes(values, min(width, len(values)))) if len(values) else np.zeros(1, np.uint64)


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def band_keys(grams: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(7)
    flip = rng.integers(0, 1 << 63, (BANDS * HASHES, 1), np.uint64)
    odd = rng.integers(0, 1 << 63, (BANDS * HASHES, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(BANDS * HASHES, (1 << 64) - 1, np.uint64)
    for k in range(0, len(grams), CHUNK):
        low = np.minimum(low, ((grams[None, k : k + CHUNK] ^ flip) * odd).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for part in low.reshape(BANDS, HASHES).T:
        key = (key ^ part) * np.uint64(BASE)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def fingerprint(grams: np.ndarray) -> int:
    """The SimHash of a shingle set as a signed number: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(grams), CHUNK):
        ones += np.unpackbits(grams[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)[0])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t) for t in batch.column(1).to_pylist()]
        prints = pa.array([fingerprint(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), prints, list_column([band_keys(s) for s in sets], pa.int64())], ["rid", "fp", "keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (low, rid, first, text): the pairs whose texts are alike."""
    at, first = None, None
    for batch in batches:
        links = []
        for low, rid, head, text in zip(*(c.to_pylist() for c in batch.columns)):
            if low != at:
                at, first = low, shingles(head)
            if alike(first, shingles(text)):
                links.append((rid, low))
        yield record(links, LINKS)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, rid, root, fp, text) sorted by key and rid: links between members of different roots. The first member is settled."""
    rids: list[int] = []
    roots: list[int] = []
    prints: list[int] = []
    sets: list[np.ndarray] = []

    def run() -> pa.RecordBatch:
        root, size, links = np.array(roots), np.array([len(s) for s in sets]), []
        fp = np.array(prints, np.int64)
        for i in range(1, len(sets)):
            fits = (size >= LEAST * size[i]) & (size[i] >= LEAST * size) & (np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= WIDE)
            for j in (np.flatnonzero(fits[i + 1 :] & (root[i + 1 :] != root[i])) + i + 1).tolist():
                if root[j] != root[i] and alike(sets[i], sets[j]):
                    links.append((rids[j], rids[i]))
                    root[root == root[j]] = root[i]
        for held in (rids, roots, prints, sets):
            held.clear()
        return record(links, LINKS)

    at = None
    for batch in batches:
        for key, rid, root, fp, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at and rids:
                yield run()
            at = key
            rids.append(rid)
            roots.append(root)
            prints.append(fp)
            sets.append(shingles(text))
    if rids:
        yield run()


def near_classes(rows: DataFrame) -> DataFrame:
    """(rid, root) of the rows (rid, text) that have a near copy; root is the least rid of the component."""
    arrow_rows(rows.sparkSession, 256)
    texts = rows.select("rid", F.col("text").cast("binary").alias("text"))
    bands = written(texts.mapInArrow(_bands, "rid bigint, fp bigint, keys array<bigint>"), "bands")
    near = components(near_links(bands.select("fp").distinct()))
    arrow_rows(rows.sparkSession, 256)
    kin = written(bands.select("rid", "fp").join(near.withColumnRenamed("node", "fp"), "fp", "left").select("rid", F.coalesce("root", "fp").alias("kin")), "kin")
    leads = kin.groupBy("kin").agg(F.min("rid").alias("low"), F.count("*").alias("n")).where("n > 1")
    close = kin.join(leads, "kin").where("rid <> low").select("low", "rid")
    every = bands.select("rid", "fp", F.explode("keys").alias("key"))
    hubs = written(every.groupBy("key").agg(F.min("rid").alias("low"), F.min_by("fp", "rid").alias("first"), F.count("*").alias("n")).where("n > 1"), "hubs")
    members = written(every.join(hubs, "key").select("key", "low", "first", "rid", "fp", "n"), "buckets")
    wide = members.where("rid <> low").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("first"))) <= WIDE).select("low", "rid")
    pairs = written(close.union(wide).distinct(), "pairs")
    heads = pairs.join(texts.select(F.col("rid").alias("low"), F.col("text").alias("first")), "low")
    links = written(heads.join(texts, "rid").select("low", "rid", "first", "text").mapInArrow(_verify, LINKS), "alike")
    roots = components(links)
    placed = written(members.where("n > 2").join(roots.withColumnRenamed("node", "rid"), "rid", "left").select("key", "rid", "fp", F.coalesce("root", "rid").alias("root")), "placed")
    kinds = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("a"), F.max("root").alias("b"), F.bit_xor(F.xxhash64("rid")).alias("who")).where("a <> b")
    open_ = written(kinds.groupBy("n", "who").agg(F.min("key").alias("key")).select("key"), "open")
    asked = placed.join(open_, "key").join(texts, "rid").select("key", "rid", "root", "fp", "text")
    more = asked.repartition("key").sortWithinPartitions("key", "rid").mapInArrow(_join, LINKS)
    return components(written(links.union(more), "near")).withColumnRenamed("node", "rid")
