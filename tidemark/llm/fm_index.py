"""Removal of repeated word windows with an FM-index per shard.

A word goes when a window of WINDOW words that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one. Every window is named by its anchor (see anchors.py), so equal
windows meet in the shard of their anchor and documents need not visit every shard.

1. One row a document keeps the digest of its words and its anchors. Copies of a word sequence are
   settled by the digest: all but the first lose every word that a window covers.
2. Anchors met once cannot belong to a repeat. The documents with others are fetched once.
3. Of segments equal as a whole only the first can hold first windows. One row for each distinct
   segment goes to the shard of its anchor.
4. A shard indexes its segments: the Burrows-Wheeler transform of their words in a wavelet matrix, bit
   planes with running counts. The segments stream through it by backward search, all windows abreast:
   a window's matching statistic reaches WINDOW if its interval still holds another row then, and the
   earliest row of the interval is the one that stays. Windows whose interval holds only themselves are
   dropped at once.
5. An anchor with more distinct segments than CLASS_ROWS is not indexed in one shard; its windows are
   compared by digest in an ordinary aggregate instead.

Defined results: null and empty texts have no words. Of repeated rows the first stays whole. Ids may be
null (they come first) or repeated (any order among them). Texts shorter than WINDOW lose nothing.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import list_column, packed_cuts, segments, unpacked
from tidemark.llm.common import arrow_rows, record, row_ids, ships, written
from tidemark.llm.suffix import runs_of, suffix_order

ships(__name__)

WINDOW, GRAM = 20, 6
SHARD_WORDS = 150_000
CLASS_ROWS = 4096
PARSED = "rid bigint, id bigint, n_words bigint, sha string, cuts array<bigint>, keys array<bigint>"
OCCURRENCES = "rid bigint, cut bigint, key bigint, seg binary"
CONTENTS = "key bigint, rid bigint, cut bigint, content binary"
RUNS = "rid bigint, low bigint, high bigint"
WINDOWS = "key bigint, rid bigint, low bigint, string binary"
KEPT = "rid bigint, n_removed bigint, kept_sha256 string, kept binary"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        words = [t.split() for t in batch.column(2).to_pylist()]
        found = segments((np.fromiter(map(digest, w), np.uint64, len(w)) for w in words), WINDOW, GRAM)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
            list_column([packed_cuts(f) for f in found], pa.int64()), list_column([f[3].view(np.int64) for f in found], pa.int64()),
        ], ["rid", "id", "n_words", "sha", "cuts", "keys"])


def _flat(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, bytes]]:
    """Row id, segment and words of each row's list of segments."""
    for rid, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        words = text.split()
        for c in cuts:
            start, count, _ = unpacked(c["cut"])
            yield rid, c, b" ".join(words[start : start + count + WINDOW - 1])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(rid, c["cut"], c["key"], xxhash.xxh3_128_digest(struct.pack("<qi", c["key"], c["cut"] & 0xFFFFF) + content)) for rid, c, content in _flat(batch)]
        yield record(rows, OCCURRENCES)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield record([(c["key"], rid, c["cut"], content) for rid, c, content in _flat(batch)], CONTENTS)


class WaveletMatrix:
    """Rank over a symbol sequence: one packed bit plane with running counts for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, now = [], symbols
        for bit in range(bits - 1, -1, -1):
            flags = (now >> bit & 1).astype(np.uint8)
            plane = np.packbits(np.concatenate([flags, np.zeros(128 - len(flags) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(plane), dtype=np.int64)))
            self.levels.append((bit, plane, counts, len(flags) - int(flags.sum())))
            now = np.concatenate((now[flags == 0], now[flags == 1]))

    def mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` comes to in the last plane on the way of its symbol; differences of these are ranks."""
        for bit, plane, counts, zeros in self.levels:
            ones = counts[at >> 6] + np.bitwise_count(plane[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1 == 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of symbols from 1 up; symbol 0 ends it."""

    def __init__(self, text: np.ndarray):
        n, top = len(text), int(text.max()) + 1
        order = np.concatenate(([n], suffix_order(text)))
        self.matrix = WaveletMatrix(np.where(order > 0, text[order - 1], 0), top.bit_length())
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top))[:-1])) + 1
        self.first[0] = 0
        self.after = np.append(self.first[1:], n + 1)
        self.base = self.matrix.mapped(np.arange(top), np.zeros(top, np.int64))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.mapped(symbol, at) - self.base[symbol]

    def intervals(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts whose string of `length` symbols occurs more than once, and the first row of its interval."""
        symbol = text[starts + length - 1]
        low, high = self.first[symbol], self.after[symbol]
        for back in range(2, length + 1):
            live = high - low > 1
            starts, low, high = starts[live], low[live], high[live]
            symbol = text[starts + length - back]
            low, high = self.step(symbol, low), self.step(symbol, high)
        live = high - low > 1
        return starts[live], low[live]


def later_windows(contents: list[bytes], counts: list[int], places: list[tuple[int, int]], window: int) -> list[np.ndarray]:
    """For each segment (first word at (row, word)) whether each of its windows also starts earlier in the shard."""
    numbers: dict[bytes, int] = {}
    words = [[numbers.setdefault(w, len(numbers) + len(contents) + 1) for w in c.split()] for c in contents]
    sizes = np.array([len(w) + 1 for w in words])
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Each segment ends with a symbol of its own, so no two suffixes are alike beyond it.
    text = np.concatenate([np.array([*w, k + 1], np.int64) for k, w in enumerate(words)])
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(firsts, counts)])
    rows = np.repeat([p[0] for p in places], counts)
    at = np.concatenate([np.arange(p[1], p[1] + c) for p, c in zip(places, counts)])
    turn = np.zeros(len(text), np.int64)
    turn[starts[np.lexsort((at, rows))]] = np.arange(len(starts))
    met, low = FMIndex(text).intervals(text, starts, window)
    later = np.zeros(len(text), bool)
    if len(met):
        order = np.lexsort((turn[met], low))
        met, low = met[order], low[order]
        later[met[np.concatenate(([False], low[1:] == low[:-1]))]] = True
    return [later[f : f + c] for f, c in zip(firsts, counts)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; whole keys are gathered up to SHARD_WORDS."""
    held: list[tuple] = []
    size = 0

    def run() -> pa.RecordBatch:
        cuts = [unpacked(r[2]) for r in held]
        marks = later_windows([r[3] for r in held], [c[1] for c in cuts], [(r[1], c[0]) for r, c in zip(held, cuts)], WINDOW)
        return record([(r[1], c[0] + a, c[0] + b) for r, c, m in zip(held, cuts, marks) for a, b in runs_of(m)], RUNS)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SHARD_WORDS and row[0] != held[-1][0]:
                yield run()
                held, size = [], 0
            held.append(row)
            size += unpacked(row[2])[1] + WINDOW
    if held:
        yield run()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, rid, cut, content in zip(*(c.to_pylist() for c in batch.columns)):
            start, count, _ = unpacked(cut)
            words = content.split()
            yield record([(key, rid, start + k, xxhash.xxh3_128_digest(b" ".join(words[k : k + WINDOW]))) for k in range(count)], WINDOWS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            words = text.split()
            edge = np.zeros(len(words) + 1, np.int64)
            for s in spans:
                edge[s["low"]] += 1
                edge[s["high"]] -= 1
            stays = np.cumsum(edge)[:-1] == 0
            left = b" ".join(w for w, k in zip(words, stays.tolist()) if k)
            rows.append((rid, int((~stays).sum()), hashlib.sha256(left).hexdigest(), left))
        yield record(rows, KEPT)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept_sha256, kept (binary, null where nothing was removed): one row per row of docs."""
    arrow_rows(docs.sparkSession, 256)
    rows = row_ids(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    parsed = written(rows.select("rid", "id", "text").mapInArrow(_parse, PARSED), "parsed")
    texts = written(parsed.groupBy("sha", "n_words").agg(F.min("rid").alias("lead"), F.count("*").alias("copies")).where("copies > 1"), "texts")
    follows = written(parsed.select("rid", "sha", "n_words").join(texts, ["sha", "n_words"]).where("rid <> lead").select("rid"), "copies")
    every = parsed.select("rid", "sha", F.explode(F.arrays_zip("cuts", "keys")).alias("a")).select("rid", "sha", F.col("a.cuts").alias("cut"), F.col("a.keys").alias("key"))
    # An anchor that stands in one text only, at one place, is no repeat, however many copies the text has.
    place = F.xxhash64("sha", "cut")
    keys = written(every.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"), "keys")
    suspects = every.drop("sha").join(keys, "key").join(follows, "rid", "left_anti")
    listed = suspects.groupBy("rid").agg(F.collect_list(F.struct("cut", "key")).alias("cuts"))
    fetched = written(rows.select("rid", "text").join(listed, "rid"), "suspects")
    places = written(fetched.mapInArrow(_occurrences, OCCURRENCES), "places")
    kinds = written(places.groupBy("key", "seg").agg(F.count("*").alias("met"), F.min(F.struct("rid", "cut")).alias("at")), "segments")
    start, count = F.shiftright("cut", 20), F.expr("shiftright(cut, 10) & 1023")
    again = places.join(kinds.where("met > 1"), ["key", "seg"]).where("rid <> at.rid OR cut <> at.cut").select("rid", start.alias("low"), (start + count).alias("high"))
    mixed = written(kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    wanted = written(kinds.join(mixed, "key").groupBy(F.col("at.rid").alias("rid"), (F.col("kinds") > CLASS_ROWS).alias("crowded")).agg(F.collect_list(F.struct("at.cut", "key")).alias("cuts")), "wanted")

    def contents(crowded: bool) -> DataFrame:
        return fetched.select("rid", "text").join(wanted.where(F.col("crowded") == crowded).select("rid", "cuts"), "rid").mapInArrow(_contents, CONTENTS)

    runs = contents(False).repartition("key").sortWithinPartitions("key").mapInArrow(_shard, RUNS)
    if wanted.where("crowded").limit(1).count():
        windows = contents(True).repartition("rid", "cut").mapInArrow(_windows, WINDOWS)
        least = windows.groupBy("key", "string").agg(F.min(F.struct("rid", "low")).alias("one"))
        runs = runs.union(windows.join(least, ["key", "string"]).where("rid <> one.rid OR low <> one.low").select("rid", "low", F.expr("low + 1").alias("high")))
    spans = again.union(runs).select("rid", F.struct("low", (F.col("high") + WINDOW - 1).alias("high")).alias("span"))
    marked = spans.groupBy("rid").agg(F.collect_list("span").alias("spans"))
    cuts = fetched.select("rid", "text").join(marked, "rid").mapInArrow(_kept, KEPT)
    both = parsed.select("rid", "id", "n_words", "sha").join(follows.withColumn("follows", F.lit(True)), "rid", "left").join(cuts, "rid", "left")
    gone = F.coalesce(F.col("follows") & (F.col("n_words") >= WINDOW), F.lit(False))
    return both.select(
        F.col("id").alias(id_col), "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
