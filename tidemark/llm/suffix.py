"""Removal of repeated passages by suffix arrays built with a difference cover.

A byte goes when a string of LENGTH bytes that covers it also starts somewhere else. Every such string
is named by its anchor: of the GRAM-byte grams inside, the one whose hash is least (of equals the last).
Equal strings have equal anchors, so they are brought together by the anchor's hash and nothing else
has to meet. A segment is a run of string starts that share an anchor, with the bytes they cover.

1. Each document is cut into segments; one row a document keeps its digest and its anchors. Copies of
   a text are settled by the digest, and one of them stands for all in what follows.
2. Anchors met once cannot belong to a repeat. The documents with others are fetched once.
3. Segments equal as a whole settle all their starts. The other segments of an anchor go, one row for
   each distinct content, to the shard of that anchor.
4. A shard sorts all suffixes of its segments: it sorts the triples at positions 1 and 2 modulo 3,
   recurses on their names until they differ, merges the suffixes at
   positions 0 modulo 3, and compares the prefixes of neighbours, byte by byte.
5. An anchor with more distinct segments than CLASS_ROWS is not sorted in one shard; its strings are
   counted by digest in an ordinary aggregate instead. repeated_words counts all its strings so.

The elements of a text are its bytes, or its words (Reading): then LENGTH and all positions count words, and
contents are words joined by blanks, numbered within a shard before it is sorted.

A segment reaches no further than twice LENGTH, so shards are bounded by CLASS_ROWS of them.

Defined results: null and empty texts have no bytes and lose none. Repeated rows are copies. Texts
shorter than LENGTH lose nothing. Ids may be null or repeated; rows are then told apart by position.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.anchors import list_column, packed_cuts, segments, unpacked, word_values
from tidemark.llm.common import arrow_rows, numbered, record, row_ids, ships, written

ships(__name__)

LENGTH, GRAM = 400, 128
SHARD_BYTES = 400_000
CLASS_ROWS = 1024
STRING_ROWS = 16384


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


class Reading(NamedTuple):
    """What the elements of a text are, how many make a repeat, and how many make a gram."""

    length: int
    gram: int
    words: bool = False

    def values(self, text: bytes) -> np.ndarray:
        return word_values(text)[2] if self.words else byte_values()[np.frombuffer(text, np.uint8)]

    def elements(self, text: bytes) -> bytes | list[bytes]:
        return text.split() if self.words else text

    def content(self, some: bytes | list[bytes]) -> bytes:
        return b" ".join(some) if self.words else some


BYTES, WORDS = Reading(LENGTH, GRAM), Reading(51, 16, True)


def _parse(reading: Reading) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            values = [reading.values(t) for t in texts]
            found = segments(values, reading.length, reading.gram)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(v) for v in values], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                list_column([packed_cuts(f) for f in found], pa.int64()), list_column([f[3].view(np.int64) for f in found], pa.int64()),
            ], ["rid", "id", "n_bytes", "n", "sha", "cuts", "keys"])

    return run


OCCURRENCES = "rid bigint, cut bigint, key bigint, seg binary"
CONTENTS = "key bigint, seg binary, met bigint, cut bigint, content binary"
RUNS = "key bigint, seg binary, low bigint, high bigint"
STRINGS = "string binary, met bigint, rid bigint, low bigint"
CUT = "rid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
PARSED = "rid bigint, id bigint, n_bytes bigint, n bigint, sha string, cuts array<bigint>, keys array<bigint>"


def _flat(batch: pa.RecordBatch, reading: Reading) -> Iterator[tuple[int, dict, bytes]]:
    """Row id, segment and content of each row's list of segments."""
    for rid, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        elements = reading.elements(text)
        for c in cuts:
            start, count, _ = unpacked(c["cut"])
            yield rid, c, reading.content(elements[start : start + count + reading.length - 1])


def _occurrences(reading: Reading) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(rid, c["cut"], c["key"], xxhash.xxh3_128_digest(struct.pack("<qi", c["key"], c["cut"] & 0xFFFFF) + content)) for rid, c, content in _flat(batch, reading)]
            yield record(rows, OCCURRENCES)

    return run


def _contents(reading: Reading) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield record([(c["key"], c["seg"], c["met"], c["cut"], content) for _, c, content in _flat(batch, reading)], CONTENTS)

    return run


def laid_out(contents: list[bytes], reading: Reading) -> tuple[np.ndarray, np.ndarray]:
    """The contents' elements as numbers, a zero between contents, and how many each has with that zero."""
    if not reading.words:
        return np.frombuffer(b"\0".join(contents), np.uint8), np.array([len(c) for c in contents]) + 1
    names: dict[bytes, int] = {}
    parts = [[names.setdefault(w, len(names) + 1) for w in c.split()] + [0] for c in contents]
    return np.array([x for p in parts for x in p][:-1], np.int64), np.array([len(p) for p in parts])


def suffix_order(t: np.ndarray) -> np.ndarray:
    """Positions of t in the order of their suffixes; values are at least 1."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda k: t[k:].tolist()), np.int64)
    s = np.concatenate((t, np.zeros(3, np.int64)))
    top = int(s.max()) + 1
    sample = np.concatenate((np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)))
    triples = (s[sample] * top + s[sample + 1]) * top + s[np.minimum(sample + 2, n + 2)]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    names = np.empty(len(sample), np.int64)
    names[order] = np.concatenate(([1], 1 + np.cumsum(ranked[1:] != ranked[:-1])))
    if names.max() < len(sample):
        order = suffix_order(names)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = np.arange(1, len(sampled) + 1)
    size = len(sampled) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(s[rest] * size + rank[rest + 1], kind="stable")]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    below = np.searchsorted(s[one] * size + rank[one + 1], s[rest] * size + rank[rest + 1])
    below += np.searchsorted((s[two] * top + s[two + 1]) * size + rank[two + 2], (s[rest] * top + s[rest + 1]) * size + rank[rest + 2])
    merged = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    slots = below + np.arange(len(rest))
    taken[slots] = True
    merged[slots] = rest
    merged[~taken] = sampled
    return merged


def repeated_starts(contents: list[bytes], counts: list[int], offs: list[int], keys: list[int], reading: Reading) -> list[np.ndarray]:
    """For each segment whether each of its starts begins a string that another start of the shard begins too."""
    blob, sizes = laid_out(contents, reading)
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    # Each segment but the last ends with a value of its own, so no two suffixes are alike beyond it.
    values = blob.astype(np.int64) + len(contents) + 1
    values[(firsts + sizes - 1)[:-1]] = np.arange(1, len(contents))
    owner = np.full(len(values), -1)
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(firsts, counts)])
    owner[starts] = np.repeat(np.arange(len(contents)), counts)
    order = suffix_order(values)
    order = order[owner[order] >= 0]
    who = owner[order]
    inside = order - firsts[who] - np.array(offs)[who]
    same = np.array(keys)[who]
    near = np.flatnonzero((inside[1:] == inside[:-1]) & (same[1:] == same[:-1]))
    strings = np.lib.stride_tricks.sliding_window_view(blob, reading.length)
    mark = np.zeros(len(values), bool)
    for k in range(0, len(near), 2048):
        a, b = order[near[k : k + 2048]], order[near[k : k + 2048] + 1]
        equal = (strings[a] == strings[b]).all(axis=1)
        mark[a[equal]] = mark[b[equal]] = True
    return [mark[f : f + c] for f, c in zip(firsts, counts)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _shard(reading: Reading) -> Callable:
    """Rows come sorted by key; whole keys are gathered up to SHARD_BYTES."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def run() -> pa.RecordBatch:
            counts, offs = [unpacked(r[3])[1] for r in held], [unpacked(r[3])[2] for r in held]
            marks = repeated_starts([r[4] for r in held], counts, offs, [r[0] for r in held], reading)
            return record([(r[0], r[1], a, b) for r, m in zip(held, marks) if r[2] == 1 for a, b in runs_of(m)], RUNS)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield run()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield run()

    return shards


def _strings(reading: Reading) -> Callable:
    """Rows (rid, text, segments): the digest of each string that starts in one of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rid, text, cuts in zip(*(c.to_pylist() for c in batch.columns)):
                elements = reading.elements(text)
                plain, gap = reading.content(elements), int(reading.words)
                at = [0, *accumulate(len(w) + 1 for w in elements)] if reading.words else range(len(text) + 1)
                for c in cuts:
                    start, count, _ = unpacked(c["cut"])
                    rows += [(xxhash.xxh3_128_digest(plain[at[k] : at[k + reading.length] - gap]), c["met"], rid, k) for k in range(start, start + count)]
                    if len(rows) >= STRING_ROWS:
                        yield record(rows, STRINGS)
                        rows = []
        if rows:
            yield record(rows, STRINGS)

    return run


def _in_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, text, spans in words): the spans in bytes, from the first word's start to the last word's end."""
    for batch in batches:
        rows = []
        for rid, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            starts, ends, _ = word_values(text)
            rows += [(rid, int(starts[s["low"]]), int(ends[s["high"] - 1])) for s in spans]
        yield record(rows, "rid bigint, low bigint, high bigint")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            at, kept, removed, n = 0, [], 0, 0
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                if low > at or not n:
                    kept.append(text[at:low])
                    n += 1
                    removed += high - low
                    at = high
                elif high > at:
                    removed += high - at
                    at = high
            kept.append(text[at:])
            left = b"".join(kept)
            rows.append((rid, removed, n, hashlib.sha256(left).hexdigest(), left))
        yield record(rows, CUT)


def _repeats(rows: DataFrame, reading: Reading, sort: bool = True, flags: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """parsed: a row per row; flags: (rid, leads, copied) of copies; fetched: (rid, text, ...) of the suspects; spans: (rid, low, high) of repeats, in elements.

    Without sort all anchors are counted by the digests of their strings. flags can be given from another reading.
    """
    arrow_rows(rows.sparkSession, 256)
    parsed = written(rows.select("rid", "id", F.col("text").cast("binary")).mapInArrow(_parse(reading), PARSED), "parsed")
    if flags is None:
        texts = parsed.groupBy("sha", "n_bytes").agg(F.min("rid").alias("lead"), F.count("*").alias("copies")).where("copies > 1")
        # Hot values are joined as written tables, whose rows adaptive execution can split.
        texts = written(texts, "texts")
        flags = parsed.select("rid", "sha", "n_bytes").join(texts, ["sha", "n_bytes"]).select("rid", (F.col("rid") == F.col("lead")).alias("leads"), F.lit(True).alias("copied"))
        flags = written(flags, "copies")
    every = parsed.select("rid", "sha", F.explode(F.arrays_zip("cuts", "keys")).alias("a")).select("rid", "sha", F.col("a.cuts").alias("cut"), F.col("a.keys").alias("key"))
    # An anchor that stands in one text only, at one place, is no repeat, however many copies the text has.
    place = F.xxhash64("sha", "cut")
    keys = written(every.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key"), "keys")
    suspects = every.drop("sha").join(keys, "key").join(flags.where("NOT leads").select("rid"), "rid", "left_anti")
    listed = suspects.groupBy("rid").agg(F.collect_list(F.struct("cut", "key")).alias("cuts"))
    fetched = written(rows.select("rid", F.col("text").cast("binary").alias("text")).join(listed, "rid"), "suspects")
    places = written(fetched.mapInArrow(_occurrences(reading), OCCURRENCES), "places")
    kinds = written(places.groupBy("key", "seg").agg(F.count("*").alias("met"), F.min(F.struct("rid", "cut")).alias("at")), "segments")
    whole = kinds.where("met > 1").select("key", "seg", F.lit(0).cast("bigint").alias("low"), F.expr("shiftright(at.cut, 10) & 1023").alias("high"))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.min("met").alias("least")).where("kinds > 1 AND least = 1").select("key", "kinds")
    wanted = kinds.join(written(mixed, "mixed"), "key").groupBy(F.col("at.rid").alias("rid"), (F.col("kinds") > (CLASS_ROWS if sort else 0)).alias("crowded")).agg(F.collect_list(F.struct("at.cut", "key", "seg", "met")).alias("cuts"))
    wanted = written(wanted, "wanted")

    def listed(crowded: bool) -> DataFrame:
        return fetched.select("rid", "text").join(wanted.where(F.col("crowded") == crowded).select("rid", "cuts"), "rid")

    runs = whole
    if sort:
        contents = listed(False).mapInArrow(_contents(reading), CONTENTS)
        runs = whole.union(contents.repartition("key").sortWithinPartitions("key").mapInArrow(_shard(reading), RUNS))
    start = F.shiftright("cut", 20)
    spans = places.join(written(runs, "runs"), ["key", "seg"]).select("rid", (start + F.col("low")).alias("low"), (start + F.col("high") + reading.length - 1).alias("high"))
    if wanted.where("crowded").limit(1).count():
        strings = written(listed(True).mapInArrow(_strings(reading), STRINGS), "strings")
        again = written(strings.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string"), "again")
        # A segment met once stands at one place only, so its strings need no look-up by segment.
        spans = spans.union(strings.where("met = 1").join(again, "string").select("rid", "low", (F.col("low") + reading.length).alias("high")))
    return parsed.select("rid", "id", "n_bytes", "n", "sha"), flags, fetched.select("rid", "text"), spans


def _listed(spans: DataFrame) -> DataFrame:
    return spans.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, spans): how many elements the spans cover."""
    for batch in batches:
        rows = []
        for rid, spans in zip(*(c.to_pylist() for c in batch.columns)):
            at = n = 0
            for low, high in sorted((s["low"], s["high"]) for s in spans):
                n += max(0, high - max(low, at))
                at = max(at, high)
            rows.append((rid, n))
        yield record(rows, "rid bigint, covered bigint")


def repeated_words(rows: DataFrame, reading: Reading = WORDS, flags: DataFrame | None = None) -> DataFrame:
    """(rid, covered) of rows (rid, id, text): the words of each text that a repeat of the reading covers; texts without any are left out."""
    parsed, flags, _, spans = _repeats(rows, reading, False, flags)
    whole = parsed.where(F.col("n") >= reading.length).join(flags, "rid").select("rid", F.col("n").cast("bigint").alias("covered"))
    part = _listed(spans).mapInArrow(_covered, "rid bigint, covered bigint")
    return whole.union(part).groupBy("rid").agg(F.max("covered").alias("covered"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: Reading | None = None) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256: one row per row of docs.

    With a reading of words, also n_repeated_words: the words in passages of its length that also stand
    elsewhere, which may be shorter than LENGTH bytes.
    """
    rows = row_ids(docs, id_col, text_col)
    found, flags = _by_bytes(rows)
    if words:
        more = written(repeated_words(rows, words, flags), "words")
        found = found.join(more, "rid", "left").withColumn("n_repeated_words", F.coalesce("covered", F.lit(0)).cast("bigint")).drop("covered")
    return found.drop("rid").withColumnRenamed("id", id_col)


def _by_bytes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed, flags, fetched, spans = _repeats(rows, BYTES)
    cuts = fetched.join(_listed(spans), "rid").mapInArrow(_cut, CUT)
    gone = F.coalesce(F.col("copied") & (F.col("n_bytes") >= LENGTH), F.lit(False))
    both = parsed.join(flags.drop("leads"), "rid", "left").join(cuts.drop("kept"), "rid", "left")
    found = both.select(
        "rid", "id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    return found, flags


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", readings: tuple[Reading, ...] = (BYTES,)) -> DataFrame:
    """docs with what repeats by any of the readings taken out of its texts; of a character cut apart nothing stays."""
    rows = numbered(docs, id_col, text_col)
    base = rows.select("rid", "id", "text")
    copied = spans = None
    for reading in readings:
        parsed, flags, fetched, found = _repeats(base, reading)
        whole = flags.join(parsed.where(F.col("n") >= reading.length).select("rid"), "rid").select("rid")
        if reading.words:
            found = fetched.join(_listed(found), "rid").mapInArrow(_in_bytes, "rid bigint, low bigint, high bigint")
        copied = whole if copied is None else copied.union(whole)
        spans = found if spans is None else spans.union(found)
    copied = copied.distinct().select("rid", F.lit("").alias("kept"))
    texts = fetched if len(readings) == 1 else base.select("rid", F.col("text").cast("binary").alias("text"))
    cuts = texts.join(_listed(spans), "rid").mapInArrow(_cut, CUT)
    part = cuts.join(copied.select("rid"), "rid", "left_anti").select("rid", "kept").mapInArrow(_readable, "rid bigint, kept string")
    found = rows.select("rid", "doc").join(copied.union(part), "rid", "left")
    cut = F.coalesce(F.col("kept"), F.col("doc").getField(text_col))
    return found.select(F.col("doc").withField(text_col, cut).alias("doc")).select("doc.*")


def _readable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode("utf-8", "ignore") for t in batch.column(1).to_pylist()], pa.string())], ["rid", "kept"])
