"""License scan by a positional index of rare licence words.

One pass over the texts keeps, for each file, the places of the words that occur in licence templates:
the postings. Document frequencies of those words give each template the word of its key phrase with the
highest IDF. A file is looked up by the rare words it holds: each place of one, less the word's place in
the template, is a relative position; the template's other postings are intersected at it, and the
template is found where at least SHARE of its words stand and its mandatory key phrase stands in full.
Since the key phrase must stand in full, every place where a template is found holds its rare word:
which word is looked up, and so what other files hold, changes the work and no result. A rare word's
neighbours in the postings are at most a template's length away, so the work is linear in the file's
postings. Long templates find altered licence texts, short ones the usual notices.

Everything is DataFrame expressions; only word counts (one row a template word) are shuffled, and only
they, bounded by the templates, reach the driver.

Defined results: null and empty texts have no words. The score is the best share of a template that is
found. Where nothing is found, labels are empty, the score is 0, and first and last are null. Repeated
rows are scanned alike. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SHARE = 0.8
# (label, phrase, key phrase). The first three are the base phrases, found only in full.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
OTHER = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("gpl", "under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by-sa", "cc by sa", "cc by sa"),
    ("mit", "the mit license", "the mit license"),
    ("apache", "apache license", "apache license"),
    ("bsd", "bsd license", "bsd license"),
    ("gpl", "gnu general public license", "gnu general public license"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "mozilla public license", "mozilla public license"),
    ("cc", "creative commons", "creative commons"),
    ("public-domain", "released into the public domain", "into the public domain"),
)
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Template:
    def __init__(self, label: str, phrase: str, key: str, base: bool):
        self.label, self.base, self.words, self.key = label, base, phrase.split(), key.split()
        self.key_at = next(k for k in range(len(self.words)) if self.words[k : k + len(self.key)] == self.key)


TEMPLATES = [Template(label, phrase, phrase, True) for label, phrase in BASE] + [Template(*t, False) for t in OTHER]


def licence_words(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def postings(docs: DataFrame, templates: list[Template], id_col: str, text_col: str) -> DataFrame:
    """id, n_words, hits: the places (from 0) of template words in each text, in order."""
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), SEPARATORS)
    lead = F.when(F.element_at("cut", 1) == "", 1).otherwise(0)
    trail = F.when((F.size("cut") > 1) & (F.element_at("cut", -1) == ""), 1).otherwise(0)
    split = docs.select(F.col(id_col).alias("id"), cut.alias("cut")).select("id", "cut", lead.alias("lead"), (F.size("cut") - lead - trail).alias("n_words"))
    # A template word is ASCII, and lower() alters an ASCII word in its A-Z only.
    plain = F.transform("cut", lambda w, k: F.struct((k - F.col("lead")).alias("at"), F.when(F.octet_length(w) == F.char_length(w), F.lower(w)).otherwise("").alias("word")))
    hits = F.filter(plain, lambda x: x["word"].isin(*licence_words(templates)))
    return split.select("id", F.col("n_words").cast("bigint").alias("n_words"), hits.alias("hits"))


def rarest(index: DataFrame, templates: list[Template]) -> list[int]:
    """For each template the place of the key word that the fewest files hold; of equals the first."""
    held = index.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word"))
    files = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most one row a template word
    return [min(range(t.key_at, t.key_at + len(t.key)), key=lambda k: (files.get(t.words[k], 0), k)) for t in templates]


def places(t: Template, rare: int) -> Column:
    """start and share of each relative position at which the template's key phrase stands in full."""
    words = F.array(*map(F.lit, t.words))

    def near(x: Column, k: Column) -> Column:
        start = x["at"] - rare
        window = F.slice("hits", F.greatest(k + 1 - rare, F.lit(1)), F.lit(2 * len(t.words)))
        aligned = F.filter(window, lambda y: y["at"].between(start, start + len(t.words) - 1) & (F.get(words, F.greatest(y["at"] - start, F.lit(0))) == y["word"]))
        keyed = F.size(F.filter(aligned, lambda y: (y["at"] - start).between(t.key_at, t.key_at + len(t.key) - 1)))
        return F.struct(start.alias("start"), (F.size(aligned) / len(t.words)).alias("share"), (keyed == len(t.key)).alias("keyed"))

    return F.filter(F.transform("hits", lambda x, k: F.when(x["word"] == t.words[rare], near(x, k))), lambda c: c.isNotNull())


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs."""
    index = written(postings(docs, templates, id_col, text_col), "postings")
    tried = index
    for k, rare in enumerate(rarest(index, templates)):
        tried = tried.withColumn(f"p{k}", places(templates[k], rare))
    found = {k: F.filter(f"p{k}", lambda c: c["keyed"] & (c["share"] >= share)) for k in range(len(templates))}
    base = [k for k, t in enumerate(templates) if t.base]
    starts = F.transform(F.concat(*[found[k] for k in base]), lambda c: c["start"])
    best = F.array_max(F.transform(F.concat(*found.values()), lambda c: c["share"]))

    def labels(which: list[int]) -> Column:
        marks = F.array(*[F.when(F.size(found[k]) > 0, templates[k].label) for k in which])
        return F.concat_ws(",", F.sort_array(F.array_distinct(F.filter(marks, lambda x: x.isNotNull()))))

    return tried.select(
        F.col("id").alias(id_col), "n_words", F.size(starts).cast("bigint").alias("n_base"), F.array_min(starts).cast("bigint").alias("first_word"), F.array_max(starts).cast("bigint").alias("last_word"),
        labels(base).alias("base_labels"), labels(list(range(len(templates)))).alias("labels"), F.coalesce(best, F.lit(0.0)).alias("score"),
    )


def oracle(templates: list[Template] = TEMPLATES, share: float = SHARE) -> str:
    rows = ", ".join(f"({k}, {at}, '{w}')" for k, t in enumerate(templates) for at, w in enumerate(t.words))
    kinds = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {t.key_at}, {len(t.key)})" for k, t in enumerate(templates))
    return rf"""
WITH tw(t, tp, word) AS (VALUES {rows}),
kinds(t, label, base, size, key_at, key_size) AS (VALUES {kinds}),
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM split),
tries AS (
  SELECT w.doc_id, tw.t, w.pos - tw.tp AS start, count(*) AS aligned, count(*) FILTER (WHERE tw.tp BETWEEN key_at AND key_at + key_size - 1) AS keyed
  FROM words w JOIN tw USING (word) JOIN kinds ON kinds.t = tw.t GROUP BY 1, 2, 3),
met AS (SELECT doc_id, label, base, start, aligned / size AS share, keyed = key_size AND aligned / size >= {share} AS ok FROM tries JOIN kinds USING (t)),
sums AS (
  SELECT doc_id, count(*) FILTER (WHERE ok AND base) AS n_base, min(start) FILTER (WHERE ok AND base) AS first_word, max(start) FILTER (WHERE ok AND base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE ok) AS labels, max(share) FILTER (WHERE ok) AS score
  FROM met GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM split LEFT JOIN sums USING (doc_id)
"""
