"""The near stage looks at pairs by their SimHash fingerprints."""

import random

import pytest
from test_operators import words

import corpus_pipeline
from tidemark.llm import resemblance

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def kept(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], COLUMNS).repartition(3)
    return {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}


def test_fingerprint_bit_by_bit():
    rng = random.Random(4)
    for n in (1, 2, 5, 5000):
        grams = resemblance.shingles(words(rng, n + 4).encode())
        want = sum(1 << b for b in range(64) if 2 * sum(int(g) >> b & 1 for g in grams) > len(grams))
        assert resemblance.fingerprint(grams) % (1 << 64) == want


@pytest.mark.parametrize("bands", ["simhash alone", "fingerprints apart"])
def test_fingerprints_decide_what_is_looked_at(spark, monkeypatch, bands):
    """Without a shared band key near fingerprints still find their texts; without near ones the keys find none."""
    rng = random.Random(3)
    base = [words(rng, 1500) for _ in range(8)]
    texts = [*base, *(f"{t} tail" for t in base)]
    if bands == "simhash alone":
        plain, seen = resemblance.band_keys, random.Random(9)
        monkeypatch.setattr(resemblance, "band_keys", lambda grams: plain(grams) * 0 + seen.randrange(1 << 62))
        assert kept(spark, texts) == set(range(8))
    else:
        monkeypatch.setattr(resemblance, "fingerprint", lambda grams: hash(grams.tobytes()) | 1)
        monkeypatch.setattr(resemblance, "WIDE", 0)
        assert kept(spark, texts) == set(range(16))
