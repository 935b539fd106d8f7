"""The pipeline, stage by stage and as a whole, against brute force on a small corpus."""

import hashlib
import random

import pytest
from test_operators import check_pieces, exact_brute, passages_brute, words

import corpus_pipeline
from tidemark.llm import quality, suffix

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Plain texts and junk, copies, near copies, shared passages, null and empty texts; labels for some."""
    rng = random.Random(11)
    passage = words(rng, 130)
    plain = [words(rng, rng.randrange(40, 200)) for _ in range(50)]
    texts = [*plain, *plain[:5], plain[0].upper(), plain[1], *[f"{t} x" for t in plain[5:9]], *[f"{words(rng, 60)} {passage} {words(rng, 60)}" for _ in range(6)]]
    junk = [" ".join(f"%%%w{rng.randrange(50)}###&&&" for _ in range(40)) for _ in range(30)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, *junk])] + [(900, "", "en", "s", 0), (901, None, None, None, None)]
    rng.shuffle(rows)
    bad = {k for k, t, *_ in rows if t and "%%%" in t}
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 0 if k in bad else 1) for k, t, *_ in rows if t and k % 4], "doc_id bigint, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, bad


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """What each stage returned, written and read again."""
    folder, out = corpus[0], [spark.read.parquet(f"{corpus[0]}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, out[-1], folder).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    for got in stages[1:-1]:
        assert got.dtypes == stages[0].dtypes


def test_quality_stage_rejects_junk_only(stages, corpus):
    _, rows, bad = corpus
    kept = {r.doc_id for r in stages[1].collect()}
    assert not kept & bad
    assert {r[0] for r in rows if r[1]} - bad <= kept


def test_exact_stage_keeps_the_last_of_equal_texts(stages):
    rows = [tuple(r) for r in stages[1].collect()]
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(r[0] for r in exact_brute(rows) if r[3])


def test_near_stage_keeps_the_first_of_near_texts(stages):
    rows = [tuple(r) for r in stages[2].collect()]
    classes = near_brute({r[0]: r[1] or "" for r in rows})
    assert any(k != low for k, low in classes.items())
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(k for k, low in classes.items() if k == low)


def test_suffix_stage_cuts_shared_passages(stages):
    rows = [tuple(r) for r in stages[3].collect()]
    want = {r[0]: (r[2], r[4]) for r in passages_brute(rows)}
    assert any(n for n, _ in want.values())
    got = {r.doc_id: r for r in stages[4].collect()}
    assert got.keys() == want.keys()
    for k, (_, sha) in want.items():
        assert hashlib.sha256((got[k].text or "").encode()).hexdigest() == sha
        assert got[k].n_chars == (None if got[k].text is None else len(got[k].text))


def test_packing_stage_packs_all(stages):
    check_pieces(stages[5].collect(), [tuple(r) for r in stages[4].collect()])


def test_run_is_its_stages(spark, corpus, stages):
    piece = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
    got = corpus_pipeline.run(spark, corpus[0]).collect()
    whole = lambda rows: sorted({(r.doc_id, r.doc_tokens) for r in rows}, key=repr)
    assert whole(got) == whole(stages[5].collect())
    assert sum(piece(r)[2] for r in got) == sum(r.length for r in stages[5].collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_labels_keep_all(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.scored(docs, model, only=0.5).count() == docs.count()


def test_repeated_rows_and_ids_leave_one_of_each_text(spark, corpus):
    """Repeated rows, null ids and one id with two texts: each text stays once through all the deduplication."""
    rng = random.Random(29)
    a, b, c, d, e, f = (words(rng, 120, 10**6) for _ in range(6))
    rows = [(1, a), (1, a), (2, b), (None, b), (None, c), (None, c), (5, d), (5, e), (6, d), (7, f), (None, f"{f} x")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], COLUMNS).repartition(3)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, corpus[0])
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (6, d), (5, e), (7, f)], key=repr)


def near_brute(texts, least=0.8):
    """The least key of each text's component, by the resemblance of all pairs."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= least * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both >= least * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {k: top(k) for k in keys}


def test_near_stage_finds_near_copies_of_any_bit_distance(spark):
    """Words replaced, chains of edits and a crowd of near copies, beside texts that share less than 0.8."""
    rng = random.Random(17)
    texts = []
    for _ in range(12):
        now = words(rng, rng.randrange(50, 150)).split()
        for _ in range(rng.randrange(2, 9)):
            texts.append(" ".join(now))
            for _ in range(rng.randrange(1, 4)):
                now[rng.randrange(len(now))] = words(rng, 1)
    crowd = words(rng, 100).split()
    texts += [" ".join(words(rng, 1) if k == j % 100 else w for k, w in enumerate(crowd)) for j in range(90)]
    texts += [f"{words(rng, 30)} {' '.join(crowd[:60])}" for _ in range(5)] + ["", " \n", "two words", "Two  words", "two wards"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], COLUMNS).repartition(3)
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    want = near_brute(dict(enumerate(texts)))
    assert got == {k for k, low in want.items() if k == low}
    assert len(got) < len(texts) - 100


@pytest.mark.parametrize("crowded", [False, True])
def test_suffix_stage_cuts_passages_of_over_50_words(spark, monkeypatch, crowded):
    """Passages of 51 to 65 short words go wherever they stand; one of 50 words stays."""
    if crowded:
        monkeypatch.setattr(suffix, "CLASS_ROWS", 2)
    rng = random.Random(31)
    short = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(100)) for _ in range(n))
    passages = {n: short(n) for n in range(50, 66)}
    rows, want = [], {}
    for n, passage in passages.items():
        assert len(passage) < 400
        for copy in range(3):
            head, tail = f"{words(rng, 30)} h{n}-{copy}", f"t{n}-{copy} {words(rng, 30)}"
            glue = "\n" if copy == 2 else " "
            rows.append((len(rows), f"{head} {passage.replace(' ', glue)} {tail}"))
            want[rows[-1][0]] = f"{head}  {tail}" if n > 50 else rows[-1][1]
    rows += [(1000, passages[51]), (1001, passages[51]), (1002, passages[50]), (1003, "é " + passages[60] + " ü")]
    want |= {1000: "", 1001: "", 1002: passages[50], 1003: "é  ü"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], COLUMNS).repartition(3)
    got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
    assert got == want
