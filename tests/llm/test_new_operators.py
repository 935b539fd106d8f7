"""Mixing, Merkle manifest and periodic runs against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import merkle, mixing, periodic_runs
from tidemark.llm.common import placed, with_rid

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, tree string, rid string, pos string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, size=2000):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(150)] + [words(rng, 9000), "a " * 4000, "a b " * 900 + "c", "a　b \x1c\x1d é\x0bc", "", " \t\n", None, None, "x" * 50000]
    out = [(k * 3, t, rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s10", "é", None]), rng.choice([None, len(t or "")]), "k", "t", "r", "p") for k, t in enumerate(texts)]
    return [*out, (-9, "a lone source", "xx", "z", 3, "k", "t", "r", "p")]


@pytest.fixture(scope="module")
def odd(rows):
    """Repeated rows and ids, null ids."""
    return [*rows, *rows[:12], (None, *rows[3][1:]), (None, *rows[3][1:]), (None, None, None, None, None, "", "", "", ""), (rows[5][0], *rows[6][1:])]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


# --- mixing ----------------------------------------------------------------------------------------


def targets_brute(sizes, share=1.5, most=2.0):
    """The excess is shared anew, one round after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    full, target = set(), dict.fromkeys(order, 0.0)
    rest = share * sum(sizes.values())
    while rest > 1e-9:
        open_ = [s for s in order if s not in full]
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += rest * weight[s] / total
        rest = 0.0
        for s in open_:
            if target[s] >= most * sizes[s]:
                rest += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


def mixing_checked(got, rows):
    size_of = [(r[0], len(WORD.findall(r[1] or "")), r[3]) for r in rows]
    sizes = defaultdict(int)
    for _, n, source in size_of:
        sizes[source] += n
    want = targets_brute(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == sorted(((d, n, sizes[s]) for d, n, s in size_of), key=repr)
    by_source = defaultdict(list)
    key = {(d, n, sizes[s]): s for d, n, s in size_of}
    for r in got:
        by_source[key[r.doc_id, r.size, r.source_size]].append(r)
    for source, rs in by_source.items():
        assert all(r.target == pytest.approx(want[source], rel=1e-9) for r in rs)
        assert abs(sum(r.taken for r in rs) - want[source]) <= 0.5 + 1e-6
        assert all(0 <= r.taken <= 2 * r.size for r in rs)
        assert sum(r.taken % r.size != 0 for r in rs if r.size) <= 1  # one document at most is taken in part


@pytest.mark.parametrize("fan", [2, 5, 256])
def test_mixing_takes_the_targets(spark, rows, fan):
    mixing_checked(mixing.mixed(frame(spark, rows), fan=fan).collect(), rows)


def test_mixing_with_repeats_and_null_ids(spark, odd):
    a = mixing.mixed(frame(spark, odd), fan=4).collect()
    assert len(a) == len(odd)
    sources = defaultdict(lambda: [0, 0.0])
    for r in a:
        sources[r.source_size][0] += r.taken
        sources[r.source_size][1] = r.target
    assert all(abs(taken - target) <= 0.5 + 1e-6 for taken, target in sources.values())


def test_mixing_reruns_agree(spark, rows):
    runs = [sorted(map(tuple, mixing.mixed(frame(spark, rows).repartition(n), fan=4).collect())) for n in (1, 5)]
    assert runs[0] == runs[1]


def fold_brute(docs, fan, blocks):
    """Copies of each document (id, size, x), by the same tree in plain Python."""
    out = {}

    def number(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)

    def step(held):
        held = sorted(held, key=lambda r: (-r[1], hashlib.md5(str(r[0]).encode()).hexdigest()))
        live = list(held[0])
        for e in held[1:]:
            e = list(e)
            gain, loss = min(live[1] - live[2], e[2]), min(live[2], e[1] - e[2])
            if number(f"{live[0]},{e[0]}") / 2**48 * (gain + loss) < loss:
                live[2], e[2] = (live[1], e[2] - (live[1] - live[2])) if live[1] - live[2] <= e[2] else (live[2] + e[2], 0)
            else:
                live[2], e[2] = (0, e[2] + live[2]) if live[2] <= e[1] - e[2] else (live[2] - (e[1] - e[2]), e[1])
            done, live = (live, e) if live[2] in (0, live[1]) else (e, live)
            out[done[0]] = done[2] / done[1]
        return live

    level = defaultdict(list)
    for d in docs:
        level[number(str(d[0])) % blocks].append(d)
    while True:
        lives = {b: step(held) for b, held in level.items()}
        if blocks <= 1:
            return out, lives[0]
        blocks = -(-blocks // fan)
        level = defaultdict(list)
        for b, live in lives.items():
            level[b // fan].append(live)


@pytest.mark.parametrize("fan", [3, 256])
def test_rounding_against_the_fold(spark, fan):
    rng = random.Random(4)
    docs = [(k, words(rng, rng.randrange(1, 90)), "en", "only" if k < 300 else "other", 0, "", "", "", "") for k in range(400)]
    got = {r.doc_id: r for r in mixing.mixed(frame(spark, docs), fan=fan).collect()}
    for lo, hi in ((0, 300), (300, 400)):
        some = got[lo]
        rate = some.target / some.source_size
        whole = int(rate)
        if rate == whole:
            assert all(got[k].copies == whole for k in range(lo, hi))
            continue
        want, live = fold_brute([(k, got[k].size, (rate - whole) * got[k].size) for k in range(lo, hi)], fan, -(-(hi - lo) // fan))
        assert {k: got[k].copies - whole for k in range(lo, hi) if k != live[0]} == want
        assert got[live[0]].taken == whole * live[1] + int(live[2] + 0.5)


def test_rounding_keeps_expectations(spark):
    """Equal documents are taken equally often on either side of the order of ids."""
    docs = [(k, words(random.Random(k), 10), "en", "s" if k % 4 else "t", 0, "", "", "", "") for k in range(4000)]
    got = mixing.mixed(frame(spark, docs), weights=(2, 1)).collect()
    mine = sorted((r for r in got if r.source_size == 30000), key=lambda r: r.doc_id)
    assert 1 < mine[0].target / 30000 < 2
    for half in (mine[:1500], mine[1500:]):
        assert np.mean([r.copies for r in half]) == pytest.approx(mine[0].target / 30000, abs=0.05)


def test_mixing_of_nothing(spark):
    assert mixing.mixed(frame(spark, [])).collect() == []
    got = mixing.mixed(frame(spark, [(1, None, None, None, None, "", "", "", ""), (2, " ", "en", "s", 1, "", "", "", "")])).collect()
    assert {tuple(r) for r in got} == {(1, 0, 0, 0.0, 0, 0.0), (2, 0, 0, 0.0, 0, 0.0)}


# --- Merkle manifest -------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_brute(row, more=0):
    doc, text, lang, source, n = row[:5]
    fields = [doc, source, lang, n if n is None else n + more, text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels_brute(leaves):
    out = [leaves] if leaves else [[]]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def proof_brute(levels, at):
    """The other node of each level's run, or none, and whether it stands before."""
    steps = []
    for level in levels[:-1]:
        other = at ^ 1
        steps.append((level[other] if other < len(level) else "", other < at))
        at //= 2
    return steps


def merkle_brute(rows):
    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_brute(r)))
        trees[lang] = levels_brute([leaf_brute(r) for r in langs[lang]])
    top = levels_brute([trees[lang][-1][0] for lang in order])
    root, out = top[-1][0] if rows else None, []
    for k, lang in enumerate(order):
        for at, r in enumerate(langs[lang]):
            steps = proof_brute(trees[lang], at) + proof_brute(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            made = leaf_brute(r, int(hit))
            for other, before in steps:
                made = h(other, made) if before else h(made, other)
            out.append((r[0], leaf_brute(r), trees[lang][-1][0], root, h(*(s for s, _ in steps)), made, made == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_merkle(spark, rows, levels):
    assert sorted(map(tuple, merkle.tamper_check(frame(spark, rows), levels).collect()), key=repr) == merkle_brute(rows)


def test_merkle_with_repeats_and_null_ids(spark, odd):
    assert sorted(map(tuple, merkle.tamper_check(frame(spark, odd), 2).collect()), key=repr) == merkle_brute(odd)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_merkle_of_few(spark, rows, n):
    assert sorted(map(tuple, merkle.tamper_check(frame(spark, rows[:n])).collect()), key=repr) == merkle_brute(rows[:n])


def test_versions_share_what_they_do_not_copy():
    leaves = [h(str(k)) for k in range(37)]
    root, height = merkle.grown(leaves, 0)

    def nodes(node):
        return {} if node is None else {id(node): node} | nodes(node.left) | nodes(node.right)

    first = nodes(root)
    for at in (0, 17, 36):
        made = merkle.version(root, height, at, h("other"))
        new = [n for k, n in nodes(made).items() if k not in first]
        assert len(new) == height + 1
        changed = [*leaves]
        changed[at] = h("other")
        assert made.digest == levels_brute(changed)[-1][0] and root.digest == levels_brute(leaves)[-1][0]


def test_placed_numbers_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice("aaab"), rng.choice([None, *range(50)])) for _ in range(700)]
    got = placed(spark.createDataFrame(data, "g string, v int").repartition(5), "g", ["v"]).collect()
    for g in "ab":
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine))) and all(r.total == len(mine) for r in mine)
        assert [r.v for r in mine] == sorted((r.v for r in mine), key=lambda v: (v is not None, v or 0))


def test_rows_without_ids_are_dealt_to_many_tasks(spark):
    docs = spark.createDataFrame([(None, f"t{k}") for k in range(4000)], "id bigint, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_rid(docs, "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({r.rid for r in got}) == 4000
    assert len({r.rid >> 33 for r in got}) > 3


# --- periodic runs ---------------------------------------------------------------------------------


def runs_brute(w):
    """Every period, every stretch: the smallest period of a stretch names it."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=5), max_size=6))
def test_runs_against_brute_force(texts):
    texts = [[b"%d" % x for unit, times in text for x in unit * times] for text in texts]
    assert periodic_runs.runs_of(texts) == [runs_brute(t) for t in texts]


def test_runs_do_not_depend_on_their_neighbours():
    rng = random.Random(8)
    texts = [[b"%d" % rng.randrange(2) for _ in range(rng.randrange(300))] for _ in range(40)]
    assert periodic_runs.runs_of(texts) == [periodic_runs.runs_of([t])[0] for t in texts] == [runs_brute(t) for t in texts]


def digest_brute(row):
    doc, w = row[0], WORD.findall(row[1] or "")
    hash_, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(w)
    if hash_ % 10 == 0 and n:
        g = hash_ // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), h(listed), h(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_digests(spark, odd):
    small = [r for r in odd if len(r[1] or "") < 20000]
    assert sorted(map(tuple, periodic_runs.run_digests(frame(spark, small)).collect()), key=repr) == sorted(map(digest_brute, small), key=repr)
    assert sum(r[1] for r in map(digest_brute, small)) > 10


def test_long_texts_and_outputs(spark):
    unit = " ".join(f"u{k}" for k in range(700))
    docs = frame(spark, [(1, " ".join(["a"] * 20000), *["x"] * 2, 0, *[""] * 4), (2, f"x y {unit} {unit} {unit} {unit} z", *["x"] * 2, 0, *[""] * 4), (3, None, *["x"] * 2, 0, *[""] * 4), (4, "w" * 300000, *["x"] * 2, 0, *[""] * 4)])
    assert sorted(map(tuple, periodic_runs.periodic_runs(docs).collect())) == [(1, 0, 20000, 1), (2, 2, 2800, 700)]
    assert {r.doc_id: r.text for r in periodic_runs.collapsed_texts(docs).collect()} == {1: "a", 2: f"x y {unit} z", 3: "", 4: "w" * 300000}


def test_runs_of_nothing(spark):
    assert periodic_runs.run_digests(frame(spark, [])).collect() == []
    assert periodic_runs.runs_of([]) == [] and periodic_runs.runs_of([[]]) == [[]]
