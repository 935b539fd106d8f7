"""Mixing sources to target weights by pivotal dependent rounding.

1. Sizes are counted in one pass over the texts; all else works on (source, id, size).
2. The target words of a source: SHARE of all words by weight, at most MOST times its own; the excess is
   shared anew by weight among the others until none is above.
3. Every document of a source has the same fractional number of copies, target / source size. Its whole
   part is taken; the fraction is a probability that must become 0 or 1 without changing what the source
   takes. A pair of documents is rounded by moving words from one to the other, in a random direction
   that keeps each one's expectation, until one of the two has all or nothing of its copy. The other goes
   on to the next pair. Large documents are paired first, so that small ones are left.
4. The reduction is a tree: the documents of a source are dealt to blocks of about FAN by a digest of
   their id, a block is folded where its rows met, and the one document it leaves undecided goes to a
   block of FAN such residuals, up to one residual a source. A hot source is so many blocks, each with
   a bounded number of rows.
5. The last residual of a source, at most one document, is taken in part, to the nearest word, so that a
   source takes its target.

Random numbers are digests of the two documents, so reruns agree. Everything is DataFrame expressions.

Defined results: a null text has size 0; nothing is taken of a document without words. A null source is
a source of its own and comes last. Without any words all targets are 0. Ids may be null or repeated;
rows are then told apart by their place in the order of ids. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import placed, with_rid, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
FAN = 256
ITEM = "struct<order:bigint,tie:string,rid:bigint,id:bigint,size:bigint,x:double>"
DONE = "struct<rid:bigint,id:bigint,size:bigint,part:double>"


def targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (key, source_size, weight) with `target`. A round sends two sums to the driver; the set of full sources grows in every round."""
    full = F.col("weight") * F.lit(0.0) > 0
    level, met = 0.0, -1
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        row = sources.agg(
            F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")
        ).first()
        if row.n == met or not row.open:
            return sources.withColumn("target", F.least(most * F.col("source_size"), F.lit(level) * F.col("weight")))
        met, level = row.n, (share * all_words - most * row.held) / row.open
        full = F.lit(level) * F.col("weight") > most * F.col("source_size")


# live: the document that is not yet decided, of which x words are taken. A pair moves words until one of
# the two has nothing or all: `gain` words to the live one, or `loss` words from it to the next one.
STEP = f"""(acc, e) -> transform(array(named_struct(
    'a', acc.live, 'e', e, 'done', acc.done, 'gain', least(acc.live.size - acc.live.x, e.x), 'loss', least(acc.live.x, e.size - e.x),
    'u', cast(conv(substr(md5(concat(cast(acc.live.rid as string), ',', cast(e.rid as string))), 1, 12), 16, 10) as double) / 281474976710656D)),
  p -> case
    when p.u * (p.gain + p.loss) < p.loss and p.a.size - p.a.x <= p.e.x then
      named_struct('live', cast(named_struct('order', p.e.order, 'tie', p.e.tie, 'rid', p.e.rid, 'id', p.e.id, 'size', p.e.size, 'x', p.e.x - (p.a.size - p.a.x)) as {ITEM}), 'done', array_append(p.done, cast(named_struct('rid', p.a.rid, 'id', p.a.id, 'size', p.a.size, 'part', 1D) as {DONE})))
    when p.u * (p.gain + p.loss) < p.loss then
      named_struct('live', cast(named_struct('order', p.a.order, 'tie', p.a.tie, 'rid', p.a.rid, 'id', p.a.id, 'size', p.a.size, 'x', p.a.x + p.e.x) as {ITEM}), 'done', array_append(p.done, cast(named_struct('rid', p.e.rid, 'id', p.e.id, 'size', p.e.size, 'part', 0D) as {DONE})))
    when p.a.x <= p.e.size - p.e.x then
      named_struct('live', cast(named_struct('order', p.e.order, 'tie', p.e.tie, 'rid', p.e.rid, 'id', p.e.id, 'size', p.e.size, 'x', p.e.x + p.a.x) as {ITEM}), 'done', array_append(p.done, cast(named_struct('rid', p.a.rid, 'id', p.a.id, 'size', p.a.size, 'part', 0D) as {DONE})))
    else
      named_struct('live', cast(named_struct('order', p.a.order, 'tie', p.a.tie, 'rid', p.a.rid, 'id', p.a.id, 'size', p.a.size, 'x', p.a.x - (p.e.size - p.e.x)) as {ITEM}), 'done', array_append(p.done, cast(named_struct('rid', p.e.rid, 'id', p.e.id, 'size', p.e.size, 'part', 1D) as {DONE})))
  end)[0]"""


def folded(items: DataFrame, by: list[str]) -> DataFrame:
    """Each block's documents, largest first, rounded pair by pair: live and done."""
    blocks = items.groupBy(*by, "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    start = f"named_struct('live', items[0], 'done', cast(array() as array<{DONE}>))"
    return blocks.select(*by, "block", F.expr(f"aggregate(slice(items, 2, size(items)), {start}, {STEP})").alias("f")).select(*by, "block", "f.live", "f.done")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, fan: int = FAN) -> DataFrame:
    """id_col, size, source_size, target, taken, copies: one row per row of docs."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), source_col), F.lit("null"))  # "=" comes before "n"
    sized = with_rid(written(docs.select(F.col(id_col).cast("bigint").alias("id"), key.alias("key"), size.alias("size")), "sizes"), "id")
    sources = written(sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    ranked = placed(sources.withColumn("all", F.lit(0)), "all", [F.col("key")])
    ranked = written(ranked.select("key", "source_size", "n", F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).alias("weight")), "weights")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = written(targets(ranked, share, most).withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("blocks", F.ceil(F.col("n") / fan)), "rates")
    rows = sized.join(rates.select("key", "source_size", "target", "rate", "whole", "blocks"), "key")
    open_ = (F.col("rate") > F.col("whole")) & (F.col("size") > 0)
    tie = F.md5(F.col("rid").cast("string"))
    item = F.struct((-F.col("size")).alias("order"), tie.alias("tie"), "rid", "id", "size", ((F.col("rate") - F.col("whole")) * F.col("size")).alias("x"))
    by = ["key", "source_size", "target", "whole"]
    live = rows.where(open_).select(*by, (F.conv(F.substr(tie, F.lit(1), F.lit(12)), 16, 10).cast("bigint") % F.col("blocks")).alias("block"), item.alias("item"))
    most_blocks = rates.agg(F.max("blocks")).first()[0] or 1
    decided = rows.where(~open_).select("id", "size", "source_size", "target", "whole", F.lit(0.0).alias("part"))
    while True:
        level = written(folded(live, by), "fold")
        decided = decided.unionByName(level.select("source_size", "target", "whole", F.explode("done").alias("d")).select("d.id", "d.size", "source_size", "target", "whole", "d.part"))
        if most_blocks <= 1:
            break
        most_blocks = -(-most_blocks // fan)
        live = level.select(*by, F.expr(f"block div {fan}").alias("block"), F.col("live").alias("item"))
    last = level.select("live.id", "live.size", "source_size", "target", "whole", (F.round("live.x") / F.col("live.size")).alias("part"))
    return decided.unionByName(last).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.round(F.col("part") * F.col("size"))).cast("bigint").alias("taken"), (F.col("whole") + F.col("part")).alias("copies")
    )


def oracle(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, fan: int = FAN, levels: int = 3) -> str:
    """SQL for up to fan ** levels documents a source, of a table whose ids are unique and not null."""
    gain, loss = "least(a.size - a.x, b.x)", "least(a.x, b.size - b.x)"
    u = "CAST(CAST('0x' || substr(md5(a.id || ',' || b.id), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    up = f"({u}) * ({gain} + {loss}) < {loss}"

    def left(who: str, x: str) -> str:
        return f"struct_pack(id := {who}.id, size := {who}.size, x := CAST({x} AS DOUBLE))"

    def gone(who: str, part: int) -> str:
        return f"struct_pack(id := {who}.id, size := {who}.size, part := CAST({part} AS DOUBLE))"

    def cases(pick: int) -> str:
        ways = [(left("b", "b.x - (a.size - a.x)"), gone("a", 1)), (left("a", "a.x + b.x"), gone("b", 0)), (left("b", "b.x + a.x"), gone("a", 0)), (left("a", "a.x - (b.size - b.x)"), gone("b", 1))]
        return f"CASE WHEN {up} AND a.size - a.x <= b.x THEN {ways[0][pick]} WHEN {up} THEN {ways[1][pick]} WHEN a.x <= b.size - b.x THEN {ways[2][pick]} ELSE {ways[3][pick]} END"

    merge = f"struct_pack(live := {cases(0)}, done := list_append(p.done, {cases(1)}))".replace("a.", "p.live.").replace("b.", "q.live.")
    first = "list(struct_pack(live := struct_pack(id := id, size := size, x := x), done := CAST([] AS STRUCT(id BIGINT, size BIGINT, part DOUBLE)[])) ORDER BY size DESC, md5(CAST(id AS VARCHAR)), id)"
    folds = "".join(
        f"f{k} AS (SELECT key, block, list_reduce(items, lambda p, q: {merge}) AS f FROM (SELECT key, block, {first} AS items FROM {'rounded' if k == 0 else f'i{k}'} GROUP BY key, block)),\n"
        f"i{k + 1} AS (SELECT key, block // {fan} AS block, f.live.id AS id, f.live.size AS size, f.live.x AS x FROM f{k}),\n"
        for k in range(levels)
    )
    done = " UNION ALL ".join(f"SELECT unnest(f.done, recursive := true) FROM f{k}" for k in range(levels))
    return rf"""
WITH RECURSIVE
sized AS (SELECT doc_id AS id, coalesce('=' || source, 'null') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
src AS (SELECT key, CAST(sum(size) AS BIGINT) AS ss, count(*) AS n, CAST([{', '.join(map(str, weights))}][(row_number() OVER (ORDER BY key) - 1) % {len(weights)} + 1] AS BIGINT) AS w, CAST(sum(sum(size)) OVER () AS DOUBLE) AS total FROM sized GROUP BY key),
lv(step, n, level) AS (
  SELECT 0, CAST(-1 AS BIGINT), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT step + 1, count(*) FILTER (WHERE f), ({share} * max(total) - {most} * CAST(coalesce(sum(ss) FILTER (WHERE f), 0) AS DOUBLE)) / CAST(sum(w) FILTER (WHERE NOT f) AS DOUBLE)
  FROM (SELECT lv.step, lv.n, s.ss, s.w, s.total, lv.level * s.w > {most} * s.ss AS f FROM lv, src s)
  GROUP BY step, n HAVING count(*) FILTER (WHERE f) <> n AND count(*) FILTER (WHERE NOT f) > 0),
rates AS (SELECT key, ss, n, least(CAST({most} AS DOUBLE) * ss, level * w) AS target, CASE WHEN ss > 0 THEN least(CAST({most} AS DOUBLE) * ss, level * w) / ss ELSE 0.0 END AS rate FROM src, (SELECT level FROM lv ORDER BY step DESC LIMIT 1)),
open AS (SELECT id, size, key, ss, n, target, rate, floor(rate) AS whole FROM sized JOIN rates USING (key)),
rounded AS (SELECT key, CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 12) AS BIGINT) % CAST(ceil(n / {fan}) AS BIGINT) AS block, id, size, (rate - whole) * size AS x FROM open WHERE rate > whole AND size > 0),
{folds}parts AS ({done} UNION ALL SELECT id, size, round(x) / size AS part FROM i{levels})
SELECT o.id AS doc_id, o.size, o.ss AS source_size, o.target, CAST(o.whole * o.size + round(coalesce(part, 0) * o.size) AS BIGINT) AS taken FROM open o LEFT JOIN parts p ON p.id = o.id
"""
