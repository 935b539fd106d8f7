"""Merkle manifest of a dataset as a persistent tree: changed leaves make versions by path copying.

Each group of rows (a language) is a binary tree over its leaves in the order of their ids; the groups'
roots are the leaves of one more tree. H is a hex digest of hex digests; a node without a partner is
digested alone.

1. A leaf digests its row's fields. Leaves are numbered within their group by one sort by range.
2. A tree is cut at aligned places into blocks of 2**BLOCK_LEVELS leaves. A task grows the nodes of a
   block, and every leaf takes its siblings up to the block's root with it.
3. A changed leaf makes a version of its block: the ancestors of the leaf are copied, every other node
   is shared with the version it was made from.
4. Blocks' roots are leaves of the tree above, which is grown in the same way. Versions are not gathered
   there: each is a row that meets the path of its block by an equal key and goes on copying ancestors
   along it, so that no task holds more than its share of versions.

Defined results: a null field is written `-`; a null group comes first, a null id too. Rows of one group
and id stand in the order of their leaves' digests, so repeated rows are neighbours. An empty table has
no rows and no root. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, placed, record, ships, written

BLOCK_LEVELS = 10
TAMPER_EVERY = 7


class Node(NamedTuple):
    digest: str
    left: Node | None = None
    right: Node | None = None


def joined(left: Node, right: Node | None) -> Node:
    both = left.digest + (right.digest if right else "")
    return Node(hashlib.sha256(both.encode("ascii")).hexdigest(), left, right)


def grown(leaves: list[str], levels: int) -> tuple[Node, int]:
    """Root over the leaves, and the levels climbed: `levels`, or with 0 as many as leave one node."""
    nodes, height = [Node(x) for x in leaves], 0
    while height < levels if levels else len(nodes) > 1:
        nodes = [joined(nodes[k], nodes[k + 1] if k + 1 < len(nodes) else None) for k in range(0, len(nodes), 2)]
        height += 1
    return nodes[0], height


def version(root: Node, height: int, at: int, leaf: str) -> Node:
    """Root of the version whose leaf `at` is another: its ancestors are copied, all else is shared."""
    if not height:
        return Node(leaf)
    if at >> (height - 1) & 1:
        return joined(root.left, version(root.right, height - 1, at, leaf))
    return joined(version(root.left, height - 1, at, leaf), root.right)


def siblings(root: Node, height: int, at: int) -> str:
    """For each level upwards: l or r and the sibling's digest, or - where there is none; joined by commas."""
    steps = []
    for level in range(height - 1, -1, -1):
        if at >> level & 1:
            steps.append("l" + root.left.digest)
            root = root.right
        else:
            steps.append("r" + root.right.digest if root.right else "-")
            root = root.left
    return ",".join(reversed(steps))


ROWS = "id bigint, tree string, pos bigint, total bigint, digest string, changed string"
BLOCKS = "id bigint, tree string, pos bigint, total bigint, digest string, path string, version string, top string"


def in_blocks(rows: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Rows of ROWS with their path and their version's root inside their block; top: the block's own root, on its first row."""
    arrow_rows(rows.sparkSession)
    width = 1 << levels

    def block(held: list[tuple]) -> list[tuple]:
        root, height = grown([r[4] for r in held], levels if held[0][3] > width else 0)
        out = []
        for at, (key, tree, pos, total, digest, changed) in enumerate(held):
            made = root if changed is None else version(root, height, at, changed)
            out.append((key, tree, pos, total, digest, siblings(root, height, at), made.digest, None if at else root.digest))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for _, held in groupby(stream, key=lambda r: (r[1], r[2] >> levels)):
            yield record(block(list(held)), BLOCKS)

    names = [x.split()[0] for x in ROWS.split(", ")]
    dealt = rows.select(*names).withColumn("_block", F.expr(f"pos >> {levels}")).repartition("tree", "_block").sortWithinPartitions("tree", "pos")
    return dealt.select(*names).mapInArrow(run, BLOCKS)


def climbed(nodes: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, pos, path, top) of nodes (tree, pos, total, digest): the path of each to its tree's root, and that root."""
    if not nodes.where("total > 1").limit(1).count():
        return nodes.select("tree", "pos", F.lit("").alias("path"), F.col("digest").alias("top"))
    rows = nodes.select(F.lit(None).cast("bigint").alias("id"), "tree", "pos", "total", "digest", F.lit(None).cast("string").alias("changed"))
    blocks = written(in_blocks(rows, levels), "nodes")
    above = written(climbed(block_roots(blocks, levels), levels), "paths").withColumnsRenamed({"path": "_above", "pos": "_block", "top": "_top"})
    return blocks.drop("top").withColumn("_block", F.expr(f"pos >> {levels}")).join(above, ["tree", "_block"]).select("tree", "pos", along(F.col("path"), F.col("_above")).alias("path"), F.col("_top").alias("top"))


def block_roots(blocks: DataFrame, levels: int) -> DataFrame:
    return blocks.where(F.col("top").isNotNull()).select("tree", F.expr(f"pos >> {levels}").alias("pos"), F.expr(f"(total + {(1 << levels) - 1}) >> {levels}").alias("total"), F.col("top").alias("digest"))


def along(lower: Column, upper: Column) -> Column:
    """The longer path of two that follow each other."""
    return F.concat_ws(",", F.nullif(lower, F.lit("")), F.nullif(upper, F.lit("")))


def folded(digest: Column, path: Column) -> Column:
    """The root of a version: its ancestors along the path are digested anew."""
    steps = F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, ","))
    other = lambda step: F.substr(step, F.lit(2))
    return F.aggregate(steps, digest, lambda made, step: F.sha2(F.when(step.startswith("l"), F.concat(other(step), made)).otherwise(F.concat(made, other(step))), 256))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def manifest(rows: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """id, tree, leaf, subroot, root, path, folded: one row per row of rows (id, tree, leaf, changed).

    tree orders the groups and is never null. folded is the root of the version that has `changed` for
    the leaf, or of the first version where changed is null.
    """
    leaves = placed(written(rows, "leaves"), "tree", [F.asc_nulls_first("id"), F.col("leaf")]).withColumnRenamed("leaf", "digest")
    blocks = written(in_blocks(leaves, levels), "blocks")
    trees = written(climbed(block_roots(blocks, levels), levels), "trees")
    roots = placed(trees.where("pos = 0").select(F.lit("").alias("all"), "tree", F.col("top").alias("digest")), "all", [F.col("tree")])
    roots = written(roots, "roots")
    whole = climbed(roots.select(F.col("all").alias("tree"), "pos", "total", "digest"), levels).select("pos", F.col("path").alias("_last"), F.col("top").alias("root"))
    tops = roots.join(whole, "pos").select("tree", F.col("digest").alias("subroot"), "_last", "root")
    uppers = trees.join(tops, "tree").select("tree", F.col("pos").alias("_block"), along(F.col("path"), F.col("_last")).alias("_upper"), "subroot", "root")
    full = blocks.withColumn("_block", F.expr(f"pos >> {levels}")).join(written(uppers, "uppers"), ["tree", "_block"])
    return full.select(
        "id", "tree", F.col("digest").alias("leaf"), "subroot", "root", along(F.col("path"), F.col("_upper")).alias("path"), folded(F.col("version"), F.col("_upper")).alias("folded"),
    )


def tamper_check(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of documents, one in TAMPER_EVERY (by its id's checksum) with n_chars one too high."""
    plain = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [(F.col("n_chars").cast("decimal(20,0)") + 1) if k == 3 else c for k, c in enumerate(plain)]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf(plain).alias("leaf"), F.when(hit, leaf(more)).alias("changed"))
    found = manifest(rows, levels)
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.translate("path", "lr-,", ""), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


ORACLE = """
WITH RECURSIVE
bits(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
sums AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM documents, crcs),
f AS (SELECT doc_id, lang, n_chars, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
leaves AS (
  SELECT f.doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY f.doc_id) - 1 AS pos, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN h % 7 = 0 THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed
  FROM f JOIN sums USING (doc_id)),
tree(lang, level, pos, digest) AS (
  SELECT lang, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM tree) WHERE n > 1 GROUP BY lang, level + 1, pos // 2),
subs AS (SELECT lang, level AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY level DESC) AS r FROM tree) WHERE r = 1),
tops(level, pos, digest) AS (
  SELECT 0, pos, subroot FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level + 1, pos // 2),
whole AS (SELECT level AS top_height, digest AS root FROM tops ORDER BY level DESC LIMIT 1),
steps AS (
  SELECT l.doc_id, g.level AS step, (l.pos >> g.level) % 2 AS on_right, t.digest FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang JOIN range(64) g(level) ON g.level < s.height
    LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = g.level AND t.pos = xor(l.pos >> g.level, 1)
  UNION ALL
  SELECT l.doc_id, s.height + g.level, (s.pos >> g.level) % 2, t.digest FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN whole JOIN range(64) g(level) ON g.level < top_height
    LEFT JOIN tops t ON t.level = g.level AND t.pos = xor(s.pos >> g.level, 1)),
proofs AS (SELECT doc_id, string_agg(digest, '' ORDER BY step) AS sibs FROM steps GROUP BY 1),
fold(doc_id, step, digest) AS (
  SELECT doc_id, 0, coalesce(changed, leaf) FROM leaves
  UNION ALL
  SELECT fold.doc_id, fold.step + 1, sha256(CASE WHEN on_right = 1 THEN coalesce(s.digest, '') || fold.digest ELSE fold.digest || coalesce(s.digest, '') END) FROM fold JOIN steps s ON s.doc_id = fold.doc_id AND s.step = fold.step),
ends AS (SELECT doc_id, arg_max(digest, step) AS folded_root FROM fold GROUP BY 1)
SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(sibs, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subs s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN whole LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN ends e ON e.doc_id = l.doc_id
"""

ships(__name__)
