"""Merkle manifest of a dataset: trees of hashes by lag and lead windows.

A row is a leaf, the hash of its columns; the leaves of a group stand in order of their id. FANOUT neighbours hash to their
parent, level by level, until one node of the group is left, its subroot; the subroots of all groups hash to the root
in the same way.

Each level is a table of nodes (group, position, number of nodes, digest). A window over a run of neighbours gives each node its run's
other digests: lag and lead columns at the fixed offsets 1 to FANOUT - 1, masked by the node's slot in its run and the run's length.
The first child of a run hashes it to the parent, whose position is the run's number; so levels shrink by FANOUT and no level has a row without a node.

Proofs come down again: a node's path is its own siblings before its parent's path, joined on (group, run), on which its window was already shuffled.

Text is read and hashed where it lies and never shuffled. Positions come from ranges of (group, id, digest), numbered in each range after the counts of the ranges before it, so that a group that
holds most rows is many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, table, with_defaults, written

FANOUT = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*columns: Column) -> Column:
    """Lowercase hex sha256 of the columns' texts, concatenated; a null column adds nothing."""
    return F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in columns]), 256)


def field(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and itself, or - if null."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def placed(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """nodes, a table that is written, with pos and n: the row's place in its group g by the order, and the rows of g.

    Rows are dealt by ranges of (g, order); rows equal in all of these are dealt by their place in the table, so that any number of them is split too.
    """
    ranges = nodes.withColumn("row", F.monotonically_increasing_id())
    keys = ["g", *order, "row"]
    ranges = written(ranges.repartitionByRange(partitions(nodes), *keys).withColumn("part", F.spark_partition_id()), f"{name}_ranges")
    counts = ranges.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"))
    group = Window.partitionBy("g")  # a row for each range that has rows of the group
    before = F.sum("rows").over(group.orderBy("part")) - F.col("rows")
    counts = counts.select("g", "part", before.alias("before"), F.sum("rows").over(group).alias("n"))
    place = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order, "row")).cast("long") - 1
    return ranges.withColumn("place", place).join(counts, ["g", "part"]).withColumn("pos", F.col("before") + F.col("place")).drop("part", "row", "before", "place")


def _neighbours(nodes: DataFrame) -> DataFrame:
    """nodes (g, pos, n, digest) with run and, for each offset that the slot and the run's length leave, the digests beside it: left and right, in order."""
    run = F.floor(F.col("pos") / FANOUT).cast("long")
    w = Window.partitionBy("g", "run").orderBy("pos")
    slot = F.col("pos") % FANOUT
    length = F.least(F.lit(FANOUT).cast("long"), F.col("n") - F.col("run") * FANOUT)
    beside = lambda on, d: F.coalesce(F.when(on, d), F.lit(""))
    left = [beside(slot >= k, F.lag("digest", k).over(w)) for k in range(FANOUT - 1, 0, -1)]
    right = [beside(slot + k < length, F.lead("digest", k).over(w)) for k in range(1, FANOUT)]
    return nodes.withColumn("run", run).withColumn("left", F.concat(*left)).withColumn("right", F.concat(*right))


def ascend(level: DataFrame, name: str) -> list[DataFrame]:
    """All levels (g, pos, n, digest), leaves first. Each is written, as the next one and the proofs read it. A group's last node has n = 1 and no parent."""
    levels = [written(level, f"{name}_0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _neighbours(levels[-1].select("g", "pos", "n", "digest").filter("n > 1")).filter(F.col("pos") % FANOUT == 0)
        up = F.ceil(F.col("n") / FANOUT).cast("long")
        levels.append(written(first.select("g", F.col("run").alias("pos"), up.alias("n"), digest("digest", "right").alias("digest")), f"{name}_{len(levels)}"))
        most = -(-most // FANOUT)
    return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the last node of each group."""
    return reduce(DataFrame.unionByName, [x.filter("n = 1").select("g", "digest") for x in levels])


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves' level with the columns of tops (g, path, ...): path holds (left, right) of every level from the leaf upwards, then the path of the group's top."""
    more = [c for c in tops.columns if c not in ("g", "path")]
    above = None
    for nodes in reversed(levels):
        own = nodes.columns
        done = nodes.filter("n = 1").join(tops, "g").select(*own, "path", *more)
        here = _neighbours(nodes.filter("n > 1"))
        if above is None:
            above = done
            continue
        parent = above.select("g", F.col("pos").alias("run"), F.col("path").alias("up"), *more)
        path = F.concat(F.array(F.struct("left", "right")), F.col("up"))
        above = here.join(parent, ["g", "run"]).select(*own, path.alias("path"), *more).unionByName(done)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, level by level, hash to."""
    return F.aggregate(path, leaf, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), "")


def manifest(rows: DataFrame, group: str, key: str, leaf: Column, altered: Column) -> DataFrame:
    """For each row: key, leaf, altered (the leaf of a row that may have been tampered with), subroot, root and path.

    group is a text column; a null group is one of its own and comes first. Rows ascend by key, a null key before all others, rows that share a key by their leaf;
    rows that are equal in both hold neighbouring places. An empty table gives no rows.
    """
    # a null group sorts before all texts, the empty one included
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`")), F.lit(""))
    leaves = written(rows.select(g.alias("g"), F.col(f"`{key}`").alias("key"), leaf.alias("digest"), altered.alias("altered")), "leaves")
    levels = ascend(placed(leaves, ["key", "digest"], "leaves"), "manifest")
    groups = written(subroots(levels).select(F.lit("").alias("g"), F.col("g").alias("of"), "digest"), "subroots")
    upper = ascend(placed(groups, ["of"], "subroots"), "roots")
    root = subroots(upper).select("g", F.col("digest").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = written(descend(upper, root).select(F.col("of").alias("g"), F.col("digest").alias("subroot"), "root", "path"), "tops")
    return descend(levels, tops).select("key", F.col("digest").alias("leaf"), "altered", "subroot", "root", "path")


def op11(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, and each row's proof against text that lost its capitals where crc32(doc_id) is divisible by 3.

    A null doc_id has no number to hash and is not tampered with; nulls are part of a leaf as -.
    """
    names = ("doc_id", "source", "lang", "n_chars", "text")
    d = with_defaults(table(spark, sf_dir, "documents"), *names)
    struck = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaf = lambda text: digest(*[field(F.col(c)) for c in names[:-1]], field(text))
    got = manifest(d, "lang", "doc_id", leaf(F.col("text")), leaf(F.when(struck, lower_ascii(F.col("text"))).otherwise(F.col("text"))))
    got = got.withColumn("folded_root", folded(F.col("altered"), F.col("path")))
    return got.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a decimal number's text, a byte at a time: eight shifts of the reflected polynomial.
_CRC = "(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))))"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP11_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
         sha256({_HEAD} || {_FIELD.format(f"CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")}) AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaf
), tree AS (
  SELECT 0 AS level, g, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT level + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY level, g, pos // 8, n
), top AS (
  SELECT g, digest AS subroot, level AS height, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM top
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n
), low AS (
  SELECT level, g, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tree WINDOW w AS (PARTITION BY level, g, pos // 8 ORDER BY pos)
), high AS (
  SELECT level, pos, n, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM upper WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)
), walk AS (
  SELECT doc_id, leaf, g, 0 AS level, pos, '' AS proof, altered AS fold FROM placed
  UNION ALL
  SELECT doc_id, leaf, g, level + 1, pos // 8, proof || l || r, sha256(l || fold || r) FROM walk JOIN low USING (level, g, pos) WHERE n > 1
), climb AS (
  SELECT doc_id, leaf, subroot, 0 AS level, top.pos, proof, fold FROM walk JOIN top ON walk.g = top.g AND walk.level = top.height
  UNION ALL
  SELECT doc_id, leaf, subroot, level + 1, pos // 8, proof || l || r, sha256(l || fold || r) FROM climb JOIN high USING (level, pos) WHERE n > 1
), root AS (SELECT level, digest AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM climb JOIN root USING (level)
"""
