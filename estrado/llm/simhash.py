"""SimHash near-duplicates: deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 3 are cut into two halves: one of the halves
then differs in at most one bit. Every half is indexed under its 32 variants with one bit
left out, so a pair meets under an equal key (half, bit left out, rest) and is verified
on all bits. Equal fingerprints are one row before the index, so copies cost nothing.

A key that many different fingerprints share (over HOT) is cut again: the other half still
differs in at most 3 bits, so one of its quarters differs in at most one, and is indexed the
same way. What then shares a key agrees on 46 of 64 bits: at most 2**18 fingerprints,
whatever the size of the input, which one task resolves with bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import own_names, partitions, release, small_batches, table, with_defaults, written

DISTANCE = 3
HOT = 256
SEED = 42


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(w: list[bytes], n: int) -> np.ndarray:
    """Hashes (uint64) of each n words in a row, in order; fewer than n words are one shingle."""
    if not w:
        return np.zeros(0, np.uint64)
    b = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    k = min(n, len(w))
    starts = np.concatenate([[0], ends[: len(w) - k] + 1]).tolist()
    xx = xxhash.xxh64_intdigest
    return np.fromiter((xx(b[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def of_hashes(h: np.ndarray) -> int:
    """The signed 64-bit SimHash of shingle hashes; none: 0."""
    if not len(h):
        return 0
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    """The SimHash of a text's shingles of n words; no words: 0."""
    return of_hashes(shingle_hashes(words(text), n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of every row of docs(doc_id, text), h being a hash of the text; null and empty texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], names=["doc_id", "h", "fp"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, fp long")


def _forest(values: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that span the components of values (uint64, distinct) under Hamming distance, by blocks of rows."""
    n = len(values)
    parent = np.arange(n)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(1, n):
        near = np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= distance)
        for j in np.unique(parent[near]) if len(near) else ():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((a, b))
    return edges


def _spanning(distance: int):
    def run(batches):
        for b in batches:
            a, c = [], []
            for fps in b.column(0).to_pylist():
                v = np.array(sorted(fps), np.int64)
                for i, j in _forest(v.view(np.uint64), distance):
                    a.append(int(v[i]))
                    c.append(int(v[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def shared_keys(fps: DataFrame) -> DataFrame:
    """(k, fp, n) of every key of fps(fp) that n > 1 fingerprints share."""
    bit = F.explode(F.expr("sequence(0, 63)")).alias("bit")
    half = F.when(F.col("bit") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp")).bitwiseAND(F.lit(0xFFFFFFFF))
    rest = half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit % 32)")))
    # dealt anew before each becomes 64 rows: as fingerprints alone they fill few partitions
    # (by an expression of its own: a deal by fp would fall together with the one that made them distinct)
    keyed = fps.repartition(partitions(fps), F.xxhash64("fp")).select("fp", bit).select("fp", (F.expr("shiftleft(cast(bit as bigint), 32)").bitwiseOR(rest)).alias("k"))
    # the keys with company: a count combined before the shuffle, then the few rows that it keeps
    # (merged: Spark takes 64 exploded rows for one, and would broadcast keys of many times the threshold)
    return keyed.hint("merge").join(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "k")


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fps(fp) that connect all that lie within distance of each other.

    Every true link lies within one of the shared keys; of the links of a key those are
    returned that span its components, all verified, so none that matters is lost.
    """
    if distance > 3:
        raise ValueError("two halves with one bit left out cover distances up to 3")
    shared = written(shared_keys(fps), "shared")
    found = []
    cold = shared.filter(F.col("n") <= HOT).groupBy("k").agg(F.collect_list("fp").alias("fps"))
    pair = cold.filter(F.size("fps") == 2).select(F.col("fps")[0].alias("a"), F.col("fps")[1].alias("b"))
    found.append(pair.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    found.append(cold.filter(F.size("fps") > 2).select("fps").mapInArrow(_spanning(distance), "a long, b long"))
    hot = shared.filter(F.col("n") > HOT)
    # the other half in two quarters of 16 bits, each with one bit left out
    other = F.when(F.expr("shiftright(k, 32) < 32"), F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    cut = hot.select("k", "fp", other.alias("o"), F.explode(F.expr("sequence(0, 31)")).alias("bit"))
    quarter = F.when(F.col("bit") < 16, F.shiftrightunsigned("o", 16)).otherwise(F.col("o")).bitwiseAND(F.lit(0xFFFF))
    cut = cut.select("k", "fp", F.col("bit"), quarter.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit % 16)"))).alias("q"))
    groups = cut.groupBy("k", "bit", "q").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    found.append(groups.select("fps").mapInArrow(_spanning(distance), "a long, b long"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row of docs(doc_id, text).

    component_id is the smallest doc_id reachable over links of at most distance bits.
    Null and empty texts have fingerprint 0 and link like others; rows that repeat a doc_id are kept,
    each with its own fingerprint; a null doc_id is never the smallest unless a component has no other.
    An empty table gives no rows.
    """
    fp = written(fingerprints(docs), "fingerprints")
    return labelled(fp, links(fp.select("fp").distinct(), distance))


def labelled(fp: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row of fp(doc_id, h, fp), fingerprints being linked by edges(a, b)."""
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(edges)
    by_fp = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = by_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = by_fp.join(least, "root").select("fp", "component_id")
    return fp.join(linked, "fp").select("doc_id", "h", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE, n: int = 3, similarity: float | None = None) -> DataFrame:
    """docs without near-duplicates: of each component the row of its smallest doc_id stays, in all its columns.

    Without a similarity, texts link whose fingerprints of three-word shingles differ in distance bits or fewer, as op6 has it. With one, texts link that
    share so much of their shingles of n words: fingerprints of those within distance, and bands of minima for what no 64 bits
    tell, give candidates, and every link is verified on whole sets (module shingles).

    Of rows that share that doc_id the one whose text's hash is least stays, of equal rows any. A component without a doc_id keeps one of its
    rows as well. The texts are shuffled once: the join and the numbering of equal rows are on the same keys.
    """
    from . import shingles

    own = with_defaults(docs, "doc_id", "text")
    return first_rows(docs, near_duplicates(own, distance) if similarity is None else shingles.near_duplicates(own, n, similarity, distance))


def first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of each component of rows(doc_id, h, fp, component_id) the row of docs that stays. Columns of docs may have any names."""
    # null doc_ids come after all others
    first = rows.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("own")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("m"))
    i, none, h, k = own_names(docs, "keep_id", "keep_none", "keep_h", "keep_k")
    kept = first.select(F.coalesce("m.doc_id", F.lit(0)).alias(i), F.col("m.none").alias(none), F.col("m.h").alias(h)).distinct()
    own = docs.withColumns({i: F.coalesce("doc_id", F.lit(0)), none: F.col("doc_id").isNull(), h: F.xxhash64("text")})
    once = F.row_number().over(Window.partitionBy(i, none, h).orderBy(h))
    return own.join(kept, [i, none, h]).withColumn(k, once).filter(F.col(k) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6(spark, sf_dir: str) -> DataFrame:
    docs = with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
