"""Near-duplicates by the shared share of word shingles: candidates by SimHash and by bands of minima, every link verified on the whole sets.

Texts of equal words are one row. Its SimHash meets all others within three bits under deletion variants (module simhash). At a share of 0.8
fingerprints of 64 bits differ in about ten, which no cut into segments finds without meeting nearly all pairs, so minima complete the candidates: 144
minima of the shingles' hashes in 24 bands of 6; two texts with a share
of 0.8 have one band at least in common with chance 0.999. Texts of a band are joined to the least of it only to find
the clusters within which true links can lie; in a cluster all texts meet by their whole sets of shingles, a large
cluster in blocks of which each two meet, so that none is left out and a task stays bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import release, small_batches, written
from .simhash import DISTANCE, SEED, labelled, links, of_hashes, shingle_hashes, words

BANDS = 24
ROWS = 6
#: Texts of a block: a task holds the shingles of two blocks at once.
BLOCK = 256
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(h: np.ndarray) -> list[int]:
    """The signed 64-bit keys of the bands of a set of hashes; an empty set has none."""
    if not len(h):
        return []
    m = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 10):
        np.minimum(m, (_FACTORS * h[i : i + (1 << 10)]).min(axis=1), out=m)
    m = m.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(m[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h, fp, sim, keys) of every row of docs(doc_id, text): hashes of the text and of its words, its SimHash, and its bands."""

    def run(batches):
        for b in batches:
            fp, sim, keys = [], [], []
            for text in b.column(2).to_pylist():
                w = words(text)
                h = shingle_hashes(w, n)
                fp.append(xxhash.xxh64_intdigest(b" ".join(w), SEED))
                sim.append(of_hashes(h))
                keys.append(band_keys(h))
            own = pa.array(np.array(fp, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), own, pa.array(sim, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "h", "fp", "sim", "keys"])
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs).select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, fp long, sim long, keys array<long>")


def _sets(n: int):
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(words(x), n).astype(np.uint32)).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["cluster", "fp", "s"])
        release()

    return run


def spanning(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) of sets whose shared share is at least similarity that span the components of all such links."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    sets = np.split(codes, np.cumsum(size)[:-1])
    mark, fresh, out = np.zeros(len(codes), bool), np.ones(len(sets), bool), []
    for i in range(len(sets)):
        todo = [i] if fresh[i] else []
        fresh[i] = False
        while todo:
            at = todo.pop()
            near = np.flatnonzero(fresh & (np.minimum(size, size[at]) >= similarity * np.maximum(size, size[at])))
            mark[sets[at]] = True
            for j in near.tolist():
                both = int(np.count_nonzero(mark[sets[j]]))
                if both >= similarity * (size[at] + size[j] - both):
                    fresh[j] = False
                    todo.append(j)
                    out.append((at, j))
            mark[sets[at]] = False
    return out


def _verified(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_pylist()
        pairs = spanning([np.frombuffer(x, np.uint32) for x in table.column("s").to_pylist()], similarity)
        return pa.table({"a": pa.array([fp[i] for i, _ in pairs], pa.int64()), "b": pa.array([fp[j] for _, j in pairs], pa.int64())})

    return run


def band_stars(classes: DataFrame) -> DataFrame:
    """Links (a, b) of every text of classes(fp, sim, keys) to the least of each of its bands: those of minima, and the SimHash itself as one more."""
    keyed = classes.select("fp", F.posexplode(F.concat("keys", F.array("sim"))).alias("band", "k"))
    least = keyed.groupBy("band", "k").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # merged: Spark takes the rows of a text's bands for one, and would broadcast bands of many times the threshold
    return keyed.hint("merge").join(least, ["band", "k"]).filter("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, h, fp, component_id) of every row of docs(doc_id, text): component_id is the smallest doc_id reachable over verified links.

    Texts of fewer than n words are one shingle; texts without words are alike.
    """
    rows = written(signatures(docs, n), "signatures")
    none = F.col("doc_id").isNull()
    classes = rows.groupBy("fp").agg(F.min(F.struct(none.alias("none"), "doc_id", "h")).alias("m"), F.first("sim").alias("sim"), F.first("keys").alias("keys"))
    classes = written(classes.select("fp", F.coalesce("m.doc_id", F.lit(0)).alias("_id"), F.col("m.none").alias("_none"), F.col("m.h").alias("_h"), "sim", "keys"), "classes")
    stars = band_stars(classes)
    # SimHashes within distance, each by the least of its texts
    by_sim = classes.groupBy("sim").agg(F.min("fp").alias("fp"))
    near = links(by_sim.select(F.col("sim").alias("fp")), distance)
    of = lambda side: by_sim.select(F.col("sim").alias(side), F.col("fp").alias(f"{side}_fp"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    clusters = components(stars.union(near))
    clusters = clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster"))
    met = classes.drop("keys", "sim").join(clusters, "fp")
    own = docs.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), none.alias("_none"), F.xxhash64("text").alias("_h"), "text")
    sets = small_batches(own.join(met, ["_id", "_none", "_h"])).select("cluster", "fp", "text").mapInArrow(_sets(n), "cluster long, fp long, s binary")
    # rows that repeat an id and a text are one
    sets = written(sets.groupBy("cluster", "fp").agg(F.first("s").alias("s")), "sets")
    size = sets.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    dealt = sets.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "s")
    edges = dealt.groupBy("cluster", "i", "j").applyInArrow(_verified(similarity), "a long, b long")
    return labelled(rows.select("doc_id", "h", "fp"), edges)
