"""Document fingerprints: randomised edit embedding.

A pointer walks over a text. At step j it emits the character below it and moves on if the shared random
bit R(j, class of the character) is one, so the walks of two texts drift apart at an edit and
meet again soon after, and their emissions differ at a number of steps that follows the edit distance. Every character of a
text is walked over.

The fingerprint samples the emissions: step j belongs to rate s if the lowest s bits of hash(j) are
zero, so rates are nested, and a text takes the lowest rate that leaves fewer than SAMPLES steps. It is
written as two hex digits for the rate and two for each sampled emission (a byte hashed from the character).
Fingerprints of different rates are compared at the steps of the coarser one. Likeness is the share of the sampled steps, up
to the end of the longer walk, at which emissions agree.

near_pairs() looks for like documents: bands of sampled emissions are equality-joined and candidates verified. op4's result
holds no pairs, so its query does without.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import partitions, small_batches, table, with_defaults, written

SAMPLES = 256
PERIOD = 1024
CLASSES = 16
STRIDE = 3


class Walk:
    """The shared random bits and the tables made of them."""

    def __init__(self, seed: int = 7):
        bits = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        # steps from j until the pointer has moved on; the bits repeat after PERIOD steps
        self.move = np.empty((CLASSES, PERIOD), np.int64)
        for c in range(CLASSES):
            ones = np.flatnonzero(bits[c])
            ones = np.append(ones, ones[0] + PERIOD)
            self.move[c] = ones[np.searchsorted(ones, np.arange(PERIOD))] - np.arange(PERIOD) + 1
        # the same for STRIDE characters at once
        j = np.broadcast_to(np.arange(PERIOD), (CLASSES,) * STRIDE + (PERIOD,))
        total = np.zeros_like(j)
        for k in range(STRIDE):
            c = np.arange(CLASSES).reshape([-1 if i == k else 1 for i in range(STRIDE)] + [1])
            total = total + self.move[c, (j + total) % PERIOD]
        if total.max() > 255:
            raise ValueError("a seed with too long a run of zeros")
        self.stride = total.astype(np.uint8).tobytes()
        self.steps: dict[int, np.ndarray] = {}
        self.reach = 0

    def sampled(self, rate: int, end: int) -> np.ndarray:
        """The steps before end that belong to rate."""
        if end > self.reach:
            self.reach, self.steps = max(1 << 16, 1 << int(end).bit_length()), {}
        if rate not in self.steps:
            h = np.arange(self.reach, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(33)
            self.steps[rate] = np.flatnonzero((h & np.uint64((1 << rate) - 1)) == 0)
        s = self.steps[rate]
        return s[: np.searchsorted(s, end)]

    def trace(self, kinds: np.ndarray, at: list[int] | None = None) -> list[int]:
        """Steps at which each whole stride of characters begins; at: those of a common beginning, known already."""
        n = len(kinds) // STRIDE
        k = kinds[: n * STRIDE].reshape(n, STRIDE).astype(np.int64)
        keys = (((k[:, 0] * CLASSES + k[:, 1]) * CLASSES + k[:, 2]) * PERIOD).tolist()
        out = at[:] if at else [0]
        j, table_, add, mask = out[-1], self.stride, out.append, PERIOD - 1
        for key in keys[len(out) - 1 :]:
            j += table_[key + (j & mask)]
            add(j)
        return out

    def fingerprint(self, points: np.ndarray, trace: list[int], kinds: np.ndarray) -> str:
        if not len(points):
            return "00"
        begin = np.array(trace, np.int64)
        end = int(begin[-1])
        for c in kinds[(len(begin) - 1) * STRIDE :].tolist():
            end += int(self.move[c, end % PERIOD])
        rate = 0
        while end >> rate >= SAMPLES:
            rate += 1
        steps = self.sampled(rate, end)
        stride = np.searchsorted(begin, steps, side="right") - 1
        i, j = stride * STRIDE, begin[stride]
        for _ in range(STRIDE):  # on to the character below the pointer at the step
            here = np.minimum(i, len(kinds) - 1)
            to = j + self.move[kinds[here], j % PERIOD]
            go = (to <= steps) & (i + 1 < len(kinds))
            i, j = np.where(go, i + 1, i), np.where(go, to, j)
        p = points[i].astype(np.uint32) * np.uint32(0x9E3779B1)
        return f"{rate:02x}" + (p >> np.uint32(24)).astype(np.uint8).tobytes().hex()

    def at_rate(self, x: str, rate: int) -> np.ndarray:
        """The emissions of a fingerprint that belong to a rate, its own or a coarser one."""
        own, v = int(x[:2], 16), np.frombuffer(bytes.fromhex(x[2:]), np.uint8)
        if own == rate or not len(v):
            return v
        # the own rate's steps are known by their number
        need = self.sampled(own, self.reach or 1)
        end = 1 << 16
        while len(need) < len(v):
            end *= 2
            need = self.sampled(own, end)
        return v[np.isin(need[: len(v)], self.sampled(rate, int(need[len(v) - 1]) + 1))]

    def likeness(self, a: str, b: str) -> float:
        """0 to 1; two empty texts are alike."""
        if a == b:
            return 1.0
        rate = max(int(a[:2], 16), int(b[:2], 16))
        x, y = self.at_rate(a, rate), self.at_rate(b, rate)
        n, m = min(len(x), len(y)), max(len(x), len(y))
        return float(np.count_nonzero(x[:n] == y[:n]) / m) if m else 0.0


_WALK: list[Walk] = []


def walk() -> Walk:
    if not _WALK:
        _WALK.append(Walk())
    return _WALK[0]


def _points(text: str) -> tuple[np.ndarray, np.ndarray]:
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return p, ((p * np.uint32(0x85EBCA6B)) >> np.uint32(28)).astype(np.uint8)


def fingerprint(text: str | None) -> str:
    w = walk()
    p, k = _points(text or "")
    return w.fingerprint(p, w.trace(k), k)


def edited(text: str, following: str) -> str:
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(batches):
    """Rows (block, doc_id, text, guest) in order: each with the row after it in its block."""
    w = walk()
    held = None

    def row(doc_id, text, p, k, t, fp, following, next_fp):
        e = edited(text, following)
        ep, ek = _points(e)
        same = (len(text) - len(text) // 2) // STRIDE
        efp = fp if e == text else w.fingerprint(ep, w.trace(ek, t[: same + 1]), ek)
        sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, fp, efp, w.likeness(fp, efp), w.likeness(fp, next_fp))

    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for b in batches:
        out = []
        for block, doc_id, text, guest in zip(*(c.to_pylist() for c in b.columns)):
            text = text or ""
            p, k = _points(text)
            t = w.trace(k)
            fp = w.fingerprint(p, t, k)
            if held and held[0] == block and not held[2]:
                out.append(row(*held[1], text, fp))
            held = (block, (doc_id, text, p, k, t, fp), guest)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)] if out else [pa.array([], kind) for kind in kinds], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """OUT for every row of docs(doc_id, text): its fingerprint, that of its edited text, and its likeness to that and to the next row.

    Next is the row with the next smaller doc_id, after the last the first; rows that share a doc_id stand in
    the order of a hash of their text, null doc_ids last. Null text counts as empty: fingerprint
    "00". A single document is its own next one. An empty table gives no rows.

    Rows are dealt into ranges of doc_id, with one bound for each partition; the last row that a range needs, the first
    of the range below, is sent to both. Text is shuffled once.
    """
    n = partitions(small_batches(docs))
    low = -(1 << 63)
    d = docs.select("doc_id", "text").withColumn("o", F.coalesce(F.col("doc_id").cast("long"), F.lit(low))).withColumn("h", F.xxhash64("text"))
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).filter("x is not null")
    bounds = sorted({int(x) for x in ids.approxQuantile("x", [i / n for i in range(1, n)], 0.001)}) if n > 1 else []
    block = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda x: x < F.col("o"))) if bounds else F.lit(0)
    d = d.withColumn("block", block)
    # one row for each range: the first of each, in descending order
    firsts = sorted((r[0], r[1][0], r[1][1]) for r in d.groupBy("block").agg(F.max(F.struct("o", "h"))).collect())
    to = [(o, h, firsts[(i + 1) % len(firsts)][0]) for i, (_, o, h) in enumerate(firsts)]
    guests = docs.sparkSession.createDataFrame(to, "_o long, _h long, _to int")
    sent = d.join(F.broadcast(guests), (F.col("o") == F.col("_o")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    places = F.when(F.col("_to").isNotNull(), F.array(F.struct("block", F.lit(False).alias("guest")), F.struct(F.col("_to").alias("block"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct("block", F.lit(False).alias("guest"))))
    sent = sent.select("doc_id", "o", "h", "text", F.explode(places).alias("place"))
    sent = sent.select(F.col("place.block").alias("block"), "doc_id", "text", F.col("place.guest").alias("guest"), "o", "h")
    dealt = sent.repartition(n, "block").sortWithinPartitions("block", "guest", F.desc("o"), F.desc("h"))
    return dealt.select("block", F.col("doc_id").cast("long").alias("doc_id"), "text", "guest").mapInArrow(_run, OUT)


BANDS = 16
PICKED = 6
#: Bands are picked from the first steps of a rate, which texts of that rate and of the finer one have.
REACH = 64
#: Fingerprints of a block: larger bands are compared block by block.
BLOCK = 256
_PICKED = np.random.Generator(np.random.PCG64(11)).permuted(np.tile(np.arange(REACH), (BANDS, 1)), axis=1)[:, :PICKED]


def band_keys(fingerprint: str) -> list[int]:
    """Keys of the bands at a fingerprint's own rate and at the next coarser one: PICKED of its emissions, sampled by their places."""
    own, out = int(fingerprint[:2], 16), []
    for rate in (own, own + 1):
        v = np.full(REACH, 0xFFFF, np.uint16)
        x = walk().at_rate(fingerprint, rate)[:REACH]
        v[: len(x)] = x
        for i, band in enumerate(v[_PICKED]):
            out.append(int.from_bytes(hashlib.blake2b(bytes([rate, i]) + band.tobytes(), digest_size=8).digest(), "little", signed=True))
    return out


def linked(prints: list[str], least: float) -> list[tuple[int, int]]:
    """Links (i, j) of likeness least or more that span the components of all such links."""
    w, out = walk(), []
    rates = np.array([int(f[:2], 16) for f in prints])
    rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(rate: int):
        if rate not in rows:
            v = [w.at_rate(f, rate) if r <= rate else np.zeros(0, np.uint8) for f, r in zip(prints, rates.tolist())]
            size = np.array([len(x) for x in v])
            m = np.full((len(v), int(size.max())), 0xFFFF, np.uint16)
            for i, x in enumerate(v):
                m[i, : len(x)] = x
            rows[rate] = m, size
        return rows[rate]

    fresh = np.ones(len(prints), bool)
    for i in range(len(prints)):
        todo = [i] if fresh[i] else []
        fresh[i] = False
        while todo:
            a = todo.pop()
            for rate in np.unique(np.maximum(rates[fresh], rates[a])).tolist() if fresh.any() else ():
                j = np.flatnonzero(fresh & (np.maximum(rates, rates[a]) == rate))
                m, size = at(rate)
                top = np.maximum(size[j], size[a])
                agree = ((m[j] == m[a]) & (m[j] != 0xFFFF)).sum(axis=1)
                for b in j[(agree >= least * np.maximum(top, 1)) & (top > 0)].tolist():
                    fresh[b] = False
                    todo.append(b)
                    out.append((a, b))
    return out


def near_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(fingerprint, root, n) of the prints(fingerprint) that have a partner of likeness least or more, among the distinct ones.

    root, the smallest fingerprint of the class, names it; n counts the rows of prints that are alike. Candidates
    share a band: PICKED emissions at sampled steps, at the own rate or the next coarser one, so texts whose rates differ by one meet too. All
    fingerprints of a band meet, in blocks of BLOCK where they are many, and every link is verified by likeness. Equal
    fingerprints are one. At a likeness of p a pair shares a band with chance 1 - (1 - p ** 6) ** 16 if its edits are spread: 0.99 at 0.8. Null
    fingerprints count as none; an empty table gives no rows.
    """

    def cut(batches):
        for b in batches:
            keys = [band_keys(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "k"])

    def verify(batches):
        for b in batches:
            x, y = [], []
            for group in b.column(0).to_pylist():
                group = sorted(group, key=lambda r: r["id"])
                for i, j in linked([r["f"] for r in group], least):
                    x.append(group[i]["id"])
                    y.append(group[j]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    own = small_batches(prints.filter("fingerprint is not null")).groupBy(F.col("fingerprint").alias("f")).agg(F.count(F.lit(1)).alias("rows"))
    own = written(own.select(F.xxhash64("f").alias("id"), "f", "rows"), "prints")
    keyed = written(own.select("id", "f").mapInArrow(cut, "id long, k array<long>").select("id", F.explode("k").alias("k")), "bands")
    many = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / BLOCK).alias("n"))
    met = keyed.join(many, "k").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    met = met.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id").join(own.select("id", "f"), "id")
    groups = met.groupBy("k", "i", "j").agg(F.collect_list(F.struct("id", "f")).alias("g")).filter(F.size("g") > 1).select("g")
    roots = components(groups.mapInArrow(verify, "a long, b long"))
    classes = written(own.join(roots.withColumnRenamed("node", "id"), "id"), "classes")
    total = classes.groupBy("root").agg(F.min("f").alias("least"), F.sum("rows").alias("n"))
    return classes.join(total, "root").select(F.col("f").alias("fingerprint"), F.col("least").alias("root"), "n")


def op4(spark, sf_dir: str) -> DataFrame:
    return fingerprints(with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text"))
