"""Repeated byte strings: distributed prefix doubling on sampled positions.

A byte is removed if a string of THRESHOLD bytes that covers it also starts in a document with a smaller
doc_id. Prefix doubling names the string of h bytes at a position by the pair of names (h at the position,
h further on) and sorts the pairs, at offsets that double, until a position's string is unique, which ends it, or is
as long as the threshold. Done for every byte, each round would sort tens of bytes for each byte of text, so the rounds
here are made to carry as few positions as exactness allows:

- Names of 1, 2, 4, 8, 16, 20 bytes are made inside a task; a name is a 64-bit mix of a pair of names.
- Round 1 sorts the names of SEED bytes at sampled positions. The sample is fixed by content: of every string of
  THRESHOLD bytes the least name of SEED bytes in it. Equal strings have equal least names, so a
  string whose least name stands in one document alone is unique and its positions end here. Neighbouring
  positions with the same least name form a run and are one entry.
- Round 2 sorts, for the runs left, the pair (name of THRESHOLD bytes at the first position, the same at the last position,
  offset between them). It names all text of the run: a run whose text starts in a smaller document is removed whole.
- Round 3 sorts the pairs (32 bytes, 32 bytes at offset 18), names of THRESHOLD bytes, at the positions
  of the runs left: the first of each text. A position is removed if its smallest document is smaller than its own.

A round is: segments of documents -> packed sorted names with their smallest document by bucket -> one
sort in each bucket, which says for each entry whether a smaller (round 1: another) document has the name -> bits back to the
segments. Within a segment equal names are one entry before anything moves, so a passage that all documents
share costs a bucket one entry for each segment, and a task holds one bucket or one segment. The segments are a bucketed table in the shared
folder: the text is written once and never shuffled.

A removal needs two names: that by doubling, and a second one that sums the bytes themselves and shares no step with it. So two different strings are taken for equal with probability
2**-96 a pair; the first round, whose names are single, only decides what goes on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, scratch, small_batches, table, with_defaults, written

THRESHOLD = 50
SEED = 20
SEGMENT_BYTES = 2 << 20
BUCKET_BYTES = 12 << 20
CHUNK = 1 << 16
U = np.uint64
#: The second name of a range of bytes: from a sum of random numbers of its bytes times powers of an odd number.
_BYTE = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 64, 256, dtype=U)
_BASE = 0x9FB21C651E98DF25
_M = [U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)]


def _pair(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """Names of pairs of names."""
    h = a * _M[turn % 4]
    h += b
    t = h >> U(29)
    h ^= t
    h *= _M[(turn + 1) % 4]
    np.right_shift(h, U(32), out=t)
    h ^= t
    return h


_ONE = _pair(np.arange(1, 257, dtype=U), np.zeros(256, U), 0)
#: Names of all two bytes, the first being the higher.
_TWO = _pair(np.repeat(_ONE, 256), np.tile(_ONE, 256), 1)


def _base(text: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Names of n bytes at every position, by doubling, and n: the largest power of two up to seed."""
    if seed < 2:
        return _ONE[text], 1
    two = text[:-1].astype(np.uint16)
    two <<= 8
    two |= text[1:]
    h, n = _TWO[two], 2
    while n * 2 <= seed:
        h = _pair(h[: len(h) - n], h[n:], n)
        n *= 2
    return h, n


def _longer(h: np.ndarray, n: int, want: int, at: np.ndarray) -> np.ndarray:
    """Names of want bytes at some positions, by doubling those of n bytes."""
    if want == n:
        return h[at]
    half = n
    while half * 2 < want:
        half *= 2
    return _pair(_longer(h, n, half, at), _longer(h, n, half, at + (want - half)), want)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, U)
    p[0] = U(1)
    return np.cumprod(p, dtype=U)


class _Ranges:
    """Second names of ranges of a text, 32 bits of them, in the order of their beginnings: they hang on the bytes alone, and share nothing with the names by doubling."""

    powers = inverse = np.zeros(0, U)
    #: Bytes of a text whose sums are kept for the next round.
    KEPT = 8 << 20

    def __init__(self, text: np.ndarray, longest: int):
        if len(self.powers) < CHUNK + longest + 1:
            _Ranges.powers, _Ranges.inverse = _powers(CHUNK + longest + 1, _BASE), _powers(CHUNK + longest + 1, pow(_BASE, -1, 1 << 64))
        self.text, self.longest = text, longest
        self.sums: dict[int, np.ndarray] = {}

    def _sums(self, a: int) -> np.ndarray:
        if a in self.sums:
            return self.sums[a]
        part = self.text[a : a + CHUNK + self.longest]
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTE[part] * self.powers[: len(part)], out=sums[1:])
        if len(self.text) <= self.KEPT:
            self.sums[a] = sums
        return sums

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.uint32)
        for a in range(0, len(self.text), CHUNK):
            i, j = np.searchsorted(begin, (a, a + CHUNK))
            if i < j:
                sums, x = self._sums(a), begin[i:j] - a
                # the higher half: lower bits hang on fewer of the bytes' places
                out[i:j] = ((sums[end[i:j] - a] - sums[x]) * self.inverse[x]) >> U(32)
        return out


def _slide_min(h: np.ndarray, w: int) -> np.ndarray:
    n = 1
    while n * 2 <= w:
        h = np.minimum(h[: len(h) - n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (w - n)], h[w - n :]) if n < w else h


def _pack(x: np.ndarray) -> bytes:
    """Sorted unsigned integers: differences, byte plane by byte plane, compressed."""
    d = np.diff(x, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    d = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(d.T).view("<u8").reshape(-1).astype(U), dtype=U)


class Segment:
    """Documents of one segment, cut into chunks: runs of positions with one least name, and names at positions.

    keep: names of a power of two bytes stay for the longer names of later rounds.
    """

    #: Bytes of a text whose names are kept.
    KEPT = 8 << 20

    def __init__(self, doc_ids: list[int], sizes: list[int], data: bytes, seed: int, threshold: int, keep: bool = False):
        self.docs = np.array(doc_ids, np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(data, np.uint8)
        self.seed, self.threshold = seed, threshold
        self.bases: dict[int, tuple[np.ndarray, int]] = {}
        key, lo, hi = [], [], []
        for a, b in self._chunks():
            h, n = base = _base(self.text[a:b], seed)
            if keep and len(self.text) <= self.KEPT:
                self.bases[a] = base
            short = h if n == seed else _pair(h[: len(h) - (seed - n)], h[seed - n :], seed)
            least = _slide_min(short, threshold - seed + 1)
            change = np.ones(len(least), bool)
            np.not_equal(least[1:], least[:-1], out=change[1:])
            i, j = np.searchsorted(self.ends, (a, a + len(least) - 1), side="right")
            change[self.ends[i:j] - a] = True
            # a run names its text by its ends, so it is no longer than the threshold
            begin = np.flatnonzero(change)
            length = np.diff(np.append(begin, len(least)))
            if (length > threshold).any():
                extra = [np.arange(s, s + n, threshold) for s, n in zip(begin[length > threshold], length[length > threshold])]
                begin = np.unique(np.concatenate([begin, *extra]))
            # positions near a document's end hold no whole string; a run may end before them
            end = self.ends[np.searchsorted(self.ends, begin + a, side="right")] - (threshold - 1) - a
            n = np.minimum(np.append(begin[1:], len(least)), end) - begin
            begin, n = begin[n > 0], n[n > 0]
            key.append(least[begin])
            lo.append(begin + a)
            hi.append(begin + n + (a - 1))
        self.key = np.concatenate(key) if key else np.zeros(0, U)
        self.lo, self.hi = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lo, hi))
        self.doc = np.searchsorted(self.ends, self.lo, side="right")
        self.ranges = _Ranges(self.text, 2 * threshold)

    def _chunks(self):
        """Stretches of about CHUNK bytes with room for the strings that start in them; a rest too short for one has no position."""
        for a in range(0, len(self.text) - self.threshold + 1, CHUNK):
            yield a, min(len(self.text), a + CHUNK + self.threshold - 1)

    def names(self, at: np.ndarray) -> np.ndarray:
        """Names of threshold bytes at positions in ascending order."""
        out = []
        for a, b in self._chunks():
            i, j = np.searchsorted(at, (a, a + CHUNK))
            if i < j:
                h, n = self.bases.get(a) or _base(self.text[a:b], self.seed)
                out.append(_longer(h, n, self.threshold, at[i:j] - a))
        return np.concatenate(out) if out else np.zeros(0, U)

    def run_names(self, at: np.ndarray) -> np.ndarray:
        lo, hi = self.lo[at], self.hi[at]
        return _pair(_pair(self.names(lo), self.names(hi), 60), (hi - lo).astype(U), 61)

    def seconds(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.ranges.of(begin, end)

    def positions(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions of the runs and their names of threshold bytes."""
        n = self.hi[runs] - self.lo[runs] + 1
        at = np.repeat(self.lo[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return at, self.names(at)


def _clash(names: np.ndarray, seconds: np.ndarray) -> bool:
    """Whether sorted names have one with several second names: then they are sorted by both."""
    return bool(((names[1:] == names[:-1]) & (seconds[1:] != seconds[:-1])).any())


def _entries(names: np.ndarray, doc_ids: np.ndarray, seconds: np.ndarray | None = None):
    """Distinct names, with their second ones if there are any, sorted; each with its smallest doc_id, whether it has others, and its second name; and each row's entry."""
    order = np.argsort(names)
    if seconds is not None and _clash(names[order], seconds[order]):
        order = np.lexsort((seconds, names))
    n, d = names[order], doc_ids[order]
    s = n if seconds is None else seconds[order]
    new = np.ones(len(n), bool)
    new[1:] = (n[1:] != n[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    entry = np.empty(len(n), np.int64)
    entry[order] = np.cumsum(new) - 1
    least, most = (f.reduceat(d, at) if len(at) else d for f in (np.minimum, np.maximum))
    return n[at], least, least != most, None if seconds is None else s[at], entry


def _bounds(n: int) -> np.ndarray:
    """Upper ends of n - 1 of n equal ranges of names."""
    return np.array([((i + 1) << 64) // n - 1 for i in range(n - 1)], U)


def _round(seg: Segment, known: dict[int, list[bytes]], buckets: int):
    """Names, doc_ids, rows and second names of the round after those in known; None after the last."""
    removed, runs = [], np.arange(len(seg.lo))
    for turn in (1, 2, 3):
        seconds = None  # the first round only tells what may go on
        if turn == 1:
            names = seg.key
        elif turn == 2:
            names, seconds = seg.run_names(runs), seg.seconds(seg.lo[runs], seg.hi[runs] + seg.threshold)
        else:
            at, names = seg.positions(runs)
            seconds = seg.seconds(at, at + seg.threshold)
        rows = seg.docs[seg.doc[runs]] if turn < 3 else seg.docs[np.searchsorted(seg.ends, at, side="right")]
        n, d, many, two, entry = _entries(names, rows, seconds)
        if turn not in known:
            return turn, (n, d, two), None
        bits = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for k, b in known[turn]]])
        assert len(bits) == len(n), "a segment's entries changed between rounds"
        if turn == 1:
            runs = runs[(bits | many)[entry]]
            continue
        hit = bits[entry] | (d[entry] < rows)
        if turn == 2:
            removed.append((seg.lo[runs[hit]], seg.hi[runs[hit]] + seg.threshold))
            runs = runs[~hit]
        else:
            removed.append((at[hit], at[hit] + seg.threshold))
    cover = np.zeros(len(seg.text) + 1, np.int32)
    for a, b in removed:
        np.add.at(cover, a, 1)
        np.add.at(cover, b, -1)
    return None, None, np.cumsum(cover[:-1]) > 0


SEGMENT = "segment long, doc_ids array<long>, rows array<long>, sizes array<long>, extra array<string>, data binary"


def _segments(limit: int):
    """Packs rows (doc_id, text, other columns as JSON) into segments."""
    lists = [(c, pa.list_(pa.int64())) for c in ("doc_ids", "rows", "sizes")]
    schema = pa.schema([("segment", pa.int64()), *lists, ("extra", pa.list_(pa.string())), ("data", pa.binary())])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        ids, texts, more, size, row = [], [], [], 0, 0

        def out():
            return pa.RecordBatch.from_pylist([{"segment": number, "doc_ids": ids, "rows": list(range(row - len(ids), row)), "sizes": [len(t) for t in texts], "extra": more, "data": b"".join(texts)}], schema=schema)

        for b in batches:
            for i, t, x in zip(*(c.to_pylist() for c in b.columns)):
                t = (t or "").encode("utf-8", "surrogatepass")
                if ids and size + len(t) > limit:
                    yield out()
                    ids, texts, more, size, number = [], [], [], 0, number + 1
                ids.append(i)
                more.append(x)
                texts.append(t)
                size += len(t)
                row += 1
        if ids:
            yield out()

    return run


def _open(row: dict, seed: int, threshold: int) -> Segment:
    return Segment(row["doc_ids"], row["sizes"], row["data"], seed, threshold, keep=row.get("r1") is not None)


def _answers(row: dict) -> dict[int, list[bytes]]:
    known: dict[int, list] = {}
    for turn in (1, 2, 3):
        if row.get(f"r{turn}") is not None:
            known[turn] = [(x["n"], x["bits"]) for x in sorted(row[f"r{turn}"], key=lambda x: x["bucket"])]
    return known


ENTRY = "bucket int, segment long, n int, names binary, docs binary, seconds binary"


def _emit(buckets: int, seed: int, threshold: int):
    schema = pa.schema([("bucket", pa.int32()), ("segment", pa.int64()), ("n", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("seconds", pa.binary())])
    ends = _bounds(buckets)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                _, (names, docs, seconds), _ = _round(_open(row, seed, threshold), _answers(row), buckets)
                edge = np.concatenate([[0], np.searchsorted(names, ends, side="right"), [len(names)]])
                ids, rank = np.unique(docs, return_inverse=True)
                out = []
                for i in range(buckets):
                    a, z = int(edge[i]), int(edge[i + 1])
                    if z > a:
                        used = np.zeros(len(ids), bool)
                        used[rank[a:z]] = True
                        own, place = ids[used], np.cumsum(used) - 1
                        ranks = place[rank[a:z]].astype("<u4").view(np.uint8).reshape(-1, 4).T
                        packed = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(ranks).tobytes())
                        head = _pack((own.view(U) ^ U(1 << 63)))
                        out.append({"bucket": i, "segment": row["segment"], "n": z - a, "names": _pack(names[a:z]), "docs": len(head).to_bytes(4, "little") + head + packed, "seconds": None if seconds is None else seconds[a:z].astype("<u4").tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        release()

    return run


def _docs(b: bytes) -> np.ndarray:
    k = int.from_bytes(b[:4], "little")
    own = (_unpack(b[4 : 4 + k]) ^ U(1 << 63)).view(np.int64)
    ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4 + k :]), np.uint8).reshape(4, -1)
    return own[np.ascontiguousarray(ranks.T).view("<u4").reshape(-1)]


def _sort(first: bool):
    """One bucket at a time: sorts its entries; a bit for each: a smaller document (first round: another) has the name."""
    schema = pa.schema([("segment", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])

    def bucket(rows):
        names = np.concatenate([_unpack(r["names"]) for r in rows])
        docs = np.concatenate([_docs(r["docs"]) for r in rows])
        two = None if first else np.concatenate([np.frombuffer(r["seconds"], "<u4") for r in rows])
        order = np.argsort(names, kind="stable")
        if not first and _clash(names[order], two[order]):
            order = np.lexsort((two, names))
        n, d = names[order], docs[order]
        new = np.ones(len(n), bool)
        new[1:] = n[1:] != n[:-1]
        if not first:
            two = two[order]
            new[1:] |= two[1:] != two[:-1]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(n)))
        bit = np.empty(len(n), bool)
        if first:
            bit[order] = np.repeat(np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), size)
        else:
            bit[order] = np.repeat(np.minimum.reduceat(d, at), size) < d
        k = 0
        out = []
        for r in rows:
            out.append({"segment": r["segment"], "bucket": r["bucket"], "n": r["n"], "bits": np.packbits(bit[k : k + r["n"]]).tobytes()})
            k += r["n"]
        return pa.RecordBatch.from_pylist(out, schema=schema)

    def run(batches):
        held = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["bucket"] != held[0]["bucket"]:
                    yield bucket(held)
                    held = []
                held.append(r)
        if held:
            yield bucket(held)
        held.clear()
        release()

    return run


DIGEST = "segment long, doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept binary, extra string"


def _finish(seed: int, threshold: int):
    schema = pa.schema([(c, pa.int64()) for c in ("segment", "doc_id", "row", "n_bytes", "n_removed", "n_spans")] + [("kept", pa.binary()), ("extra", pa.string())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                seg = _open(row, seed, threshold)
                gone = _round(seg, _answers(row), 0)[2]
                out, a = [], 0
                for i, k, x, z in zip(row["doc_ids"], row["rows"], row["extra"], seg.ends.tolist()):
                    g, t = gone[a:z], seg.text[a:z]
                    spans = int(np.count_nonzero(g[1:] & ~g[:-1]) + (len(g) > 0 and bool(g[0])))
                    out.append({"segment": row["segment"], "doc_id": i, "row": k, "n_bytes": z - a, "n_removed": int(np.count_nonzero(g)), "n_spans": spans, "kept": t[~g].tobytes(), "extra": x})
                    a = z
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        release()

    return run


def text_of(kept: str):
    """The kept bytes as text; what is left of a character whose other bytes were removed goes with them."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decode(kept)


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, seed: int = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """(segment, row, doc_id, n_bytes, n_removed, n_spans, kept binary) of every row of docs(doc_id, text), and the columns in extra.

    Null and empty texts have no bytes. Rows that share a doc_id are judged alike against smaller ids and never
    against each other. A null doc_id counts as the largest of all. An empty table gives no rows. Texts of any length are
    taken whole. (segment, row) tells rows apart.
    """
    spark: SparkSession = small_batches(docs).sparkSession
    top = (1 << 63) - 1
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(top)).alias("doc_id"), "text", (F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")).alias("extra"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = int(max(4, -(-total // BUCKET_BYTES)))
    name, path = f"segments_{uuid.uuid4().hex}", scratch(spark, "segments")
    d.mapInArrow(_segments(SEGMENT_BYTES), SEGMENT).write.bucketBy(buckets, "segment").sortBy("segment").option("path", path).option("compression", "zstd").saveAsTable(name)
    segments = spark.table(name)
    with_answers = segments
    for turn in (1, 2, 3):
        entries = with_answers.mapInArrow(_emit(buckets, seed, threshold), ENTRY)
        entries = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket", "segment")
        bits = entries.mapInArrow(_sort(turn == 1), "segment long, bucket int, n int, bits binary")
        answer = bits.groupBy("segment").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(f"r{turn}"))
        answer = written(answer, f"answers_{turn}").repartition(buckets, "segment")
        with_answers = with_answers.join(answer.hint("shuffle_hash"), "segment", "left").withColumn(f"r{turn}", F.coalesce(f"r{turn}", F.expr("array()")))
    out = with_answers.mapInArrow(_finish(seed, threshold), DIGEST).withColumn("doc_id", F.when(F.col("doc_id") != top, F.col("doc_id")))
    if extra:
        kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
        out = out.withColumn("extra", F.from_json("extra", kinds))
    return out.select("segment", "row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept", *[F.col("extra")[c].alias(c) for c in extra])


def op3(spark, sf_dir: str) -> DataFrame:
    d = remove_repeats(with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS f FROM s) WHERE f < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS nw FROM c),
r AS (SELECT doc_id, i, sum(nw) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM p),
u AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last FROM p GROUP BY doc_id),
t AS (SELECT q.doc_id, string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS front FROM q JOIN d ON q.doc_id = d.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
