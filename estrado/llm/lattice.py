"""Language-model scoring: the likelihood of a text over all segmentations of a lattice.

A text is a sequence of words and one end. An arc of the lattice over a word is the word itself, if training text has it, or a piece of an existing subword vocabulary; every path of arcs is a
segmentation, and the forward recursion adds up, in logarithms, the probabilities of all of them. No piece crosses a word, so the lattice of a text is the chain of its words' lattices and its marginal the sum of theirs:
each distinct word goes through the recursion once.

- The vocabulary comes with scores; those of a merge vocabulary are ranks, and a piece of rank r starts at 1 / (r + RANK). ROUNDS rounds of forward-backward over the distinct training words turn them
  into the shares of pieces in spelling new words. Nothing is added to the vocabulary, and its size bounds what a round gathers.
- A word seen c times has an arc of (c - d) / (N + 1): the discount d comes from the words seen once and twice (n1 / (n1 + 2 n2)), and what it frees, (d V + 1/2) / (N + 1), is the weight with which pieces spell words.
  The end has its own count and half an event more. All words and the end add up to 1.

Word counts are summed in a task before they are shuffled. For scoring, words so common that at most HEAD of them can be go to every task; each document's other words meet their scores by a join on
the word, in which no word has more rows than that share leaves it. Both ways give a word the same score.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, with_defaults, written

#: Words that every scoring task may hold.
HEAD = 50_000
#: Distinct words that a counting task holds before it hands them in.
HELD = 200_000
RANK = 10.0
ROUNDS = 2
START = "▁"
#: Characters that go through the recursion side by side, and the longest word that does; longer ones go alone, and keep no more than a few pieces' length of it.
TOGETHER = 200_000
LONG = 1000
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SLOTS = 22


class Pieces:
    """The pieces of a vocabulary file, by text and by byte, and the weights they start with; key and slot find pieces for whole arrays of code points."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.at: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        ranks = []
        for i in range(m.get_piece_size()):
            if m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                continue
            piece = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte[int(piece[3:5], 16)] = len(ranks)
            elif START not in piece[1:]:  # others hold several words
                self.at[piece] = len(ranks)
            else:
                continue
            ranks.append(-m.get_score(i))
        self.longest = max(map(len, self.at))
        weight = 1 / (np.maximum(np.array(ranks), 0) + RANK)
        self.initial = np.log(weight / weight.sum())
        # open addressing: a piece lies in the first free slot from that of its key on, probes bounds how far
        self.slot = np.full((1 << _SLOTS) + 64, -1, np.int32)
        self.key = np.zeros(len(ranks), np.uint64)
        self.probes = 1
        for piece, i in self.at.items():
            code = np.frombuffer(piece.encode("utf-32-le"), "<u4").astype(np.uint64)
            self.key[i] = self.keys(code)[len(code) - 1][0]
            home = int(self.home(self.key[i : i + 1])[0])
            k = next(k for k in range(64) if self.slot[home + k] < 0)
            self.slot[home + k] = i
            self.probes = max(self.probes, k + 1)

    def keys(self, code: np.ndarray):
        """For each length 1, 2, ... the keys of the parts of code of that length, by their start."""
        k = np.zeros(len(code), np.uint64)
        out = []
        for n in range(min(self.longest, len(code)) if hasattr(self, "longest") else len(code)):
            k = k[: len(code) - n] * _FACTOR + code[n:] + np.uint64(1)
            out.append(k)
        return out

    @staticmethod
    def home(key: np.ndarray) -> np.ndarray:
        return (((key ^ (key >> np.uint64(32))) * _SPREAD) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        home, out = self.home(key), np.full(len(key), -1, np.int32)
        for k in range(self.probes):
            got = self.slot[home + k]
            hit = (got >= 0) & (self.key[got] == key)
            out[hit] = got[hit]
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _arcs(word: str, p: Pieces):
    """For each end 1, 2, ... in START + word, its arcs (start, piece or tuple of pieces). A character without a piece of its own is spelled by its bytes."""
    s = START + word
    for z in range(1, len(s) + 1):
        arcs = [(a, p.at[s[a:z]]) for a in range(max(0, z - p.longest), z) if s[a:z] in p.at]
        if s[z - 1] not in p.at:
            arcs.append((z - 1, tuple(p.byte[b] for b in s[z - 1].encode())))
        yield z, arcs


def _add(terms: list[float]) -> float:
    top = max(terms)
    return top if top == -math.inf or len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms))


def _weight(arc, w: list[float]) -> float:
    return w[arc] if isinstance(arc, int) else sum(w[b] for b in arc)


def forward(word: str, p: Pieces, w: list[float]) -> float:
    """Log probability of spelling the word: the sum over all its segmentations. Of the positions behind, a few pieces' length is kept."""
    a = [0.0]
    for z, arcs in _arcs(word, p):
        # a[-1] is position z - 1
        a.append(_add([a[s - z] + _weight(arc, w) for s, arc in arcs]))
        if len(a) > 4 * p.longest:
            a = a[-p.longest :]
    return a[-1]


def expected(word: str, p: Pieces, w: list[float], into: np.ndarray) -> None:
    """Adds the expected number of each piece in the word's spelling, by forward and backward sums."""
    lattice = list(_arcs(word, p))
    a = [0.0]
    for _, arcs in lattice:
        a.append(_add([a[s] + _weight(arc, w) for s, arc in arcs]))
    b = [-math.inf] * len(a)
    b[-1] = 0.0
    for z, arcs in reversed(lattice):
        for s, arc in arcs:
            x = _weight(arc, w) + b[z]
            b[s] = _add([b[s], x])
            share = math.exp(a[s] + x - a[-1])
            for piece in (arc,) if isinstance(arc, int) else arc:
                into[piece] += share


class _Lattices:
    """The lattices of many words side by side, longest first: for each length and start the piece there, and the sums from both ends."""

    def __init__(self, words: list[str], p: Pieces, w: np.ndarray):
        self.order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        code = np.frombuffer("".join([START + words[i] for i in self.order]).encode("utf-32-le"), "<u4").astype(np.uint64)
        self.length = np.array([len(words[i]) + 1 for i in self.order])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.piece = [p.find(k) for k in p.keys(code)[: self.length[0]]]
        # characters without a piece get numbers behind the pieces', -1 stays the number of none
        bare = np.flatnonzero(self.piece[0] < 0)
        chars, number = np.unique(code[bare], return_inverse=True)
        self.spelled = [[p.byte[b] for b in chr(int(c)).encode()] for c in chars]
        self.piece[0][bare] = len(w) + number
        w = np.concatenate([w, [sum(w[b] for b in s) for s in self.spelled], [-np.inf]])
        self.weight = [w[i] for i in self.piece]
        self.node = self.start + np.arange(len(words))  # a word has a node before each character and one at its end
        self.pieces = len(w) - 1 - len(self.spelled)

    def _sum(self, terms: np.ndarray) -> np.ndarray:
        top = terms.max(0)
        return top + np.log(np.exp(terms - top).sum(0))

    def forward(self) -> np.ndarray:
        a = np.full(int(self.length.sum()) + len(self.length), -np.inf)
        a[self.node] = 0.0
        for t in range(1, int(self.length[0]) + 1):
            n = int(np.searchsorted(-self.length, -t, "right"))  # words of t characters and more
            node, start = self.node[:n] + t, self.start[:n] + t
            a[node] = self._sum(np.stack([a[node - k] + self.weight[k - 1][start - k] for k in range(1, min(t, len(self.weight)) + 1)]))
        return a

    def backward(self) -> np.ndarray:
        b = np.full(int(self.length.sum()) + len(self.length), -np.inf)
        b[self.node + self.length] = 0.0
        for t in range(int(self.length[0]) - 1, -1, -1):
            n = int(np.searchsorted(-self.length, -(t + 1), "right"))
            node, start = self.node[:n] + t, self.start[:n] + t
            terms = np.full((len(self.weight), n), -np.inf)
            for k in range(1, len(self.weight) + 1):
                m = int(np.searchsorted(-self.length, -(t + k), "right"))
                if not m:
                    break
                terms[k - 1, :m] = b[node[:m] + k] + self.weight[k - 1][start[:m]]
            b[node] = self._sum(terms)
        return b

    def whole(self, a: np.ndarray) -> np.ndarray:
        """The sums of whole words, in the order given."""
        out = np.zeros(len(self.order))
        out[self.order] = a[self.node + self.length]
        return out

    def expected(self, into: np.ndarray) -> None:
        a, b = self.forward(), self.backward()
        word = np.repeat(np.arange(len(self.length)), self.length)
        at = np.arange(len(word))
        node, left, all_of = at + word, self.length[word] - (at - self.start[word]), a[self.node + self.length][word]
        n = np.zeros(self.pieces + len(self.spelled))
        for k, piece in enumerate(self.piece, 1):
            i = np.flatnonzero((piece >= 0) & (left[: len(piece)] >= k))
            n += np.bincount(piece[i], np.exp(a[node[i]] + self.weight[k - 1][i] + b[node[i] + k] - all_of[i]), len(n))
        into += n[: self.pieces]
        for s, x in zip(self.spelled, n[self.pieces :]):
            np.add.at(into, s, x)


def _together(words: list[str]):
    """Numbers of words that go side by side, about TOGETHER characters at a time, and then of the long ones, one by one."""
    part, size = [], 0
    for i, w in enumerate(words):
        if len(w) > LONG:
            yield [i]
            continue
        part.append(i)
        size += len(w) + 1
        if size > TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def spelled(words: list[str], p: Pieces, w: np.ndarray) -> np.ndarray:
    """forward() of each word."""
    out = np.zeros(len(words))
    for part in _together(words):
        if len(words[part[0]]) > LONG:
            out[part] = forward(words[part[0]], p, w.tolist())
        else:
            s = _Lattices([words[i] for i in part], p, w)
            out[part] = s.whole(s.forward())
    return out


def needed(words: list[str], p: Pieces, w: np.ndarray, into: np.ndarray) -> None:
    """expected() of each word."""
    for part in _together(words):
        if len(words[part[0]]) > LONG:
            expected(words[part[0]], p, w.tolist(), into)
        else:
            _Lattices([words[i] for i in part], p, w).expected(into)


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case: bytes are split at the six ASCII white-space characters."""
    return (text or "").encode().lower().split()


def trains(doc_id: Column, folds: int = 10) -> Column:
    """Whether a document is one to learn from; a null doc_id is, as it has no number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != 0, F.lit(True))


def _counted(batches):
    """Rows (word, train, every) of a task, summed before they leave it."""
    n: dict[bytes, list[int]] = {}

    def out():
        v = np.array(list(n.values()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(v[:, 0]), pa.array(v[:, 1])], names=["word", "train", "every"])

    for b in batches:
        for train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for w in words(text):
                got = n.get(w)
                if got is None:
                    n[w] = [int(train), 1]
                else:
                    got[0] += train
                    got[1] += 1
            if len(n) > HELD:
                yield out()
                n.clear()
    if n:
        yield out()


def counts(docs: DataFrame) -> DataFrame:
    """(word binary, train, every): occurrences of each distinct word in training rows and in all of docs (train, text)."""
    got = small_batches(docs).mapInArrow(_counted, "word binary, train long, every long")
    return got.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def _rounds(path: str, w: np.ndarray):
    """A task's expected pieces over the spellings of its words."""

    def run(batches):
        p, into = pieces(path), np.zeros(len(w))
        for b in batches:
            needed([x.decode() for x in b.column(0).to_pylist()], p, w, into)
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(into[at])], names=["piece", "n"])

    return run


def learned(seen: DataFrame, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the vocabulary's pieces after rounds of expectation over the distinct training words of seen (word, train).

    The driver gets one number for each piece of the vocabulary, whatever the words. A piece that no word needs keeps a tenth of an occurrence.
    """
    w = pieces(path).initial
    types = seen.filter("train > 0").select("word")
    for _ in range(rounds):
        n = np.full(len(w), 0.1)
        for r in types.mapInArrow(_rounds(path, w), "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            n[r["piece"]] += r["n"]
        w = np.log(n / n.sum())
    return w


def _scored(path: str, w: np.ndarray, total: dict):
    """(word, known, base, score): both log10 probabilities of each distinct word."""

    def run(batches):
        p = pieces(path)
        for b in batches:
            c = b.column(1).to_numpy().astype(float)
            own = np.full(len(c), -np.inf)
            own[c > 0] = np.log((c[c > 0] - total["d"]) / (total["n"] + 1))
            every = np.logaddexp(own, spelled([x.decode() for x in b.column(0).to_pylist()], p, w) + math.log(total["free"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c > 0), pa.array(base_log10(c, total)), pa.array(every / math.log(10))], names=["word", "known", "base", "score"])

    return run


def base_log10(c, total: dict):
    return np.log10((c + 0.1) / (total["n"] + 0.1 * (total["v"] + 1)))


SCORED = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,n:long>>"


def _documents(head, end: tuple[bool, float, float]):
    """A row for each document: the sums over its end and its common words, and the words that are left with their numbers."""
    known: dict[bytes, tuple[bool, float, float]] = {}

    def run(batches):
        if not known:
            known.update({r[0]: r[1:] for r in head.value})
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in b.column(3).to_pylist():
                n: dict[bytes, int] = {}
                for w in words(text):
                    n[w] = n.get(w, 0) + 1
                hit = [(k, known[w]) for w, k in n.items() if w in known]
                cols[0].append(sum(n.values()) + 1)
                cols[1].append(sum(k for k, h in hit if h[0]) + end[0])
                cols[2].append(math.fsum([end[1], *(k * h[1] for k, h in hit)]))
                cols[3].append(math.fsum([end[2], *(k * h[2] for k, h in hit)]))
                cols[4].append([{"word": w, "n": k} for w, k in n.items() if w not in known])
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "rest"])

    return run


def size_class(n: Column) -> Column:
    """Eighths of powers of two."""
    return F.floor(8 * F.log2(n.cast("double"))).cast("int")


def common(scores: DataFrame, most: int = HEAD) -> int:
    """The least size class of occurrences above which at most so many words lie: all of these may go to every task."""
    by = scores.groupBy(size_class(F.col("every")).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # 504 rows at most
    taken, least = 0, 505
    for r in sorted(by, key=lambda r: -r["c"]):
        taken += r["n"]
        if taken > most:
            break
        least = r["c"]
    return least


def score_texts(docs: DataFrame, path: str, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text, train).

    A null or empty text is its end alone. Rows that repeat are scored each, and train as often as they stand there. A text or a word of any length is read whole. Without a training row the pieces alone
    spell, as the vocabulary's scores have it, and the end is half of all events. An empty table gives no rows.
    """
    spark = docs.sparkSession
    seen = written(counts(docs.select("train", "text")), "words")
    t = seen.filter("train > 0").agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("train") == 1), F.count_if(F.col("train") == 2)).first()
    ends = docs.agg(F.count_if("train")).first()[0] or 0
    n, v = t[0] + ends, t[1] + (ends > 0)
    d = t[2] / (t[2] + 2 * t[3]) if t[2] and t[3] else 0.5
    total = {"n": n, "v": v, "d": d, "free": (d * t[1] + 0.5) / (n + 1)}
    w = learned(seen, path, rounds)
    spelled = small_batches(seen.select("word", "train")).mapInArrow(_scored(path, w, total), "word binary, known boolean, base double, score double")
    scores = written(spelled.join(seen.select("word", "every"), "word"), "word_scores")
    often = size_class(F.col("every")) >= common(scores, head)
    few = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in scores.filter(often).select("word", "known", "base", "score").collect()]
    end = (ends > 0, float(base_log10(ends, total)), math.log10((ends + 0.5) / (n + 1)))
    numbered = docs.select(F.col("doc_id").cast("long"), (~F.col("train")).alias("held_out"), F.monotonically_increasing_id().alias("row"), "text")
    rows = written(small_batches(numbered).mapInArrow(_documents(spark.sparkContext.broadcast(few), end), SCORED), "document_scores")
    left = rows.select("row", F.explode("rest").alias("of")).select("row", "of.word", "of.n")
    rare = left.join(scores.filter(~often).select("word", "known", F.col("base").alias("b"), F.col("score").alias("s")), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("known"), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("s")).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("rest").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score")
    )


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents by a lattice learned from those whose crc32(doc_id) is not divisible by 10. A null doc_id is learned from."""
    import public_tokenizers

    docs = with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text")
    return score_texts(docs.withColumn("train", trains(F.col("doc_id"))), public_tokenizers.path("piece_bpe_32k.model"))
