"""Language identification: a linear-chain conditional random field over words.

Each word is labelled with a language; features are its affixes, character n-grams and its
entry in a lexicon, and transitions between the languages of neighbouring words are learned with them, so that in
code-switched text each stretch finds its own. The field is trained on a bounded sample: of each language about
PER_LANGUAGE labelled documents, a stretch of at most STRETCH words within STRETCH_CHARS characters of each, joined to sequences that switch.

Forward-backward runs over whole texts. A text's words are cut into segments; the transfer
matrices of all segments of a batch are computed together, then chained, so the loop is as long as a segment,
not as a text, and the marginals are exact.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, small_batches, table, with_defaults
from .tokens import slices

PER_LANGUAGE = 300
STRETCH = 160
STRETCH_CHARS = 6000
#: Rows that training gathers at most, shared by the languages; of more languages than that, one row each.
SAMPLE_ROWS = 24_000
BUCKETS = 1 << 15
SEGMENT = 256
#: Labels up to which long texts are cut into segments that are chained.
CHAINED = 32
EPOCHS = 6
UNKNOWN = "und"
_CLEAN = re.compile(r"[\W\d_]+")


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of words without empties, and the word that each is of: 2- and 3-grams with the word's ends, affixes, the word."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    c = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    of, end = np.repeat(np.arange(len(words)), size), np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(c))  # characters from here to the word's end

    def mix(a, b, kind):
        h = (a * np.uint64(0x9E3779B97F4A7C15) + b + np.uint64(kind)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))

    grams = [c]
    for n in (2, 3, 4):
        grams.append(mix(grams[-1][:-1], c[n - 1 :], n))
    out, owner = [], []
    for n in (2, 3):
        ok = np.flatnonzero(left[: len(grams[n - 1])] >= n)
        out.append(grams[n - 1][ok])
        owner.append(of[ok])
    start = end - size
    for n in (2, 3, 4):  # affixes, shorter ones where the word is
        at = np.minimum(n, size)
        for k in np.unique(at).tolist():
            w = np.flatnonzero(at == k)
            out += [mix(grams[k - 1][start[w]], grams[k - 1][start[w]], 10 + n), mix(grams[k - 1][end[w] - k], grams[k - 1][end[w] - k], 20 + n)]
            owner += [w, w]
    # the word by its weighted sum of mixed characters
    place = np.arange(len(c)) - np.repeat(start, size)
    whole = np.add.reduceat(mix(c, place.astype(np.uint64), 30), start) if len(words) else np.zeros(0, np.uint64)
    out.append(mix(whole, whole, 31))
    owner.append(np.arange(len(words)))
    flat = np.concatenate(out)
    return ((flat >> np.uint64(20)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owner)


def clean(word: str) -> str:
    """The letters of a word, in lower case; empty if it has none."""
    return word.lower() if word.isalpha() else _CLEAN.sub("", word).lower()


class Field:
    """Weights of the field, and its emissions of words, kept for words seen before up to a bound."""

    KEPT = 250_000

    def __init__(self, languages: list[str], lexicon: dict[str, list[float]], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, int] = {}
        self.word: dict[str, int] = {"": 0}
        self.rows = np.ones((1 << 12, len(self.languages)), np.float64)

    def __getstate__(self):
        return (self.languages, self.lexicon, self.weights, self.transitions)

    def __setstate__(self, s):
        self.__init__(*s)

    def emissions(self, words: list[str]) -> np.ndarray:
        f, of = _features(words)
        n, L = len(words), len(self.languages)
        e = np.stack([np.bincount(of, self.weights[f, l], n) for l in range(L)], axis=1) / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))[:, None]
        known = [i for i, w in enumerate(words) if w in self.lexicon]
        if known:
            e[known] += self.weights[BUCKETS] * np.array([self.lexicon[words[i]] for i in known])
        return np.exp(e - e.max(axis=1, keepdims=True))

    def codes(self, raw: list[str]) -> np.ndarray:
        """Rows of the emission table for distinct raw words; 0 for those without letters."""
        if len(self.raw) > self.KEPT:
            self.clear()
        known, word = self.raw, self.word
        new = {r: clean(r) for r in raw if r not in known}
        fresh = [w for w in dict.fromkeys(new.values()) if w not in word]
        if fresh:
            n = len(word)
            while n + len(fresh) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.ones_like(self.rows)])
            for a in range(0, len(fresh), 1 << 16):
                self.rows[n + a : n + min(len(fresh), a + (1 << 16))] = self.emissions(fresh[a : a + (1 << 16)])
            word.update(zip(fresh, range(n, n + len(fresh))))
        known.update((r, word[w]) for r, w in new.items())
        return np.fromiter((known[r] for r in raw), np.int64, len(raw))


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, forward: bool = False):
    """Posterior of each label at each word; with forward also its posterior given the words up to it. emit: (words, labels) of all texts, one after the other, positive."""
    L = emit.shape[1]
    T = np.exp(transitions - transitions.max())
    # transfer matrices are squares of the labels: with many labels a text is one segment
    segment = SEGMENT if L <= CHAINED else int(max(SEGMENT, lengths.max(initial=0)))
    n_seg = -(-lengths // segment)
    text = np.repeat(np.arange(len(lengths)), n_seg)
    order = np.arange(len(text)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
    start = (np.cumsum(lengths) - lengths)[text] + order * segment
    size = np.minimum(lengths[text] - order * segment, segment)
    by = np.argsort(-size, kind="stable")
    at, n = start[by], size[by]
    live = [int(np.searchsorted(-n, -t, side="left")) for t in range(int(n[0]) + 1 if len(n) else 1)]  # segments longer than t
    S, norm = len(by), lambda x: x / x.sum(axis=-1, keepdims=True)
    # transfer of each segment: row i is the outcome of entering with label i
    chained = S > 0 and n_seg.max() > 1  # texts of one segment enter and leave freely
    M = np.broadcast_to(np.eye(L), (S, L, L))
    M = M.copy() if chained else M
    for t in range(int(n[0]) if chained else 0):
        m = live[t]
        x = (M[:m] @ T) * emit[at[:m] + t][:, None, :]
        M[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    inv = np.empty(S, np.int64)
    inv[by] = np.arange(S)
    M = M[inv] if chained else M
    enter, leave = np.full((S, L), 1.0 / L), np.ones((S, L))
    for k in range(1, int(n_seg.max(initial=0))):
        s = np.flatnonzero(order == k)
        enter[s] = norm(np.einsum("si,sij->sj", enter[s - 1], M[s - 1]))
    for k in range(int(n_seg.max(initial=0)) - 1, 0, -1):
        s = np.flatnonzero(order == k)
        leave[s - 1] = norm(np.einsum("sij,sj->si", M[s], leave[s]))
    alpha = np.empty_like(emit)
    a, b = enter[by], leave[by]
    for t in range(int(n[0]) if S else 0):
        m = live[t]
        # the first word of a text has no transition into it
        a[:m] = norm((a[:m] @ T) * emit[at[:m] + t])
        alpha[at[:m] + t] = a[:m]
    ahead = alpha.copy() if forward else None
    for t in range((int(n[0]) if S else 0) - 1, -1, -1):
        m = live[t]
        i = at[:m] + t
        alpha[i] *= b[:m]
        b[:m] = norm((b[:m] * emit[i]) @ T.T)
    return (norm(alpha), ahead) if forward else norm(alpha)


def train(samples: list[tuple[str, str]], seed: int = 5) -> Field:
    """A field from (text, language) pairs."""
    rng = np.random.Generator(np.random.PCG64(seed))
    languages = sorted({l for _, l in samples})
    number = {l: i for i, l in enumerate(languages)}
    L = len(languages)
    words = []
    for text, l in samples:
        w = [c for c in map(clean, text.split()) if c]
        if w:
            a = int(rng.integers(0, max(1, len(w) - STRETCH + 1)))
            words.append((w[a : a + STRETCH], number[l]))
    weights, trans = np.zeros((BUCKETS + 1, L)), np.zeros((L, L))
    if not words:
        return Field(languages or [UNKNOWN], {}, weights if L else np.zeros((BUCKETS + 1, 1)), trans if L else np.zeros((1, 1)))
    # lexicon: words in two documents or more, and how their documents' languages part
    count: dict[str, Counter] = {}
    for w, l in words:
        for x in set(w):
            count.setdefault(x, Counter())[l] += 1
    share = np.maximum(np.bincount([l for _, l in words], minlength=L), 1)
    lexicon = {}
    for x, c in count.items():
        if sum(c.values()) > 1:
            p = np.array([(c[i] + 0.1) / share[i] for i in range(L)])
            lexicon[x] = (p / p.sum()).tolist()
    vocabulary = list(count)
    flat, of = _features(vocabulary)
    order = np.argsort(of, kind="stable")
    feats = dict(zip(vocabulary, np.split(flat[order], np.searchsorted(of[order], np.arange(1, len(vocabulary))))))
    lex = {x: np.array(lexicon.get(x, [0.0] * L)) for x in count}
    gw, gt = np.full_like(weights, 1e-3), np.full_like(trans, 1e-1)
    for epoch in range(EPOCHS):
        rng.shuffle(order := np.arange(len(words)))
        pieces = []
        for i in order.tolist():
            w, l = words[i]
            cut = int(rng.integers(4, 24))
            pieces += [(w[a : a + cut], l) for a in range(0, len(w), cut)]
        rng.shuffle(mixed := np.arange(len(pieces)))
        for a in range(0, len(mixed), 64):
            batch, size = [], []
            for k in range(a, min(a + 64, len(mixed)), 4):
                run = [(x, l) for i in mixed[k : k + 4].tolist() for x in pieces[i][0] for l in (pieces[i][1],)]
                batch += run
                size.append(len(run))
            at = [feats[x] for x, _ in batch]
            n = np.array([len(f) for f in at])
            flat, row = np.concatenate(at), np.repeat(np.arange(len(at)), n)
            scale = 1 / np.sqrt(n)
            e = np.add.reduceat(weights[flat], np.cumsum(n) - n, axis=0)
            lx = np.array([lex[x] for x, _ in batch])
            e = e * scale[:, None] + weights[BUCKETS] * lx
            em = np.exp(e - e.max(axis=1, keepdims=True))
            post, ahead = marginals(em, np.array(size), trans, True)
            truth = np.array([l for _, l in batch])
            g = -post
            g[np.arange(len(g)), truth] += 1
            inner = np.ones(len(batch) - 1, bool)
            inner[np.cumsum(size)[:-1] - 1] = False
            i = np.flatnonzero(inner)
            # posterior of each pair of neighbours: forward, transition, and the second word's posterior over what led to it
            step = ahead[i][:, :, None] * np.exp(trans - trans.max())[None]
            pair = step / step.sum(axis=1, keepdims=True) * post[i + 1][:, None, :]
            dt = -pair.sum(axis=0)
            np.add.at(dt, (truth[i], truth[i + 1]), 1)
            # only the features that the batch has change
            order = np.argsort(flat, kind="stable")
            used, begin = np.unique(flat[order], return_index=True)
            used = np.append(used, BUCKETS)
            dw = np.concatenate([np.add.reduceat((g * scale[:, None])[row[order]], begin, axis=0), (g * lx).sum(axis=0)[None]])
            gw[used] += dw**2
            gt += dt**2
            weights[used] += 0.3 * dw / np.sqrt(gw[used])
            trans += 0.3 * dt / np.sqrt(gt)
    return Field(languages, lexicon, weights, trans)


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """per_language distinct rows (text, lang) of each language of labelled(doc_id, text, lang), or all if there are fewer; with many languages fewer rows of each (SAMPLE_ROWS).

    Rows are drawn by a hash; one that stands there n times is drawn as if each copy drew, and comes once. So a language whose rows are all equal is learned too.
    Of a longer text STRETCH_CHARS characters from a place that the hash draws are taken, so what is gathered has a bound.
    """
    h = F.xxhash64("doc_id", "text")
    copies = labelled.select("lang", h.alias("h")).groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    languages = labelled.select("lang").distinct().count()
    if not languages:
        return []
    each = max(1, min(per_language, SAMPLE_ROWS // languages))
    # the least of n exponential draws is one of n times the rate
    u = (F.pmod(F.xxhash64("h"), F.lit(1 << 40)) + 1) / float(1 << 40)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(-F.log(u) / F.col("n"), "h"))
    drawn = copies.withColumn("r", rank).filter(F.col("r") <= each).select(F.col("lang").alias("l"), F.col("h").alias("drawn"))  # SAMPLE_ROWS or a row for each language
    room = F.greatest(F.length("text") - STRETCH_CHARS + 1, F.lit(1))
    text = F.substr("text", (F.pmod(F.xxhash64(h), room) + 1).cast("int"), F.lit(STRETCH_CHARS))
    rows = labelled.join(F.broadcast(drawn), (F.col("lang") == F.col("l")) & (h == F.col("drawn"))).select("lang", "drawn", text.alias("text"))
    return sorted((r["text"], r["lang"]) for r in rows.groupBy("lang", "drawn").agg(F.min("text").alias("text")).collect())


def predict(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the language whose mean posterior over all words is the greatest, and that mean.

    Only words with letters are labelled. A null text, or one without a letter, is UNKNOWN with score 0. Columns
    of these names are replaced; all others stay.
    """
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    at = [f.name for f in keep].index(text)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = shared.value
        names = np.array([*f.languages, UNKNOWN], object)
        for b in batches:
            col = b.column(at)
            for a, k in slices(col, (16 << 20) // max(4, len(f.languages))):
                part = b.slice(a, k)
                words = pc.ascii_split_whitespace(pc.fill_null(part.column(at).cast(pa.large_string()), ""))
                flat = words.flatten().dictionary_encode()
                code = f.codes(flat.dictionary.to_pylist())[flat.indices.to_numpy(zero_copy_only=False)]
                row = np.repeat(np.arange(k), pc.list_value_length(words).to_numpy(zero_copy_only=False))
                row, code = row[code > 0], code[code > 0]
                n = np.bincount(row, minlength=k)
                has = np.flatnonzero(n)
                mean = np.zeros((k, len(f.languages)))
                if len(has):
                    post = marginals(f.rows[code], n[has], f.transitions)
                    mean[has] = np.add.reduceat(post, np.cumsum(n[has]) - n[has], axis=0) / n[has][:, None]
                best = mean.argmax(axis=1)
                score = np.where(n > 0, mean[np.arange(k), best], 0.0)
                best = np.where(n > 0, best, len(f.languages))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best].tolist(), pa.string()), pa.array(np.minimum(score, 1.0))], names=[*part.schema.names, "lang_pred", "score"])

        # workers live on for other stages: what was kept for this task goes with it
        f.clear()
        release()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "lang_pred string", "score double"])
    return small_batches(docs).select(*[f"`{f.name}`" for f in keep]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> Field:
    """A field from docs(doc_id, text, lang), without the held-out rows; a row without doc_id isn't learned from."""
    return train(sample(docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
