"""Every operator against a plain version of its contract, on the smallest tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from estrado.llm import binary, fingerprints, html, langid, mixing, packing, quality, simhash, suffixes, tokens, topk
from estrado.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(tiny):
    return pd.read_parquet(f"{tiny}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def rows(spark, tiny, name, by):
    return QUERIES[name](spark, tiny).toPandas().sort_values(by).reset_index(drop=True)


def ids_of(text):
    return np.array(tokens.words(tokens.default_path()).tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_op1_keeps_the_article_alone(spark, tiny):
    got = rows(spark, tiny, "op1_html", "page_id")
    pages = pd.read_parquet(f"{tiny}/pages.parquet").sort_values("page_id")
    assert got.page_id.tolist() == pages.page_id.tolist()
    assert (got.n_chars == got.text.str.len()).all() and (got.n_chars > 0).all()
    for text, page in zip(got.text, pages.html):
        assert "track(" not in text and "<p>" not in text and "©" not in text


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site for many reasons, all of them long.</div>
<main><article><h1>Head &amp; line</h1><p>First  paragraph with\n some words in it, as long as one would wish.<p>Second &lt;one&gt;, unclosed, also of a fair length for a paragraph.
<aside>Read also</aside><div class="ad banner">Buy now</div><form><input name=q> search text</form><p>Short.</p><script>var x = "</p>";</script></article>
<section id="comments"><p>I disagree with everything that was said above, at length and in detail.</p></section></main><footer>&copy; me</footer></body></html>"""


def test_op1_on_a_page_with_everything():
    assert html.extract(PAGE) == "Head & line\nFirst paragraph with some words in it, as long as one would wish.\nSecond <one>, unclosed, also of a fair length for a paragraph.\nShort."


LONG = [f"{'long sentence of a real text number %d ' % i * 6}".strip() for i in range(5)]
PARAS = "".join(f"<p>{x}</p>" for x in LONG)
MENU = "".join(f"<li><a href={i}>Another page {i}</a></li>" for i in range(6))
# pages by hand, with the text that a reader would mark
BY_HAND = {
    "wrapped in a sidebar layout": (f"<body><div class='layout has-sidebar'><div class=sidebar><p>Aside</p></div><h1>Title</h1>{PARAS}</div>", ["Title", *LONG]),
    "no end of head": (f"<html><head><title>T</title><body><h1>Title</h1>{PARAS}", ["Title", *LONG]),
    "no head's end and no body": (f"<html><head><title>T</title><article><h1>Title</h1>{PARAS}</article>", ["Title", *LONG]),
    "menu within the article": (f"<article><h1>Title</h1>{PARAS}<ul>{MENU}</ul><p>End.</p></article>", ["Title", *LONG, "End."]),
    "one link in the article stays": (f"<article><h1>Title</h1>{PARAS}<p><a href=x>Source of this</a></p></article>", ["Title", *LONG, "Source of this"]),
    "several articles": (f"<main>{''.join(f'<article><h2>Part</h2><p>{x}</p></article>' for x in LONG)}</main>", [y for x in LONG for y in ("Part", x)]),
    "page in a form": (f"<body><form action=x><h1>Title</h1>{PARAS}<div class=cookie-notice>{'We use cookies, as all do. ' * 4}</div></form>", ["Title", *LONG]),
    "long comments below a short article": (f"<article><h1>Title</h1><p>{LONG[0]}</p></article><div id=comments><article class=comment>{PARAS}</article></div>", ["Title", LONG[0]]),
    "comments within the article": (f"<article><h1>Title</h1>{PARAS}<section class='comments-area'><article class=comment><p>{LONG[0]}</p></article></section></article>", ["Title", *LONG]),
    "page without any container": (f"<body><p>Home</p><p>News</p><h2>Title</h2>{PARAS}<p>Imprint</p>", ["Title", *LONG]),
    "article classed as related": (f"<div class=related-content><article><h1>Title</h1>{PARAS}</article></div><aside>x</aside>", ["Title", *LONG]),
    "one advert of text": (f"<div class=ad>{LONG[0]}</div><div><h1>Title</h1>{PARAS}</div>", ["Title", *LONG]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_op1_on_pages_by_hand(name):
    page, want = BY_HAND[name]
    assert html.extract(page).split("\n") == want


def test_op1_the_clusters_decide(monkeypatch):
    """With every line marked, pages come out otherwise: what is kept hangs on the threshold."""
    names = ["page without any container", "menu within the article"]
    right = {n: html.extract(BY_HAND[n][0]) for n in names}
    monkeypatch.setattr(html, "_threshold", lambda x: -1.0)
    for n in names:
        assert html.extract(BY_HAND[n][0]) != right[n]


def test_op1_without_an_article():
    body = "".join(f"<p>{'long sentence of a real text number %d ' % i * 6}</p>" for i in range(5))
    page = f"<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div><h2>Title</h2>{body}</div><div class=footer>x</div></body>"
    assert html.extract(page).split("\n")[0] == "Title" and html.extract(page).count("\n") == 5


def test_op1_wrapped_in_a_name():
    page = "<body class=page><div class='has-sidebar widget'><nav>Menu here</nav><p>The only text there is, and it is long enough.</p></div></body>"
    assert html.extract(page) == "The only text there is, and it is long enough."


@pytest.mark.parametrize("bad", [None, "", "   ", "<", "<p", "plain text", "<!-- x", "<article>", "<p>a<b>c", "&#x;&amp;&nosuch;", "<script>x"])
def test_op1_on_scraps(bad):
    assert isinstance(html.extract(bad), str)


def test_op2_and_op8(spark, tiny, docs):
    two, eight = rows(spark, tiny, "op2_binary", "doc_id"), rows(spark, tiny, "op8_packing", ["doc_id", "piece"])
    start, want, pieces = 0, [], []
    for i, t in zip(docs.doc_id, docs.text):
        x = ids_of(t)
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
        pieces += [(i, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes())) for k in range(0, len(x), 4096)]
    assert list(two.itertuples(index=False, name=None)) == want
    assert list(eight[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == pieces
    for _, g in eight.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert eight.sequence_id.nunique() <= np.ceil(eight.length.sum() / 4096 * 1.02) + 1


@pytest.mark.parametrize("bit", [False, True])
@pytest.mark.parametrize("top", [1, 200, 49_000, 2**32 - 1])
def test_shards_round_trip(bit, top):
    rng = np.random.default_rng(top)
    counts = np.array([0, 1, 70_000, 5, 130_001])
    ids = rng.integers(0, top, counts.sum(), dtype=np.uint64).astype(np.uint32)
    doc_ids = np.array([-5, 2, 3, 2**40, 2**62])
    s = binary.Shard(binary.encode_shard(doc_ids, counts, ids, bit))
    assert (s.doc_ids == doc_ids).all() and (s.counts == counts).all()
    assert (np.concatenate([s.block(i) for i in range(len(s.blocks))]) == ids).all()
    assert (s.slice(70_001, 9) == ids[70_001:70_010]).all() and not len(s.slice(3, 0))


def test_words_give_what_the_tokenizer_gives():
    rng = np.random.default_rng(0)
    alphabet = list("aAéÉ ßñ'’ś \n\t\x1c\x85.,!12½IİıΣς日😀_-<|>e") + ["<|endoftext|>", "don't", " "]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(1500)] + [None, "", "   "]
    import pyarrow as pa

    ids, counts = tokens.words(tokens.default_path()).encode(pa.array(texts))
    at = 0
    for t, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == ids_of(t).tolist(), repr(t)
        at += n


def plain_repeats(pairs, k=50):
    seen, out = {}, []
    for i, t in sorted(pairs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - k + 1):
            if seen.get(b[j : j + k], i) < i:
                gone[j] += 1
                gone[j + k] -= 1
        for j in range(len(b) - k + 1):
            seen.setdefault(b[j : j + k], i)
        g = np.cumsum(gone[:-1]) > 0
        out.append((i, len(b), int(g.sum()), int((np.diff(g.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~g])).hexdigest()))
    return out


def test_op3(spark, tiny, docs):
    got = rows(spark, tiny, "op3_suffixes", "doc_id")
    assert list(got.itertuples(index=False, name=None)) == plain_repeats(list(zip(docs.doc_id, docs.text)))


def test_op3_on_hard_texts(spark, monkeypatch):
    """Periodic texts, few letters, repeats in a document, passages at the borders, and segments and chunks of a few bytes."""
    monkeypatch.setattr(suffixes, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    rng = np.random.default_rng(1)
    word = lambda n, a: "".join(rng.choice(list(a), n))
    p = word(120, "abcdefgh ")
    texts = ["a" * 400, "a" * 49, "a" * 50, "ab" * 90, p, "x" + p + "y", p[:60] + p[:60], word(300, "ab"), word(300, "ab"), "é" * 60, "", None, p[10:70] + word(80, "xyz") + p[50:110], word(49, "q"), p]
    texts += [word(200, "ab") for _ in range(8)]
    pairs = [(i * 3 - 7, t) for i, t in enumerate(texts)]
    d = suffixes.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5))
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in d.collect())
    assert got == plain_repeats(pairs)


def test_op4(spark, tiny, docs):
    got = rows(spark, tiny, "op4_fingerprints", "doc_id").iloc[::-1].reset_index(drop=True)
    d = docs.iloc[::-1].reset_index(drop=True)
    w = fingerprints.walk()
    for i, r in got.iterrows():
        t, nxt = d.text[i], d.text[(i + 1) % len(d)]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (d.doc_id[i], len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.fingerprint(t), fingerprints.fingerprint(e))
        assert r.near_next == pytest.approx(w.likeness(r.fingerprint, fingerprints.fingerprint(nxt)))
    assert got.near_edited.mean() > 0.45 and got.near_next.mean() < 0.2


def plain_walk(text):
    p, k = fingerprints._points(text)
    bits = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (fingerprints.CLASSES, fingerprints.PERIOD)).astype(bool)
    i = j = 0
    out = []
    while i < len(p):
        out.append((int(p[i]) * 0x9E3779B1 & 0xFFFFFFFF) >> 24)
        i += bits[k[i], j % fingerprints.PERIOD]
        j += 1
    rate = 0
    while len(out) >> rate >= fingerprints.SAMPLES:
        rate += 1
    return f"{rate:02x}" + bytes(out[x] for x in fingerprints.walk().sampled(rate, len(out))).hex() if out else "00"


def test_op4_walk_is_the_plain_walk(docs):
    for t in ["", "a", "ab", "abc", "abcd", "日本 é", *docs.text[:40]]:
        assert fingerprints.fingerprint(t) == plain_walk(t)


def test_op4_likeness_follows_edits(docs):
    w, rng = fingerprints.walk(), np.random.default_rng(2)
    means = []
    for share in (0.0, 0.01, 0.05, 0.3):
        got = []
        for t in docs.text[docs.text.str.len() > 800][:30]:
            u = list(t)
            for i in rng.choice(len(u), int(share * len(u)), replace=False):
                u[i] = rng.choice(["", "x", u[i] + "y"])
            got.append(w.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint("".join(u))))
        means.append(np.mean(got))
    assert means[0] == 1 and means[0] > means[1] > means[2] > means[3]


def test_op4_near_pairs_against_all_pairs(spark, docs, monkeypatch):
    """Of all pairs of likeness 0.8 or more, planted ones and ones with edits spread over the text, 0.97 and more share a class; none below do."""
    monkeypatch.setattr(fingerprints, "BLOCK", 8)
    rng = np.random.default_rng(8)
    texts = [t for t in docs.text if t]
    for t in [t for t in texts if len(t) > 300][:40]:
        for edits in (1, 3, 6):
            c = list(t)
            for at in rng.integers(0, len(c), edits).tolist():
                c[at] = rng.choice(["", "x", c[at] + "q"])
            texts.append("".join(c))
    texts += ["the same beginning of many texts, again and again, " * 6 + f"number {i}" for i in range(40)]
    prints = [fingerprints.fingerprint(t) for t in texts]
    found = {r.fingerprint: (r.root, r.n) for r in fingerprints.near_pairs(spark.createDataFrame([(p,) for p in [*prints, None]], "fingerprint string")).collect()}
    own, w = sorted(set(prints)), fingerprints.walk()
    want = [(a, b) for i, a in enumerate(own) for b in own[:i] if w.likeness(a, b) >= 0.8]
    assert len(want) > 100
    assert sum(a in found and b in found and found[a][0] == found[b][0] for a, b in want) >= 0.97 * len(want)
    parent = {p: p for p in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for f, (r, n) in found.items():
        assert root(f) == root(r) and n >= prints.count(f)


def test_op5_on_held_out(spark, tiny, docs):
    got = rows(spark, tiny, "op5_langid", "doc_id").merge(docs, on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.9 and got.score.between(0, 1).all()


def test_op5_marginals_are_exact():
    """Against the sum over all labellings, and over segments cut small."""
    rng = np.random.default_rng(3)
    trans = rng.normal(size=(3, 3))
    e = rng.random((5, 3)) + 0.1
    T, total = np.exp(trans), np.zeros((5, 3))
    for path in np.ndindex(*[3] * 5):
        p = np.prod([e[i, s] for i, s in enumerate(path)]) * np.prod([T[a, b] for a, b in zip(path, path[1:])]) * T[:, path[0]].sum()
        for i, s in enumerate(path):
            total[i, s] += p
    want = total / total.sum(axis=1, keepdims=True)
    assert np.allclose(langid.marginals(e, np.array([5]), trans), want)
    old, langid.SEGMENT = langid.SEGMENT, 2
    try:
        both = langid.marginals(np.concatenate([e, e[:1]]), np.array([5, 1]), trans)
    finally:
        langid.SEGMENT = old
    assert np.allclose(both[:5], want)


def test_op5_code_switching():
    en, es = ["the house and the water of this land are good and with us"] * 5, ["la casa y el agua de esta tierra son buenas para nosotros"] * 5
    f = langid.train([(t, "en") for t in en] + [(t, "es") for t in es])
    w = "the house and the water la casa y el agua".split()
    post = langid.marginals(f.rows[f.codes(w)], np.array([len(w)]), f.transitions)
    assert (post.argmax(axis=1) == [0] * 5 + [1] * 5).all()


def plain_components(fps, ids, distance=3):
    order = np.argsort(ids)
    v, ids = fps[order], ids[order]
    parent = list(range(len(v)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:i] ^ v[i]) <= distance):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {int(ids[i]): int(ids[root(i)]) for i in range(len(v))}


def test_op6(spark, tiny, docs):
    import xxhash

    got = rows(spark, tiny, "op6_simhash", "doc_id")
    for t, f in zip(docs.text[:60], got.fingerprint[:60]):
        w = t.encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        c = Counter(b for s in sh for b in range(64) if xxhash.xxh64_intdigest(s, 42) >> b & 1)
        assert int(f, 16) == sum(1 << b for b in range(64) if 2 * c[b] > len(sh))
    want = plain_components(np.array([int(f, 16) for f in got.fingerprint], np.uint64), got.doc_id.to_numpy())
    assert dict(zip(got.doc_id, got.component_id)) == want


@pytest.mark.parametrize("hot", [256, 4])
def test_op6_links_lose_nothing_in_dense_groups(spark, monkeypatch, hot):
    """Clouds of close fingerprints, also with every shared key cut again."""
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    v = [b ^ np.uint64(sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 4))))) for b in base for _ in range(25)]
    v = np.unique(np.array(v, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = plain_components(v, v.view(np.int64))
    groups = {}
    for n in v.view(np.int64).tolist():
        groups.setdefault(roots.get(n, n), set()).add(n)
    expect = {}
    for n, r in want.items():
        expect.setdefault(r, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_op7_on_held_out(spark, tiny):
    sf = tiny.replace("sf0.001", "sf0.01")
    got = QUERIES["op7_quality"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.5)).all()


def test_op7_column_is_the_model(spark):
    rng = np.random.default_rng(5)
    x = rng.random((400, len(quality.STATS)))
    m = quality.fit(x, ((x[:, 3] < 0.4) & (x[:, 5] > 0.2)).astype(float))
    assert m.rules and len(m.rules) < 200
    s = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"`{n}` double" for n in quality.STATS)).select(m.column().alias("s"))
    assert np.allclose([r.s for r in s.collect()], m.score(x))


def plain_targets(sizes, weights=(5, 2, 1), share=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        for s in over:
            out[s] = 2 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def test_op9(spark, tiny, docs):
    got = rows(spark, tiny, "op9_mixing", "doc_id")
    again = rows(spark, tiny, "op9_mixing", "doc_id")
    assert got.equals(again)
    d = docs.merge(got, on="doc_id")
    assert (d["size"] == [len(t.encode().split()) for t in d.text]).all()
    sizes = d.groupby("source")["size"].sum().to_dict()
    for s, t in plain_targets(sizes).items():
        g = d[d.source == s]
        assert (g.source_size == sizes[s]).all() and g.target.iloc[0] == pytest.approx(t)
        assert abs(g.taken.sum() - t) <= max(g["size"].max(), 0.02 * t)
    assert (d.taken <= 2 * d["size"]).all() and (d.taken % d["size"].clip(lower=1) == 0).all()


def test_op9_pareto_prefers_by_odds(spark):
    """Expected copies follow the root of the size, whole copies are certain, and a third of all rows in a source is no matter."""
    r = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(12000)]
    m = mixing.mix(spark.createDataFrame(r, "doc_id long, text string, source string")).toPandas()
    for s, g in m.groupby("source"):
        target = g.target.iloc[0]
        assert abs((g.copies * g["size"]).sum() - target) <= 7
        level = 2.0
        for _ in range(100):  # the level at which expected words add up, by fixed-point steps
            e = np.minimum(2, level * g["size"] ** 0.5)
            level *= target / (e * g["size"]).sum()
        e = np.minimum(2, level * g["size"] ** 0.5)
        assert ((g.copies == np.floor(e + 1e-9)) | (g.copies == np.ceil(e - 1e-9))).all()
        for size, h in g.groupby("size"):
            assert abs(h.copies.mean() - e[h.index].mean()) < 0.12, (s, size)
    by_size = m[m.source == "big"].groupby("size").copies.mean()
    assert by_size[7] > by_size[1] + 0.2


@pytest.mark.parametrize("n", [2, 3000])
def test_op9_equal_rows_draw_once_each(spark, n):
    r = [(1, "w " * 10, "same", {"x": 1}, 5)] * n + [(2 + i, "v " * (3 + i % 5), "other", {}, i) for i in range(200)] + [(900 + i, "z " * 9, None, None, i) for i in range(50)]
    d = spark.createDataFrame(r, "doc_id long, text string, source string, more map<string,int>, tie long").repartition(3)
    m = mixing.mix(d)
    assert m.columns == ["doc_id", "text", "source", "more", "tie", "size", "source_size", "target", "copies"]
    got = m.toPandas()
    assert len(got) == len(r) and sorted(got[got.source == "other"].tie) == list(range(200))
    want = plain_targets({"same": 10 * n, "other": sum(3 + i % 5 for i in range(200)), None: 450})
    for s, g in got.fillna({"source": "-"}).groupby("source"):
        t = want[None if s == "-" else s]
        assert g.target.iloc[0] == pytest.approx(t) and abs((g.copies * g["size"]).sum() - t) <= 10 and g.copies.max() <= 2
    again = mixing.mix(d.repartition(5)).toPandas()
    assert sorted(zip(got.doc_id, got.copies)) == sorted(zip(again.doc_id, again.copies))
    assert mixing.apply_mix(d).columns == d.columns


def test_op10(spark, tiny):
    got = rows(spark, tiny, "op10_topk", ["query_id", "rank"])
    e = pd.read_parquet(f"{tiny}/embeddings.parquet")
    v = np.floor(256 * np.stack(e.embedding).astype(np.float64)).astype(np.int64)
    ids = e.vec_id.to_numpy()
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        best = sorted((-int(x), int(n)) for x, n in zip(s, ids) if n != ids[i])[:5]
        want += [(int(ids[i]), k + 1, n, -x) for k, (x, n) in enumerate(best)]
    assert list(got.itertuples(index=False, name=None)) == sorted(want)


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_op10_with_ties_and_negative_scores(spark, lists):
    rng = np.random.default_rng(6)
    v = rng.integers(-3, 4, (90, 6))
    v[10:40] = v[0]
    df = spark.createDataFrame([(i, [int(c) for c in x]) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got = topk.top_k(df.filter("vec_id % 9 = 0"), df, 5, lists).collect()
    want = []
    for i in range(0, 90, 9):
        best = sorted((-int(v[j] @ v[i]), j) for j in range(90) if j != i)[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_plan_packs_each_piece_once():
    rng = np.random.default_rng(7)
    lengths = np.concatenate([rng.integers(1, 101, 3000), np.full(1500, 37)])
    counts = Counter(lengths.tolist())
    used = Counter()
    for length, lo, hi, first, per, base in packing.plan(counts, 100):
        for i in range(hi - lo):
            for at in range(base + i % per * length, base + i % per * length + length):
                used[first + i // per, at] += 1
    assert max(used.values()) == 1 and sum(used.values()) == lengths.sum()
    rooms = []
    for x in sorted(lengths.tolist(), reverse=True):  # best fit, one by one
        fits = [r for r in rooms if r >= x]
        rooms.append((min(fits) if fits else 100) - x)
        if fits:
            rooms.remove(min(fits))
    assert len({s for s, _ in used}) <= len(rooms) and all(at < 100 for _, at in used)


def test_op5_learns_from_repeated_rows(spark):
    """4,000 equal rows of one language and 390 others of another: both are learned, and both are found again."""
    es, en = "la casa y el agua de esta tierra son buenas", "the house and the water of this land are good"
    rows = [(3, es, "es")] * 4000 + [(i, f"{en} {i}", "en") for i in range(390)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.sample(d)
    assert {l for _, l in got} == {"en", "es"} and sum(l == "en" for _, l in got) == langid.PER_LANGUAGE and sum(l == "es" for _, l in got) == 1
    assert sorted(got) == sorted(langid.sample(d.repartition(5)))
    f = langid.train(got)
    out = {r.text: r.lang_pred for r in langid.predict(spark.createDataFrame([(es,), (en,)], "text string"), f).collect()}
    assert out == {es: "es", en: "en"}


def test_op5_many_languages(spark, monkeypatch):
    """No language is left out, and the rows gathered keep their bound."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 100)
    rows = [(i, f"word{i % 60} text{i}", f"l{i % 60}") for i in range(600)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len({l for _, l in got}) == 60 and len(got) == 60
    # one segment for a long text gives the marginals that chained segments give
    rng = np.random.default_rng(4)
    e, T = rng.random((700, 3)) + 0.1, rng.normal(size=(3, 3))
    want = langid.marginals(e, np.array([650, 50]), T)
    monkeypatch.setattr(langid, "CHAINED", 2)
    assert np.allclose(langid.marginals(e, np.array([650, 50]), T), want)
