"""Removal of repeats where names clash: the second name keeps different strings apart."""

import numpy as np
import pyarrow as pa
import pytest

from estrado.llm import suffixes as s


def brute(docs, threshold):
    first = {}
    for i, t in docs:
        for a in range(len(t) - threshold + 1):
            w = t[a : a + threshold]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - threshold + 1):
            if first[t[a : a + threshold]] < i:
                gone[a : a + threshold] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g))
    return out


def here(docs, per_segment, buckets=3, seed=6, threshold=15):
    """The rounds of remove_repeats() in this process, so that what names are can be changed."""
    rows = []
    for k in range(0, len(docs), per_segment):
        part = docs[k : k + per_segment]
        rows.append({"segment": k, "doc_ids": [i for i, _ in part], "rows": list(range(len(part))), "sizes": [len(t) for _, t in part], "extra": [None] * len(part), "data": b"".join(t for _, t in part)})
    for turn in (1, 2, 3):
        entries = [r for row in rows for b in s._emit(buckets, seed, threshold)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]
        entries.sort(key=lambda r: (r["bucket"], r["segment"]))
        bits = [r for b in s._sort(turn == 1)(iter([pa.RecordBatch.from_pylist(entries)] if entries else [])) for r in b.to_pylist()]
        for row in rows:
            row[f"r{turn}"] = [{"bucket": r["bucket"], "n": r["n"], "bits": r["bits"]} for r in bits if r["segment"] == row["segment"]]
    return [r["kept"] for row in rows for b in s._finish(seed, threshold)(iter([pa.RecordBatch.from_pylist([row])])) for r in b.to_pylist()]


def texts(seed):
    r = np.random.default_rng(seed)
    shared = [bytes(r.integers(97, 101, n, dtype=np.uint8)) for n in (15, 16, 40, 90)]
    out = []
    for i in range(40):
        own = bytes(r.integers(97, 123, int(r.integers(0, 120)), dtype=np.uint8))
        out.append((int(r.integers(0, 30)), own[:50] + shared[i % 4] + own[50:]) if i % 3 else (i, own))
    return out


@pytest.mark.parametrize("bits", [64, 10, 3, 0])
@pytest.mark.parametrize("per_segment", [1, 7, 40])
def test_clashing_names_remove_nothing_more(monkeypatch, bits, per_segment):
    """Names of some bits only: nearly all clash, and the result is that of the bytes."""
    whole = s._pair
    monkeypatch.setattr(s, "_pair", lambda a, b, turn: whole(a, b, turn) & np.uint64((1 << bits) - 1))
    for seed in (1, 2):
        docs = texts(seed)
        assert here(docs, per_segment) == brute(docs, 15)


def test_second_names_across_chunks(monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 64)
    monkeypatch.setattr(s._Ranges, "powers", np.zeros(0, np.uint64))
    text = np.frombuffer(bytes(np.random.default_rng(3).integers(97, 99, 1000, dtype=np.uint8)), np.uint8)
    at = np.arange(0, 980)
    r = s._Ranges(text, 40)
    got = r.of(at, at + 20)
    assert (got == r.of(at, at + 20)).all() and len(r.sums) == 16
    by = {}
    for i in at.tolist():
        by.setdefault(text[i : i + 20].tobytes(), set()).add(int(got[i]))
    assert all(len(v) == 1 for v in by.values()) and len({x for v in by.values() for x in v}) == len(by)
