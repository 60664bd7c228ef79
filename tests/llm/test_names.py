"""Names of byte strings by doubling: how many pairs a byte costs, and that they hang on the string alone."""

import numpy as np
import pytest

from estrado.llm import suffixes as s


def segment(data, **more):
    return s.Segment([1, 2], [len(data) // 3, len(data) - len(data) // 3], data, s.SEED, s.THRESHOLD, **more)


def test_pairs_for_a_byte(monkeypatch):
    """Opening a segment, which each of three rounds and the end do, makes at most five names a byte; longer names are made where they are asked for."""
    made, pair = [], s._pair
    monkeypatch.setattr(s, "_pair", lambda a, b, turn: (made.append(len(a)), pair(a, b, turn))[1])
    data = np.random.default_rng(4).bytes(300_000)
    seg = segment(data)
    assert sum(made) <= 5 * len(data)
    assert 0 < len(seg.lo) < len(data) / 10


@pytest.mark.parametrize("keep", [False, True])
@pytest.mark.parametrize("chunk", [97, 1 << 16])
def test_names_hang_on_the_string_alone(monkeypatch, chunk, keep):
    """Wherever it stands in a chunk, and whether shorter names are kept or made again."""
    monkeypatch.setattr(s, "CHUNK", chunk)
    r = np.random.default_rng(5)
    own = [bytes(r.integers(97, 99, 30, dtype=np.uint8)) for _ in range(40)]
    data = b"".join(own[i] for i in r.integers(0, 40, 300))
    seg = segment(data, **({"keep": True} if keep else {}))
    at, names = seg.positions(np.arange(len(seg.lo)))
    cut = len(data) // 3
    assert at.tolist() == [i for i in range(len(data) - 49) if i + 50 <= cut or i >= cut]
    by = {}
    for i, n in zip(at.tolist(), names.tolist()):
        by.setdefault(data[i : i + 50], set()).add(n)
    assert all(len(v) == 1 for v in by.values())
    assert len({n for v in by.values() for n in v}) == len(by) < len(at)
