"""Alignments hold every session and every name of it."""

import numpy as np
import pandas as pd
import pytest

from estrado import catalog
from estrado.operators import sequences


def test_align_nw_takes_every_name_of_every_session(spark, tiny):
    e = pd.read_parquet(f"{tiny}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    want = []
    for session, g in e.groupby("user_id"):
        a = list(enumerate(g.event_type, 1))
        b = [(n, w + "s" if n % 7 == 0 else w) for n, w in a if n % 5]
        s = np.array([[sequences.similarity(u, v) for _, v in b] for _, u in a])
        want += [(session, a[i][0], b[j][0], round(s[i, j], 9)) for i, j in sequences.align(s, -0.3, 0.5)]
    got = catalog.QUERIES["align_nw"](spark, tiny).collect()
    assert sorted((r.pleno_id, r.a_pos, r.b_pos, round(r.sim, 9)) for r in got) == sorted(want)
    assert max(r.a_pos for r in got) > 60


def test_speaker_accuracy_counts_every_intervention(spark, tiny):
    e = pd.read_parquet(f"{tiny}/embeddings.parquet")
    size = e.groupby(e.vec_id // 50).size().to_dict()
    got = {r.pleno_id: r for r in catalog.QUERIES["speaker_accuracy"](spark, tiny).collect()}
    assert set(got) == set(size)
    for s, r in got.items():
        # the share of all official interventions, every sixth of which is missing on our side
        assert r.cobertura == pytest.approx(r.pares / size[s], abs=1e-6) and r.pares >= size[s] - size[s] // 6 - 2
