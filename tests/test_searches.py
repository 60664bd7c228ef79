"""Searches of all vectors: no side goes to every task, no row stands for a pair that is not among the best, and equal vectors tie as in SQL."""

import pytest

from estrado import catalog
from estrado.operators import index, vectors

from .test_odd_tables import agrees  # noqa: F401

SEARCHES = ["knn_batch_topk", "identify_openset", "match_margin", "supervised_assign", "search_identified", "index_exact", "premise_topk", "hit_at_k", "relative_threshold", "soft_scope", "priority_concat"]


@pytest.mark.parametrize("name", SEARCHES)
def test_blocks_meet_in_groups(spark, tiny, monkeypatch, name):
    monkeypatch.setattr(vectors, "written", lambda df, _: df)
    plan = catalog.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["soft_scope", "priority_concat", "relative_threshold", "identify_openset"])
def test_equal_vectors_in_small_groups(agrees, tiny, monkeypatch, name):  # noqa: F811
    """Each vector twice, some ten times, a label with few rows and one missing, dealt into many groups."""
    for what, n in (("PACKED", 16), ("ASKED_BLOCKS", 1), ("BLOCKS", 2), ("AT_ONCE", 7), ("HEAD", 5), ("PAIRS", 64)):
        monkeypatch.setattr(vectors, what, n)
    monkeypatch.setattr(index, "AT_ONCE", 7)
    e = f"'{tiny}/embeddings.parquet'"
    rows = f"SELECT vec_id, embedding, CASE WHEN vec_id < 200 THEN label ELSE 3 END::INTEGER AS label FROM {e} WHERE label <> 5 UNION ALL SELECT vec_id + 500, embedding, label FROM {e} WHERE label <> 5 AND vec_id < 250"
    agrees(name, embeddings=f"{rows} UNION ALL SELECT 2000 + i, embedding, 2 FROM {e}, (SELECT unnest(range(0, 10)) i) WHERE vec_id = 20")
