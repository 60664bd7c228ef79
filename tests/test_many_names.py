"""Names and sounds that few bounds tell apart, and both ways of a glossary."""

from difflib import SequenceMatcher

import pytest

from estrado import catalog
from estrado.operators import lexicon, names


def test_digits_tell_names_apart(monkeypatch):
    """Of numbered names only those with the digits of the name asked are compared letter by letter."""
    tried = []
    ratio = names.Block.ratio
    monkeypatch.setattr(names.Block, "ratio", lambda self, a, b: tried.append(b) or ratio(self, a, b))
    block = names.Block([f"Supplier#{i:09}" for i in range(3000)])
    assert block.best("Supplie#000001234 de la", 0.62) == (pytest.approx(SequenceMatcher(None, "supplie#000001234", "supplier#000001234").ratio()), 1234)
    assert len(tried) <= 24


def test_a_glossary_at_hand_and_by_blocks(spark, tiny, monkeypatch):
    whole = sorted(map(tuple, catalog.QUERIES["glossary_fix"](spark, tiny).collect()))
    plan = catalog.QUERIES["glossary_fix"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(lexicon, "AT_HAND", 0)
    assert sorted(map(tuple, catalog.QUERIES["glossary_fix"](spark, tiny).collect())) == whole and len(whole)


def test_names_of_the_same_letters_are_bounded_once():
    names_ = ["Gil Mora", "Lig Roma", "Gil Ramo", "Ruiz Mora"]
    block = names.Announced(names_)
    assert sorted(map(sorted, block.members)) == [[0, 1, 2], [3]]
    assert block.best("lig roma por su grupo", 0.6) == (1.0, 1)
