"""Leaks of passages with few distinct word triples."""

import pytest

from duelframe.llm import leaks
from tests.llm.test_leaks_ranking import plain


@pytest.mark.parametrize("phrase", [1, 2, 3, 4, 5, 7])
def test_a_repeated_phrase_is_found(phrase):
    items = [([f"w{i}x{k}" for k in range(phrase)] * 20)[:20] for i in range(50)]
    index = leaks.ItemIndex((i, " ".join(ws)) for i, ws in enumerate(items))
    for i, ws in enumerate(items[:5]):
        doc = ["zz"] * 7 + ws + ["zz"] * 7
        assert plain(doc, ws) and index.leaks(doc) == [i]
        doc[16] = doc[20] = "zz"  # two of twenty words replaced: fewer than one in eight
        assert plain(doc, ws) and index.leaks(doc) == [i]
