"""Consistent forms, look-alike pairs and co-occurrence against brute force."""

import itertools
import random
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duelframe.llm import cooccur, glyphs


def form(s):
    return glyphs.fold(pa.array([s], pa.string()))[0].as_py()


@pytest.mark.parametrize("a,b", [
    ("café", "café"), ("ＡＢ １", "AB 1"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("a  b ", "a b"), ("сор", "cop"), ("ё", "ё"),
    ("ﬁn", "fin"), ("x‑y", "x-y"), ("ｶﾞ", "ガ"), ("が", "が"), ("ạ́", "ạ́"), ("각", "각"), ("a\r\nb", "a\nb"),
])
def test_alike(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", [("e", "é"), ("0", "O"), ("1", "l"), ("a", "A"), ("n", "ñ"), ("a b", "a\nb"), ("か", "が"), ("'", "’"), ("2", "²"), ("и", "й")])
def test_not_alike(a, b):
    assert form(a) != form(b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_batch_equals_single_and_is_stable(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    out = glyphs.fold(pa.array(texts, pa.string())).to_pylist()
    assert out == [None if t is None else form(t) for t in texts]
    assert glyphs.fold(pa.array(out, pa.string())).to_pylist() == out
    composed = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert glyphs.fold(pa.array(composed, pa.string())).to_pylist() == out


def test_long_text_in_parts(monkeypatch):
    text = "café   Ａbc def​ghi " * 400
    whole = form(text)
    monkeypatch.setattr(glyphs, "PART_BYTES", 64)
    assert glyphs.fold(pa.array([text, None, "x"], pa.string())).to_pylist() == [whole, None, "x"]


def test_all_pairs(spark):
    texts = ["aé", "aé", "aé", "b", "b", "", None, " ", "​", "aе́", "c"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, form string")
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if texts[i] and texts[j] and form(texts[i]) and form(texts[i]) == form(texts[j]) and texts[i] != texts[j]}
    got = [tuple(r) for r in glyphs.look_alike_pairs(docs).collect()]
    assert set(got) == want and len(got) == len(want)
    assert glyphs.look_alike_pairs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [48, 2])
def test_cooccur_brute_force(spark, wide):
    rnd = random.Random(1)
    rows = [(rnd.choice(["b%d" % i for i in range(30)] + [None, " "]), rnd.choice(["p1", "P1 ", "p2", None]), rnd.choice(["A", "a ", "b ", "c", "d", "e", None, ""]), 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "battle_id string, player_side string, pokemon_name string, item int")
    baskets = {}
    for b, s, n, _ in rows:
        if b and b.strip() and s and n is not None:
            baskets.setdefault((b, s.strip().lower()), set()).add(n.strip().strip(" ").lower())
    want = {}
    for items in baskets.values():
        for a, b in itertools.combinations(sorted(items), 2):
            want[(a, b)] = want.get((a, b), 0) + 1
    got = {(r.name_a, r.name_b): (r.n_ab, r.n) for r in cooccur.pair_counts(cooccur.roster_items(df), 3, wide, broadcast_rows=0 if wide == 2 else 1000).collect()}
    assert got == {k: (n, len(baskets)) for k, n in want.items() if n >= 3}
    single = lambda x: sum(x in v for v in baskets.values())
    hit = {tuple(r) for r in cooccur.found(df, 2, 1).collect()}
    assert hit == {k for k, n in want.items() if n >= 2 and n * len(baskets) >= single(k[0]) * single(k[1])}
    assert cooccur.found(df.limit(0)).count() == 0
