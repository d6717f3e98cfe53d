"""Leak search against a plain search, and the ranking against a dense fit."""

import random

import numpy as np

import pytest

from duelframe.llm import leaks, ranking


def plain(words, item, run=20):
    for s in range(-len(item), len(words)):
        same = [0 <= i - s < len(item) and words[i] == item[i - s] for i in range(len(words))]
        for a in range(len(words)):
            if same[a]:
                for b in range(a + run, len(words) + 1):
                    if same[b - 1] and 0 <= a - s and b - s <= len(item) and sum(not x for x in same[a:b]) * 8 <= b - a:
                        return True
    return False


def test_leaks_brute_force(spark):
    rnd = random.Random(5)
    vocab = ["w%d" % i for i in range(40)]
    items = [[rnd.choice(vocab) for _ in range(rnd.randint(15, 60))] for _ in range(8)]
    docs = []
    for n in range(60):
        item = items[n % 8]
        low = rnd.randint(0, max(0, len(item) - 22))
        part = list(item[low : low + rnd.randint(12, 32)])
        for k in range(rnd.randint(0, 5)):
            part[rnd.randrange(len(part))] = "zz"
        docs.append([rnd.choice(vocab) for _ in range(rnd.randint(0, 30))] + part + [rnd.choice(vocab) for _ in range(rnd.randint(0, 30))])
    want = {(d, i) for d, ws in enumerate(docs) for i, it in enumerate(items) if plain(ws, it)}
    assert 5 < len(want) < 60
    dirty = lambda ws: "<p>" + " ".join(w.upper() if k % 3 else "**" + w + "**," for k, w in enumerate(ws)).replace("W1", "Ｗ1") + "</p>"
    d = spark.createDataFrame([(i, dirty(ws), 1) for i, ws in enumerate(docs)] + [(900, None, 1), (901, "", 1), (0, dirty(docs[0]), 1)], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(items)] + [(77, None), (78, "")], "item_id long, text string")
    for at_once in (1000, 3):
        got = [tuple(r) for r in leaks.found(d, e, at_once).collect()]
        assert set(got) == want and len(got) == len(want)
    assert leaks.found(d, e.limit(0)).count() == 0 and leaks.found(d.limit(0), e).count() == 0


def test_wand_equals_full_scores():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(30)) for _ in range(150)]
    index = leaks.ItemIndex(list(enumerate(texts)))
    terms = index.terms.tolist()
    for threshold in (3.0, 8.0, 15.0):
        index.threshold = threshold
        for _ in range(20):
            q = rnd.sample(terms, 25)
            full = {}
            for t in q:
                for n, s in zip(*index.postings[t][:2], strict=True):
                    full[n] = full.get(n, 0.0) + s
            assert set(index.search(q)) == {n for n, s in full.items() if s >= threshold - 1e-12} or all(abs(full[n] - threshold) < 1e-9 for n in set(index.search(q)) ^ {n for n, s in full.items() if s >= threshold})


def dense(pairs, names, penalty, draw_mean, draw_penalty):
    """Newton on the full parameter vector."""
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros(len(names) + 2)
    x[-1] = draw_mean
    for _ in range(200):
        g, h = np.zeros_like(x), np.zeros((len(x), len(x)))
        for a, b, n, w, d in pairs:
            z = x[at[a]] - x[at[b]] + x[-2]
            e = np.array([np.exp(z / 2), np.exp(x[-1]), np.exp(-z / 2)])
            p = e / e.sum()
            v = np.zeros((3, len(x)))
            for k, c in enumerate((0.5, 0.0, -0.5)):
                v[k, at[a]], v[k, at[b]], v[k, -2] = c, -c, c
            v[1, -1] = 1.0
            mean = p @ v
            g += np.array([w, d, n - w - d]) @ v - n * mean
            h += n * ((v * p[:, None]).T @ v - np.outer(mean, mean))
        g[:-1] -= penalty * x[:-1]
        g[-1] -= draw_penalty * (x[-1] - draw_mean)
        h += np.diag([penalty] * (len(x) - 1) + [draw_penalty])
        step = np.linalg.solve(h, g)
        x += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return x


def test_ranking_with_draws_and_order(spark):
    rnd = random.Random(4)
    names = ["n%d" % i for i in range(8)]
    true = {n: 0.6 * i for i, n in enumerate(names)}
    games = []
    for _ in range(500):
        i = rnd.randrange(7)
        a, b = rnd.sample(names[max(0, i - 1) : i + 2], 2)
        z = true[a] - true[b] + 0.5
        e = np.array([np.exp(z / 2), 0.3, np.exp(-z / 2)])
        games.append((a, b, float(rnd.choices([1.0, 0.5, 0.0], e / e.sum())[0])))
    table = ranking.pair_table(spark.createDataFrame(games, "first string, second string, win double")).collect()
    want = dense([(r["first"], r["second"], r.n, r.wins, r.draws) for r in table], names, 0.5, ranking.DRAW_MEAN, ranking.DRAW_PENALTY)
    for many in (2_000_000, 0):
        model = ranking.PairedComparison(ranking.pair_table(spark.createDataFrame(games, "first string, second string, win double")), broadcast_items=many)
        got = {r.item: r.strength for r in model.fit(newton_steps=30).collect()}
        assert max(abs(got[n] - want[i]) for i, n in enumerate(names)) < 0.05
        assert abs(model.order - want[-2]) < 0.05 and abs(model.draw - want[-1]) < 0.1
        if many == 0:
            break


def test_decided(spark):
    rows = [
        ("b1", "p1", "Ann", "WIN"), ("B1 ", "p2", " bo", "LOSS"), ("b1", "p1", "ann", "WIN"), ("b2", "p1", "x", "WIN"), ("b3", "p1", "x", "WIN"), ("b3", "p2", "y", "WIN"), ("b4", "p1", "x", "WIN"), ("b4", "p2", None, "LOSS"),
        ("b5", "p1", "x", None), ("b5", "p2", "y", None), ("b6", "p1", "x", "WIN"), ("b6", "p2", "y", "LOSS"), ("b6", "p2", "z", "LOSS"), ("b7", "p1", "x", "WIN"), ("b7", "p2", "x", "LOSS"), (None, "p1", "x", "WIN"), (" ", "p2", "y", "LOSS"), ("b8", "p2", "q", "WIN"), ("b8", "p1", "r", "LOSS"),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "battle_id string, side string, username string, result string, win double")
    assert {tuple(r) for r in ranking.decided_battles(df).collect()} == {("ann", "bo", 1.0), ("r", "q", 0.0)}
    assert ranking.strongest(df, least_games=1).count() == 4 and ranking.strongest(df.limit(0)).count() == 0


def test_a_fit_that_does_not_end_is_an_error(spark):
    games = [("a", "b", 1.0)] * 30 + [("b", "c", 1.0)] * 30 + [("c", "a", 0.0)] * 9
    pairs = ranking.pair_table(spark.createDataFrame(games, "first string, second string, win double"))
    with pytest.raises(ranking.NotConverged):
        ranking.PairedComparison(pairs).fit(newton_steps=1)
    # how far each inner system is solved does not change the end
    far, near = ({r.item: r.strength for r in ranking.PairedComparison(pairs).fit(inner_steps=n).collect()} for n in (1, 12))
    assert far == pytest.approx(near, abs=0.02)
    assert ranking.PairedComparison(pairs.limit(0)).fit().count() == 0
