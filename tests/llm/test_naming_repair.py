"""Token repair against all distances, and how complete names are ranked."""

import random

from duelframe.llm import naming


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_repair_finds_all_words_in_reach_on_both_sides_of_the_length_limit(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("ab") for _ in range(n)) for n in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 22, 23, 24, 25, 26, 27, 60, 64, 65, 66, 300)] + ["12", "123"]
    tokens = ["13", "12"]
    for w in words:
        for _ in range(4):
            t = list(w)
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(t) + 1)
                t[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "b"])
            tokens.append("".join(t) or "a")
    typed, vocabulary = spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string")

    def fits(t, w):
        d = distance(t, w)
        return d == 0 or (not (t.isdigit() or w.isdigit()) and min(len(t), len(w)) > 1 and d <= 2)

    want = {(t, w) for t in tokens for w in words if fits(t, w)}
    for long in (6, naming.LONG_TOKEN):
        assert {(r.token, r.word) for r in naming.repaired(typed, vocabulary, long).collect()} == want


def test_the_score_ranks_complete_names(spark):
    stats = spark.createDataFrame([("old-treva",), ("treva",), ("mrs-gollan",), ("kreivos",), ("kreivos-thorn",), ("pelmar",), ("pelmarok",)], "pokemon string")
    slots = spark.createDataFrame([(x,) for x in ("Ol Treva", "Ok Treva", "Ms. Golan", "Kreivos (Thrn)", "Tank (Kreivos)", "Pelmaro", "Xyz Treva", "Pelmaq")], "pokemon_name string")
    none = spark.createDataFrame([], "showdown_name string, pokemon string"), spark.createDataFrame([], "showdown_name string, reason string")
    got = {r.entered: r.pokemon for r in naming.found(slots, stats, *none).collect()}
    assert got == {
        "Ol Treva": "old-treva", "Ok Treva": "old-treva", "Ms. Golan": "mrs-gollan", "Kreivos (Thrn)": "kreivos-thorn", "Tank (Kreivos)": "kreivos",
        "Pelmaro": "pelmarok", "Xyz Treva": "", "Pelmaq": "pelmar",
    }
