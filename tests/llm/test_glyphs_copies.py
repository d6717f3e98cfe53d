"""Look-alike pairs of heavily copied texts."""

from pyspark.sql import functions as F

from duelframe.llm import glyphs


def test_all_pairs_of_many_copies(spark):
    rows = [(i, "aé") for i in range(40)] + [(i, "aе́") for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in glyphs.look_alike_pairs(docs).collect()]
    assert set(got) == {(i, j) for i in range(40) for j in range(40, 80)} and len(got) == 1600


def test_parts_of_a_form_and_classes(spark):
    rows = [(0, "aé"), (1, "aé"), (2, "aе́"), (3, "aе́"), (4, "plain"), (5, " "), (None, "aé"), (6, None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string").withColumn("form", F.lit("clash")).withColumn("docs", F.lit(1))
    want = {(0, 2), (0, 3), (1, 2), (1, 3)}
    for part in (1, 3, 100):
        got = [tuple(r) for r in glyphs.look_alike_pairs(docs, part=part).collect()]
        assert set(got) == want and len(got) == 4
    classes = {r.doc: (r.docs, r.spellings, r.links) for r in glyphs.look_alike_classes(docs).collect()}
    assert classes == {d: (4, 2, 2) for d in range(4)}
    assert glyphs.look_alike_classes(docs.limit(0)).count() == 0
