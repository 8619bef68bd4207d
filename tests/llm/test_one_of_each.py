"""The pipeline's near-duplicate stage with repeated and null ids."""

import corpus_pipeline


def test_one_row_of_each_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [
        (1, a), (2, a + " tail"), (2, b),  # the repeated id loses its near copy, not its unique text
        (3, c), (3, c), (3, c.upper()),  # exact and equal-set repeats
        (None, a), (None, d), (None, d + " tail"), (None, "solo e f g h i"),
        (4, ""), (4, ""), (None, None), (5, b), (6, "other words stand here alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.one_of_each(spark, docs, "").collect()), key=str)
    rest = [r for r in got if r not in ((None, d), (None, d + " tail"))]
    assert len(got) == len(rest) + 1
    want = [(1, a), (2, b), (3, min(c, c.upper())), (None, "solo e f g h i"), (4, ""), (4, ""), (None, None), (6, "other words stand here alone")]
    assert rest == sorted(want, key=str)


def test_unique_ids_go_by_the_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (3, b)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, "").collect()) == [1, 3]
