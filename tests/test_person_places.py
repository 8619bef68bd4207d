"""Every place of a name on a page counts."""

from pyspark.sql import functions as F

from leadloom.operators import pages


def test_places(spark):
    rows = [("an", "an ban .an", [1, 5, 9]), ("a.c", "abc a.c", [5]), ("", "x", [1]), ("q", "x", [])]
    df = spark.createDataFrame(rows, "n string, t string, want array<int>")
    assert all(r.got == r.want for r in df.withColumn("got", pages.places(F.col("n"), F.col("t"))).collect())


def test_contact_row_after_prose(spark):
    text = "Firmu založil Jan Novák v roce 1990. " + "Vyrábíme díly. " * 20 + "Kontakt: JAN NOVÁK, jednatel, novak@firma.cz, +420 123 456 789."
    page = spark.createDataFrame([("1", 0, text), ("1", 1, "Jan Novák, jednatel")], "ico string, page_ord int, text string")
    got = pages.person_occurrences(page, spark.createDataFrame([("1", "Jan Novák")], "ico string, name string")).collect()
    assert [(r.score, r.page_ord, r.email, r.phone) for r in got] == [(10, 0, "novak@firma.cz", "+420 123 456 789")]
