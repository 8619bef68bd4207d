"""The audit compares places across its blocks, and q61 ranks and judges by the brief."""

from pyspark.sql import functions as F

from leadloom.operators import audit, evidence, select
from leadloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_order_is_checked_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 2)
    rows = spark.range(1, 7).select(F.col("id").alias("place"), F.col("id").cast("string").alias("ico"), *[(F.lit(0) if k != "age_days" else F.when(F.col("id") < 5, F.col("id")).otherwise(F.col("id") - 4)).alias(k) for k in select.ORDERING])
    assert [r.ico for r in audit.monotone({"ranked": rows}).collect()] == ["5"]
    assert audit.monotone({"ranked": rows.where("place < 5")}).count() == 0


def test_audited_run_follows_the_brief(spark, monkeypatch):
    seen = {}
    real = audit.report
    monkeypatch.setattr(audit, "report", lambda t: seen.update(t) or real(t))
    rich = []
    real_rich = evidence.richness
    monkeypatch.setattr(evidence, "richness", lambda claims: rich.append(1) or real_rich(claims))
    reported = {r.check: r.violations for r in catalogue.audited(spark, SF).collect()}
    # The audit alone reports companies that buy already; nothing holds them back before.
    funded = {r.ico for r in seen["events"].where("kind = 'subsidy_signed'").collect()} & {r.ico for r in seen["buying"].collect()}
    assert reported.pop("buying") == sum(r.ico in funded for r in seen["week"].collect())
    assert set(reported.values()) == {0}
    assert audit.not_already_buying(dict(seen, buying=seen["buying"].limit(0))).count() == 0
    assert audit.not_already_buying(dict(seen, buying=seen["week"].select("ico"), events=seen["week"].selectExpr("ico", "'subsidy_signed' AS kind"))).count() == seen["week"].count() > 0
    failed = catalogue.judged(spark, SF).where("reject_reason is not null")
    assert rich and failed.count() > 0 and seen["ranked"].join(failed, "ico", "left_semi").count() == 0
    wrong = dict(seen, ranked=failed.select("ico").limit(3))
    assert audit.satisfies_brief(wrong).count() == 3
