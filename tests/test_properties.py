"""Properties: batching, partition count, stage totals."""

from pyspark.sql import functions as F

from rosterline.operators.upsert import assign_ids, upsert_contacts
from rosterline.plans.catalog import contacts, hits

SF = "/root/testdata/sf0.001"
NOW = "2025-01-01 00:00:00"


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_upsert_batches_equal_one_batch(spark):
    h = hits(spark, SF)
    one = upsert_contacts(None, h, NOW)
    a = upsert_contacts(None, h.where("ord < 3000"), NOW).drop("_inserted")
    two = upsert_contacts(a, h.where("ord >= 3000"), NOW)
    cols = ["list_id", "id", "ord", "linkedin_url_normalized"]
    assert _rows(one, cols) == _rows(two, cols)


def test_ids_independent_of_partition_count(spark):
    h = hits(spark, SF).select("list_id", "ord")
    a = assign_ids(h, ["ord"], "list_id", num_partitions=1)
    b = assign_ids(h.repartition(7), ["ord"], "list_id", num_partitions=13)
    assert _rows(a, ["list_id", "ord", "id"]) == _rows(b, ["list_id", "ord", "id"])
    # dense 1..n per list
    per = a.groupBy("list_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).collect()
    assert all(r["lo"] == 1 and r["hi"] == r["n"] for r in per)


def test_stage_counts_sum_to_total(spark):
    c = contacts(spark, SF)
    total = c.count()
    assert sum(r["count"] for r in c.groupBy("stage").count().collect()) == total


def test_waterfall_with_one_provider_is_direct_lookup(spark):
    from rosterline.operators.waterfall import email_waterfall
    from rosterline.sources.bindings import results_src
    r = results_src(spark, SF).where(F.col("rank") == 1).withColumn(
        "verdict", F.when(F.col("raw_status") == "verified", "accept").otherwise("miss"))
    contacts_ = r.select("contact_id").distinct()
    wf = email_waterfall(contacts_, r).select("contact_id", "email")
    direct = (r.where(F.col("verdict") == "accept").groupBy("contact_id")
              .agg(F.min_by("email", "ord").alias("email")))
    want = contacts_.join(direct, "contact_id", "left")
    assert _rows(wf, ["contact_id", "email"]) == _rows(want, ["contact_id", "email"])
