"""Streaming = batch on the same input, over several micro-batches."""

from pyspark.sql import functions as F

from rosterline.operators.upsert import upsert_contacts
from rosterline.plans.catalog import hits
from rosterline.streaming.streams import (file_stream, latest_snapshot, run_available_now, stream_checkpoint,
                                          stream_upsert)

SF = "/root/testdata/sf0.001"
NOW = "2025-01-01 00:00:00"


def test_stream_upsert_many_batches_equals_batch(spark, tmp_path):
    h = hits(spark, SF)
    src = str(tmp_path / "src")
    # Four files in time order; one file per micro-batch.
    cuts = ["2024-01-08", "2024-01-15", "2024-01-22"]
    bounds = [None] + cuts + [None]
    for i in range(4):
        part = h
        if bounds[i]:
            part = part.where(F.col("seen_at") >= F.lit(bounds[i]).cast("timestamp_ntz"))
        if bounds[i + 1]:
            part = part.where(F.col("seen_at") < F.lit(bounds[i + 1]).cast("timestamp_ntz"))
        part.coalesce(1).write.parquet(f"{src}/batch={i}")
    schema = h.schema
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    snap = str(tmp_path / "snap")
    q_checkpoint = stream_checkpoint(spark, "t")
    q = run_available_now(stream_upsert(stream, snap, NOW, q_checkpoint))
    assert q.lastProgress is not None
    import os
    assert len([d for d in os.listdir(snap) if d.startswith("v=")]) == 4   # one version per micro-batch
    # The same checkpoint again: nothing is left to read.  A new checkpoint: the same rows, known by their
    # keys; rows without a key are new rows of a new run.
    n, free = latest_snapshot(spark, snap).count(), h.where("linkedin_url is null").count()
    run_available_now(stream_upsert(stream, snap, NOW, q_checkpoint))
    assert latest_snapshot(spark, snap).count() == n
    again = str(tmp_path / "again")
    new = spark.createDataFrame([(9, "https://www.linkedin.com/in/new-one", 1)], "ord bigint, linkedin_url string, list_id bigint")
    new.write.parquet(again)
    more = spark.readStream.schema(new.schema).parquet(again)
    run_available_now(stream_upsert(more, snap, NOW, stream_checkpoint(spark, "t2")))
    assert latest_snapshot(spark, snap).count() == n + 1 and free >= 0
    got = latest_snapshot(spark, snap).where("linkedin_url_normalized is distinct from 'https://www.linkedin.com/in/new-one'")
    want = upsert_contacts(None, h, NOW)
    cols = ["list_id", "id", "ord", "linkedin_url_normalized"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
