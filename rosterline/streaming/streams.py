"""Structured Streaming operators X1–X5.

* X1 ``stream_upsert`` / ``stream_upsert_companies``: ``foreachBatch`` runs the batch
  upserts (J1 / J2) against a ``BucketStore``: a batch reads the buckets its keys fall
  into, joins the rows it touches and writes only those it changed.  A replayed batch is
  skipped; a new run with a new checkpoint adds its rows.
* X2 ``stream_dedupe``: bounded-state dedup with a watermark
  (``dropDuplicatesWithinWatermark``); NULL keys bypass the state.
* X3 ``stream_valid_track``: three chained stateful operators in append mode.  A
  stream–stream interval join pairs requests with the searches of the validity before
  them; a window aggregation keeps each request's latest search; a session aggregation
  per search finds its first request.  All state expires by the watermark.
* X4 ``stream_funnel``: tumbling-window counts per stage, append mode; rows later than
  the watermark are dropped, a window is written once, when it is closed.
* X5 ``stream_master``: incremental master roll-up (A13): each batch adds its partial
  roll-up per (URL, campaign) to a ``BucketStore``, which merges partials as they pile up;
  ``master_of`` merges the rest.  Nothing grows in the state store.

Results go to files in the sink's folder, never through the driver.  Checkpoints live
under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.normalize import normalize_domain, normalize_linkedin_url
from rosterline.operators.match import MASTER_STATUS_RANK
from rosterline.operators.upsert import upsert_companies, upsert_contacts
from rosterline.schema import MASTER_SCHEMA
from rosterline.session import checkpoint_dir, materialize
from rosterline.sources.buckets import BucketStore, newest_per

__all__ = ["file_stream", "stream_checkpoint", "stream_upsert", "stream_upsert_companies", "upsert_batch_fn",
           "contact_store", "company_store", "latest_snapshot", "latest_companies", "stream_dedupe", "stream_valid_track",
           "stream_funnel", "master_store", "stream_master", "master_of", "run_available_now", "to_files"]


def _event_time(c: str):
    """Watermarks need TIMESTAMP; data at rest is TIMESTAMP_NTZ (session time zone UTC)."""
    return F.col(c).cast("timestamp")


def stream_checkpoint(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "rosterline-streams", f"{name}-{uuid.uuid4().hex}")


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet file stream with the schema taken from the data at rest."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.endswith(".parquet") and not any(ch in path for ch in "*?["):
        # A single file: stream it through a glob on its own name.
        path = path[:-len(".parquet")] + "*.parquet"
    return reader.parquet(path)


def run_available_now(writer):
    """Runs until all data there is has been processed, however long that takes; raises if the query failed."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def to_files(df: DataFrame, path: str, checkpoint: str | None = None):
    """An append sink of parquet files; committed files only are seen by readers of the folder."""
    return (df.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint or stream_checkpoint(df.sparkSession, "files")))


# --- X1 ---------------------------------------------------------------------

def contact_store(spark: SparkSession, path: str, **kw) -> BucketStore:
    """Contacts are only ever added, so no merge is needed."""
    return BucketStore(spark, path, ["list_id", "linkedin_url_normalized"], spread="ord", **kw)


def company_store(spark: SparkSession, path: str, **kw) -> BucketStore:
    return BucketStore(spark, path, ["list_id", "company_domain_normalized"], newest_per("list_id", "id"), spread="ord", **kw)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The contacts under ``path``; None if no batch has been committed."""
    return contact_store(spark, path).read()


def latest_companies(spark: SparkSession, path: str) -> DataFrame | None:
    """The companies under ``path``; None if no batch has been committed."""
    return company_store(spark, path).read()


def upsert_batch_fn(spark: SparkSession, path: str, now, run: str = "run", companies: bool = False, **options):
    """The ``foreachBatch`` body of X1.  ``run`` identifies the checkpoint: a batch id of the
    same run that is already committed is a replay and is skipped; batch 0 of another run is new data.
    ``options`` are those of ``BucketStore``."""
    store = (company_store if companies else contact_store)(spark, path, **options)
    key, normal = (("company_domain_normalized", normalize_domain("company_domain")) if companies
                   else ("linkedin_url_normalized", normalize_linkedin_url("linkedin_url")))

    def batch(df: DataFrame, batch_id: int) -> None:
        if store.has(run, batch_id):
            return
        keys = df.select("list_id", normal.alias(key), "ord")
        # Rows without a key are new rows: no state is read for them.
        known = store.read(store.touched(keys.where(F.col(key).isNotNull())))
        base = store.largest_ids()
        if companies:
            if known is not None:
                at = keys.where(F.col(key).isNotNull()).select(F.col("list_id").alias("_l"), F.col(key).alias("_k")).distinct()
                known = known.join(at, F.col("list_id").eqNullSafe(F.col("_l")) & (F.col(key) == F.col("_k")), "left_semi")
            rows = upsert_companies(known, df, now, base).drop("_status", "_n_new")
        else:
            rows = upsert_contacts(known, df, now, base)
            rows = (rows.where("_inserted") if known is not None else rows).drop("_inserted")
        store.add(materialize(rows, "stream-batch"), run, batch_id, with_ids=True)

    return batch


def _upsert(stream: DataFrame, path: str, now, checkpoint: str | None, companies: bool, options: dict):
    checkpoint = checkpoint or stream_checkpoint(stream.sparkSession, "upsert")
    batch = upsert_batch_fn(stream.sparkSession, path, now, checkpoint, companies, **options)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def stream_upsert(stream: DataFrame, path: str, now, checkpoint: str | None = None, **options):
    """Continuous J1 upsert; each batch writes the contacts it inserted."""
    return _upsert(stream, path, now, checkpoint, False, options)


def stream_upsert_companies(stream: DataFrame, path: str, now, checkpoint: str | None = None, **options):
    """X1 for companies: continuous J2 merge upsert; each batch writes the companies it changed."""
    return _upsert(stream, path, now, checkpoint, True, options)


# --- X2 ---------------------------------------------------------------------

def stream_dedupe(stream: DataFrame, delay: str, ts_col: str = "seen_at",
                  keys: tuple = ("list_id", "linkedin_url_normalized")) -> DataFrame:
    """First arrival per key within the watermark delay; NULL keys pass through."""
    s = (stream.withColumn("linkedin_url_normalized", normalize_linkedin_url("linkedin_url"))
         .withColumn("_et", _event_time(ts_col)).withWatermark("_et", delay))
    keyed = s.where(F.col("linkedin_url_normalized").isNotNull()).dropDuplicatesWithinWatermark(list(keys))
    return keyed.unionByName(s.where(F.col("linkedin_url_normalized").isNull())).drop("_et")


# --- X3 ---------------------------------------------------------------------

def stream_valid_track(requests: DataFrame, searches: DataFrame, ttl_hours: int = 6, key: str = "user_id") -> DataFrame:
    """X3 (J12 as a stream): request_id, r_ts, track_id and ``valid`` of every request that has a search of its
    key at most ``ttl_hours`` before it.  The latest one is its track, valid for the first request that uses it.

    A request is written when the watermark has passed all that may still change it.  Heartbeat rows, with keys
    that the other side never has, move the watermark and so close what is open.
    """
    ttl = f"{ttl_hours} hours"
    r = (requests.select(F.col(key).alias("r_key"), F.col("id").alias("request_id"), F.col("ts").alias("r_ts"))
         .withColumn("r_et", _event_time("r_ts")).withWatermark("r_et", ttl))
    s = (searches.select(F.col(key).alias("s_key"), F.col("id").alias("track_id"), F.col("ts").alias("s_ts"))
         .withColumn("s_et", _event_time("s_ts")).withWatermark("s_et", ttl))
    cond = ((F.col("r_key") == F.col("s_key")) & (F.col("s_et") <= F.col("r_et")) &
            (F.col("s_et") >= F.col("r_et") - F.expr(f"INTERVAL {ttl_hours} HOURS")))
    pairs = r.join(s, cond, "inner").drop("s_et")
    latest = (pairs.groupBy("request_id", "r_ts", F.window("r_et", "1 minute").alias("_w"))
              .agg(F.max(F.struct("s_ts", "track_id"))["track_id"].alias("track_id"))
              .select("request_id", "r_ts", "track_id", F.window_time("_w").alias("_t")))
    # All requests of a search lie within its validity, so one session of that gap holds them.
    uses = (latest.groupBy("track_id", F.session_window("_t", ttl))
            .agg(F.array_sort(F.collect_list(F.struct("r_ts", "request_id"))).alias("_q")))
    return (uses.select("track_id", F.posexplode("_q").alias("_pos", "_q"))
            .select("_q.request_id", "_q.r_ts", "track_id", (F.col("_pos") == 0).alias("valid")))


# --- X4 ---------------------------------------------------------------------

def stream_funnel(stream: DataFrame, ts_col: str, stage_col: str, window: str = "1 hour",
                  delay: str = "1 hour") -> DataFrame:
    """Transitions per stage per tumbling window; rows later than the watermark are dropped."""
    w = (stream.withColumn("_et", _event_time(ts_col)).withWatermark("_et", delay)
         .groupBy(F.window("_et", window).alias("w"), F.col(stage_col)))
    return w.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col(stage_col), "n")


# --- X5 ---------------------------------------------------------------------

_NAMES = ("first_name", "last_name", "company_name", "email")
_FLAGS = ("replied", "bounced", "unsubscribed")


def _partial(touches: DataFrame) -> DataFrame:
    """A13's roll-up of some touches per (URL, campaign), in a form that merges."""
    t = touches.withColumn("linkedin_url_normalized", normalize_linkedin_url("linkedin_url")) \
        .where(F.col("linkedin_url_normalized").isNotNull())
    rank = F.try_element_at(F.create_map(*[x for k, v in MASTER_STATUS_RANK.items()
                                           for x in (F.lit(k), F.lit(v))]), F.col("status"))
    names = [c for c in _NAMES if c in touches.columns]
    return t.groupBy("linkedin_url_normalized", "campaign_id").agg(
        F.min(F.struct("ts", "linkedin_url")).alias("_url"),
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("ts", c))).alias(f"_{c}") for c in names],
        F.max(F.when(rank.isNotNull(), F.struct(rank.alias("r"), F.col("status").alias("s")))).alias("_best"),
        *[F.max(F.coalesce(F.col("status") == x, F.lit(False)).cast("int")).alias(f"_{x}") for x in _FLAGS],
        F.min("ts").alias("first_contacted_at"), F.max("ts").alias("last_contacted_at"))


def _merged(parts: DataFrame) -> DataFrame:
    """Partial roll-ups of the same (URL, campaign) as one."""
    names = [c for c in _NAMES if f"_{c}" in parts.columns]
    return parts.groupBy("linkedin_url_normalized", "campaign_id").agg(
        F.min("_url").alias("_url"), *[F.max(f"_{c}").alias(f"_{c}") for c in (*names, "best", *_FLAGS)],
        F.min("first_contacted_at").alias("first_contacted_at"), F.max("last_contacted_at").alias("last_contacted_at"))


def master_store(spark: SparkSession, path: str, **kw) -> BucketStore:
    return BucketStore(spark, path, ["linkedin_url_normalized"], _merged, **kw)


def stream_master(touches: DataFrame, path: str, checkpoint: str | None = None, **options):
    """Each batch adds its partial roll-up to the store under ``path``; a replayed batch is skipped."""
    spark = touches.sparkSession
    checkpoint = checkpoint or stream_checkpoint(spark, "master")
    into = master_store(spark, path, **options)

    def batch(df: DataFrame, batch_id: int) -> None:
        if not into.has(checkpoint, batch_id):
            into.add(_partial(df), checkpoint, batch_id)

    return touches.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def master_of(spark: SparkSession, path: str) -> DataFrame:
    """The master table of all batches that X5 has committed: one merge aggregation; empty before the first batch."""
    parts = master_store(spark, path).raw()
    if parts is None:
        drop = {"contact_id", "full_name"}
        return spark.createDataFrame([], MASTER_SCHEMA).drop(*drop)
    names = [c for c in _NAMES if f"_{c}" in parts.columns]
    return parts.groupBy("linkedin_url_normalized").agg(
        F.min("_url")["linkedin_url"].alias("linkedin_url"),
        *[F.max(f"_{c}")[c].alias(c) for c in names],
        F.coalesce(F.max("_best")["s"], F.lit("contacted")).alias("overall_status"),
        F.count_distinct("campaign_id").cast("int").alias("total_campaigns"),
        *[(F.max(f"_{x}") > 0).alias(f"has_{x}") for x in _FLAGS],
        F.min("first_contacted_at").alias("first_contacted_at"), F.max("last_contacted_at").alias("last_contacted_at"))
