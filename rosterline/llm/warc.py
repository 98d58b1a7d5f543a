"""Operator 12: content-addressed WARC archive.

``write_archive`` writes two tables under one folder.  ``payloads`` holds every
distinct payload once, under its SHA-256; ``records`` holds, for every page, its
exact record header and block header and the digest of its payload.
``read_records`` joins them back to the original records, byte for byte, and
``parse`` reads those bytes: header fields, type, reference and payload.

A digest is verified twice: on writing, all payloads under one digest must agree
in length and in a second hash, which are aggregated along with them; on
reading, the stored bytes are hashed again and must give their key, and the
parsed payload must give the SHA-1 in the header.  Either failure raises.

Of pages with equal payloads of at least ``least`` bytes, the one with the
largest id is the ``response``; the others are ``revisit`` records, whose block
is the HTTP header alone and which refer to it.  Smaller payloads are always
responses (their bytes are stored once as well).

Scale: the bytes meet by digest in one aggregation that combines map-side, so a
payload held by a third of all pages is sent once a task.  Headers and payloads
join by (digest, salt): a digest of more than ``most`` records is split into
enough salts, ``most`` growing so that at most ``HOT_KEYS`` digests are split;
only that list, 40 bytes each, is broadcast.

Defined cases: a null html is an empty payload; a null url gives no target URI,
line ends in one are percent-encoded; a null id sorts below all others and is
written as an empty one; rows that share the largest id of a payload are all
responses; repeated rows give repeated records; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.llm.common import materialize
from rosterline.session import scratch_dir

__all__ = ["write_archive", "read_records", "parse", "write_warc_files", "ORACLE"]

LEAST, MOST, HOT_KEYS = 1000, 512, 100_000
_END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit(_END))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _target(url: Column) -> Column:
    """The URI of a header line: line ends are percent-encoded."""
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _spread(rows: DataFrame, per_digest: DataFrame, copies: str = "copies") -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``; a digest of many rows gets several, and ``per_digest`` is repeated for each."""
    most = max(MOST, -(-rows.count() // HOT_KEYS))
    salts = F.ceil(F.col(copies) / most)
    hot = per_digest.where(F.col(copies) > most).select(F.col("digest").alias("_d"), salts.alias("_n"))
    # At most HOT_KEYS digests have more than rows / HOT_KEYS rows.
    dealt = (rows.join(F.broadcast(hot), F.col("digest") == F.col("_d"), "left")
             .withColumn("_salt", F.pmod(F.col("uid"), F.coalesce("_n", F.lit(1)))).drop("_d", "_n"))
    return dealt, per_digest.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(salts, F.lit(1)) - 1)))


def write_archive(pages: DataFrame, path: str | None = None, least: int = LEAST, page_id: str = "page_id",
                  url: str = "url", html: str = "html", date: str = "2025-01-01T00:00:00Z") -> str:
    """Writes the archive of ``pages`` and returns its folder (default: one of this application's own)."""
    path = path or os.path.join(scratch_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256)).alias("digest")
    second = F.xxhash64("payload")
    stored = base.select(digest, "page_id", "payload").groupBy("digest").agg(
        F.first("payload").alias("payload"), F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"),
        F.min(second).alias("_h0"), F.max(second).alias("_h1"),
        F.min(F.length("payload")).alias("_n0"), F.max(F.length("payload")).alias("_n1"))
    stored = stored.withColumn("digest", F.when((F.col("_h0") == F.col("_h1")) & (F.col("_n0") == F.col("_n1")), F.col("digest"))
                               .otherwise(F.raise_error(F.lit("different payloads under one digest"))))
    stored.select("digest", F.col("_n0").cast("bigint").alias("bytes"), F.sha1("payload").alias("sha1"), "owner", "copies",
                  "payload").write.parquet(os.path.join(path, "payloads"))

    rows = materialize(base.select("page_id", "url", digest, F.monotonically_increasing_id().alias("uid")), "warc-rows")
    facts = pages.sparkSession.read.parquet(os.path.join(path, "payloads")).drop("payload")
    rows, facts = _spread(rows, facts)
    revisit = (F.col("bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}"),
                    _line("Content-Length", F.col("bytes").cast("string")), F.lit(_END))
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1" + _END), _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))), _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", _target(F.col("url"))), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("owner")))))
        .otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")), _line("Content-Length", block.cast("string")),
        F.lit(_END))
    (rows.join(facts, ["digest", "_salt"]).withColumn("revisit", revisit).withColumn("http", http)
     .select("uid", "digest", header.alias("header"), "http", "revisit").write.parquet(os.path.join(path, "records")))
    return path


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record (the exact bytes of each record), payload (of a revisit: the bytes it refers to)."""
    rows = spark.read.parquet(os.path.join(path, "records"))
    payloads = spark.read.parquet(os.path.join(path, "payloads")).select("digest", "copies", "payload")
    rows, payloads = _spread(rows, payloads)
    same = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    payloads = payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(
        F.raise_error(F.lit("stored bytes do not give their digest"))))
    whole = rows.join(payloads, ["digest", "_salt"])
    body = F.when(F.col("revisit"), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return whole.select(F.concat(F.encode("header", "UTF-8"), F.encode("http", "UTF-8"), body,
                                 F.lit(_END * 2).cast("binary")).alias("record"), "payload")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("_head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), "^<urn:page:(.*)>$", 1).try_cast("bigint")


def parse(records: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, read from the bytes of each record.

    A revisit's payload is that of the record it refers to.  The payload must give the digest in the header.
    """
    gap = F.lit(_END * 2)
    text = F.col("record").cast("string")
    at = records.withColumn("_head", F.concat(F.substring_index(text, _END * 2, 1), F.lit(_END)))
    at = at.withColumns({"_type": _field("WARC-Type"), "_length": _field("Content-Length").cast("int"),
                         "_sum": _field("WARC-Payload-Digest"), "_from": F.octet_length("_head") + F.octet_length(gap) - 1})
    at = at.withColumn("_block", F.substring(F.col("record"), F.col("_from"), F.col("_length")))
    http = F.octet_length(F.substring_index(F.col("_block").cast("string"), _END * 2, 1)) + F.octet_length(gap)
    own = F.substring(F.col("_block"), http + 1, F.col("_length"))
    at = at.withColumn("payload", F.when(F.col("_type") == "response", own).otherwise(F.col("payload")))
    at = at.withColumn("payload_digest", F.sha1("payload"))
    fits = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("_sum")
    return at.select(
        _page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(fits, F.col("payload_digest")).otherwise(
            F.raise_error(F.lit("a payload does not give the digest of its header"))).alias("payload_digest"),
        F.col("_type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), "payload")


def write_warc_files(spark: SparkSession, path: str, target: str, compression: str = "gzip") -> None:
    """The records of an archive as WARC files; every record ends in the blank lines that the text sink adds."""
    record = F.col("record").cast("string")
    (read_records(spark, path).select(F.substring(record, F.lit(1), F.length(record) - len(_END * 2)).alias("value"))
     .write.option("lineSep", _END * 2).option("compression", compression).text(target))


ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
o AS (SELECT page_id, h, strlen(h) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS owner FROM p),
r AS (SELECT *, payload_bytes >= 1000 AND page_id IS DISTINCT FROM owner AS revisit FROM o)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN revisit THEN owner END AS refers_to FROM r"""
