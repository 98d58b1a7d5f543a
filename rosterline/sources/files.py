"""File sources and sinks: S1, S2, S4, S5, S6.

Readers use Spark's own CSV/JSON scanners (splittable, schema-on-read); sinks
write partitioned files.  Nothing is assembled on the driver: JSON envelopes
are built per bounded page of rows, never per whole list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.functions.normalize import blank_to_null
from rosterline.schema import EXPORT_COLUMNS
from rosterline.session import materialize

__all__ = ["read_companies_csv", "read_jsonl", "write_export_csv", "read_export_csv",
           "write_snapshot", "read_snapshot", "write_bucketed_snapshot", "to_json_rows", "to_json_pages", "to_json_map",
           "NAME_COLS", "DOMAIN_COLS", "LINKEDIN_COLS"]

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference exactly)
# ---------------------------------------------------------------------------
# Header aliases, in priority order (first non-blank wins).
NAME_COLS = ("company_name", "company", "name", "account", "organization", "account_name")
DOMAIN_COLS = ("company_domain", "domain", "website", "url", "site", "web")
LINKEDIN_COLS = ("company_linkedin_url", "linkedin_url", "linkedin", "company_linkedin")
# ---------------------------------------------------------------------------


def read_companies_csv(spark: SparkSession, path: str, multi_line: bool = True, max_columns: int = 256):
    """Tolerant company CSV → (companies, skipped per file).

    Every file is read by its own header, so files may differ in columns and their order.
    Headers are trimmed and lowercased; name/domain/LinkedIn come from the first
    non-blank alias (of a header that stands twice, the first non-blank cell); rows with
    neither name nor domain are skipped; other non-blank columns become ``extras``.
    BOM-safe; quoted multi-line fields.  Output uses the canonical names ``company_name`` /
    ``company_domain`` (D19).  A file with more than ``max_columns`` columns raises.

    The headers are read first, a row per file (one small job, at the call): where each field stands
    follows from the header alone.  Then the files are read by their own number of columns, once,
    as the parser raises inside for every cell that a row lacks.

    ``multiLine`` parsing reads each file in one task; account lists are
    usually many small files, and ``multi_line=False`` makes big single files
    splittable when no quoted field spans lines.
    """
    options = {"multiLine": str(multi_line).lower(), "escape": '"', "encoding": "UTF-8"}
    head = materialize(_headers(spark, path, options, max_columns), "csv-headers")
    widths = [r["_width"] for r in head.select("_width").distinct().orderBy("_width").collect()]

    def read(width):
        """Cells of the files with that many columns, below the header."""
        names = [f"_c{i}" for i in range(width)]
        rows = (spark.read.schema(", ".join(f"{n} string" for n in names)).options(header="true", **options).csv(path)
                .select(F.array(*names).alias("_v"), F.col("_metadata.file_path").alias("_file")))
        own = head.where(F.col("_width") == width)
        if len(widths) > 1:     # paths, as the driver's own listing holds them: other files are not opened
            rows = rows.where(F.col("_file").isin([r["_file"] for r in own.select("_file").collect()]))
        return rows.join(F.broadcast(own), "_file")

    rows = reduce(DataFrame.unionAll, [read(w) for w in widths or [1]])

    def pick(places):
        """The first non-blank cell of some places."""
        cells = F.transform(places, lambda i: blank_to_null(F.get("_v", i)))
        return F.try_element_at(F.filter(cells, lambda x: x.isNotNull()), F.lit(1))

    cells = F.filter(F.transform("_extra", lambda x: F.struct(x["h"].alias("h"), blank_to_null(F.get("_v", x["i"])).alias("v"))),
                     lambda x: x["v"].isNotNull())
    names = F.transform("_cells", lambda x: x["h"])
    once = F.filter("_cells", lambda x, i: F.array_position(names, x["h"]) == i + 1)
    out = (rows.select(pick("_name").alias("company_name"), pick("_domain").alias("company_domain"),
                       pick("_linkedin").alias("linkedin_url"), cells.alias("_cells"), "_twice", "_file")
           .select("company_name", "company_domain", "linkedin_url",
                   F.map_from_entries(F.when(F.col("_twice"), once).otherwise(F.col("_cells"))).alias("extras"), "_file"))
    keep = F.col("company_name").isNotNull() | F.col("company_domain").isNotNull()
    skipped = out.where(~keep).groupBy("_file").agg(F.count(F.lit(1)).alias("skipped"))
    return out.where(keep).drop("_file"), skipped


def _headers(spark: SparkSession, path: str, options: dict[str, str], max_columns: int) -> DataFrame:
    """Per file: number of columns up to the last named one, places (from 0) of name, domain, LinkedIn
    and extra columns, whether an extra header stands twice."""
    # Records stay text here (the corrupt-record column; a single cell is no corrupt record): only headers are split.
    raw = (spark.read.schema("_c0 string, _record string").options(header="false", columnNameOfCorruptRecord="_record", **options)
           .csv(path).select("_c0", "_record", F.col("_metadata.file_path").alias("_file"),
                             F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n")))
    # The header is the first row of a file's first block.
    first = raw.where(F.col("_at") == 0).groupBy("_file").agg(F.min("_n").alias("_n"))
    names = [f"_c{i}" for i in range(max_columns + 1)]
    split = F.from_csv("_record", ", ".join(f"{n} string" for n in names), options)
    cells = F.when(F.col("_record").isNull(), F.array("_c0")).otherwise(F.array(*[F.col("_s")[n] for n in names]))
    wide = F.raise_error(F.lit("a file has more columns than max_columns"))
    clean = F.transform("_v", lambda x: F.lower(F.trim(F.regexp_replace(x, "^\ufeff", ""))))
    head = (raw.join(first, ["_file", "_n"]).withColumn("_s", split).select("_file", cells.alias("_v"))
            .select("_file", F.when(F.try_element_at("_v", F.lit(max_columns + 1)).isNull(), clean).otherwise(wide).alias("_h"))
            .select("_file", F.filter(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))),
                                      lambda x: blank_to_null(x["h"]).isNotNull()).alias("_h")))

    def under(name):
        return F.transform(F.filter("_h", lambda x: x["h"] == name), lambda x: x["i"])

    def places(aliases):
        """Of the columns under some headers, those under the first header first."""
        return F.flatten(F.array(*[under(a) for a in aliases]))

    extra = F.filter("_h", lambda x: ~x["h"].isin(*NAME_COLS, *DOMAIN_COLS, *LINKEDIN_COLS))
    extra_names = F.transform(extra, lambda x: x["h"])
    return head.select("_file", F.greatest(F.lit(1), F.array_max(F.transform("_h", lambda x: x["i"])) + 1).alias("_width"),
                       places(NAME_COLS).alias("_name"), places(DOMAIN_COLS).alias("_domain"), places(LINKEDIN_COLS).alias("_linkedin"),
                       extra.alias("_extra"), (F.size(F.array_distinct(extra_names)) < F.size(extra_names)).alias("_twice"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON Lines with a fixed schema; blank lines are skipped, a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_export_csv(df: DataFrame, path: str, partition_col: str | None = "list_id") -> None:
    """The 16 export columns in order, header row, NULL → empty cell, RFC-4180 quoting."""
    cols = ([partition_col] if partition_col else []) + EXPORT_COLUMNS
    if "export_pos" in df.columns:      # files of position ranges, each in order
        order = ([partition_col] if partition_col else []) + ["export_pos"]
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    w = (df.select(*cols).write.mode("overwrite").option("header", "true")
         .option("emptyValue", "").option("nullValue", "").option("escape", '"')
         .option("quoteAll", "false"))
    if partition_col:
        w = w.partitionBy(partition_col)
    w.csv(path)


def read_export_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", "true").option("escape", '"').option("multiLine", "true")
            .csv(path))


def write_snapshot(df: DataFrame, path: str, partition_col: str = "list_id") -> None:
    """Parquet partitioned by list; only the lists present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_col).parquet(path))


def read_snapshot(spark: SparkSession, path: str, partition_col: str = "list_id") -> DataFrame:
    """Read an S5 snapshot; the partition column keeps its BIGINT type."""
    return spark.read.parquet(path).withColumn(partition_col, F.col(partition_col).cast("bigint"))


def write_bucketed_snapshot(df: DataFrame, table: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """S5 (co-located form): an external parquet table bucketed and sorted on
    ``keys`` (e.g. ``list_id`` + a dedup key).  Later joins or aggregations on
    the same keys against another table with the same bucket count read it
    without a shuffle.  Returns the table."""
    (df.write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table))
    return df.sparkSession.table(table)


def to_json_rows(df: DataFrame, out_col: str = "json") -> DataFrame:
    """One JSON object per row (JSON Lines form of the reference's row arrays)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out_col))


def to_json_pages(df: DataFrame, page_size: int = 1000, partition_col: str = "list_id",
                  order_col: str = "id") -> DataFrame:
    """JSON array envelopes of at most ``page_size`` rows per (list, page)."""
    from rosterline.operators.upsert import assign_ids
    paged = assign_ids(df, [order_col], partition_col, id_col="_pos").withColumn(
        "_page", F.floor((F.col("_pos") - 1) / page_size)).drop("_pos")
    return (paged.groupBy(partition_col, "_page")
            .agg(F.to_json(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in df.columns])))).alias("json"))
            .withColumnRenamed("_page", "page"))


def to_json_map(df: DataFrame, key: str, value: str, page_size: int = 1000) -> DataFrame:
    """``{key: value}`` objects of at most ``page_size`` keys each.

    Duplicate keys are folded first (max value); keys are paged in key order,
    so no object (and no group) grows with the data.  A reader merges pages.
    """
    from rosterline.operators.upsert import assign_ids
    kv = df.groupBy(key).agg(F.max(value).alias(value))
    paged = assign_ids(kv, [key], None, id_col="_pos").withColumn(
        "page", F.floor((F.col("_pos") - 1) / page_size))
    return (paged.groupBy("page")
            .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("json")))
