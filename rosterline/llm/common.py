"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterline.session import materialize, read_table, scratch_dir

__all__ = ["materialize", "bucketed", "discard", "read_table", "bound_batches", "map_arrow", "texts_of", "raw_of", "batch_of", "crc_bucket",
           "mix64", "rising", "runs_of"]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = LOWER.copy()
_WORD[[i for i in range(128) if not (48 <= LOWER[i] <= 57 or 97 <= LOWER[i] <= 122)]] = 32
#: Bytes to lower-cased word bytes: A-Z lowered, ASCII that is no letter or digit becomes a space.
WORD_BYTES = _WORD.tobytes()


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text after lowering A-Z."""
    return raw.translate(WORD_BYTES).split()


def bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """Like ``materialize``, as a table bucketed by ``column``: a later grouping or cogrouping by it does not
    shuffle these rows again.  Files and name are this run's own."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.format("parquet").option("path", os.path.join(scratch_dir(spark), name)).bucketBy(n, column).saveAsTable(name))
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Deletes the files of a frame that ``materialize`` gave, once all that reads it has been written."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a record batch between Spark and Python, about; texts differ in length, so a count of rows bounds nothing.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Record batches of this session hold at most ``BATCH_BYTES`` (or one longer row); a smaller limit is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_arrow(df: DataFrame, cols: list, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``fn`` turns a record batch of ``cols`` into dicts of columns; each becomes one batch of ``schema``."""
    picked = df.select(*cols)
    bound_batches(picked.sparkSession)
    target = _arrow_schema(picked.sparkSession, schema)

    def run(batches):
        for b in batches:
            if b.num_rows:
                for out in fn(b):
                    yield batch_of(out, target)

    return picked.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def batch_of(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        v = columns[f.name]
        if isinstance(v, (pa.Array, pa.ChunkedArray)):
            v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
            arrays.append(v if v.type == f.type else v.cast(f.type))
        else:
            arrays.append(pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def texts_of(col: pa.Array) -> list[str]:
    """Texts as ``str``; null counts as empty."""
    return [t or "" for t in col.to_pylist()]


def raw_of(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [t or b"" for t in col.cast(kind).to_pylist()]


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) over uint64 values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def rising(x: np.ndarray) -> np.ndarray:
    """The distinct values, in order, by sorting; ``np.unique`` hashes integers, which takes far longer when most differ."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[:len(x)]]


def runs_of(sizes, limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum to at most ``limit`` (one item may exceed it)."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield slice(at, i)
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield slice(at, len(sizes))
