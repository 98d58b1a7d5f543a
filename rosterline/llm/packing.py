"""Operator 8: harmonic packing of token sequences.

A document is cut into pieces whose lengths fall into reciprocal-capacity
classes: class ``k`` holds lengths in (capacity/(k+1), capacity/k], and each of
its bins takes exactly ``k`` pieces.  Full blocks are class 1 and fill a bin
alone.  The rest of a document is cut at capacity/2, /4, /8 and /16 as long as
at least ``least`` tokens remain, so these classes fill their bins exactly, and
the last piece goes to the class of its own length (10 or more to a bin, which
bounds the padding of such a bin by 1/11 and averages far less).

Bins are filled without any task seeing a whole class: each task numbers its
pieces per class while it tokenises, the (task, class) counts give each task its
first rank, and rank // k is the bin.  Only each class's last, incomplete bin
is open at the end; those pieces (fewer than the sum of k over all classes,
about 10,000 rows at any input size) are packed across classes by first fit.

Defined cases: a null text counts as empty and is one piece, the end id alone;
repeated documents are packed each time; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import map_arrow, materialize, texts_of

__all__ = ["pack", "cut", "tokenizer", "added_tokens", "ids_of"]

_LOADED: dict[str, object] = {}


def tokenizer(path: str | None = None):
    """Byte-level BPE with the ranks at ``path`` (default: the 50k vocabulary); loaded once per worker.

    The rank file holds the vocabulary of ``byte_bpe_50k.json``, so the ids are
    those of that tokenizer for text without added tokens (tested), which
    ``ids_of`` cuts out before; this reader of it is about six times faster.
    """
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})
    return _LOADED[path]


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Ids of the added tokens of the JSON vocabulary beside the rank file; none if there is no such file."""
    import public_tokenizers

    path = os.path.splitext(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))[0] + ".json"
    if path not in _LOADED:
        tokens = []
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                tokens = json.load(f)["added_tokens"]
        if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that depend on their surroundings are not supported")
        _LOADED[path] = {t["content"]: t["id"] for t in tokens}
    return _LOADED[path]


def ids_of(text: str, path: str | None = None) -> np.ndarray:
    """The ids that ``tokenizers`` gives on the JSON vocabulary with add_special_tokens=False."""
    enc, added = tokenizer(path), added_tokens(path)
    if not any(t in text for t in added):
        return np.asarray(enc.encode_to_numpy(text), np.uint32)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
    return np.concatenate([np.array([added[t]], np.uint32) if k % 2 else np.asarray(enc.encode_to_numpy(t), np.uint32)
                           for k, t in enumerate(parts)])


def cut(n: int, capacity: int = 2048, least: int = 64) -> list[int]:
    """Piece lengths of a document of ``n`` tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for size in (capacity // 2, capacity // 4, capacity // 8, capacity // 16):
        if rest == size or rest - size >= least:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


def pieces_of(docs: DataFrame, capacity: int, end_id: int, path: str | None, doc_id: str, text: str) -> DataFrame:
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = (f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "_class int, _task int, _rank bigint")
    state: dict = {}

    def run(b: pa.RecordBatch):
        ctx = TaskContext.get()
        key = (ctx.stageId(), ctx.partitionId(), ctx.taskAttemptId())
        seen = state.setdefault(key, {})  # pieces of this task per class, over its batches
        out = {c: [] for c in ("_row", "start", "length", "ids_crc32", "doc_tokens", "_class", "_rank")}
        for row, t in enumerate(texts_of(b.column("_text"))):
            ids = np.append(ids_of(t, path), np.uint32(end_id)).astype("<u4")
            raw = memoryview(ids.tobytes())
            at = 0
            for n in cut(len(ids), capacity):
                k = capacity // n
                out["_row"].append(row)
                out["start"].append(at)
                out["length"].append(n)
                out["ids_crc32"].append(zlib.crc32(raw[4 * at:4 * (at + n)]))
                out["doc_tokens"].append(len(ids))
                out["_class"].append(k)
                out["_rank"].append(seen.get(k, 0))
                seen[k] = seen.get(k, 0) + 1
                at += n
        rows = out.pop("_row")
        yield out | {"doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())),
                     "_task": [ctx.partitionId()] * len(rows)}

    return map_arrow(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")], run, schema)


def _fit_rest(capacity: int):
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """First fit, longest first, over the few pieces of incomplete bins."""
        rows = rows.sort_values(["length", "doc_id", "start", "_g"], ascending=[False, True, True, True])
        room: list[int] = []
        by_room: dict[int, list[int]] = {}
        bins, offsets = [], []
        for n in rows["length"]:
            fits = [r for r in by_room if r >= n]
            if fits:
                best = min(fits)
                i = by_room[best].pop()
                if not by_room[best]:
                    del by_room[best]
            else:
                i, best = len(room), capacity
                room.append(capacity)
            bins.append(i)
            offsets.append(capacity - best)
            room[i] = best - n
            if room[i]:
                by_room.setdefault(room[i], []).append(i)
        rows["sequence_id"] = np.asarray(bins, np.int64) * 4096
        rows["offset"] = np.asarray(offsets, np.int64)
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return fit


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``capacity`` is at most 4095, so ``bin * 4096 + class`` numbers the sequences
    (class 0: those packed across classes).
    """
    if not 16 <= capacity < 4096:
        raise ValueError("capacity must be between 16 and 4095")
    pieces = materialize(pieces_of(docs, capacity, end_id, path, doc_id, text), "pieces")
    counts = pieces.groupBy("_task", "_class").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_class").orderBy("_task")
    first = counts.select("_task", "_class",
                          (F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"),
                          F.sum("_n").over(Window.partitionBy("_class")).alias("_total"))
    ranked = (pieces.join(first, ["_task", "_class"])
              .withColumn("_g", F.col("_first") + F.col("_rank"))
              .withColumn("_bin", F.floor(F.col("_g") / F.col("_class")).cast("bigint")))
    whole = F.col("_bin") < F.floor(F.col("_total") / F.col("_class"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    before = (Window.partitionBy("_class", "_bin").orderBy("_g")
              .rowsBetween(Window.unboundedPreceding, -1))
    full = ranked.where(whole).select(
        *cols, (F.col("_bin") * 4096 + F.col("_class")).cast("bigint").alias("sequence_id"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))
    rest = ranked.where(~whole).select(*cols, "_g", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(
        _fit_rest(capacity), full.schema)
    return full.unionByName(rest)
