"""Operator 2: document quality by an interpolated modified Kneser-Ney character model.

Trained on trusted text (labelled good and not toxic).  N-gram counts, the
continuation counts of the shorter orders and the context totals are sharded
tables, joined by context and by shorter n-gram to give the smoothed
probabilities.  A document's perplexity (per character) follows from one pass;
it is kept if its perplexity is at most a quantile of the trusted documents of
its language, times a margin.

Every n-gram of the trusted text is kept at every size.  A slice of documents
sends its distinct n-grams to shards; the distinct ones of all slices are joined
to the probability tables, those that are missing to the weights of their
contexts and to their shorter forms; the shards send each slice its answers.
The texts themselves are written once, as slices bucketed by their number, and never
shuffled: which of them are trusted is a join of ids, whose places in the slices, and
later the answers, are sent to the slices.  Requests are dealt to shards once and stored,
bucketed by shard.  The n-grams of a context go to one shard, so that a slice's rising
n-grams have small gaps; a context has at most 4,096.

A key has 12 bits a character: code points below 2048 are themselves (digits and
white space as one each), those above share 2047 codes by remainder, so that some
ideographs look alike to the model.  A text is cut into pieces of ``SLICE``
characters, which overlap by an n-gram, so texts of any length are read whole.

Defined cases: a null or empty text has no perplexity and is not kept; without
trusted text every perplexity is null and documents with text are kept; a null
language is a group of its own; a language without trusted documents gets the
threshold of all trusted ones; a document labelled twice is trusted if every
label says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import _arrow_schema as arrow_schema
from rosterline.llm.common import batch_of, bucketed, discard, map_arrow, materialize, mix64, rising, runs_of, texts_of
from rosterline.llm.lm import cat, packed, restored, squeezed, unpacked

__all__ = ["fit", "perplexities", "rate"]

BITS = 12  # of a character in an n-gram key
BOS, EOS = 0, 1
SLICE = 2_000_000
#: Bytes of text for each shard of n-grams, about.
SHARD_BYTES = 64_000_000


def _fold() -> np.ndarray:
    """Characters below 2048 are themselves; digits are one, white space is one."""
    out = np.arange(2048)
    out[48:58] = 48
    out[[9, 10, 11, 12, 13]] = 32
    out[[BOS, EOS]] = 32
    return out


FOLD = _fold()


def folded(text: str) -> np.ndarray:
    """The code of each character in an n-gram key."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = FOLD[np.minimum(c, 2047)]
    other = np.flatnonzero(c >= 2048)
    out[other] = 2048 + c[other] % 2047
    return out.astype(np.uint16)


def grams(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, text numbers) of the n-grams that end at each character and at the end of each text."""
    return grams_of(folded("".join(texts)), np.array([len(t) for t in texts], np.int64), order)


def grams_of(codes: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``grams`` of the texts with ``sizes``, one after the other in ``codes``."""
    pieces, first = [], (np.cumsum(sizes) - sizes).tolist()
    for i, n in enumerate(sizes.tolist()):
        for at in range(0, n, SLICE):
            head = min(at, order - 1)
            pieces.append((i, order - 1 - head, first[i] + at - head, first[i] + min(n, at + SLICE), at + SLICE >= n))
    for part in runs_of([p[3] - p[2] for p in pieces], SLICE):
        number, pad, begin, end, last = (np.array(x, np.int64) for x in zip(*pieces[part]))
        size = pad + end - begin + last     # of a piece: what stands before a text, its characters, its end
        start = np.cumsum(size) - size
        ids, real = np.full(size.sum(), BOS, np.int64), np.ones(size.sum(), bool)
        for k in range(order - 1):
            real[start[pad > k] + k] = False
        ends = (start + size - 1)[last == 1]
        real[ends] = False
        # Characters that two pieces share are in two parts, as a piece that is not the last fills its own.
        ids[real], ids[ends] = codes[begin[0]:end[-1]], EOS
        key = ids.copy()
        for back in range(1, order):
            key[back:] += ids[:-back] << (BITS * back)
        whole = np.ones(len(ids), bool)
        for k in range(order - 1):
            whole[start + k] = False
        yield key[whole], np.repeat(number, size - order + 1)


def spans(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places from each ``begin`` to its ``end``."""
    size = end - begin
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def counted(docs: DataFrame, order: int) -> DataFrame:
    """(gram, c) of the longest order over the texts ``_text``."""

    def run(b: pa.RecordBatch):
        for keys, _ in grams(texts_of(b.column("_text")), order):
            code, distinct = pd.factorize(keys)
            yield {"gram": distinct, "c": np.bincount(code)}

    return _summed(map_arrow(docs, ["_text"], run, "gram bigint, c bigint"))


def _summed(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("gram").agg(F.sum("c").alias("c")), "grams")


def slices_of(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The texts in slices: slice, sizes, texts (their codes, compressed) and, as arrays ``_x0`` and on, the columns ``keep``."""
    named = [F.col(c).alias(f"_x{i}") for i, c in enumerate(keep)]
    types = [docs.schema[c].dataType.simpleString() for c in keep]
    state: dict = {}

    def run(b: pa.RecordBatch):
        texts = texts_of(b.column("_text"))
        for part in runs_of([len(t) for t in texts], 3 * SLICE):
            ctx = TaskContext.get()
            task = (ctx.stageId(), ctx.partitionId(), ctx.taskAttemptId())
            state[task] = state.get(task, -1) + 1
            mine, ends = texts[part], pa.array([0, part.stop - part.start], pa.int32())
            yield {"slice": [(ctx.partitionId() << 32) + state[task]], "sizes": [packed(np.array([len(t) for t in mine], np.int64))],
                   "texts": [squeezed(as_text(folded("".join(mine))), 12)]} | {
                f"_x{i}": pa.ListArray.from_arrays(ends, b.column(f"_x{i}").take(pa.array(np.arange(part.start, part.stop))))
                for i in range(len(keep))}

    return bucketed(map_arrow(docs, [*named, F.col(text).alias("_text")], run, "slice bigint, sizes binary, texts binary"
                              + "".join(f", _x{i} array<{t}>" for i, t in enumerate(types))), "texts", "slice")


def as_text(codes: np.ndarray) -> bytes:
    """Codes of characters as UTF-8; none is a surrogate."""
    return codes.astype("<u4").tobytes().decode("utf-32-le").encode()


def codes_in(texts: bytes) -> np.ndarray:
    """The codes of a slice's characters, its texts one after the other."""
    return np.frombuffer(restored(texts).decode().encode("utf-32-le"), "<u4").astype(np.uint16)


def counted_in(slices: DataFrame, good: DataFrame, order: int) -> DataFrame:
    """(gram, c) over the texts of ``slices`` whose ``_x0`` is among ``good``."""
    places = (slices.select(F.col("slice").alias("at"), F.posexplode("_x0").alias("pos", "_x"))
              .join(good, F.col("_x") == F.col("_id"), "left_semi").select("at", "pos"))
    schema = arrow_schema(slices.sparkSession, "gram bigint, c bigint")

    def count(key, t, at):
        if not t.num_rows or not at.num_rows:
            return pa.Table.from_batches([], schema)
        size, pos = unpacked(t.column("sizes")[0].as_py()), np.asarray(at.column("pos"))
        codes = codes_in(t.column("texts")[0].as_py())[spans((np.cumsum(size) - size)[pos], np.cumsum(size)[pos])]
        parts = [pd.factorize(keys) for keys, _ in grams_of(codes, size[pos], order)]
        return pa.Table.from_batches([batch_of({"gram": distinct, "c": np.bincount(code)}, schema) for code, distinct in parts], schema)

    return _summed(slices.select("slice", "sizes", "texts").groupBy("slice").cogroup(places.groupBy("at"))
                   .applyInArrow(count, "gram bigint, c bigint"))


def _short(o: int):
    """The n-gram without its first character."""
    return F.col("gram").bitwiseAND(F.lit((1 << (BITS * (o - 1))) - 1))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 up, from the numbers of n-grams that occur 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [max(0.1, k - (k + 1) * y * n[k] / n[k - 1]) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def fit(trusted: DataFrame, order: int = 5, share: float = 0.0) -> dict | None:
    """Tables of log10 probabilities and context weights of texts ``_text``; None if there is no text.

    Longest n-grams below ``share`` of all counts are left out, their mass goes to the weights; 0 keeps all.
    """
    return fit_counts(counted(trusted, order), order, share)


def fit_counts(longest: DataFrame, order: int, share: float = 0.0) -> dict | None:
    """``fit`` from the summed counts of the longest order."""
    tables = {order: longest}
    for o in range(order - 1, 0, -1):  # continuation counts: in how many longer n-grams
        tables[o] = materialize(tables[o + 1].select(_short(o + 1).alias("gram")).groupBy("gram")
                                .agg(F.count(F.lit(1)).alias("c")), f"grams{o}")
    model, lower = {"order": order}, None
    for o in range(1, order + 1):
        g = tables[o]
        total, *n = g.agg(F.sum("c"), *[F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]).first()
        if not total:
            return None
        d = discounts(n)
        kept = F.col("c") >= (share * total if o == order else 0)
        off = F.when(~kept, F.col("c")).when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        g = g.withColumn("ctx", F.shiftright("gram", BITS))
        ctx = g.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(off).alias("left"))
        ctx = ctx.withColumn("gamma", F.col("left") / F.col("total"))
        p = g.where(kept).join(ctx, "ctx").withColumn("own", (F.col("c") - off) / F.col("total"))
        if lower is None:
            p = p.withColumn("p", F.col("own") + F.col("gamma") / F.lit(float(g.count() + 1)))
        else:
            p = (p.withColumn("short", _short(o)).join(lower, "short")
                 .withColumn("p", F.col("own") + F.col("gamma") * F.col("below")))
        p = materialize(p.select("gram", "c", "p"), f"p{o}")
        lower = p.select(F.col("gram").alias("short"), F.col("p").alias("below"))
        model[f"p{o}"] = p.select("gram", F.log10("p").alias("lp"))
        model[f"g{o}"] = materialize(ctx.select("ctx", F.log10("gamma").alias("lg")), f"g{o}")
        discard(tables[o])
    model["unknown"] = float(model["g1"].first()["lg"] - np.log10(model["p1"].count() + 1))
    return model


def log_probabilities(model: dict, wanted: DataFrame) -> DataFrame:
    """(gram, shard, lp) of the distinct n-grams (gram, shard): log10 p of the last character.

    The longest stored n-gram counts, and the weights of the contexts above it.
    """
    order, found, rows = model["order"], {}, wanted
    for o in range(order, 0, -1):
        found[o] = materialize(rows.join(model[f"p{o}"], "gram", "left"), f"found{o}")
        if o > 1:
            rows = found[o].where("lp is null").select(_short(o).alias("gram")).distinct().withColumn("shard", F.lit(0))
    out = found[1].withColumn("lp", F.coalesce("lp", F.lit(model["unknown"])))
    for o in range(2, order + 1):
        below = out.select(F.col("gram").alias("short"), F.col("lp").alias("below"))
        missing = (found[o].where("lp is null").select("gram", "shard", F.shiftright("gram", BITS).alias("ctx"), _short(o).alias("short"))
                   .join(model[f"g{o}"], "ctx", "left").join(below, "short")
                   .select("gram", "shard", (F.coalesce("lg", F.lit(0.0)) + F.col("below")).alias("lp")))
        out = found[o].where("lp is not null").select("gram", "shard", "lp").unionByName(missing)
    return out


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of distinct n-grams by shard, which their context gives; the ends of the shards in that order)."""
    shard = (mix64((keys >> BITS).view(np.uint64), 5) % np.uint64(shards)).astype(np.uint16 if shards < 2 ** 16 else np.int64)
    by = np.argsort(shard, kind="stable")
    return by, np.searchsorted(shard[by], np.arange(shards + 1))


def perplexities(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``n_chars_scored``, ``perplexity`` of every row."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    return _scored(slices_of(docs, keep, text), model, keep, size)


def _scored(slices: DataFrame, model: dict | None, keep: list[str], size: int) -> DataFrame:
    """``perplexities`` of the texts of ``slices``, ``size`` bytes in all."""
    spark = slices.sparkSession
    names = [f"_x{i}" for i in range(len(keep))]
    types = [slices.schema[x].dataType.elementType.simpleString() for x in names]
    kinds = "".join(f"{x} {t}, " for x, t in zip(names, types)) + "n_chars_scored bigint, perplexity double"
    last = [*[F.col(x).alias(c) for x, c in zip(names, keep)], "n_chars_scored", "perplexity"]
    scored = np.vectorize(lambda n: n + (n > 0), otypes=[np.int64])

    if model is None:
        def unscored(b: pa.RecordBatch):
            for i in range(b.num_rows):
                n = scored(unpacked(b.column("sizes")[i].as_py()))
                yield {x: b.column(x).slice(i, 1).flatten() for x in names} | {"n_chars_scored": n, "perplexity": [None] * len(n)}

        return map_arrow(slices, ["sizes", *names], unscored, kinds).select(*last)

    order, shards = model["order"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)

    def run(b: pa.RecordBatch):
        for i in range(b.num_rows):
            parts = grams_of(codes_in(b.column("texts")[i].as_py()), unpacked(b.column("sizes")[i].as_py()), order)
            keys = rising(np.concatenate([np.empty(0, np.int64), *(rising(k) for k, _ in parts)]))
            by, cut = by_shard(keys, shards)
            at = np.flatnonzero(cut[1:] > cut[:-1])
            yield {"slice": [b.column("slice")[i].as_py()] * len(at), "shard": at,
                   "keys": [packed(np.diff(keys[by[cut[s]:cut[s + 1]]], prepend=0), 9) for s in at]}

    asked = bucketed(map_arrow(slices, ["slice", "sizes", "texts"], run, "slice bigint, shard int, keys binary").repartition("shard"),
                     "requests", "shard")
    wanted_schema = arrow_schema(spark, "gram bigint, shard int")
    answer_schema = arrow_schema(spark, "slice bigint, shard int, lp binary")
    out_schema = arrow_schema(spark, kinds)
    sums = lambda x: np.cumsum(unpacked(x))

    def distinct(key, t):
        keys = rising(cat(t.column("keys"), sums))
        return pa.Table.from_batches([batch_of({"gram": keys, "shard": np.full(len(keys), key[0].as_py())}, wanted_schema)])

    def answer(key, t, rows):
        gram, lp = np.asarray(rows.column("gram")), np.asarray(rows.column("lp"))
        by = np.argsort(gram)
        gram, lp = gram[by], lp[by].astype("<f4")
        out = [squeezed(lp[np.searchsorted(gram, sums(x))].tobytes(), 9) for x in t.column("keys").to_pylist()]
        return pa.Table.from_batches([batch_of({"slice": t.column("slice"), "shard": t.column("shard"), "lp": out}, answer_schema)])

    def add_up(key, t, got):
        size = cat(t.column("sizes"))
        parts = []      # n-grams by number: in 4 bytes each, with the distinct ones of a part
        for k, owner in grams_of(codes_in(t.column("texts")[0].as_py()), size, order):
            code, some = pd.factorize(k)
            parts.append((code.astype(np.int32), some, owner.astype(np.int32)))
        keys = rising(np.concatenate([np.empty(0, np.int64), *(some for _, some, _ in parts)]))
        lp, total = np.empty(len(keys)), np.zeros(len(size))
        lp[by_shard(keys, shards)[0]] = cat(got.sort_by("shard").column("lp"), lambda x: np.frombuffer(restored(x), "<f4"))
        for code, some, owner in parts:
            total += np.bincount(owner, lp[np.searchsorted(keys, some)][code], len(size))
        n = scored(size) if len(size) else size
        ppl = [float(10 ** (-x / k)) if k else None for x, k in zip(total, n)]
        out = {x: t.column(x).combine_chunks().flatten() for x in names} | {"n_chars_scored": n, "perplexity": ppl}
        return pa.Table.from_batches([batch_of(out, out_schema)])

    lp = log_probabilities(model, asked.groupBy("shard").applyInArrow(distinct, "gram bigint, shard int"))
    answers = asked.groupBy("shard").cogroup(lp.groupBy("shard")).applyInArrow(answer, "slice bigint, shard int, lp binary")
    return (slices.groupBy("slice")
            .cogroup(answers.groupBy("slice")).applyInArrow(add_up, kinds).select(*last))


def rate(docs: DataFrame, labels: DataFrame, order: int = 5, share: float = 0.0, quantile: float = 0.995,
         margin: float = 1.25, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, n_chars_scored, perplexity, threshold, kept of every document."""
    good = (labels.groupBy(F.col("doc_id").alias("_id"))
            .agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("_good"))
            .where("_good").select("_id"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("_text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    slices = slices_of(source, ["doc_id", "lang"], "_text")
    model = fit_counts(counted_in(slices, good, order), order, share)
    scored = materialize(_scored(slices, model, ["doc_id", "lang"], size), "perplexities")
    trusted = scored.join(good, F.col("doc_id") == F.col("_id"), "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = trusted.groupBy(F.col("lang").alias("_lang")).agg((cut * margin).alias("_own"))  # one row per language
    overall = trusted.agg((cut * margin).alias("x")).first()["x"]
    limit = F.coalesce("_own", F.lit(overall).cast("double"))
    return (scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left")
            .select("doc_id", "lang", "n_chars_scored", "perplexity", limit.alias("threshold"),
                    ((F.col("n_chars_scored") > 0) & F.coalesce(F.col("perplexity") <= limit, F.lit(True))).alias("kept")))
