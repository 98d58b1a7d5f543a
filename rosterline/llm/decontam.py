"""Operator 6: benchmark decontamination with one Aho-Corasick automaton.

Benchmark items are normalised to words; every window of ``window`` consecutive
words (or a shorter item as a whole) is a pattern of one automaton.  Each text
is normalised the same way and scanned once; every occurrence is mapped back to
word positions and to code-point offsets in the original text.

The automaton is broadcast, so its size is checked: patterns are dealt to
shards of at most ``shard_bytes`` normalised bytes.  One shard is the usual
case.  More shards scan the rows one after another, each adding its hits to the
row, so nothing is shuffled or joined and no item is left out.

Defined cases: a null or empty text has no words and is clean; an item without
words or without an id takes no part; repeated items count once per id; repeated
documents give repeated rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import bound_batches, map_arrow, raw_of, words_of

__all__ = ["scan_contamination", "drop_contaminated", "windows_of"]

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
SCHEMA = ("doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
          "contaminated boolean, hit_spans string")


def normalise(raw: bytes) -> str:
    """Words with one space around each; one character per byte."""
    return f" {b' '.join(words_of(raw)).decode('latin-1')} "


def windows_of(raw: bytes, window: int) -> set[str]:
    words = [w.decode("latin-1") for w in words_of(raw)]
    if not words:
        return set()
    return {f" {' '.join(words[i:i + window])} " for i in range(max(1, len(words) - window + 1))}


def shards_of(items: list[tuple[str, bytes]], window: int, shard_bytes: int) -> list[dict[str, list[str]]]:
    """Pattern -> item ids, in shards of at most ``shard_bytes`` pattern bytes."""
    shards: list[dict[str, list[str]]] = [{}]
    where: dict[str, dict] = {}
    used = 0
    for item, raw in items:
        for p in sorted(windows_of(raw, window)):
            if p not in where:
                if used and used + len(p) > shard_bytes:
                    shards.append({})
                    used = 0
                used += len(p)
                where[p] = shards[-1]
            where[p].setdefault(p, []).append(item)
    return shards


_BUILT: dict[str, ahocorasick.Automaton] = {}


def automaton_of(patterns: dict[str, list[str]], key: str) -> ahocorasick.Automaton | None:
    """The worker's automaton of a shard, built once per worker process."""
    if not patterns:
        return None
    if key not in _BUILT:
        _BUILT.clear()
        a = ahocorasick.Automaton()
        for p, items in patterns.items():
            a.add_word(p, (p.count(" ") - 1, items))
        a.make_automaton()
        _BUILT[key] = a
    return _BUILT[key]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def scan(auto, text: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged hit word ranges (end exclusive) and the items found."""
    ends, items = [], set()
    for end, (k, found) in auto.iter(text):
        ends.append((end, k))
        items.update(found)
    if not ends:
        return [], items
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
    last = np.searchsorted(spaces, [e for e, _ in ends])
    return merge([(int(j) - k, int(j)) for j, (_, k) in zip(last, ends)]), items


def char_spans(raw: bytes, ranges: list[tuple[int, int]]) -> str:
    """Word ranges as code-point spans of the original text."""
    if not ranges:
        return ""
    found = [m.span() for m in WORD.finditer(raw)]
    b = np.frombuffer(raw, np.uint8)
    points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    return ",".join(f"{points[found[i][0]]}:{points[found[j - 1][1]]}" for i, j in ranges)


def sent_shards(docs: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, item_id: str, text: str) -> list:
    """(broadcast patterns, worker key) of each shard."""
    spark = docs.sparkSession
    items = sorted({(str(r[0]), bytes(r[1])) for r in benchmark
                    .where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
                    .select(F.col(item_id).cast("string"), F.col(text).cast("binary")).toLocalIterator()})
    run = uuid.uuid4().hex
    return [(spark.sparkContext.broadcast(s), f"{run}-{i}")
            for i, s in enumerate(shards_of(items, window, shard_bytes))]


def scan_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 2_000_000,
                       doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """One row per document with its hits (``hit_spans``: code points, end exclusive); see the module for the cases."""
    shards = sent_shards(docs, benchmark, window, shard_bytes, item_id, text)
    df = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"),
                     F.lit("").alias("_ranges"), F.array().cast("array<string>").alias("_items"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    mid = f"doc_id {id_type}, _text string, _ranges string, _items array<string>"
    last = SCHEMA.replace("doc_id bigint", f"doc_id {id_type}")
    for k, (patterns, key) in enumerate(shards):
        final = k == len(shards) - 1
        df = map_arrow(df, df.columns, _step(patterns, key, final), last if final else mid)
    return df


def _step(patterns, key: str, final: bool):
    def run(b: pa.RecordBatch):
        auto = automaton_of(patterns.value, key)
        raws = raw_of(b.column("_text"))
        ranges, items, n_words = [], [], []
        for raw, r, i in zip(raws, b.column("_ranges").to_pylist(), b.column("_items").to_pylist()):
            norm = normalise(raw)
            n_words.append(norm.count(" ") - 1 if len(norm) > 2 else 0)
            got, found = scan(auto, norm) if auto else ([], set())
            ranges.append(merge([tuple(map(int, x.split(":"))) for x in r.split(",") if x] + got))
            items.append(sorted(found | set(i)))
        if not final:
            yield {"doc_id": b.column("doc_id"), "_text": b.column("_text"), "_items": items,
                   "_ranges": [",".join(f"{x}:{y}" for x, y in r) for r in ranges]}
            return
        hit = [sum(y - x for x, y in r) for r in ranges]
        yield {"doc_id": b.column("doc_id"), "n_words": n_words, "n_hit": hit, "n_items": [len(i) for i in items],
               "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items],
               "contaminated": [h > 0 for h in hit],
               "hit_spans": [char_spans(raw, r) for raw, r in zip(raws, ranges)]}

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 2_000_000,
                      text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The documents without any benchmark window, all columns as they are."""
    at = docs.columns.index(text)

    def clean(patterns, key):
        def run(batches):
            for b in batches:
                auto = automaton_of(patterns.value, key)
                kept = [auto is None or next(auto.iter(normalise(raw)), None) is None for raw in raw_of(b.column(at))]
                yield b.filter(pa.array(kept, pa.bool_()))
        return run

    out = docs
    for patterns, key in sent_shards(docs, benchmark, window, shard_bytes, item_id, "text"):
        bound_batches(docs.sparkSession)
        out = out.mapInArrow(clean(patterns, key), docs.schema)
    return out


ORACLE = r"""
WITH dw AS (SELECT doc_id, rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM (SELECT doc_id, text, row_number() OVER () AS rn FROM documents)),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bx AS (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0),
pat AS (SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS p, least(10, len(w)) AS k FROM bx),
ks AS (SELECT DISTINCT k FROM pat),
dx AS (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
occ AS (SELECT d.rn, d.i, d.k, pat.item FROM (SELECT rn, i, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM dx) d
        JOIN pat ON pat.p = d.p AND pat.k = d.k),
hit AS (SELECT rn, count(DISTINCT j) AS n FROM (SELECT rn, unnest(range(i, i + k)) AS j FROM
        (SELECT DISTINCT rn, i, k FROM occ)) GROUP BY rn),
it AS (SELECT rn, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rn, item FROM occ) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rn) LEFT JOIN it USING (rn)
"""
