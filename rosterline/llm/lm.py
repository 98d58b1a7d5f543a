"""Operator 9: language-model scores from sharded Elias-Fano n-gram tries.

The model.  Every n-gram of the training texts is stored, at every corpus size:
p(w | context) = (count - d) / total + gamma * p(w | shorter context), with one
absolute discount an order, down to (count of w + 1) / (tokens + words + 1).
What the contexts lose by the discount is what gamma hands on, so probabilities
sum to one.

The tries (``eliasfano.Trie``).  A shard's trie has its contexts nearest word
first: monotone pointers lead from a context to its longer ones and to the words
seen after it, both Elias-Fano sequences, and every word there has the 16-bit
code of its discounted probability.  An n-gram is looked up by a successor search among
the children of each context on its path, and nowhere else.

The jobs.  (1) Contexts that hold a large share of all n-grams are found in a
sample of the texts; that steers routing only, not results.  (2) Slices of texts are stored as codes of their words.
(3) In each of ``ROUNDS`` turns, every slice derives the distinct n-grams of a share of the nearest words, with their
training counts, and sends them to shards by the nearest word, so a context, its totals and its successors share a shard.  A context
that is too large for one is passed on: its longer contexts are dealt by the next word, and its own successors by (context, word),
with the totals summed over shards.  Word counts are dealt by word.  A shard sums the counts and stores each distinct n-gram once, with
the places that every slice asks for; the shuffle's files go before the next turn.  (4) The sums give the discounts.  (5) A shard's
trie is built from what it stored, every n-gram asked for is searched once, and share and gamma go back to the
slices, which derive their n-grams again, in the same order, and add up their texts.  Rows are blocks of n-grams
and never more than n-grams; the only broadcast is the list of large contexts, at most ``LARGE`` at any size.

Words, and contexts of several, are known by 64-bit hashes: two of ten million
collide with probability 3e-6, two of a billion contexts with 0.03.

Defined cases: a null or empty text is its end token alone; with no training
tokens base_score and score of a text are those of the formulas with zero
counts; repeated rows give repeated scores; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import batch_of, bucketed, crc_bucket, map_arrow, materialize, mix64, rising, runs_of
from rosterline.llm.common import _arrow_schema as arrow_schema
from rosterline.llm.eliasfano import Children, Trie, context_hash, mapped, quantised, to_bytes

__all__ = ["tokens_of", "score_texts"]

END = np.int64(np.uint64(xxhash.xxh3_64_intdigest(b"")).astype(np.int64))
NONE = np.iinfo(np.int64).min  # stands before the end token that stands before a text
#: Large contexts at most; tokens of a shard, about; share of the texts that are looked through for large contexts.
LARGE, SHARD_TOKENS, SAMPLE = 1_000_000, 4_000_000, 16
#: Turns in which the n-grams are sent; the files of one are deleted before the next.
ROUNDS = 4


def tokens_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct token, code of each token, document of each token); every text ends with ``END``."""
    text = pc.ascii_lower(col.cast(pa.large_string()).fill_null(""))
    lists = pc.ascii_split_whitespace(text)
    flat, doc = pc.list_flatten(lists), np.asarray(pc.list_parent_indices(lists), np.int64)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    coded = flat.dictionary_encode()
    words = byte_strings(coded.dictionary)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words] + [xxhash.xxh3_64_intdigest(b"")], np.uint64).view(np.int64)
    code, doc = np.asarray(coded.indices, np.int64)[real], doc[real]
    n = len(col)
    ends = np.searchsorted(doc, np.arange(n), side="right")
    return hashes, np.insert(code, ends, len(words)), np.insert(doc, ends, np.arange(n))


def byte_strings(col: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of strings without nulls; ``to_pylist`` makes a scalar of each."""
    col = col.cast(pa.large_string())
    _, ends, raw = col.buffers()
    ends = np.frombuffer(ends, np.int64)[col.offset:col.offset + len(col) + 1].tolist() if len(col) else [0]
    raw = raw.to_pybytes() if raw is not None else b""
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def parts_of(b: pa.RecordBatch, size: int = 6_000_000):
    """Slices of a batch with about ``size`` bytes of text each, which bounds a worker's memory."""
    lengths = pc.binary_length(b.column("_text")).fill_null(0).to_pylist()
    for part in runs_of(lengths, size):
        # Copied: the split kernel misreads sliced strings.
        yield b.take(pa.array(np.arange(part.start, part.stop)))


def distinct(cols: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(an index of each distinct row, rows in order of the columns; number of the distinct row of each row); values are below ``size``."""
    key = None
    if max(1, size) ** len(cols) < 2 ** 63:
        key = np.zeros(len(cols[0]), np.int64)
        for c in cols:
            key = key * size + c
    if key is None:
        by = np.lexsort(cols[::-1])
    else:   # rows in order are not sorted again
        by = np.argsort(key) if (key[1:] < key[:-1]).any() else np.arange(len(key))
    new = np.ones(len(by), bool)
    for i, c in enumerate(cols if key is None else [key]):
        c = c[by]
        new[1:] = c[1:] != c[:-1] if i == 0 else new[1:] | (c[1:] != c[:-1])
    of = np.empty(len(by), np.int64)
    of[by] = np.cumsum(new) - 1
    return by[new], of


def histories(code: np.ndarray, size: np.ndarray, end: int, order: int) -> list[np.ndarray]:
    """Codes of each token and of the order - 1 before it, nearest first; before a text stands one end token, then 0."""
    out, first = [code], np.cumsum(size) - size
    for back in range(1, order):
        p = np.roll(out[-1], 1)
        p[first] = end if back == 1 else 0
        out.append(p)
    return out


def contexts_of(cols: list[np.ndarray], names: np.ndarray) -> list[np.ndarray]:
    """Names of the contexts of 1, 2, ... words of each n-gram, a row of codes into ``names``; 0 where it has no such context."""
    out, real = [], names != NONE
    for j, c in enumerate(cols[1:], 1):
        if j == 1:      # a name of one word is that word's, whatever follows it
            out.append(np.where(real, context_hash(np.zeros(len(names), np.uint64), names, j), np.uint64(0))[c])
        else:
            out.append(np.where(real[c], context_hash(out[-1], names[c], j), np.uint64(0)))
    return out


def among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which items are in ``some``, whose values rise."""
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def packed(x: np.ndarray, level: int = 3) -> bytes:
    """Integers, byte planes apart, compressed."""
    return squeezed(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), level)


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(restored(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


@cache
def _compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def squeezed(x: bytes, level: int = 3) -> bytes:
    return _compressor(level).compress(x)


def restored(x: bytes) -> bytes:
    return _decompressor().decompress(x)


def words_block(cols: list[np.ndarray], names: np.ndarray) -> list[bytes]:
    """Rows of codes into ``names`` (rising), last word first, as places in a list of the names they have.  Rows are in order of
    the nearest word, those before it, and the last; so the first of these columns, and the second below it, are gaps."""
    all_ = np.concatenate(cols)
    if 64 * len(all_) < len(names):
        used, of = np.unique(all_, return_inverse=True)
    else:
        has = np.zeros(len(names), bool)
        has[all_] = True
        used, of = np.flatnonzero(has), (np.cumsum(has) - 1)[all_]
    last, *past = np.split(of, len(cols))
    past = [*past, last]
    out = [packed(np.diff(names[used], prepend=0)), packed(np.diff(past[0], prepend=0))]
    if len(past) > 1:
        new = np.diff(past[0], prepend=-1) != 0
        out.append(packed(np.where(new, past[1], np.diff(past[1], prepend=0))))
    return out + [packed(x) for x in past[2:]]


def words_of_block(block: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(names, rows of codes) of ``words_block``."""
    names, past = np.cumsum(unpacked(block[0])), [np.cumsum(unpacked(block[1]))] + [unpacked(x) for x in block[2:]]
    if len(past) > 1 and len(past[0]):
        first = np.flatnonzero(np.diff(past[0], prepend=-1) != 0)
        total = np.cumsum(past[1])
        past[1] = total - np.repeat(total[first] - past[1][first], np.diff(first, append=len(total)))
    return names, [x.astype(np.int32) for x in (past[-1], *past[:-1])]


def cat(column, read=unpacked) -> np.ndarray:
    """The arrays of a column of blocks, one after the other."""
    parts = [read(x) for x in column.to_pylist() if x is not None]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def sums(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(of, n, size).astype(np.int64)


def large_contexts(docs: DataFrame, order: int, shards: int) -> list[np.ndarray]:
    """Names, per level, of the contexts that hold over 1 / (8 shards) of the distinct n-grams of slices; a context counts
    as large only if the one it extends is."""
    least = max(1 / (8 * shards), 2 / LARGE)

    def run(batch: pa.RecordBatch):
        for b in parts_of(batch):
            names, code, size = slice_of(b)
            past = histories(code, size, int(np.searchsorted(names, END, side="right")), order)
            one, _ = distinct(past[1:] + past[:1], len(names) + 1)
            out = [(0, 0, len(one))]
            for j, c in enumerate(contexts_of([p[one] for p in past], np.append(NONE, names)), 1):
                found, n = np.unique(c[c != 0], return_counts=True)
                big = n >= least / 2 * len(one)
                out += [(j, int(x), int(k)) for x, k in zip(found[big].view(np.int64), n[big])]
            level, name, n = zip(*out)
            yield {"level": level, "name": name, "n": n}

    some = docs.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0)
    found = map_arrow(some, ["_text"], run, "level int, name bigint, n bigint").groupBy("level", "name").agg(F.sum("n").alias("n"))
    found = materialize(found, "large-contexts")
    total = found.where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = found.where((F.col("level") > 0) & (F.col("n") >= least * total)).orderBy(F.desc("n")).limit(LARGE).toArrow()
    level, name = np.asarray(rows.column("level")), np.asarray(rows.column("name"), np.int64).view(np.uint64)
    return [np.sort(name[level == j]) for j in range(1, order)]


def routes(cols: list[np.ndarray], names: np.ndarray, large: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(context that each n-gram is routed by, 0 if all its contexts are large; contexts; which of them are large)."""
    ctx, lead, by = contexts_of(cols, names), [], np.zeros(len(cols[0]), np.uint64)
    open_ = np.ones(len(by), bool)
    for c, some in zip(ctx, large):
        big = open_ & (c != 0) & among(c, some)
        by = np.where(open_ & ~big, c, by)
        open_ &= big
        lead.append(big)
    return by, ctx, lead


def slice_of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the words, rising; code of each token, the place of its word from 1; tokens of each text)."""
    hashes, code, doc = tokens_of(b.column("_text"))
    names, rank = np.unique(hashes, return_inverse=True)
    return names, rank[code] + 1, np.bincount(doc, minlength=b.num_rows)


def slices(docs: DataFrame) -> DataFrame:
    """A row per slice of texts: its words, and its texts as codes.  All n-grams are derived from these rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def run(batch: pa.RecordBatch):
        for b in parts_of(batch):
            ctx = TaskContext.get()
            task = (ctx.stageId(), ctx.partitionId(), ctx.taskAttemptId())
            number = state[task] = state.get(task, -1) + 1
            names, code, size = slice_of(b)
            ends = pa.array(np.array([0, b.num_rows], np.int32))
            yield {"slice": [(ctx.partitionId() << 32) + number], "doc_id": pa.ListArray.from_arrays(ends, b.column("doc_id")),
                   "train": pa.ListArray.from_arrays(ends, b.column("_train")), "sizes": [packed(size)],
                   "names": [packed(np.diff(names, prepend=0))], "codes": [packed(code)]}

    return bucketed(map_arrow(docs, docs.columns, run, (
        f"slice bigint, doc_id array<{id_type}>, train array<boolean>, sizes binary, names binary, codes binary")), "slices", "slice")


class Asked:
    """What a slice asks in one turn, always in the same order: ``blocks`` are the whole n-grams, the words and, per level, the
    successors of large contexts, each as (shard, codes, names, training counts) in order of shards."""

    def __init__(self, names, code, size, train, order: int, turn: int, deal: int, large):
        small = np.uint16 if deal < 2 ** 16 else np.int64   # sorted by radix
        home = lambda key: (mix64(key, 7) % np.uint64(deal)).astype(small)
        named = np.append(NONE, names)
        # All n-grams with the same nearest word have the same turn, so their contexts are whole there.
        mine = mix64(context_hash(np.zeros(len(named), np.uint64), named, 1), 11) % np.uint64(ROUNDS) == turn
        past = histories(code, size, int(np.searchsorted(names, END, side="right")), order)
        taught = np.repeat(train, size)
        self.tokens = np.flatnonzero(mine[past[min(1, order - 1)]])
        cols = [p[self.tokens] for p in past]
        one, of = distinct(cols[1:] + cols[:1], len(named))
        n, grams = np.bincount(of[taught[self.tokens]], minlength=len(one)), [c[one] for c in cols]
        by, ctx, lead = routes(grams, named, large)
        # Whole n-grams, by shard; those without one come last.  This is the order of n-grams from here on.
        shard = np.where(by == 0, deal, home(by))
        at = np.argsort(shard, kind="stable")
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        self.of, grams, n = place[of], [g[at] for g in grams], n[at]
        self.last = grams[0] - 1
        words = np.flatnonzero(mine[1:])
        to = home(names[words].view(np.uint64))
        self.words = words[np.argsort(to, kind="stable")]
        self.blocks = [(shard[at], grams, named, n),
                       (np.sort(to), [self.words], names, np.bincount(code[taught], minlength=len(named))[1:][self.words])]
        self.split = []
        for c, big in zip(ctx, lead):
            c, big = c[at], big[at]
            found, i = np.unique(c[big].view(np.int64), return_inverse=True)
            first, i = distinct([i, grams[0][big]], max(len(found), len(named)))
            ww, cw = named[grams[0][big][first]], c[big][first]
            to = home(cw ^ mix64(ww.view(np.uint64), 5))
            at_ = np.argsort(to, kind="stable")
            where, back = np.full(len(n), -1), np.empty(len(at_), np.int64)
            back[at_] = np.arange(len(at_))
            where[big] = back[i]
            self.split.append(where)
            both, codes = np.unique(np.concatenate([ww[at_], cw[at_].view(np.int64)]), return_inverse=True)
            self.blocks.append((to[at_], np.split(codes, 2), both, sums(i, n[big], len(first))[at_]))


def slice_columns(t, i: int):
    """Names, codes, sizes and training marks of row ``i`` of ``slices``."""
    return (np.cumsum(unpacked(t.column("names")[i].as_py())), unpacked(t.column("codes")[i].as_py()),
            unpacked(t.column("sizes")[i].as_py()), np.array(t.column("train")[i].as_py(), bool))


def requests(texts: DataFrame, order: int, turn: int, deal: int, large) -> DataFrame:
    """What each slice asks of each shard in one turn: whole n-grams, words, and successors of large contexts, each with its
    training count."""
    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            blocks = Asked(*slice_columns(batch, i), order, turn, deal, large.value).blocks
            cuts = [np.searchsorted(b[0], np.arange(deal + 1)) for b in blocks]
            for s in range(deal):
                spans = [slice(c[s], c[s + 1]) for c in cuts]
                if any(x.stop > x.start for x in spans):
                    yield {"slice": batch.column("slice").slice(i, 1), "shard": [s],
                           "asks": [[words_block([c[x] for c in cols], names) for x, (_, cols, names, _) in zip(spans, blocks)]],
                           "counts": [[packed(n[x]) for x, (_, _, _, n) in zip(spans, blocks)]]}

    return map_arrow(texts, ["slice", "train", "sizes", "names", "codes"], run,
                     "slice bigint, shard int, asks array<array<binary>>, counts array<binary>")


def level_counts(cols: list[np.ndarray], names: np.ndarray, n: np.ndarray, large: list[np.ndarray]) -> list[np.ndarray]:
    """Per j from 1, counts of the distinct n-grams of order j + 1 whose context of j words is served whole here."""
    out = []
    for j, (c, big) in enumerate(zip(*routes(cols, names, large)[1:]), 1):
        own = np.flatnonzero((c != 0) & ~big)
        one, of = distinct([x[own] for x in (*cols[1:j + 1], cols[0])], len(names))
        out.append(sums(of, n[own], len(one)))
    return out


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2,
                order: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    if order < 1:
        raise ValueError("order must be at least 1")
    fold = crc_bucket(doc_id, folds)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), (fold != held_out).alias("_train"))
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * SHARD_TOKENS)))
    deal = max(-(-2 * shards // ROUNDS), min(shards, spark.sparkContext.defaultParallelism))    # shards of a turn
    large = spark.sparkContext.broadcast(large_contexts(docs, order, shards))
    texts = slices(docs)

    counted_schema = arrow_schema(spark, counted := (
        "turn int, shard int, rows array<array<binary>>, counts array<binary>, slices array<bigint>, places array<array<binary>>, "
        "tokens bigint, words bigint, once array<bigint>, twice array<bigint>, level array<int>, "
        "name array<bigint>, total array<bigint>, followers array<bigint>"))

    def count(turn):
        def run(key, t):
            """Sums of a shard: its n-grams, its words, the successors of large contexts; and which of them each slice asks for."""
            asks, counts = t.column("asks").to_pylist(), t.column("counts").to_pylist()
            out = {k: [] for k in ("rows", "counts", "once", "twice", "level", "name", "total", "followers")}
            places = []
            for i in range(order + 1):
                parts = [words_of_block(a[i]) for a in asks]
                names = rising(np.concatenate([x for x, _ in parts]))
                ends = np.cumsum([0] + [len(x[0]) for _, x in parts])
                for own, cols in parts:
                    here = np.searchsorted(names, own).astype(np.int32)
                    cols[:] = [here[c] for c in cols]
                cols = [np.concatenate(x) for x in zip(*[x for _, x in parts])]
                del parts
                one, of = distinct(cols[1:] + cols[:1], len(names))
                places.append([packed(np.diff(of[a:b], prepend=0)) for a, b in zip(ends, ends[1:])])
                cols, n = [c[one] for c in cols], sums(of, np.concatenate([unpacked(c[i]) for c in counts]), len(one))
                out["rows"].append(words_block(cols, names))
                out["counts"].append(packed(n))
                cols, n = [c[n > 0] for c in cols], n[n > 0]
                if i == 0:
                    wholes = level_counts(cols, names, n, large.value)
                elif i == 1:
                    out |= {"tokens": int(n.sum()), "words": len(n)}
                else:
                    whole = wholes[i - 2]
                    out["once"].append(int((n == 1).sum() + (whole == 1).sum()))
                    out["twice"].append(int((n == 2).sum() + (whole == 2).sum()))
                    ctx, of = np.unique(names[cols[1]], return_inverse=True)
                    out["level"] += [i - 1] * len(ctx)
                    out["name"] += ctx.tolist()
                    out["total"] += sums(of, n, len(ctx)).tolist()
                    out["followers"] += np.bincount(of, minlength=len(ctx)).tolist()
            row = {k: [v] for k, v in out.items()} | {"turn": [turn], "shard": [key[0].as_py()], "places": [list(zip(*places))],
                                                      "slices": [t.column("slice").to_pylist()]}
            return pa.Table.from_batches([batch_of(row, counted_schema)])
        return run

    found = reduce(DataFrame.unionAll, [
        once_shuffled(requests(texts, order, turn, deal, large).groupBy("shard").applyInArrow(count(turn), counted), "counted")
        for turn in range(ROUNDS)])
    n, v, *seen = found.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0)),
                            *[F.coalesce(F.sum(F.col(k)[o]), F.lit(0)) for o in range(order - 1) for k in ("once", "twice")]).first()
    discounts = [x / (x + 2 * y) if x + y else 0.5 for x, y in zip(seen[::2], seen[1::2])]
    spread = (found.select(F.explode(F.arrays_zip("level", "name", "total", "followers")).alias("x")).groupBy("x.level", "x.name")
              .agg(F.sum("x.total").alias("total"), F.sum("x.followers").alias("followers")).toArrow())   # a row for each large context
    of_large = spark.sparkContext.broadcast(tuple(np.asarray(spread.column(k), np.int64)[np.argsort(np.asarray(spread.column("name"), np.int64))]
                                                  for k in ("name", "level", "total", "followers")))

    def build(blocks, counts):
        """A shard's trie, its successors of large contexts (a trie of one level, the context as its word), its words."""
        (names, cols), n_ = blocks[0], counts[0]
        cols, n_ = [c[n_ > 0] for c in cols], n_[n_ > 0]
        has = np.zeros(len(names), bool)
        for c in cols:
            has[c] = True
        has &= names != NONE
        number = np.where(has, np.cumsum(has) - 1, -1)
        lead = lambda j, c: among(c, large.value[j - 1])
        out = {f"t.{k}": x for k, x in Trie.build_numbered(names[has], [number[c] for c in cols], n_, discounts, lead).items()}
        name, level, total, followers = of_large.value
        held = [(*(names[c[k > 0]] for c in cols), k[k > 0]) for (names, cols), k in zip(blocks[2:], counts[2:])]
        word, ctx, k = (np.concatenate(x) for x in zip(*held)) if held else [np.empty(0, np.int64)] * 3
        at = np.searchsorted(name, ctx)
        names = rising(word)
        pair = np.unique(at * max(1, len(names)) + np.searchsorted(names, word), return_index=True)
        d = np.array([0.0, *discounts])[level[at]]
        book, codes = quantised(((k - d) / total[at])[pair[1]]) if len(k) else quantised(np.empty(0))
        out |= {"s.names": names, "s.codes": codes, "s.book": book} | {f"s.{x}": y for x, y in Children.build(
            pair[0], len(name), max(1, len(names)), "w.").items()}
        return mapped(to_bytes(out))

    def answer(b: pa.RecordBatch):
        """Builds the trie of a shard, searches every n-gram that a slice asks for, once, and answers each slice."""
        for r in range(b.num_rows):
            blocks = [words_of_block(x) for x in b.column("rows")[r].as_py()]
            counts = [unpacked(x) for x in b.column("counts")[r].as_py()]
            held = build(blocks, counts)
            part = lambda p: {k.removeprefix(p): x for k, x in held.items() if k.startswith(p)}
            trie, s = Trie(part("t.")), part("s.")
            after = Children(s, "w.", max(1, len(s["names"])))
            name, level, total, followers = of_large.value
            weight = np.array([0.0, *discounts])[level] * followers / np.maximum(total, 1)
            number = trie.number(blocks[0][0])
            got = [trie.search_numbered([number[c] for c in blocks[0][1]])]
            for names, cols in blocks[2:]:
                word, ctx = (names[c] for c in cols)
                at = np.minimum(np.searchsorted(name, ctx), max(0, len(name) - 1))
                met = (name[at] == ctx) if len(name) else np.zeros(len(ctx), bool)
                w = np.minimum(np.searchsorted(s["names"], word), max(0, len(s["names"]) - 1))
                w = np.where(s["names"][w] == word, w, -1) if len(s["names"]) else np.full(len(word), -1)
                i = after.find(np.where(met, at, -1), w)
                share = np.where(i >= 0, s["book"][s["codes"][np.maximum(i, 0)]], 0) if len(s["codes"]) else np.zeros(len(i))
                got.append((share, np.where(met, weight[at], 1.0) if len(name) else np.ones(len(i))))
            got = [(near_one(x), y.astype("<f4")) for x, y in got]
            asked = b.column("slices")[r].as_py()
            for i, places in zip(asked, b.column("places")[r].as_py()):
                whole, words, *more = [np.cumsum(unpacked(x)) for x in places]
                yield {"slice": [i], "turn": b.column("turn").slice(r, 1), "shard": b.column("shard").slice(r, 1),
                       "share": [[floats(x[at]) for at, (x, _) in zip((whole, *more), got)]],
                       "gamma": [[floats(x[at], gaps=True) for at, (_, x) in zip((whole, *more), got)]], "known": [packed(counts[1][words])]}

    answers = map_arrow(found, ["turn", "shard", "rows", "counts", "slices", "places"], answer,
                        "slice bigint, turn int, shard int, share array<binary>, gamma array<binary>, known binary")
    id_type = texts.schema["doc_id"].dataType.elementType.simpleString()
    scored = (f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    scored_schema = arrow_schema(spark, scored)

    def add_up(key, t, got):
        got = got.sort_by([("turn", "ascending"), ("shard", "ascending")])
        turns = np.asarray(got.column("turn"))
        got = [got.slice(a, b - a) for a, b in zip(*(np.searchsorted(turns, np.arange(ROUNDS), side=x) for x in ("left", "right")))]
        names, code, size, train = slice_columns(t, 0)
        asked = [Asked(names, code, size, train, order, turn, deal, large.value) for turn in range(ROUNDS)]
        known = np.zeros(len(names), np.int64)
        for a, g in zip(asked, got):
            known[a.words] = cat(g.column("known"))
        logs = np.empty(len(code))
        for a, g in zip(asked, got):
            values = lambda c, i: cat(g.column(c), lambda x: floats_of(x[i], c == "gamma"))  # noqa: B023, E731
            p = (known[a.last] + 1) / (n + v + 1)
            for i, where in enumerate(a.split, 1):     # large contexts, shortest first
                if (where >= 0).any():
                    hit = where >= 0
                    share, gamma = from_near_one(values("share", i)), values("gamma", i).astype(np.float64)
                    p[hit] = share[where[hit]] + gamma[where[hit]] * p[hit]
            share, gamma = from_near_one(values("share", 0)), values("gamma", 0).astype(np.float64)
            p[:len(share)] = share + gamma * p[:len(share)]
            logs[a.tokens] = np.log10(p)[a.of]
        doc = np.repeat(np.arange(len(size)), size)
        out = {"doc_id": t.column("doc_id").combine_chunks().flatten(), "held_out": pc.invert(t.column("train").combine_chunks().flatten()),
               "n_tokens": size, "n_known": sums(doc, known[code - 1] > 0, len(size)), "train_tokens": np.full(len(size), n),
               "base_score": np.bincount(doc, np.log10(known + 1.0)[code - 1], len(size)) - size * float(np.log10(n + v + 1)),
               "score": np.bincount(doc, logs, len(size))}
        return pa.Table.from_batches([batch_of(out, scored_schema)])

    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(add_up, scored)


def once_shuffled(df: DataFrame, tag: str) -> DataFrame:
    """Like ``materialize``; the files of the job's shuffles are deleted when it ends, not when the driver collects garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        return materialize(df, tag)
    finally:
        conf.set(name, before)


def floats(x: np.ndarray, gaps: bool = False) -> bytes:
    """Floats of four bytes, byte planes apart, compressed; with ``gaps`` each as the bits that differ from the one before."""
    bits = x.astype("<f4").view("<u4")
    if gaps:
        bits = bits ^ np.append(np.uint32(0), bits[:-1])[:len(bits)]
    return squeezed(np.ascontiguousarray(bits.view(np.uint8).reshape(-1, 4).T).tobytes())


def floats_of(x: bytes, gaps: bool = False) -> np.ndarray:
    bits = np.ascontiguousarray(np.frombuffer(restored(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()
    return (np.bitwise_xor.accumulate(bits) if gaps else bits).view("<f4")


def near_one(share: np.ndarray) -> np.ndarray:
    """Four bytes a share; above one half, what it lacks to one, with a minus sign, so that it stays exact there."""
    return np.where(share > 0.5, -(1 - share), share).astype("<f4")


def from_near_one(x: np.ndarray) -> np.ndarray:
    return np.where(np.signbit(x), 1 + x.astype(np.float64), x)
