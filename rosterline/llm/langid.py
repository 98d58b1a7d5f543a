"""Operator 7: word-level language ID by a linear-chain conditional random field.

Every word (a run of letters) gets affix, character n-gram and lexicon features;
learned transitions tie neighbouring words, and forward-backward gives each word
its language marginals, so that text that switches language is labelled word by
word.  A document's language is the one with the largest summed marginals; its
score is their mean.

The model is fitted on a bounded, per-language sample of snippets (``per_lang``
snippets of ``snippet`` words, documented parameters; at most twice as many reach
the driver, repeated rows or not); half of the training
sequences are spliced from two languages so that transitions are learned.  It
has a fixed size (2^16 hashed features x languages) and is broadcast.

Feature scores depend on the word alone, so each batch scores its distinct words
once.  Forward-backward runs over blocks of words: block transfer matrices for
all blocks at once, then a scan over a document's blocks, so one very long text
costs linear time and no deep loop.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text if there is nothing to learn from.  Ties go to the first
language in alphabetical order.  Repeated documents give repeated rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterline.llm.common import bound_batches, crc_bucket, map_arrow, mix64, runs_of, texts_of

__all__ = ["fit", "predict", "keep_known", "label_words"]

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 16
BLOCK = 64


def features(words: list[str], lexicon: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature ids of the words and the word of each.

    2- to 4-grams of bytes with word ends marked (those with an end mark are the
    affixes) and the word itself if it is in the lexicon.
    """
    raw = [w.encode() for w in words]
    flat = np.frombuffer(b"".join(b"\x02" + r + b"\x03" for r in raw), np.uint8).astype(np.uint64)
    size = np.array([len(r) + 2 for r in raw])
    owner = np.repeat(np.arange(len(raw)), size)
    ids, of = [], []
    code = flat
    for n in (2, 3, 4):
        code = (code[:-1] << np.uint64(8)) | flat[n - 1:]
        whole = owner[:len(code)] == owner[n - 1:]
        ids.append(mix64(code[whole], n) % BUCKETS)
        of.append(owner[:len(code)][whole])
    known = [(lexicon[h], i) for i, r in enumerate(raw) if (h := zlib.crc32(r)) in lexicon]
    ids.append(np.array([k for k, _ in known], np.uint64))
    of.append(np.array([i for _, i in known], np.int64))
    return np.concatenate(ids).astype(np.int64), np.concatenate(of)


def word_scores(weights: np.ndarray, words: list[str], lexicon: dict[int, int]) -> np.ndarray:
    """Emission scores (words, languages); n-gram sums are scaled by word length."""
    f, of = features(words, lexicon)
    n = np.maximum(1, np.bincount(of, minlength=len(words)))
    return np.stack([np.bincount(of, w[f], len(words)) for w in weights.T], 1) / np.sqrt(n)[:, None]


# --- fitting ---------------------------------------------------------------

def _snippets(bound: int):
    def run(b: pa.RecordBatch):
        out, langs = [], []
        for t, lang, at in zip(texts_of(b.column("_text")), b.column("_lang").to_pylist(), b.column("_at").to_pylist()):
            words = WORD.findall(t.lower())
            if words:
                first = at % max(1, len(words) - bound + 1)
                out.append(words[first:first + bound])
                langs.append(lang)
        yield {"words": out, "lang": langs}
    return run


def spliced(snips: dict[int, list[list[str]]], length: int, rng) -> tuple[list[list[str]], list[list[int]]]:
    """Training sequences of ``length`` words; every second one switches language midway."""
    seqs, labels = [], []
    langs = sorted(snips)
    for lang in langs:
        for i, s in enumerate(snips[lang]):
            cut = length
            other, o = [], lang
            if i % 2 and len(langs) > 1:
                o = langs[int(rng.choice([k for k, x in enumerate(langs) if x != lang]))]
                other = snips[o][int(rng.integers(len(snips[o])))]
                cut = int(rng.integers(1, length))
            words = (s[:cut] + other)[:length]
            seqs.append(words)
            labels.append(([lang] * len(s[:cut]) + [o] * length)[:len(words)])
    return seqs, labels


def train(seqs: list[list[str]], labels: list[list[int]], n_langs: int, epochs: int = 12, rate: float = 0.3,
          min_count: int = 3) -> dict:
    """AdaGrad on the CRF likelihood; exact gradients by forward-backward."""
    length = max(map(len, seqs))
    vocab: dict[str, int] = {}
    x = np.full((len(seqs), length), -1)
    y = np.zeros((len(seqs), length), np.int64)
    for i, (s, lab) in enumerate(zip(seqs, labels)):
        x[i, :len(s)] = [vocab.setdefault(w, len(vocab)) for w in s]
        y[i, :len(s)] = lab
    words = list(vocab)
    seen = np.bincount(x[x >= 0], minlength=len(words))
    lexicon = {zlib.crc32(w.encode()): BUCKETS + i for i, w in enumerate(
        [w for w, n in zip(words, seen) if n >= min_count])}
    f, of = features(words, lexicon)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(words))))
    order = np.argsort(of, kind="stable")
    f, start = f[order], np.searchsorted(of[order], np.arange(len(words) + 1))
    w = np.zeros((BUCKETS + len(lexicon), n_langs))
    trans = np.zeros((n_langs, n_langs))
    gw, gt = np.full_like(w, 1e-4), np.full_like(trans, 1e-4)
    rng = np.random.default_rng(1)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            ids, where = np.unique(x[at], return_inverse=True)
            where = where.reshape(x[at].shape)
            valid = x[at] >= 0
            real = ids[ids >= 0]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in real])
            fs = f[rows]
            own = np.repeat(np.arange(len(ids) - len(real), len(ids)), start[real + 1] - start[real])
            sc = np.where(ids >= 0, scale[ids], 0)[:, None]
            score = np.stack([np.bincount(own, w[fs, k], len(ids)) for k in range(n_langs)], 1) * sc
            de, dt = gradient(score[where], trans, y[at], valid)
            per = np.stack([np.bincount(where.ravel(), de[:, :, k].ravel(), len(ids)) for k in range(n_langs)], 1) * sc
            used, back = np.unique(fs, return_inverse=True)
            dw = np.stack([np.bincount(back, per[own, k], len(used)) for k in range(n_langs)], 1) + 1e-6 * w[used]
            gw[used] += dw * dw
            gt += dt * dt
            w[used] -= rate * dw / np.sqrt(gw[used])
            trans -= rate * dt / np.sqrt(gt)
    return {"w": w.astype(np.float32), "trans": trans, "lexicon": lexicon}


def gradient(score: np.ndarray, trans: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean negative log-likelihood by scores and transitions; sequences are valid up to their end."""
    n, steps, _ = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    m = np.exp(trans)
    a, b = np.empty_like(e), np.ones_like(e)
    a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        v = (a[:, t - 1] @ m) * e[:, t]
        a[:, t] = np.where(valid[:, t, None], v / v.sum(1, keepdims=True), a[:, t - 1])
    dt = np.zeros_like(m)
    for t in range(steps - 1, 0, -1):
        right = e[:, t] * b[:, t]
        v = right @ m.T
        b[:, t - 1] = np.where(valid[:, t, None], v / v.sum(1, keepdims=True), b[:, t])
        pair = a[:, t - 1, :, None] * m * right[:, None, :]
        pair *= (valid[:, t] / pair.sum((1, 2)))[:, None, None]
        dt += pair.sum(0)
        np.add.at(dt, (y[valid[:, t], t - 1], y[valid[:, t], t]), -1)
    post = a * b
    post /= post.sum(2, keepdims=True)
    post[np.arange(n)[:, None], np.arange(steps)[None], y] -= 1
    total = max(1, int(valid.sum()))
    return np.where(valid[:, :, None], post, 0) / total, dt / total


def fit(docs: DataFrame, per_lang: int = 1200, snippet: int = 24, doc_id: str = "doc_id", text: str = "text",
        lang: str = "lang", held_out: int = 0, folds: int = 5) -> dict | None:
    """A model learned from documents outside the held-out fold; None if they have no labelled word."""
    known = docs.where((crc_bucket(doc_id, folds) != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items()
                           for x in (k, float(min(1.0, 1.2 * per_lang / n)))])
    # Drawn by id and text, so that rows that share an id are not picked together; repeated rows still are,
    # so what reaches the driver is limited per language as well, by the same draw.
    key = F.xxhash64(F.col(doc_id), F.col(text), F.lit(17))
    draw = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.where(draw <= share[F.col(lang)]).select(
        F.col(text).alias("_text"), F.col(lang).alias("_lang"), F.pmod(key, F.lit(1 << 20)).alias("_at"))
    first = Window.partitionBy("lang").orderBy("words")
    rows = (map_arrow(picked, picked.columns, _snippets(snippet), "words array<string>, lang string")
            .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= 2 * per_lang).drop("_n").collect())
    langs = sorted({r[1] for r in rows})
    if not langs:
        return None
    snips: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        snips.setdefault(langs.index(r[1]), []).append(list(r[0]))
    rng = np.random.default_rng(2)
    for s in snips.values():
        rng.shuffle(s)
        del s[int(1.5 * per_lang):]
    model = train(*spliced(snips, snippet, rng), len(langs))
    return model | {"langs": langs}


# --- labelling ---------------------------------------------------------------

def marginals(score: np.ndarray, trans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Word marginals (words, languages) of concatenated documents of ``sizes`` words (none empty)."""
    langs = score.shape[1]
    m = np.exp(trans).astype(np.float32)
    score = score.astype(np.float32)
    e = np.exp(score - score.max(1, keepdims=True))
    per = -(-sizes // BLOCK)
    n = int(per.sum())
    doc_first = np.cumsum(per) - per
    number = np.arange(n) - np.repeat(doc_first, per)
    at = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    width = np.minimum(BLOCK, np.repeat(sizes, per) - number * BLOCK)
    first = number == 0
    step = np.minimum(at + np.arange(BLOCK)[:, None], len(e) - 1)  # step-major from here on
    eb = e[step]
    live = (np.arange(BLOCK)[:, None] < width)[:, :, None]
    # Transfer matrix of each block, entering transition included; scaled every few steps.
    block = np.broadcast_to(np.eye(langs, dtype=np.float32), (n, langs, langs)).copy()
    for t in range(BLOCK):
        nxt = (block.reshape(-1, langs) @ m).reshape(block.shape)
        if t == 0:
            nxt[first] = block[first]
        nxt *= eb[t, :, None, :]
        block = np.where(live[t, :, None], nxt, block)
        if t % 8 == 7:
            block /= block.max((1, 2), keepdims=True)
    into, outof = np.ones((n, langs), np.float32), np.ones((n, langs), np.float32)
    depth = int(per.max())
    for j in range(1, depth):
        rows = doc_first[per > j] + j
        v = np.einsum("ni,nij->nj", into[rows - 1], block[rows - 1])
        into[rows] = v / v.max(1, keepdims=True)
    for j in range(depth - 1, 0, -1):
        rows = doc_first[per > j] + j
        v = np.einsum("nij,nj->ni", block[rows], outof[rows])
        outof[rows - 1] = v / v.max(1, keepdims=True)
    post = np.empty_like(eb)
    a = into
    for t in range(BLOCK):
        v = a @ m
        if t == 0:
            v[first] = a[first]
        v *= eb[t]
        a = np.where(live[t], v, a)
        if t % 8 == 7:
            a /= a.max(1, keepdims=True)
        post[t] = a
    b, back = outof, np.ascontiguousarray(m.T)
    for t in range(BLOCK - 1, -1, -1):
        post[t] *= b
        b = np.where(live[t], (eb[t] * b) @ back, b)
        if t % 8 == 0:
            b /= b.max(1, keepdims=True)
    post = post.transpose(1, 0, 2)[live[:, :, 0].T]
    return post / (post @ np.ones((langs, 1), np.float32))


def label_words(model: dict, texts: list[str], chars: int = 1_000_000):
    """(slice of texts, words per text, distinct words, code of each word, marginals), for about ``chars`` characters at once."""
    for part in runs_of([len(t) for t in texts], chars):
        words = [WORD.findall(t.lower()) if any(map(str.isalpha, t)) else [] for t in texts[part]]
        sizes = np.array([len(w) for w in words])
        if not sizes.sum():
            yield part, sizes, [], np.empty(0, int), np.empty((0, len(model["langs"])))
            continue
        coded = pa.array([w for doc in words for w in doc], pa.large_string()).dictionary_encode()
        del words
        distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        score = np.concatenate([word_scores(model["w"], distinct[i:i + 10_000], model["lexicon"]).astype(np.float32)
                                for i in range(0, len(distinct), 10_000)])
        yield part, sizes, distinct, code, marginals(score[code], model["trans"], sizes[sizes > 0])


def languages(model: dict | None, texts: list[str]) -> tuple[list[str], list[float]]:
    """(language, score) of each text."""
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return pred, score
    for part, sizes, _, _, post in label_words(model, texts):
        if not len(post):
            continue
        docs = np.flatnonzero(sizes)
        sums = np.add.reduceat(post.astype(np.float64), np.cumsum(sizes[docs]) - sizes[docs], axis=0)
        for d, s in zip(docs, sums):
            pred[part.start + d] = model["langs"][int(s.argmax())]
            score[part.start + d] = min(1.0, float(s.max() / sizes[d]))
    return pred, score


def predict(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5,
            held_out: int = 0, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(
        fit(docs, doc_id=doc_id, text=text, lang=lang, held_out=held_out, folds=folds, **options))
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(b: pa.RecordBatch):
        pred, score = languages(model.value, texts_of(b.column("_text")))
        yield {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "lang_pred": pred, "score": score}

    cols = [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"),
            (crc_bucket(doc_id, folds) == held_out).alias("held_out")]
    return map_arrow(docs, cols, run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The documents whose language is known with a score of at least ``least``; all columns as they are."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text=text, **options))
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            pred, score = languages(model.value, texts_of(b.column(at)))
            kept = pa.array([p != "und" and s >= least for p, s in zip(pred, score)], pa.bool_())
            yield b.filter(kept)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
