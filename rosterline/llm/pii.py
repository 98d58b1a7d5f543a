"""Operator 4: personal data by a character-level bidirectional LSTM with a CRF.

Base spans come from four fixed patterns.  A bounded sample of windows around
them (``sample``, a documented parameter), partly rewritten into spellings the
patterns miss, trains a small BiLSTM-CRF in numpy.  Its weights (a few thousand
numbers) are broadcast.  Each text is covered by a fixed grid of overlapping
windows; a character's label is taken from the window whose middle holds it, and
labels are joined across windows over the whole text.  A span the network finds
is added if an exact check of its kind holds and no base span overlaps it.

A kept span holds a digit or ``@``, so decoding starts at the windows whose middles
hold one, and goes on to the next window wherever a label reaches the end of a middle,
as far as it takes.  Spans may have any length; windows that are not decoded can't take
part in one (tested against decoding every window).

Defined cases: a null or empty text has no spans; with no labelled windows at
all the base spans stand alone; repeated documents give repeated rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import bound_batches, batch_of, map_arrow, texts_of

__all__ = ["KINDS", "base_spans", "fit_from", "find_spans", "find_pii", "mask_pii"]

KINDS = ("email", "ip", "card", "phone")
CORE, SIDE = 80, 40
TRAIN_WIDTH = 96
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def _byte(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 4 and int(x or 0) <= 255


def _emails(t: str):
    """Leftmost matches; each ``@`` looks back over its own run only, so a text costs linear time."""
    done, at = 0, t.find("@")
    while at >= 0:
        run = len(t[done:at]) - len(t[done:at].rstrip(_LOCAL))
        m = _HOST.match(t, at) if run else None
        if m:
            yield at - run, m.end()
        done = m.end() if m else at + 1
        at = t.find("@", done)


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, in order."""
    out = [(a, 0, b) for a, b in _emails(t)]
    if _SIGN.search(t):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(t):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t)
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def checked(kind: int, s: str) -> bool:
    """The exact check of a span the network proposes."""
    d = "".join(_DIGITS.findall(s))
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]+(\s?[\[(]?[.,][\])]?\s?[0-9]+){3}", s)) and all(
            map(_byte, _DIGITS.findall(s)))
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]([\W_]{0,2}[0-9])+", s))
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"(\+|00|\(|0)[0-9](\W{0,3}[0-9])+", s))


# --- the network ---------------------------------------------------------------

_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \n\t "
PAD = 0
N_CHARS = 6 + len(_PUNCT)


def _classes() -> np.ndarray:
    """Character class of every code point below 256; digits share one class, and so do letters of a case."""
    c = np.full(256, 4, np.int16)
    c[48:58], c[65:91], c[97:123] = 1, 2, 3
    for i, p in enumerate(_PUNCT):
        c[ord(p)] = 6 + i
    return c


CLASS = _classes()
N_LABELS = 1 + 2 * len(KINDS)


def char_ids(t: str) -> np.ndarray:
    p = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(p < 256, CLASS[np.minimum(p, 255)], 5).astype(np.int16)


def _allowed() -> np.ndarray:
    ok = np.ones((N_LABELS, N_LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


def new_model(embed: int = 12, hidden: int = 16, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = {"emb": rng.normal(0, 0.3, (N_CHARS, embed)), "out": rng.normal(0, 0.2, (2 * hidden, N_LABELS)),
         "bias": np.zeros(N_LABELS), "trans": np.zeros((N_LABELS, N_LABELS))}
    for d in "fb":
        m |= {f"wx{d}": rng.normal(0, 0.3, (embed, 4 * hidden)), f"wh{d}": rng.normal(0, 0.2, (hidden, 4 * hidden)),
              f"b{d}": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}
    return {k: v.astype(np.float32) for k, v in m.items()}


def _lstm(m: dict, ids: np.ndarray, d: str, keep: bool = False):
    """Hidden states (n, steps, hidden) of one direction; gates are in, forget, out, cell."""
    n, steps = ids.shape
    wh = m[f"wh{d}"]
    hid = len(wh)
    table = m["emb"] @ m[f"wx{d}"] + m[f"b{d}"]
    h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    out = np.empty((n, steps, hid), np.float32)
    saved = []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = table[ids[:, t]] + h @ wh
        s = 0.5 + 0.5 * np.tanh(0.5 * z[:, :3 * hid])
        g = np.tanh(z[:, 3 * hid:])
        c0, h0 = c, h
        c = s[:, hid:2 * hid] * c + s[:, :hid] * g
        tc = np.tanh(c)
        h = s[:, 2 * hid:] * tc
        out[:, t] = h
        if keep:
            saved.append((t, s, g, c0, tc, h0))
    return out, saved


def emissions(m: dict, ids: np.ndarray) -> np.ndarray:
    return np.concatenate([_lstm(m, ids, "f")[0], _lstm(m, ids, "b")[0]], 2) @ m["out"] + m["bias"]


def _lstm_back(m: dict, g: dict, ids: np.ndarray, d: str, saved: list, dout: np.ndarray) -> None:
    wh = m[f"wh{d}"]
    n, hid = len(ids), len(wh)
    dtable = np.zeros((N_CHARS, 4 * hid), np.float32)
    dh, dc = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
    for t, s, cell, c0, tc, h0 in reversed(saved):
        i, f, o = s[:, :hid], s[:, hid:2 * hid], s[:, 2 * hid:]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * cell * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o),
                             dc * i * (1 - cell * cell)], 1)
        g[f"wh{d}"] += h0.T @ dz
        np.add.at(dtable, ids[:, t], dz)
        dh, dc = dz @ wh.T, dc * f
    g[f"b{d}"] += dtable.sum(0)
    g[f"wx{d}"] += m["emb"].T @ dtable
    g["emb"] += dtable @ m[f"wx{d}"].T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def crf_loss(em: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with its gradients by emissions and transitions (forward-backward)."""
    n, steps, _ = em.shape
    tr = np.where(ALLOWED, trans, -1e4)
    a, b = np.empty_like(em), np.zeros_like(em)
    a[:, 0] = em[:, 0]
    for t in range(1, steps):
        a[:, t] = _lse(a[:, t - 1, :, None] + tr, 1) + em[:, t]
    for t in range(steps - 2, -1, -1):
        b[:, t] = _lse(tr + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = _lse(a[:, -1], 1)
    demit = np.exp(a + b - z[:, None, None])
    dtrans = np.zeros_like(tr)
    for t in range(1, steps):
        dtrans += np.exp(a[:, t - 1, :, None] + tr + (em[:, t] + b[:, t] - z[:, None])[:, None, :]).sum(0)
    r = np.arange(n)[:, None], np.arange(steps)[None], y
    gold = em[r].sum(1) + tr[y[:, :-1], y[:, 1:]].sum(1)
    demit[r] -= 1
    np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    return float((z - gold).mean()), demit / n, np.where(ALLOWED, dtrans, 0) / n


def viterbi(em: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, steps, _ = em.shape
    tr = np.where(ALLOWED, trans, -1e4).astype(np.float32)
    back = np.empty(em.shape, np.int8)
    v = em[:, 0]
    for t in range(1, steps):
        s = v[:, :, None] + tr
        back[:, t] = s.argmax(1)
        v = s.max(1) + em[:, t]
    y = np.empty((n, steps), np.int8)
    y[:, -1] = v.argmax(1)
    for t in range(steps - 1, 0, -1):
        y[:, t - 1] = back[np.arange(n), t, y[:, t]]
    return y


def train(ids: np.ndarray, labels: np.ndarray, epochs: int = 16, batch: int = 128, rate: float = 0.02) -> dict:
    """Adam on the CRF likelihood."""
    m = new_model()
    mean, var = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    rng, step = np.random.default_rng(9), 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(ids)), max(1, len(ids) // batch)):
            g = {k: np.zeros_like(v) for k, v in m.items()}
            (hf, sf), (hb, sb) = _lstm(m, ids[at], "f", True), _lstm(m, ids[at], "b", True)
            h = np.concatenate([hf, hb], 2)
            _, de, dt = crf_loss(h @ m["out"] + m["bias"], m["trans"], labels[at])
            g["trans"] += dt
            g["bias"] += de.sum((0, 1))
            g["out"] += np.einsum("nth,ntl->hl", h, de)
            dh = de @ m["out"].T
            half = hf.shape[2]
            _lstm_back(m, g, ids[at], "f", sf, dh[:, :, :half])
            _lstm_back(m, g, ids[at], "b", sb, dh[:, :, half:])
            step += 1
            lr = rate * min(1.0, 2 * (1 - epoch / epochs))
            for k in m:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                var[k] = 0.99 * var[k] + 0.01 * g[k] ** 2
                m[k] = (m[k] - lr * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(var[k] / (1 - 0.99 ** step)) + 1e-7)
                        ).astype(np.float32)
    return m


# --- labelled windows ---------------------------------------------------------------

def rewritten(kind: int, s: str, rng) -> str:
    """Another spelling of a span of the kind, one that the base patterns may miss."""
    d = "".join(_DIGITS.findall(s))
    if kind == 0:
        return s.replace("@", (" @ ", "@ ", " @")[rng.integers(3)])
    if kind == 1:
        return s.replace(".", ("[.]", " . ", "(.)", ",")[rng.integers(4)])
    if kind == 2:
        return (".", " ", "/", "_", "  ")[rng.integers(4)].join(d[i:i + 4] for i in range(0, len(d), 4))
    cut = int(rng.integers(1, 4))
    sep = ("/", " ", " ", "-", ".")[rng.integers(5)]
    return ("00", "+", "0", "(0")[rng.integers(4)] + sep.join([d[:cut] + (")" if rng.integers(4) == 3 else ""), d[cut:cut + 3], d[cut + 3:]])


def labelled(windows: list[tuple[str, list]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Character ids and BIO labels of windows; half of the spans are rewritten."""
    rng = np.random.default_rng(seed)
    width = TRAIN_WIDTH
    ids = np.full((len(windows), width), PAD, np.int16)
    labels = np.zeros((len(windows), width), np.int64)
    for n, (t, spans) in enumerate(windows):
        parts, at, marks, size = [], 0, [], 0
        for a, k, b in spans:
            if a < at:
                continue
            s = rewritten(k, t[a:b], rng) if rng.random() < 0.5 else t[a:b]
            parts += [t[at:a], s]
            size += a - at
            marks.append((size, k, size + len(s)))
            size += len(s)
            at = b
        row = char_ids("".join(parts) + t[at:])[:width]
        ids[n, :len(row)] = row
        for a, k, b in marks:
            if b <= width:
                labels[n, a], labels[n, a + 1:b] = 1 + 2 * k, 2 + 2 * k
    return ids, labels


def _windows(b: pa.RecordBatch):
    """Windows around up to three spans of each text, and some without; no span is cut by a window's ends."""
    text, spans = [], []
    for t in texts_of(b.column("_text")):
        i, found = zlib.crc32(t.encode("utf-8", "surrogatepass")), base_spans(t)     # the text alone places its windows
        for a, _, _ in found[:: max(1, len(found) // 3)] or [(min(len(t), 37 * i % 400), 0, 0)] * (i % 4 == 0):
            at = max([0, a - 5 - 29 * i % 40, *(y for _, _, y in found if y <= a)])
            end = at + TRAIN_WIDTH - 12
            end = min([end, *(x for x, _, y in found if at <= x < end < y)])
            text.append(t[at:end])
            spans.append([f"{x - at}:{k}:{y - at}" for x, k, y in found if x >= at and y <= end])
    yield {"text": text, "spans": spans}


def fit_from(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 1500) -> dict | None:
    """A tagger trained on at most ``sample`` windows of the documents; None if there is no labelled span."""
    rows = docs.where(F.col(text).rlike("[0-9@]"))
    total = docs.count()
    share = int((1 << 30) * min(1.0, 40 * sample / max(1, total))) + 1
    rows = rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < share)
    got = map_arrow(rows, [F.col(text).alias("_text")], _windows, "text string, spans array<string>")
    # The least by a hash: the same windows however the table is cut into files and partitions.
    got = got.orderBy(F.xxhash64("text", "spans"), "text").limit(sample).collect()
    windows = [(r[0], [tuple(map(int, s.split(":"))) for s in r[1]]) for r in got]
    if not any(s for _, s in windows):
        return None
    return train(*labelled(windows))


# --- finding ---------------------------------------------------------------

def decode_cores(m: dict, texts: list[str], every: bool = False, batch: int = 1024) -> list[dict[int, np.ndarray]]:
    """Labels of the decoded windows' middles, per text and window number."""
    out: list[dict[int, np.ndarray]] = [{} for _ in texts]
    last = [(len(t) - 1) // CORE for t in texts]
    if every:
        wanted = [(i, w) for i in range(len(texts)) for w in range(last[i] + 1)]
    else:
        wanted = [(i, w) for i, t in enumerate(texts) for w in sorted({x.start() // CORE for x in _SIGN.finditer(t)})]
    while wanted:
        more = set()
        for some in range(0, len(wanted), batch):
            part = wanted[some:some + batch]
            y = viterbi(emissions(m, np.stack([_window(texts[i], w) for i, w in part])), m["trans"])
            for (i, w), row in zip(part, y):
                core = out[i][w] = row[SIDE:SIDE + CORE]
                if core[0] and core[0] % 2 == 0:    # inside a span: it may begin in the window before
                    more.add((i, w - 1))
                if core[-1]:
                    more.add((i, w + 1))
        wanted = sorted((i, w) for i, w in more if 0 <= w <= last[i] and w not in out[i])
    return out


def _window(t: str, w: int) -> np.ndarray:
    """Character classes of window ``w``: its middle and ``SIDE`` characters on either side."""
    at = w * CORE - SIDE
    row = np.full(CORE + 2 * SIDE, PAD, np.int16)
    piece = char_ids(t[max(0, at):at + CORE + 2 * SIDE])
    row[max(0, -at):max(0, -at) + len(piece)] = piece
    return row


def joined(t: str, cores: dict[int, np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Base spans plus the checked spans of the labels, reconciled over the whole text."""
    found, open_kind, start, end = [], None, 0, -1
    for w in sorted(cores):
        for j in np.flatnonzero(cores[w]):
            at, label = w * CORE + int(j), int(cores[w][j])
            if at >= len(t):
                break
            kind = (label - 1) // 2
            if label % 2 == 0 and open_kind == kind and at == end:
                end = at + 1
                continue
            if open_kind is not None:
                found.append((start, open_kind, end))
            open_kind, start, end = kind, at, at + 1
    if open_kind is not None:
        found.append((start, open_kind, end))
    out, starts = list(base), sorted(x for x, _, _ in base)
    reach = list(accumulate((y for _, _, y in sorted(base)), max))     # the furthest end of the spans up to each start

    def taken(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and reach[i - 1] > a

    for a, k, b in found:
        s = t[a:b]
        a, b = a + len(s) - len(s.lstrip()), b - len(s) + len(s.rstrip())
        s = t[a:b]
        if s and _SIGN.search(s) and checked(k, s) and not taken(a, b):
            out.append((a, k, b))
    return sorted(out)


def find_spans(m: dict | None, texts: list[str], every: bool = False) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    if m is None:
        return [(b, b) for b in base]
    return [(b, joined(t, c, b)) for t, c, b in zip(texts, decode_cores(m, texts, every), base)]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: dict | None = None, doc_id: str = "doc_id", text: str = "text",
             sample: int = 1500) -> DataFrame:
    """One row per document: base counts, the digest of base spans and all spans (code points, end exclusive)."""
    model = model or fit_from(docs, doc_id, text, sample)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[doc_id].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)

    def run(b: pa.RecordBatch):
        found = find_spans(sent.value, texts_of(b.column("_text")))
        yield {"doc_id": b.column("doc_id"),
               "base_sha256": [hashlib.sha256(digest(x).encode()).hexdigest() for x, _ in found],
               "spans": [digest(x) for _, x in found]} | {
            f"n_{name}": [sum(s[1] == k for s in x) for x, _ in found] for k, name in enumerate(KINDS)}

    return map_arrow(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")], run,
                     f"doc_id {id_type}, {counts}, base_sha256 string, spans string")


def masked(t: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    parts, at = [], 0
    for a, k, b in spans:
        if a >= at:
            parts += [t[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(parts) + t[at:]


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: str | None = "n_chars",
             sample: int = 1500) -> DataFrame:
    """The same rows and columns with all spans masked; ``chars``, if there, follows the new text."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_from(docs, doc_id, text, sample))
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            raw = b.column(at).to_pylist()
            texts = [t or "" for t in raw]
            new = [masked(t, s) for t, (_, s) in zip(texts, find_spans(sent.value, texts))]
            cols = {f.name: b.column(i) for i, f in enumerate(b.schema)}
            cols[text] = pa.array([None if r is None else n for r, n in zip(raw, new)], b.schema.field(at).type)
            if chars in cols:
                cols[chars] = pa.array([c if r is None or n == r else len(n) for c, r, n in zip(
                    cols[chars].to_pylist(), raw, new)], b.schema.field(chars).type)
            yield batch_of(cols, b.schema)

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
