"""Operator 11: fill-in-the-middle transformation, cut at units found by word-parallel byte arithmetic.

The texts of a slice lie in one byte buffer, read as little-endian 64-bit words.
Arithmetic on whole words marks the top bit of every byte that ends a unit (a
line feed, or the last byte of a code point), ``bitwise_count`` counts the marks
of each word and a running sum makes them ranks.  The end of the k-th unit of any
text is then one binary search for its word and one multiplication that selects
the mark inside the word: no byte is looked at by itself, and all texts of a
slice are cut at once.  The same ranks over continuation bytes turn byte lengths
into code points.

Two hashes of the seed and the id choose the cuts, two more the form:
``plain`` (the text as it is), ``psm`` or ``spm``.  ``restored`` gives the exact
text back with DataFrame functions.

One pass, no shuffle.  Slices hold ``SLICE`` bytes of text or one longer text;
temporaries are about six times that.

Defined cases: a null text is empty; an empty text, and one that holds a
sentinel, is plain; a null id is hashed as the empty string; a text that does not
end in a line feed ends in a unit without one; repeated rows give repeated,
equal results; an empty table gives no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.llm.common import map_arrow, runs_of

__all__ = ["transform", "restored", "Marks", "line_ends", "char_ends", "ORACLE"]

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE, SLICE = 7, 100, 50, 4 << 20

_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
#: Bits of the bytes below the i-th of a word.
_BELOW = np.array([(1 << (8 * i)) - 1 for i in range(8)], np.uint64)


def line_ends(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte equal to a line feed (exact: nothing carries from byte to byte)."""
    x = words ^ (_ONES * np.uint64(10))
    return ~(((x & _LOW7) + _LOW7) | x | _LOW7)


def continuations(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte ``10xxxxxx``."""
    return words & ~(words << np.uint64(1)) & _HIGH


def char_ends(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte whose successor starts a code point."""
    starts = ~continuations(words) & _HIGH
    after = np.append(starts[1:], _HIGH)
    return (starts >> np.uint64(8)) | (after << np.uint64(56))


UNITS = {"line": line_ends, "char": char_ends}


class Marks:
    """Ranks and selection over the marked bytes of a buffer of words."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word = at >> 3
        return self.before[word] + np.bitwise_count(self.marks[word] & _BELOW[at & 7])

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th marked byte, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        need = (k - self.before[word] + 1).astype(np.uint64)
        upto = (self.marks[word] >> np.uint64(7)) * _ONES          # byte i: marks of bytes 0 to i
        reached = ((upto | _HIGH) - need * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached).astype(np.int64)


def cut(offsets: np.ndarray, units: Marks, h1: np.ndarray, h2: np.ndarray):
    """(n units, end of prefix, end of middle) of the texts between ``offsets``; positions in the buffer."""
    start, end = offsets[:-1], offsets[1:]
    first = units.rank(start)
    marked = units.rank(end) - first
    tail = (end > start) & (units.rank(np.maximum(end - 1, start)) - first == marked)   # the last byte ends no unit
    n = marked + tail
    a, b = h1 % (n + 1), h2 % (n + 1)

    def position(k):
        inside = (k > 0) & (k <= marked)
        at = units.select(np.where(inside, first + k - 1, 0)) + 1 if inside.any() else start
        return np.where(k == 0, start, np.where(inside, at, end))

    return n, position(np.minimum(a, b)), position(np.maximum(a, b))


def _hashes(key: str, seed: int) -> np.ndarray:
    return np.frombuffer(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16], ">u4")


def _batches(unit: str, sentinels: tuple, seed: int, rate: int, spm_rate: int):
    marker = UNITS[unit]
    pattern = "|".join(re.escape(s) for s in sentinels)
    p, s, m = (x.encode() for x in sentinels)

    def run(b: pa.RecordBatch):
        texts = pc.fill_null(b.column("_text"), "").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy()
        held = pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
        keys = b.column("_key").to_pylist()
        for part in runs_of(sizes.tolist(), SLICE):
            offsets = np.concatenate([[0], np.cumsum(sizes[part])]).astype(np.int64)
            chunk = texts.slice(part.start, part.stop - part.start)
            at = int(np.frombuffer(chunk.buffers()[1], np.int64, 1, chunk.offset * 8)[0])
            raw = memoryview(chunk.buffers()[2] or b"")[at:at + int(offsets[-1])]
            words = np.zeros(len(raw) // 8 + 1, "<u8")
            words.view(np.uint8)[:len(raw)] = np.frombuffer(raw, np.uint8)
            h = np.array([_hashes(k, seed) for k in keys[part]]).astype(np.int64).reshape(-1, 4)
            n, lo, hi = cut(offsets, Marks(marker(words)), h[:, 0], h[:, 1])
            inner = Marks(continuations(words))
            start, end = offsets[:-1], offsets[1:]
            plain = (start == end) | held[part] | (h[:, 2] % 100 >= rate)
            spm = h[:, 3] % 100 < spm_rate
            chars = [y - x - (inner.rank(y) - inner.rank(x)) for x, y in ((start, lo), (lo, hi))]
            out, form = [], []
            for i in range(len(n)):
                pre, mid, suf = raw[start[i]:lo[i]], raw[lo[i]:hi[i]], raw[hi[i]:end[i]]
                if plain[i]:
                    form.append("plain")
                    out.append(bytes(raw[start[i]:end[i]]))
                elif spm[i]:
                    form.append("spm")
                    out.append(b"".join((s, suf, p, pre, m, mid)))
                else:
                    form.append("psm")
                    out.append(b"".join((p, pre, s, suf, m, mid)))
            yield {"doc_id": b.column("_id").slice(part.start, part.stop - part.start), "n": n, "form": form,
                   "prefix_chars": pa.array(chars[0], mask=plain), "middle_chars": pa.array(chars[1], mask=plain),
                   "output": pa.array(out, pa.large_binary()).cast(pa.large_string())}

    return run


def check_sentinels(sentinels: tuple) -> None:
    """Raises unless a sentinel can be found again wherever it stands next to a text that holds none."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    for x in sentinels:
        for y in sentinels:
            if any(x.endswith(y[:i]) for i in range(1, len(y))) or (x != y and y in x):
                raise ValueError(f"sentinels {x!r} and {y!r} overlap")


def transform(docs: DataFrame, unit: str = "line", doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
              rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: tuple = SENTINELS) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output.

    ``unit`` is ``line`` or ``char``; ``rate`` percent of the documents are cut and ``spm_rate`` percent of
    those put the suffix first, chosen by a hash of ``seed`` and id.
    """
    check_sentinels(sentinels)
    kind = docs.schema[doc_id].dataType.simpleString()
    cols = [F.col(doc_id).alias("_id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_key"),
            F.col(text).alias("_text")]
    return map_arrow(docs, cols, _batches(unit, sentinels, seed, rate, spm_rate),
                     f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str = "output", form: str = "form", sentinels: tuple = SENTINELS) -> Column:
    """The exact text that ``transform`` was given; splits at the sentinels, which a cut text does not hold."""
    parts = F.split(F.col(output), "|".join(f"\\Q{s}\\E" for s in sentinels), -1)
    return (F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col(output)))


ORACLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
  CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
k AS (SELECT *, CAST(len(l) AS BIGINT) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS lo,
  greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, coalesce(array_to_string(l[1:lo], ''), '') AS p, coalesce(array_to_string(l[lo + 1:hi], ''), '') AS m,
  coalesce(array_to_string(l[hi + 1:n], ''), '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""
