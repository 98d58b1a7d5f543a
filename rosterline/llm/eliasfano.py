"""Elias-Fano sequences and the n-gram trie of operator 9, over flat numpy arrays viewed in place."""

from __future__ import annotations

import io

import numpy as np

from rosterline.llm.common import mix64, rising

__all__ = ["EliasFano", "Children", "Trie", "context_hash", "quantised", "to_bytes", "mapped"]


#: N-grams that are searched at a time, so that what is made on the way stays in the processor's cache.
CHUNK = 1 << 15


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Position of the k-th (from 0) one, or zero, of a bit vector; ``before`` counts them before each word."""
    w = np.searchsorted(before, k, side="right") - 1
    rest = k - before[w]
    x = words[w]
    if zeros:
        x = ~x
    at = np.zeros(len(k), np.int64)
    for half in (32, 16, 8, 4, 2, 1):  # halve the word by its number of ones
        low = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        up = rest >= low
        rest = np.where(up, rest - low, rest)
        x = np.where(up, x >> np.uint64(half), x)
        at += np.where(up, half, 0)
    return w * 64 + at


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``: low bits packed, high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["head"])
        self.low, self.high = arrays["low"], arrays["high"]
        self.ones, self.zeros = arrays["ones"], arrays["zeros"]
        self.asked, self.listed = [0, 0], [None, None]

    def _at(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """``_select`` in the high bits; after many questions the positions of all ones, or zeros, are listed, word after word."""
        self.asked[zeros] += len(k)
        if 4 * self.asked[zeros] <= len(self.high):
            return _select(self.high, self.zeros if zeros else self.ones, k, zeros)
        if self.listed[zeros] is None:
            flags = np.unpackbits((~self.high if zeros else self.high).view(np.uint8), bitorder="little").view(bool)
            self.listed[zeros] = np.flatnonzero(flags).astype(np.int32 if len(flags) < 2 ** 31 else np.int64)
        return self.listed[zeros][k].astype(np.int64)

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(np.log2(max(1, universe) / max(1, n))))
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            part = v & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.diff(w, prepend=-1))      # of each word
            low[w[first]] = np.bitwise_or.reduceat(part << s, first) if n else 0
            over = np.flatnonzero(s + np.uint64(bits) > 64)     # at most the last of each word
            low[w[over] + 1] |= part[over] >> (np.uint64(64) - s[over])
        flags = np.zeros((n + (universe >> bits) + 2 + 63) // 64 * 64, np.uint8)
        flags[(v >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)[:-1]])
        return {"head": np.array([n, bits]), "low": low, "high": high, "ones": ones,
                "zeros": np.arange(len(high)) * 64 - ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        w, s = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        more = self.low[w + 1] << np.uint64(1) << (np.uint64(63) - s)   # none if s is 0
        return (self.low[w] >> s | more) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        high = self._at(i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.bits) | self._low(i)).astype(np.int64)

    def successor(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of the first element >= v within [lo, hi); hi if there is none."""
        return self._search(v, lo, hi)[0]

    def find(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Index of an element equal to v within [lo, hi), by the search for its successor; -1 if there is none."""
        i, last = self._search(v, lo, hi)
        # Below ``last``, an element has the high part of v.
        inside = np.flatnonzero(i < last)
        same = inside[self._low(i[inside]) == (np.asarray(v, np.int64)[inside] & ((1 << self.bits) - 1)).astype(np.uint64)]
        out = np.full(len(i), -1)
        out[same] = i[same]
        return out

    def _search(self, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(successor of v within [lo, hi); end of the elements there that have its high part)."""
        v = np.asarray(v, np.int64)
        top = v >> self.bits
        # Elements whose high part is that of v lie between two zeros of the unary part.
        first = np.where(top > 0, self._at(np.maximum(top - 1, 0), True) - top + 1, 0)
        last = self._at(top, True) - top
        a, b = np.clip(first, lo, hi), np.clip(last, lo, hi)
        open_ = np.flatnonzero(a < b)
        x, y, low = a[open_], b[open_], (v[open_] & ((1 << self.bits) - 1)).astype(np.uint64)
        while len(open_):
            mid = (x + y) >> 1
            less = self._low(mid) < low
            x, y = np.where(less, mid + 1, x), np.where(less, y, mid)
            a[open_] = x
            more = np.flatnonzero(x < y)
            open_, x, y, low = open_[more], x[more], y[more], low[more]
        return a, b


def _runs(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each run of equal neighbours; run of each item)."""
    new = np.ones(len(cols[0]), bool)
    for i, c in enumerate(cols):
        new[1:] = c[1:] != c[:-1] if i == 0 else new[1:] | (c[1:] != c[:-1])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, rising, and the place of each item's; items in order are not sorted again."""
    if (x[1:] < x[:-1]).any():
        by = np.argsort(x)
        first, run = _runs(x[by])
        of = np.empty(len(x), np.int64)
        of[by] = run
        return x[by[first]], of
    first, of = _runs(x)
    return x[first], of


class Children:
    """The children of one level: for every parent a rising run of ``parent * size + word``, found through its pointer."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str, size: int):
        part = lambda p: {k.removeprefix(p): v for k, v in arrays.items() if k.startswith(p)}
        self.pointers, self.values, self.size = EliasFano(part(prefix + "ptr.")), EliasFano(part(prefix + "val.")), size

    @staticmethod
    def build(values: np.ndarray, parents: int, size: int, prefix: str) -> dict[str, np.ndarray]:
        start = np.searchsorted(values, np.arange(parents + 1) * size)
        return ({f"{prefix}ptr.{k}": v for k, v in EliasFano.build(start, len(values) + 1).items()}
                | {f"{prefix}val.{k}": v for k, v in EliasFano.build(values, max(1, parents * size)).items()})

    def find(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index of child ``word`` of parent ``at``, searched among that parent's children only; -1 if it is not there."""
        out = np.full(len(at), -1)
        live = np.flatnonzero((at >= 0) & (word >= 0))
        if not len(live) or not self.values.n:
            return out
        a, w = at[live], word[live]
        new, of = _runs(a, w)   # equal neighbours are looked up once, and so are the pointers of a parent
        a, w = a[new], w[new]
        parent, back = _runs(a)
        parent = a[parent]
        end, begin = self.pointers.get(parent + 1), np.empty(len(parent), np.int64)
        after = np.flatnonzero(parent[1:] == parent[:-1] + 1) + 1   # begins where the one before ends
        begin[after] = end[after - 1]
        other = np.ones(len(parent), bool)
        other[after] = False
        begin[other] = self.pointers.get(parent[other])
        lo, hi = begin[back], end[back]
        found = np.full(len(a), -1)
        one, more = np.flatnonzero(lo + 1 == hi), np.flatnonzero(lo + 1 < hi)
        same = one[self.values.get(lo[one]) == a[one] * self.size + w[one]]    # an only child
        found[same] = lo[same]
        found[more] = self.values.find(a[more] * self.size + w[more], lo[more], hi[more])
        out[live] = found[of]
        return out


def quantised(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codebook of at most 2**16 values, 16-bit code of each share).

    Shares are ratios of small counts, so a level's distinct values often fit as they are; otherwise their
    mantissas are cut to as many bits as do, rounding down, so that shares still sum to at most one.
    """
    for bits in (52, 24, 20, 18, 16, 15, 14, 13, 12, 11):
        cut = (share.view(np.int64) >> (52 - bits) << (52 - bits)).view(np.float64)
        book = rising(np.where(cut < 2.0 ** -31, 0, cut))
        if len(book) <= 1 << 16:
            break
    if not len(share):
        return np.zeros(1), np.empty(0, np.uint16)
    return book, (np.searchsorted(book, np.where(cut < 2.0 ** -31, 0, cut))).astype(np.uint16)


class Trie:
    """N-grams in a trie of contexts, nearest word first; every context has its successors.

    Level j (1 to order - 1) holds the contexts of j words, the children of their first j - 1; under each
    context lie the words seen after it, with the quantised discounted probability they take there, and
    ``gamma`` is what the context leaves to the next shorter one.  So p = share + gamma * p(shorter) sums to
    one over the words after any context.  Words are 64-bit hashes; ``names`` are those of this trie.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.names, self.order = arrays["names"], int(arrays["order"][0])
        size = max(1, len(self.names))
        self.contexts = [Children(arrays, f"c{j}.", size) for j in range(1, self.order)]
        self.words = [Children(arrays, f"w{j}.", size) for j in range(1, self.order)]
        self.codes = [arrays[f"code{j}"] for j in range(1, self.order)]
        self.books = [arrays[f"book{j}"] for j in range(1, self.order)]
        self.gamma = [arrays[f"gamma{j}"] for j in range(1, self.order)]

    @staticmethod
    def build(words: list[np.ndarray], n: np.ndarray, discounts: list[float], none: int, passed=None) -> dict[str, np.ndarray]:
        """``words``: the last word of each n-gram, then those before it, nearest first (``none``: no further word);
        ``n``: their counts.  ``passed(level, contexts)`` marks contexts that only lead to longer ones here."""
        names = np.unique(np.concatenate(words))
        names = names[names != none]
        return Trie.build_numbered(names, [np.where(w == none, -1, np.searchsorted(names, w)) for w in words], n, discounts, passed)

    @staticmethod
    def build_numbered(names: np.ndarray, at: list[np.ndarray], n: np.ndarray, discounts: list[float], passed=None) -> dict[str, np.ndarray]:
        """``build`` from the distinct names, rising, and the words as numbers among them (-1: no further word)."""
        size = max(1, len(names))
        out = {"names": names, "order": np.array([len(at)])}
        node, live, parents = np.zeros(len(n), np.int64), np.arange(len(n)), 1
        hashed = np.zeros(1, np.uint64)
        for j, d in enumerate(discounts, 1):
            live = live[at[j][live] >= 0]
            values, of = _distinct(node[live] * size + at[j][live])
            node[live] = of
            out |= Children.build(values, parents, size, f"c{j}.")
            parents = len(values)
            hashed = context_hash(hashed[values // size], names[values % size], j)
            lead = passed(j, hashed) if passed is not None and parents else np.zeros(parents, bool)
            own = live[~lead[node[live]]]
            pairs, of = _distinct(node[own] * size + at[0][own])
            count = np.bincount(of, n[own], len(pairs))
            context = pairs // size
            total = np.bincount(context, count, parents)
            book, codes = quantised(np.maximum(count - d, 0) / np.maximum(total[context], 1))
            out |= Children.build(pairs, parents, size, f"w{j}.") | {f"code{j}": codes, f"book{j}": book, f"gamma{j}": np.where(
                lead, 1.0, 1 - np.bincount(context, book[codes], parents)).astype(np.float32)}
        return out

    def number(self, word: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(word), -1)
        i = np.minimum(np.searchsorted(self.names, word), len(self.names) - 1)
        return np.where(self.names[i] == word, i, -1)

    def search(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(share, gamma) of each n-gram, words as for ``build``: its probability is share + gamma * p(last word)."""
        return self.search_numbered([self.number(w) for w in words])

    def search_numbered(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """``search`` for words that ``number`` has numbered, ``CHUNK`` n-grams at a time."""
        if len(words[0]) > CHUNK:
            parts = [self.search_numbered([w[a:a + CHUNK] for w in words]) for a in range(0, len(words[0]), CHUNK)]
            return np.concatenate([s for s, _ in parts]), np.concatenate([g for _, g in parts])
        last = words[0]
        share, gamma = np.zeros(len(last)), np.ones(len(last))
        at = np.zeros(len(last), np.int64)
        for j in range(1, self.order):
            at = self.contexts[j - 1].find(at, words[j])
            live = np.flatnonzero(at >= 0)
            if not len(live):
                break
            g = self.gamma[j - 1][at[live]].astype(np.float64)
            i = self.words[j - 1].find(at[live], last[live])
            here = np.where(i >= 0, self.books[j - 1][self.codes[j - 1][np.maximum(i, 0)]], 0) if len(self.codes[j - 1]) else 0.0
            share[live] = here + g * share[live]
            gamma[live] *= g
        return share, gamma


def context_hash(before: np.ndarray, word: np.ndarray, level: int) -> np.ndarray:
    """64-bit name of a context: that of its nearer words, and the next word."""
    return mix64(before ^ mix64(word.view(np.uint64), 1), level)


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Uncompressed, so that the levels can be mapped in place."""
    out = io.BytesIO()
    names = sorted(arrays)
    head = "\n".join(f"{n}|{arrays[n].dtype.str}|{','.join(map(str, arrays[n].shape))}" for n in names).encode()
    out.write(len(head).to_bytes(8, "little") + head)
    for n in names:
        out.write(b"\0" * (-out.tell() % 8) + arrays[n].tobytes())
    return out.getvalue()


def mapped(blob) -> dict[str, np.ndarray]:
    """The arrays as views into the bytes, which may be a record batch's own memory: nothing is copied."""
    flat = np.frombuffer(blob, np.uint8)
    n = int.from_bytes(flat[:8].tobytes(), "little")
    at, out = 8 + n, {}
    for line in flat[8:8 + n].tobytes().decode().split("\n"):
        name, kind, shape = line.split("|")
        at += -at % 8
        dims = tuple(int(x) for x in shape.split(",") if x)
        size = int(np.prod(dims)) * np.dtype(kind).itemsize
        part = flat[at:at + size]
        out[name] = (part if part.ctypes.data % 8 == 0 else part.copy()).view(kind).reshape(dims)
        at += size
    return out
