"""Operators 1, 5, 8, 9, 10 and the pipeline: brute force, round trips and the defined edge cases."""

import collections
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import ann, chat, jaccard, lm, packing
from rosterline.llm.eliasfano import EliasFano, Trie, mapped, quantised, to_bytes
from tests.llm.cases import SCHEMA, by_id, edge_docs, edge_rows, empty_docs, words

# --- 1 ---------------------------------------------------------------


def brute_classes(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(jaccard.shingles((t or "").encode()).tolist()), []).append(i)
    keys = [k for k in sets if k]
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] is not k:
            k = parent[k]
        return k

    links = collections.Counter()
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if len(a & b) >= 0.8 * len(a | b):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for k in keys:
        first[find(k)] = min([first.get(find(k), 1 << 60), *sets[k]])
    return {i: (first[find(k)], links[k]) for k in keys for i in sets[k]}


def near_copies(n, seed, length=80, edits=2):
    base = words(length, seed).split(" ")
    out = []
    for i in range(n):
        r = random.Random(seed * 1000 + i)
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(length)] = f"new{r.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("leaf,block", [(64, 4096), (8, 16)])
def test_similarity_classes_match_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    passage = words(60, 1234)
    texts = [words(90, 10_000 + i) + " " + passage for i in range(30)]
    for g, n in enumerate((2, 3, 70, 5)):
        texts += near_copies(n, g + 1)
    texts += [texts[0]] * 20 + ["a b", "a b", "c"]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {i: (r.class_id, r.n_links) for i, [r] in by_id(jaccard.similar_documents(docs)).items()}
    want = brute_classes(rows)
    assert sum(got[i] != want[i] for i in want) <= len(want) // 100  # the target recall
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for c, _ in got.values()}


def test_similarity_edges(spark):
    got = by_id(jaccard.similar_documents(edge_docs(spark)))
    assert [got[i][0].class_id for i in (1, 2, 3, 6, 7, 8)] == [1, 2, 3, 6, 6, 6]
    assert len(got[6]) == 2 and got[8][0].n_links == 1 and got[7][0].n_links == 1 and got[9][0].n_links == 0
    assert jaccard.similar_documents(empty_docs(spark)).count() == 0
    kept = sorted((r.doc_id or 0) for r in jaccard.drop_near_duplicates(edge_docs(spark)).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12]
    assert jaccard.expected_recall(0.8) > 0.9995


@pytest.mark.parametrize("listed", [0, 1 << 60])
@pytest.mark.parametrize("same", [False, True])
def test_common_values_by_lists_and_by_product(monkeypatch, listed, same):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "LISTED_ROW", 0)
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(-hi, hi, r.integers(0, 40))) for _ in range(n)] for n, hi in ((50, 60), (33, 90)))
    b = a if same else b
    got = jaccard.common(a, b, same)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert got[i, j] == len({*x.tolist()} & {*y.tolist()}) or same and i == j
    assert jaccard.common(a, [np.array([500 + i]) for i in range(4)]).sum() == 0
    assert jaccard.common([x[:0] for x in a], b).sum() == 0


def sketches(n, r, shared=4, own=20):
    return [{"n": int(np.exp(r.uniform(2, 8))), "nodes": np.array([7], np.int64), "node": 7, "sig": b"%d" % i,
             "picks": np.concatenate([np.arange(shared), r.integers(1 << 40, 1 << 60, own)])} for i in range(n)]


def test_a_group_that_shares_a_line_costs_about_what_it_holds():
    """3,000 sets with a line in common and nothing else; a product over all values took more than 10 seconds."""
    group = sketches(3000, np.random.default_rng(5))
    group[2000] = {**group[10], "n": group[10]["n"] + 1, "sig": b"copy"}
    began = time.process_time()
    ok = jaccard.candidates(group, group, True, 0.8)
    assert np.argwhere(ok).tolist() == [[10, 2000]]
    assert time.process_time() - began < 3


def test_blocks_of_large_nodes_hold_like_sizes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    r = random.Random(4)
    n = [1, 4, 5, 5, *(int(math.exp(r.uniform(0, 8))) for _ in range(300)), *[40] * 70]
    sig = [b"%04d" % i for i in range(len(n))]
    classes = spark.createDataFrame(list(zip(sig, n)), "sig binary, n int")
    members = spark.createDataFrame([(1, x, len(n)) for x in sig] + [(2, x, 16) for x in sig[:16]], "node bigint, sig binary, size bigint")
    rows = jaccard.in_blocks(members, classes, 0.8).collect()
    assert {(x["part_a"], x["part_b"], x["_own"]) for x in rows if x["node"] == 2} == {(0, 0, 0)}
    groups, met, size = {}, collections.Counter(), dict(zip(sig, n))
    for x in rows:
        if x["node"] == 1:
            groups.setdefault((x["part_a"], x["part_b"]), []).append({"sig": bytes(x["sig"]), **{k: x[k] for k in ("part_a", "part_b", "_own")}})
    for g in groups.values():
        a, b, same = jaccard.sides(g)
        assert max(len(a), len(b)) < 64
        met.update(frozenset((x["sig"], y["sig"])) for i, x in enumerate(a) for y in (b[i + 1:] if same else b))
    pairs = [frozenset((x, y)) for i, x in enumerate(sig) for y in sig[:i]]
    assert all(met[p] == 1 for p in pairs if min(map(size.get, p)) >= 0.8 * max(map(size.get, p)))
    assert max(met.values()) == 1 and len(met) < len(pairs) / 3


# --- 5 ---------------------------------------------------------------

def brute_nearest(ids, x, queries, k):
    out = {}
    for q in queries:
        s = [float(np.dot(x[j], x[q]) / (math.sqrt(np.dot(x[j], x[j])) * math.sqrt(np.dot(x[q], x[q])))) for j in range(len(x))]
        out[ids[q]] = sorted((-round(s[j], 12), ids[j]) for j in range(len(x)) if ids[j] != ids[q])[:k]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, _v int, _part int, rank int")


def test_nearest_recall_ties_and_edges(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[200:900] = x[200]  # one vector very often
    rows = [(i, [float(v) for v in r], 1, 2, 3) for i, r in enumerate(x)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [float("inf")] * 16), (None, [1.0] * 16),
           (5200, [None] + [1.0] * 15)]
    df = vectors(spark, rows + [(i, v, 1, 2, 3) for i, v in odd]).repartition(5)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.pmod("vec_id", F.lit(50)) == 0, per_part=100, block=128, sample=1000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(list(range(1500)), x.astype(float), range(0, 1500, 50), 5)
    assert set(got) == set(want)
    hit = 0
    for q, w in want.items():
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert got[q] == sorted(got[q], key=lambda t: (-t[2], t[1]))
        hit += len({v for _, v, _ in got[q]} & {v for _, v in w})
        for _, v, s in got[q]:
            assert math.isclose(s, float(np.dot(x[q].astype(float), x[v].astype(float)) / math.sqrt(
                np.dot(x[q].astype(float), x[q].astype(float)) * np.dot(x[v].astype(float), x[v].astype(float)))), abs_tol=1e-12)
    assert hit >= 0.9 * 5 * len(want)
    assert [v for _, v, _ in got[300]] == [200, 201, 202, 203, 204]


def test_nearest_of_few_rows(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 1, 1, 1), (50, [1.0, 1.0], 1, 1, 1), (3, [0.0, -2.0], 1, 1, 1), (50, [5.0, 5.0], 1, 1, 1)])
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df, F.pmod("vec_id", F.lit(50)) == 0).collect())
    # Every row but the query's own is a candidate: both rows of id 50, for each other as well.
    assert got == [(0, 1, 50), (0, 2, 50), (0, 3, 3), (50, 1, 50), (50, 1, 50), (50, 2, 0), (50, 2, 0), (50, 3, 3), (50, 3, 3)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


# --- 8 ---------------------------------------------------------------

def test_ids_are_those_of_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r[1] or "" for r in edge_rows() if len(r[1] or "") < 9000] + ["<|endoftext|> a", "a b\r\n\t  c 12345'll don't", "日本語 🎉é́"]
    for x, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert packing.tokenizer().encode_to_numpy(x).tolist() == e.ids


def test_added_tokens_have_their_own_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x  \n", "<|endoftext|", "x<|endoftext|>\n\n 12 <|endoftext|>don't", ""]
    want = {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in enumerate(texts)}
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in got} == {
        i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}


def test_cut_covers_every_length():
    for n in list(range(1, 5000)) + [2048 * 7]:
        parts = packing.cut(n)
        assert sum(parts) == n and max(parts) <= 2048
        assert sum(p < 64 for p in parts) <= (n % 2048 < 64)


def check_packing(rows, docs_rows):
    enc = packing.tokenizer()
    ids = collections.defaultdict(list)
    for i, t in docs_rows:
        ids[i].append(enc.encode_to_numpy(t or "").tolist() + [1])
    seqs = collections.defaultdict(list)
    seen = collections.Counter()
    for r in rows:
        ok = [d for d in ids[r.doc_id] if len(d) == r.doc_tokens and r.ids_crc32 == zlib.crc32(
            np.asarray(d[r.start:r.start + r.length], "<u4").tobytes()) and r.start + r.length <= len(d)]
        assert ok, r
        seen[r.doc_id] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: sum(map(len, d)) for i, d in ids.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(seen.values())
    return total, len(seqs) * 2048 - total


def test_packing_round_trip(spark):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(1000 + i, words(random.Random(i).randrange(1, 900), i)) for i in range(150)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id bigint, text string, length int, _rank string").repartition(6)
    total, waste = check_packing(packing.pack(docs).collect(), rows)
    assert waste < 0.02 * total + 2048
    assert packing.pack(empty_docs(spark)).count() == 0


# --- 9 ---------------------------------------------------------------

def test_elias_fano():
    r = np.random.default_rng(0)
    for n, u in ((1, 1), (5, 100), (1000, 10**6), (3000, 3000), (0, 10), (500, 2**40)):
        v = np.sort(r.integers(0, u, n))
        e = EliasFano(mapped(to_bytes(EliasFano.build(v, u))))
        assert (e.get(np.arange(n)) == v).all()
        if n:
            q, lo = r.integers(0, u, 500), r.integers(0, n + 1, 500)
            hi = np.maximum(lo, r.integers(0, n + 1, 500))
            assert (e.successor(q, lo, hi) == [a + np.searchsorted(v[a:b], x) for x, a, b in zip(q, lo, hi)]).all()


def test_trie_sums_to_one_and_matches_the_formula():
    r = np.random.default_rng(1)
    k = 12
    seq = r.integers(0, k, 4000) * r.integers(0, 2, 4000)
    name = r.integers(-2 ** 62, 2 ** 62, k)          # words are hashes
    none = np.iinfo(np.int64).min
    one = np.bincount(seq, minlength=k)
    two, three = collections.Counter(zip(seq, seq[1:])), collections.Counter(zip(seq, seq[1:], seq[2:]))
    t = np.array(sorted(three))
    words = [name[t[:, 2]], name[t[:, 1]], name[t[:, 0]]]
    words = [np.append(w, [name[seq[0]], none][min(i, 1)]) for i, w in enumerate(words)]   # a row without a second word
    words[1][-1] = name[3]
    n = np.append([three[tuple(x)] for x in t], 5)
    arrays = Trie.build(words, n, [0.6, 0.7], none)
    trie = Trie(mapped(to_bytes(arrays)))
    count2 = collections.Counter()
    for (u, v, w), c in three.items():
        count2[v, w] += c
    count2[3, seq[0]] += 5
    total2 = collections.Counter()
    for (v, w), c in count2.items():
        total2[v] += c
    low = (one + 1) / (len(seq) + k)
    for h in ([0, 0], [3, 5], [-1, 4], [-1, -1], [11, 11]):
        at = [name] + [np.full(k, name[x] if x >= 0 else none) for x in h[::-1]]
        share, gamma = trie.search(at)
        p = share + gamma * low
        assert math.isclose(p.sum(), 1, abs_tol=1e-6)
        two_ = {w: max(count2[h[1], w] - 0.6, 0) / max(1, total2[h[1]]) for w in range(k)} if h[1] >= 0 else {}
        rest = 1 - sum(two_.values())
        want = np.array([two_.get(w, 0) + rest * low[w] for w in range(k)])
        total = sum(three[(*h, w)] for w in range(k))
        if h[0] >= 0 and total:
            three_ = {w: max(three[(*h, w)] - 0.7, 0) / total for w in range(k)}
            want = np.array([three_[w] + (1 - sum(three_.values())) * want[w] for w in range(k)])
        assert np.allclose(p, want, rtol=1e-6)


def test_quantised_probabilities():
    r = np.random.default_rng(4)
    few, many = r.integers(1, 50, 10_000) / 97, r.random(300_000) ** 6
    for share, err in ((few, 0), (many, 2.0 ** -11)):
        book, code = quantised(share)
        got = book[code]
        assert len(book) <= 1 << 16 and (got <= share).all() and (share - got <= np.maximum(err * share, 2.0 ** -31)).all()


def test_tokens_of_slices():
    """Slices of a batch give the tokens of the whole batch."""
    import pyarrow as pa
    import xxhash

    texts = [words(30, i, 60) + " Çà été\u3000x" for i in range(40)] + [None, "", " \t a"]
    b = pa.RecordBatch.from_pydict({"_text": texts})
    got = []
    for part in lm.parts_of(b, 500):
        hashes, code, doc = lm.tokens_of(part.column("_text"))
        got += [hashes[code[doc == i]].tolist() for i in range(part.num_rows)]
    want = [[xxhash.xxh3_64_intdigest(w) for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(
        {j: j + 32 for j in range(65, 91)})) + [""]] for t in texts]
    assert [[x % 2**64 for x in g] for g in got] == want


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, order):
    rows = [(i, words(40, i % 37, 60) + (" X Ünï\x1cß" if i % 5 == 0 else "")) for i in range(200)] + [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, h int, uid int").repartition(4)
    got = by_id(lm.score_texts(docs, order=order))
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({j: j + 32 for j in range(65, 91)})) + [None]) for i, t in rows]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in tokens if not fold(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for i, ws in tokens:
        want[i].append((len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    better = 0
    for i, w in want.items():
        assert sorted((r.n_tokens, r.n_known) for r in got[i]) == sorted(x[:2] for x in w)
        assert np.allclose(sorted(r.base_score for r in got[i]), sorted(x[2] for x in w), rtol=1e-9)
        assert all(r.train_tokens == n and r.held_out == fold(i) and r.score < 0 for r in got[i])
        better += sum(r.score > r.base_score for r in got[i])
    assert better > 0.8 * len(rows)


@pytest.mark.parametrize("order,sample", [(1, 16), (2, 16), (3, 16), (4, 1), (3, 1)])
def test_scores_keep_every_ngram(spark, order, sample, monkeypatch):
    """Scores by brute force; rare n-grams count in 2.3 million tokens, too, and held-out text teaches nothing.

    With all texts looked through, ``a``, ``b`` and pairs of them are large contexts and are dealt over shards.
    """
    monkeypatch.setattr(lm, "SAMPLE", sample)
    found = []
    real = lm.large_contexts
    monkeypatch.setattr(lm, "large_contexts", lambda *a: found.append(real(*a)) or found[-1])
    rows = [(i, "a b " * 50_000 + ("q r a b s t" if i % 7 == 0 else "a c")) for i in range(32)]
    rows += [(100 + i, t) for i, t in enumerate(["q r a b s t", "q r a", "zz zz zz b", "", "b q r a b s", "a c q r", "s t"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = by_id(lm.score_texts(docs, order=order))
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tables, total = [collections.Counter() for _ in range(order + 1)], [collections.Counter() for _ in range(order + 1)]
    texts = {i: t.split() + [""] for i, t in rows}
    for i, ws in texts.items():
        if not fold(i):
            for o in range(1, order + 1):
                padded = [""] * (o > 1) + ws  # one end token stands before a text
                tables[o].update(zip(*[padded[k:] for k in range(o)]))
    for o in range(2, order + 1):
        for g, k in tables[o].items():
            total[o][g[:-1]] += k
    followers = [collections.Counter(g[:-1] for g in t) for t in tables]
    n, v = sum(tables[1].values()), len(tables[1])
    d = [0.0, 0.0]
    for t in tables[2:]:
        x, y = sum(k == 1 for k in t.values()), sum(k == 2 for k in t.values())
        d.append(x / (x + 2 * y) if x + y else 0.5)

    def p(g):
        o = len(g)
        if o == 1:
            return (tables[1][g] + 1) / (n + v + 1)
        t = total[o][g[:-1]]
        if not t:
            return p(g[1:])
        return (max(tables[o][g] - d[o], 0) + d[o] * followers[o][g[:-1]] * p(g[1:])) / t

    assert n > 2_000_000 and any(fold(i) for i in texts if i >= 100)
    assert sample > 1 or all(len(x) for x in found[0])
    for i, ws in texts.items():
        padded = [""] + ws
        grams = collections.Counter(tuple(padded[max(0, k - order + 1):k + 1]) for k in range(1, len(padded)))
        [r] = got[i]
        assert math.isclose(r.score, sum(k * math.log10(p(g)) for g, k in grams.items()), rel_tol=1e-6), i


def test_scores_store_no_ngrams_of_slices(spark, monkeypatch):
    """N-grams are derived from the slices in every turn, never stored with them, and each turn sends its own share of them once."""
    import pyarrow.parquet as pq

    docs = spark.createDataFrame([(i, words(400, i, 3000)) for i in range(60)], "doc_id bigint, text string").repartition(3)
    sent, stored = [], []
    requests, bucketed = lm.requests, lm.bucketed
    monkeypatch.setattr(lm, "requests", lambda *a: sent.append(requests(*a)) or sent[-1])
    monkeypatch.setattr(lm, "bucketed", lambda *a: stored.append(bucketed(*a)) or stored[-1])
    assert lm.score_texts(docs).count() == 60
    [texts] = stored
    assert len(sent) == lm.ROUNDS and texts.columns == ["slice", "doc_id", "train", "sizes", "names", "codes"]
    kept = sum(pq.read_metadata(f.removeprefix("file://").removeprefix("file:")).row_group(0).total_byte_size for f in texts.inputFiles())
    size = lambda df: sum(len(x) for r in df.collect() for a in r.asks for x in a)
    turns = [size(df) for df in sent]
    assert kept < sum(turns) / 2 and max(turns) < sum(turns) / 2
    n = collections.Counter()
    for df in sent:
        for r in df.collect():
            names, cols = lm.words_of_block(r.asks[0])
            n.update((r.slice, *(int(names[c]) for c in row)) for row in zip(*cols))
    assert n and set(n.values()) == {1}


def test_search_of_many_lists_positions_once(monkeypatch):
    """Searching all n-grams selects in the bit vectors by lists that are made once, in chunks, and finds what single searches find."""
    from rosterline.llm import eliasfano

    r = np.random.default_rng(5)
    cols = [x.astype(np.int64) for x in np.unique(r.zipf(1.3, (200_000, 3)) % 3000, axis=0).T]
    cols = [cols[2], cols[0], cols[1]]
    made = Trie.build(cols, np.arange(len(cols[0])) % 4 + 1, [0.5, 0.5], -1)
    picked = r.permutation(len(cols[0]))[:200]
    one = [Trie(mapped(to_bytes(made))).search([c[i:i + 1] for c in cols]) for i in picked]
    asked, real = [], eliasfano._select
    monkeypatch.setattr(eliasfano, "_select", lambda words, before, k, zeros: asked.append(len(k)) or real(words, before, k, zeros))
    share, gamma = Trie(mapped(to_bytes(made))).search(cols)
    assert len(cols[0]) > eliasfano.CHUNK and sum(asked) < len(cols[0]) / 10
    assert [(s[0], g[0]) for s, g in one] == list(zip(share[picked], gamma[picked]))


def test_distinct_values_rise():
    from rosterline.llm.common import rising

    for x in ([], [3], [2, 2, 1], [5, -1, 5, 0]):
        assert rising(np.array(x, np.int64)).tolist() == sorted(set(x))
    assert lm.among(np.array([4, 1, 9, 2]), np.array([1, 4])).tolist() == [True, True, False, False]
    assert lm.among(np.array([4]), np.array([], np.int64)).tolist() == [False]
    import pyarrow as pa

    assert lm.byte_strings(pa.array(["x", "a", "", "é\0"]).slice(1)) == [b"a", b"", "é\0".encode()]
    assert lm.byte_strings(pa.array([], pa.string())) == []


def test_blocks_of_words_are_read_back():
    r = np.random.default_rng(2)
    names = np.unique(r.integers(-2 ** 63, 2 ** 63 - 1, 5000))
    for n, width in ((0, 3), (1, 1), (3000, 1), (3000, 2), (3000, 3), (40, 4)):
        cols = [r.integers(0, 60, n) for _ in range(width)]
        one, of = lm.distinct(cols[1:] + cols[:1], 60)
        rows = [tuple(x) for x in np.array(cols).T]
        assert sorted({x[1:] + x[:1] for x in rows}) == [rows[i][1:] + rows[i][:1] for i in one]
        assert [rows[i] for i in one[of]] == rows
        long, back = lm.distinct(cols[1:] + cols[:1], 2 ** 62)     # too large for one number a row
        assert [rows[i] for i in long] == [rows[i] for i in one] and (back == of).all()
        got, places = lm.words_of_block(lm.words_block([c[one] * 80 for c in cols], names))
        assert all((got[p] == names[c[one] * 80]).all() for p, c in zip(places, cols))


def test_registered_scores_use_two_words_of_context(spark):
    docs = spark.createDataFrame([(i, f"a b {'c' if i % 2 else 'd'} b {'d' if i % 2 else 'c'}") for i in range(30)], "doc_id bigint, text string")
    scores = [{r.doc_id: r.score for r in df.collect()} for df in (
        lm.score_texts(docs), lm.score_texts(docs, order=3), lm.score_texts(docs, order=2))]
    assert scores[0] == scores[1] and all(abs(scores[0][i] - scores[2][i]) > 1e-6 for i in scores[2])


def test_scores_without_training_text(spark):
    assert lm.score_texts(empty_docs(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    [r] = lm.score_texts(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.held_out


# --- 10 ---------------------------------------------------------------

def test_calls_linked_ordered_and_validated(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "x"), (None, 0, None, "")],
                              "conv_id bigint, turn bigint, role string, text string")
    calls = spark.createDataFrame([
        (1, 0, "a", "lookup", '{"query": "q", "limit": 3}', None), (1, 1, "b", "lookup", '{"limit":"3","more":{"z":1,"a":[2, 1]},"query":"q"}', "a"),
        (1, 2, "c", "nothing", "{}", "b"), (1, 2, "d", "lookup", "{oops", "gone"), (1, 3, "d", "lookup", None, None),
        (2, 0, "x", "summarise", '{"text":"t","max_words":5}', "y"), (2, 1, "y", "summarise", '{"max_words":5}', "x"),
        (2, 2, "z", "summarise", '[1]', "y"), (None, 0, "n", "lookup", "{}", None)],
        "conv_id bigint, turn bigint, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 1, "a", "r1"), (1, 2, "a", "r2"), (1, 2, "b", "r3"), (1, 9, "lost", "r4"), (None, 1, "n", "r5")],
                                    "conv_id bigint, turn bigint, call_id string, content string")
    rows = chat.chat_records(m, calls, results, chat.tools_frame(spark)).collect()
    call = {(r.conv_id, r.call_id): r for r in rows if r.kind == 1}
    assert [(call[1, i].depth, call[1, i].mark, call[1, i].errors) for i in "abcd"] == [
        (0, None, ""), (1, None, "type:limit,unknown:more"), (2, "unanswered", "unknown_tool"),
        (0, "unknown_dependency", "invalid_json")]
    assert [(call[2, i].depth, call[2, i].mark, call[2, i].errors) for i in "xyz"] == [
        (None, "cycle", ""), (None, "cycle", "missing:text"), (None, "cycle", "invalid_json")]
    arguments = json.loads(call[1, "b"].json)["tool_calls"][0]["function"]["arguments"]
    assert arguments == '{"limit":"3","more":{"a":[2,1],"z":1},"query":"q"}'
    found = sorted((r.call_id, r.mark) for r in rows if r.kind == 2 and r.conv_id == 1)
    assert found == [("a", None), ("a", None), ("b", None), ("lost", "orphan")]
    for r in rows:
        parsed = json.loads(r.json)
        assert json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert sum(r.kind == 0 for r in rows) == 4


def test_no_call_is_lost(spark):
    calls = spark.createDataFrame([
        (1, 0, "a", "lookup", '{"query":"q","limit":3}', None), (1, 0, "a", "lookup", '{"query":"q","limit":3}', None),
        (1, 0, "a", "summarise", '{"text":"t","max_words":5}', None), (1, 4, "b", "lookup", '{"query":"r","limit":1}', "a"),
        (None, 0, "n", "lookup", "{}", None), (None, 1, "n", "lookup", "{}", None), (None, 1, "n", "lookup", "{}", None),
        (1, 5, None, "lookup", "{}", None), (1, 6, None, "summarise", "{}", None)],
        "conv_id bigint, turn bigint, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 1, "a", "r"), (1, 5, "b", "s")], "conv_id bigint, turn bigint, call_id string, content string")
    m = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    rows = chat.chat_records(m, calls, results, chat.tools_frame(spark)).collect()
    made = [(r.conv_id, r.turn, r.call_id, json.loads(r.json)["tool_calls"][0]["function"]["name"]) for r in rows if r.kind in (1, 3)]
    assert collections.Counter(made) == collections.Counter(tuple(r)[:4] for r in calls.collect())
    marks = collections.Counter((r.conv_id, r.call_id, r.kind, r.mark, r.depth, r.n_same) for r in rows if r.kind in (1, 3))
    assert marks == {(1, "a", 1, None, 0, 2): 1, (1, "a", 3, "duplicate", 0, 2): 2, (1, "b", 1, None, 1, 0): 1,
                     (None, "n", 1, "unanswered", 0, 0): 3, (1, None, 1, "unanswered", 0, 0): 2}
    assert [(r.call_id, r.mark, r.depth) for r in rows if r.kind == 2 and r.call_id == "a"] == [("a", None, 0)]


def test_rows_without_a_key_meet_in_no_join(spark):
    """Half of all rows have no conversation: they keep their rows, link to nothing, and spread over the tasks."""
    n = 4000
    null = F.when(F.col("id") % 2 == 0, F.col("id")).cast("bigint").alias("conv_id")
    m = spark.range(0, n, 1, 8).select(null, F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    calls = spark.range(0, n, 1, 8).select(null, F.lit(0).cast("bigint").alias("turn"), F.lit("c").alias("call_id"), F.lit("lookup").alias("name"),
                                           F.concat(F.lit('{"query":"'), "id", F.lit('","limit":1}')).alias("arguments"), F.lit(None).cast("string").alias("after"))
    results = spark.range(0, n, 1, 8).select(null, F.lit(1).cast("bigint").alias("turn"), F.lit("c").alias("call_id"), F.lit("r").alias("content"))
    out = chat.chat_records(m, calls, results, chat.tools_frame(spark))
    rows = collections.Counter((r.conv_id is None, r.kind, r.mark, r.depth) for r in out.collect())
    assert rows == {(False, 0, None, 0): n // 2, (True, 0, None, None): n // 2, (False, 1, None, 0): n // 2,
                    (True, 1, "unanswered", 0): n // 2, (False, 2, None, 0): n // 2, (True, 2, "orphan", None): n // 2}
    most = out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < n


def test_long_chains_and_empty_conversations(spark):
    calls = spark.range(300).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("c"), "id").alias("call_id"),
                                    F.lit("lookup").alias("name"), F.lit("{}").alias("arguments"),
                                    F.when(F.col("id") > 0, F.concat(F.lit("c"), (F.col("id") - 1).cast("string"))).alias("after"))
    got = {r.call_id: r.depth for r in chat.depths(calls).collect()}
    assert got == {f"c{i}": i for i in range(300)}
    m = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, depth int, errors string")
    assert chat.chat_records(m, *chat.derived_calls(m), chat.tools_frame(spark)).count() == 0


# --- pipeline ---------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    item = words(40, 4242)
    texts = {i: words(150, i) for i in range(60)} | {100: words(150, 3), 101: words(150, 4).replace(" ", "  "), 102: words(30, 1) + " " + item,
                                                      103: "123 456", 104: None, 105: words(30, 8) + " a.b@mail.example.com " + words(9, 8)}
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in texts.items()],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint, sig string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, left = docs.columns, []
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == columns
        left.append({r.doc_id for r in docs.collect()})
    assert left[0] == set(texts) - {103, 104}
    assert left[1] == left[0] - {100, 101} and left[2] == left[1] - {102} and left[3] == left[2]
    masked = {r.doc_id: r for r in docs.collect()}
    assert "[EMAIL]" in masked[105].text and masked[105].n_chars == len(masked[105].text) and masked[5].text == texts[5]
    rows = cp.run(spark, str(tmp_path)).collect()
    total, waste = check_packing(rows, [(i, r.text) for i, r in masked.items()])
    assert waste < 2048 + 0.03 * total and cp.ORACLE_SQL is None
