"""Fill-in-middle, archive and manifest against plain versions of the same rules."""

import gzip
import hashlib
import os
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterline.llm import fim, merkle, warc
from tests.llm.cases import SCHEMA, edge_docs, edge_rows, empty_docs

# --- fill in the middle -------------------------------------------------------


def cut_of(doc_id, text, unit, rate=100, spm=50, seed=7):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t) if unit == "line" else list(t)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, t
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def tricky_texts():
    r = random.Random(5)
    out = [None, "", "\n", "\n\n\n", "a", "no line end", "a\n", "a\nb", "é\né\U0001F600\n", "<P>", "x <M> y\nz", "\r\n\x0b\x8a\n",
           "\n" * 5000, "x" * 70_000, "Ċਊ\nഊ"]
    for n in (1, 7, 8, 9, 63, 64, 65, 3000):
        out.append("".join(r.choice("ab\nĉ上\U0001F600<P>") for _ in range(n)))
    return out


@pytest.mark.parametrize("unit", ["line", "char"])
@pytest.mark.parametrize("rate,spm", [(100, 50), (60, 20)])
def test_cuts(spark, unit, rate, spm, monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 5000)
    rows = [(i, t) for k, t in enumerate(tricky_texts()) for i in (k, k + 1000)] + [(None, "of no\nid"), (3, "\n\n\n"), (3, "\n\n\n")]
    got = fim.transform(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), unit, rate=rate, spm_rate=spm)
    got = got.withColumn("back", fim.restored()).collect()
    want = sorted(((i, *cut_of(i, t, unit, rate, spm), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_fim_edges(spark):
    got = fim.transform(edge_docs(spark)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        ((r[0], *cut_of(r[0], r[1], "line")) for r in edge_rows()), key=repr)
    assert fim.transform(empty_docs(spark)).count() == 0


def test_marks():
    r = random.Random(1)
    raw = bytes(r.choice(b"\n\x0b\x8a\x09\x00a") for _ in range(1000))
    words = np.frombuffer(raw, "<u8")
    m = fim.Marks(fim.line_ends(words))
    at = [i for i, b in enumerate(raw) if b == 10]
    assert m.select(np.arange(len(at))).tolist() == at
    assert m.rank(np.arange(1001)).tolist() == [raw[:i].count(10) for i in range(1001)]


def test_sentinels_that_overlap_raise(spark):
    for bad in (("<P>", "<P>x", "<M>"), ("ab", "ba", "c"), ("<P>", "<P>", "<M>"), ("<P>", "", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(empty_docs(spark), sentinels=bad)
    one = spark.createDataFrame([(1, "a|\n$b\nc\n")], "doc_id bigint, text string")
    back = fim.transform(one, sentinels=("|p$", "|s$", "|m$")).select(fim.restored(sentinels=("|p$", "|s$", "|m$"))).first()[0]
    assert back == "a|\n$b\nc\n"


# --- archive ------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, digest string, payload int, copies int, _salt int"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", 1, 2, 3) for i, u, h in rows], PAGES).repartition(3)


def read_back(spark, rows, **kw):
    path = warc.write_archive(pages_of(spark, rows), **kw)
    return path, warc.parse(warc.read_records(spark, path)).collect()


def archive_rows():
    big, other = "é" * 600, "y" * 1000
    return [(1, "http://a", big), (2, "http://b", big), (5, None, big), (5, "http://again", big), (3, "http://c", "x" * 999),
            (4, "http://d", "x" * 999), (6, "http://e\r\nX: 1", other), (None, "http://n", other), (7, "http://f", None),
            (8, "http://g", ""), (9, "http://h", "WARC/1.1\r\nWARC-Type: revisit\r\n\r\n" + "z" * 2000), (10, "http://i", "\r\n\r\n" * 400),
            (None, "http://m", "w" * 1500), (None, "http://o", "w" * 1500)]


def test_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "MOST", 2)   # digests of more than two pages are salted
    rows = archive_rows()
    path, got = read_back(spark, rows)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "")]
        top = max((j for j in same if j is not None), default=None)
        revisit = len(raw) >= 1000 and i != top
        want.append((i, u and u.replace("\r", "%0D").replace("\n", "%0A"), len(raw), hashlib.sha1(raw).hexdigest(),
                     "revisit" if revisit else "response", top if revisit else None, raw))
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
                   for r in got), key=repr) == sorted(want, key=repr)
    stored = spark.read.parquet(os.path.join(path, "payloads"))
    assert stored.count() == len({h or "" for _, _, h in rows})      # every payload once


def records_of(raw):
    """Records of a WARC file by their lengths."""
    out = []
    while raw:
        head, rest = raw.split(b"\r\n\r\n", 1)
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[n:n + 4] == b"\r\n\r\n"
        out.append((head, rest[:n]))
        raw = rest[n + 4:]
    return out


def test_warc_files(spark):
    path, _ = read_back(spark, archive_rows())
    target = os.path.join(tempfile.mkdtemp(prefix="rl-warc-"), "files")
    warc.write_warc_files(spark, path, target)
    got = [r for f in os.listdir(target) if f.endswith(".gz") for r in records_of(gzip.open(os.path.join(target, f)).read())]
    assert len(got) == len(archive_rows())
    for head, block in got:
        http, payload = block.split(b"\r\n\r\n", 1)
        if b"WARC-Type: response" in head:
            assert f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}".encode() in head
        else:
            assert payload == b"" and b"WARC-Refers-To: <urn:page:" in head


def test_archive_detects_damage(spark):
    path, _ = read_back(spark, archive_rows())
    broken = os.path.join(tempfile.mkdtemp(prefix="rl-warc-"), "broken")
    spark.read.parquet(os.path.join(path, "records")).write.parquet(os.path.join(broken, "records"))
    spark.read.parquet(os.path.join(path, "payloads")).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(
        os.path.join(broken, "payloads"))
    with pytest.raises(Exception, match="do not give their digest"):
        warc.parse(warc.read_records(spark, broken)).collect()


def test_archive_empty(spark):
    assert read_back(spark, [])[1] == []


# --- manifest -----------------------------------------------------------------

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row, lower=False):
    i, text, lang, source, n = row
    if lower and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def manifest_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]])
    top = tree_of([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for p, r in enumerate(groups[g]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur, proof = leaf_of(r, bad), ""
            for levels, at in ((trees[g], p), (top, t)):
                for level in levels[:-1]:
                    run = level[at // 16 * 16:at // 16 * 16 + 16]
                    left, right = "".join(run[:at % 16]), "".join(run[at % 16 + 1:])
                    cur, proof, at = sha(left + cur + right), proof + left + right, at // 16
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, proof, cur, cur == root, sha(proof)))
    return sorted(out, key=repr)


def verified(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows],
                               "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, pos int").repartition(3)
    return sorted((tuple(r) for r in merkle.verify(df).select(
        "doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified", "proof_sha256").collect()), key=repr)


def test_manifest(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SPAN", 32)      # nodes above 32 leaves are salted
    monkeypatch.setattr(merkle, "ROWS", 50)
    r = random.Random(3)
    rows = [(i, f"Text {r.random()} É", "en", "hot", 5) for i in range(700)]
    rows += [(1000 + i, None if i % 7 == 0 else "lower", None if i % 3 else "fr", f"s{i % 40}", i) for i in range(300)]
    rows += [(None, "no id", "en", None, 1), (None, "no id", "en", None, 1), (7, "SAME", "en", "one", None), (8, "", "en", "é", 0)]
    rows += [(9, "Again", "en", "twice", 1)] * 20
    rows += [(5000 + i, "Lone", "en", f"lone{i}", 1) for i in range(30)]
    want = manifest_of(rows)
    got = verified(spark, rows)
    assert got == want
    assert {x[6] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_manifest_of_one_group(spark, n):
    rows = [(i, f"Text {i}", "en", "s", i) for i in range(n)]
    assert verified(spark, rows) == manifest_of(rows)


def test_manifest_edges(spark):
    rows = [r[:5] for r in edge_rows()]
    got = merkle.verify(edge_docs(spark)).select(
        "doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified", "proof_sha256").collect()
    assert sorted((tuple(r) for r in got), key=repr) == manifest_of(rows)
    assert merkle.verify(empty_docs(spark)).count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"
    assert "_text" in SCHEMA
