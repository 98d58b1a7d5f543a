"""Operators 2, 3, 4, 6 and 7: brute force, held-out accuracy and the defined edge cases."""

import math
import random
import re

import numpy as np
import pytest

from rosterline.llm import decontam, langid, licences, pii, quality
from tests.llm.cases import by_id, edge_docs, edge_rows, empty_docs, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


# --- 6 ---------------------------------------------------------------

def brute_hits(text, items):
    w = WORD.findall(lowered(text or ""))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(lowered(t or ""))
        k = min(10, len(v))
        if item is None or not k:
            continue
        grams = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("shard_bytes", [2_000_000, 60])
def test_contamination_matches_brute_force(spark, shard_bytes):
    import hashlib

    r = random.Random(4)
    item_words = words(300, 77).split(" ")
    items = [(i, " ".join(item_words[20 * i:20 * i + r.choice([3, 9, 10, 25])])) for i in range(8)] + [
        (3, "ONE, two"), (None, "no id here"), (50, None), (51, "..."), (8, "été Straße")]
    rows = edge_rows()
    for i in range(30):
        t = words(60, i).split(" ")
        a = r.randrange(250)
        t[r.randrange(50):1] = item_words[a:a + r.choice([5, 12, 40])]
        rows.append((100 + i, r.choice([" ", "!! ", "\n"]).join(t).upper() if i % 2 else " ".join(t), *rows[0][2:]))
    rows.append((200, "l'été, straße Été STRAßE", *rows[0][2:]))
    from tests.llm.cases import SCHEMA
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontam.scan_contamination(docs, bench, shard_bytes=shard_bytes))
    for row in rows:
        n, h, found = brute_hits(row[1], items)
        for g in got[row[0]]:
            assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, h, len(found), h > 0)
            assert g.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            spans = [tuple(map(int, s.split(":"))) for s in g.hit_spans.split(",") if s]
            assert sum(len(WORD.findall(lowered(row[1][a:b]))) for a, b in spans) == h
    kept = decontam.drop_contaminated(docs, bench, shard_bytes=shard_bytes)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not brute_hits(r[1], items)[1] for r in rows)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.scan_contamination(empty_docs(spark), none).count() == 0
    assert {r.contaminated for r in decontam.scan_contamination(edge_docs(spark), none).collect()} == {False}


# --- 4 ---------------------------------------------------------------

def brute_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    r = random.Random(0)
    for _ in range(6000):
        t = "".join(r.choice("1234567890+.- ()@ab_%\n") for _ in range(r.randrange(60)))
        assert pii.base_spans(t) == brute_base(t), t
    assert pii.base_spans("a" * 200_000 + "@" + "9" * 200_000 + ". +" + "1" * 100_000) is not None  # linear time


def labelled_texts(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = words(40, seed * 1000 + i, 0).split(" ")
        card = "4" + "".join(r.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        w[10] = [f"{w[0]}.{w[1]}@{w[2]}.example.com", ".".join(str(r.randrange(256)) for _ in range(4)), card,
                 f"+{r.randrange(1, 99)} ({r.randrange(100, 999)}) 555-{r.randrange(1000, 9999)}"][i % 4]
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def tagger():
    texts = labelled_texts(500, 1)
    return pii.train(*pii.labelled([(t[max(0, s[0][0] - 30):s[0][0] + 50], [
        (a - max(0, s[0][0] - 30), k, b - max(0, s[0][0] - 30)) for a, k, b in s]) for t in texts if (s := pii.base_spans(t))]), epochs=40)


def test_crf_gradient():
    r = np.random.default_rng(0)
    em, tr = r.normal(size=(2, 4, pii.N_LABELS)), r.normal(size=(pii.N_LABELS, pii.N_LABELS))
    y = np.array([[0, 1, 2, 0], [3, 4, 0, 0]])
    loss, de, dt = pii.crf_loss(em, tr, y)
    for where, grad, x in (((1, 2, 3), de, em), ((1, 2), dt, tr)):
        up = x.copy()
        up[where] += 1e-5
        other = pii.crf_loss(up, tr, y)[0] if x is em else pii.crf_loss(em, up, y)[0]
        assert math.isclose((other - loss) / 1e-5, grad[where], abs_tol=1e-3)


def test_tagger_finds_other_spellings_and_spares_clean_text(tagger):
    texts = labelled_texts(200, 9)
    moved = [t.replace("@", " @ ") if "@" in t else re.sub(r"(\d+)\.(\d+)\.(\d+)\.(\d+)", r"\1[.]\2[.]\3[.]\4", t) for t in texts[:200]]
    found = pii.find_spans(tagger, [t for i, t in enumerate(moved) if i % 4 < 2])
    assert np.mean([len(s) > 0 for _, s in found]) > 0.6
    clean = [words(200, i, 0) for i in range(50)]
    assert not any(s for _, s in pii.find_spans(tagger, clean))


def test_skipped_windows_lose_nothing(tagger):
    texts = [" ".join(words(80, i, 0) + " " + t for t in labelled_texts(5, i)) for i in range(8)] + ["", "@", "7" * 300]
    assert pii.find_spans(tagger, texts) == pii.find_spans(tagger, texts, every=True)


def test_spans_of_any_length_are_kept(monkeypatch):
    """A tagger that marks every line as an e-mail: the span reaches many windows to both sides of its only sign."""
    line = pii.char_ids("\n")[0]

    def lines(em, _):
        inside = (em != line) & (em != pii.PAD)
        first = inside & ~np.pad(inside, ((0, 0), (1, 0)))[:, :-1]
        return np.where(first, 1, np.where(inside, 2, 0)).astype(np.int8)

    monkeypatch.setattr(pii, "emissions", lambda m, ids: ids)
    monkeypatch.setattr(pii, "viterbi", lines)
    for before, after in ((300, 500), (5, 1000), (1000, 5), (40, 39), (39, 41)):
        t = "plain words\n" * 30 + "a" * before + " @ " + "b" * after + ".com" + "\nplain words" * 30
        span = (360, 0, 360 + before + 3 + after + 4)
        model = {"trans": None}
        assert pii.find_spans(model, [t, "", "no sign"]) == [([], [span]), ([], []), ([], [])]
        assert pii.find_spans(model, [t], every=True) == [([], [span])]


def test_pii_edges_and_masking(spark):
    got = by_id(pii.find_pii(edge_docs(spark)))
    assert {i: len(r) for i, r in got.items()}[6] == 2 and len(got) == 13
    r = got[12][0]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert set("email:5:25,ip:29:37,card:39:58,phone:64:81".split(",")) <= set(r.spans.split(","))
    assert got[1][0].spans == got[2][0].spans == ""
    assert pii.find_pii(empty_docs(spark)).count() == 0
    masked = by_id(pii.mask_pii(edge_docs(spark)))
    assert masked[12][0].text == "mail [EMAIL] or [IP], [CARD] call [PHONE]" and masked[1][0].text is None
    assert masked[12][0].n_chars == len(masked[12][0].text) and masked[12][0]._text == "clash"
    assert masked[5][0].text == edge_rows()[4][1]


# --- 7 ---------------------------------------------------------------

def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    sizes = np.array([1, 3, 70, 2])
    score, trans = r.normal(size=(sizes.sum(), 2)), r.normal(size=(2, 2))
    got = langid.marginals(score, trans, sizes)
    at = 0
    for n in sizes:
        a = np.zeros((n, 2))
        b = np.zeros((n, 2))
        a[0] = score[at]
        for t in range(1, n):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0) + score[at + t]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + score[at + t + 1] + b[t + 1], axis=1)
        p = np.exp(a + b - np.logaddexp.reduce(a[-1]))
        assert np.allclose(got[at:at + n], p, atol=1e-4)
        at += n


def tongue(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    ends = {"en": ["ing", "the", "wh"], "de": ["ung", "sch", "ü"], "fr": ["eau", "è", "tion"]}[lang]
    return " ".join("".join(r.choice(ends + ["er", "an"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id_held_out_and_code_switching(spark):
    rows = [(i, tongue(lang, 30, i), lang) for i, lang in enumerate(["en", "de", "fr"] * 120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = by_id(langid.predict(docs))
    held = [(r.lang_pred == rows[i][2], r.score) for i, [r] in got.items() if r.held_out]
    assert len(held) > 40 and np.mean([x for x, _ in held]) > 0.95 and all(0 <= s <= 1 for _, s in held)
    # Languages of held-out documents don't matter.
    import zlib
    other = docs.sparkSession.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, t, x in rows], docs.schema)
    assert by_id(langid.predict(other)) == got
    model = langid.fit(docs)
    text = tongue("en", 25, 900) + " " + tongue("fr", 25, 901)
    [(_, _, _, _, post)] = list(langid.label_words(model, [text]))
    assert [model["langs"][k] for k in post.argmax(1)][::49] == ["en", "fr"]


def test_language_edges(spark):
    got = by_id(langid.predict(edge_docs(spark)))
    assert {got[i][0].lang_pred for i in (1, 2, 3)} == {"und"} and got[1][0].score == 0
    assert {r.lang_pred for rs in got.values() for r in rs} == {"und", "en"} and len(got[6]) == 2
    assert langid.predict(empty_docs(spark)).count() == 0
    kept = langid.keep_known(edge_docs(spark), 0.35)
    assert kept.columns == edge_docs(spark).columns and kept.count() == 11


# --- 2 ---------------------------------------------------------------

def brute_kneser_ney(texts, order):
    grams = {}
    for t in texts:
        c = [0] * (order - 1) + [int(quality.FOLD[ord(x)]) for x in t] + [1]
        for i in range(order - 1, len(c)):
            g = tuple(c[i - order + 1:i + 1])
            grams[g] = grams.get(g, 0) + 1
    tables = {order: grams}
    for o in range(order - 1, 0, -1):
        t = {}
        for g in tables[o + 1]:
            t[g[1:]] = t.get(g[1:], 0) + 1
        tables[o] = t
    ds = {o: quality.discounts([sum(v == k for v in t.values()) for k in (1, 2, 3, 4)]) for o, t in tables.items()}

    def p(g):
        if not g:
            return 1 / (len(tables[1]) + 1)
        t, d = tables[len(g)], ds[len(g)]
        follow = [v for x, v in t.items() if x[:-1] == g[:-1]]
        if not follow:
            return p(g[1:])
        c = t.get(g, 0)
        gamma = sum(d[min(3, v) - 1] for v in follow) / sum(follow)
        return max(0, c - (d[min(3, c) - 1] if c else 0)) / sum(follow) + gamma * p(g[1:])

    return p


def test_kneser_ney_matches_brute_force(spark):
    texts = [words(12, i, 0) for i in range(15)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, _text string")
    model = quality.fit(docs, order=3, share=0.0)
    p = brute_kneser_ney(texts, 3)
    probe = [words(5, 99, 0), "zz abq", "abc"]
    rows = {r.text: r for r in quality.perplexities(spark.createDataFrame([(t,) for t in probe], "text string"), model, ["text"]).collect()}
    assert len(rows) == len(set(probe))
    for t, row in ((t, rows[t]) for t in probe):     # rows of a frame have no order
        c = [0, 0] + [int(quality.FOLD[ord(x)]) for x in t] + [1]
        want = sum(math.log10(p(tuple(c[i - 2:i + 1]))) for i in range(2, len(c)))
        assert math.isclose(row.perplexity, 10 ** (-want / (len(t) + 1)), rel_tol=1e-4)


def test_quality_keeps_rare_ngrams_of_large_text(spark):
    """With its defaults, too, the model is that of brute force: 2.5 million characters leave out nothing."""
    texts = [words(12, i, 0) for i in range(15)] + ["qx"]
    often = "ab " * 850_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([often, *texts])], "doc_id bigint, _text string")
    p = brute_kneser_ney([often, *texts], 3)
    probe = ["qx", words(5, 99, 0), "zz abq", "", None]
    model = quality.fit(docs, order=3)
    got = {r.text: r.perplexity for r in quality.perplexities(
        spark.createDataFrame([(t,) for t in probe], "text string"), model, ["text"]).collect()}
    assert got[""] is None and got[None] is None
    for t in probe[:3]:
        c = [0, 0] + [int(quality.FOLD[ord(x)]) for x in t] + [1]
        want = sum(math.log10(p(tuple(c[i - 2:i + 1]))) for i in range(2, len(c)))
        assert math.isclose(got[t], 10 ** (-want / (len(t) + 1)), rel_tol=1e-5)


def test_quality_cuts_slices_into_ngrams_at_once(spark, monkeypatch):
    """Slices hold codes, and n-grams come from whole slices: once a job, and no text is decoded by itself."""
    texts = ["", "a", "x\U00010fffy 12", "日本語 5 \t٣", "z" * 30, ""]
    codes, size = quality.folded("".join(texts)), np.array([len(t) for t in texts])
    assert (quality.codes_in(quality.squeezed(quality.as_text(codes))) == codes).all()
    ids = lambda t: [int(quality.FOLD[ord(c)]) if ord(c) < 2048 else 2048 + ord(c) % 2047 for c in t]
    for cut in (4, 7, 2_000_000):
        monkeypatch.setattr(quality, "SLICE", cut)
        for order in (1, 2, 3, 5):
            want = []
            for i, t in enumerate(texts):
                c = [0] * (order - 1) + ids(t) + [1]
                want += [(sum(x << (12 * j) for j, x in enumerate(c[k:k + order][::-1])), i) for k in range(len(t) + 1) if t]
            for got in (quality.grams(texts, order), quality.grams_of(codes, size, order)):
                assert [(int(k), int(i)) for keys, of in got for k, i in zip(keys, of)] == want
    by, ends = quality.by_shard(np.arange(1000), 7)
    assert sorted(by) == list(range(1000)) and len(ends) == 8 and (ends[0], ends[-1]) == (0, 1000)


def test_quality_deals_requests_once(spark, monkeypatch, capsys):
    """Requests are stored by shard and no later step shuffles them; n-grams of a context meet in one shard, so their gaps are small."""
    texts = [words(60, i, 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, _text string").repartition(3)
    model, frames, ask = quality.fit(docs, order=3), [], quality.log_probabilities
    monkeypatch.setattr(quality, "log_probabilities", lambda m, wanted: frames.append(wanted) or ask(m, wanted))
    frames.append(quality.perplexities(docs, model, ["doc_id"], "_text"))
    assert frames[1].count() == 40
    capsys.readouterr()
    for df in frames:
        df.explain("formatted")
        plan = capsys.readouterr().out
        assert "keys#" in plan
        assert not re.search(r"\) Exchange\nInput \[\d+\]: \[[^]]*(keys|texts)#", plan)
    keys = np.unique(np.concatenate([k for k, _ in quality.grams(texts, 5)]))
    by, ends = quality.by_shard(keys, 50)
    assert (np.sort(by) == np.arange(len(keys))).all() and (np.diff(ends) > 0).sum() > 40
    shard = np.empty(len(keys), int)
    shard[by] = np.repeat(np.arange(50), np.diff(ends))
    same = keys[1:] >> quality.BITS == keys[:-1] >> quality.BITS
    assert same.any() and (shard[1:][same] == shard[:-1][same]).all()


def test_quality_separates_and_edges(spark):
    rows = [(i, words(60, i, 0), "en" if i % 2 else None) for i in range(200)] + [
        (1000 + i, words(60, 500 + i, 0).upper().replace(" ", "!! "), "en") for i in range(10)] + [(2000, None, "en"), (2001, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(i, 0, 0) for i in range(1000, 1005)] + [(3, 1, 1), (2000, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    got = by_id(quality.rate(docs, labels, order=3))
    assert all(got[i][0].kept for i in range(200)) and not any(got[1000 + i][0].kept for i in range(10))
    assert got[2000][0].perplexity is None and not got[2000][0].kept and not got[2001][0].kept
    no = spark.createDataFrame([], labels.schema)
    assert sum(r.kept for rs in by_id(quality.rate(edge_docs(spark), no)).values() for r in rs) == 12
    assert quality.rate(empty_docs(spark), no).count() == 0


def test_long_text_in_slices():
    t = words(3000, 5, 0)
    old = quality.SLICE
    try:
        whole = np.sort(np.concatenate([k for k, _ in quality.grams([t, "", "ab"], 4)]))
        quality.SLICE = 700
        assert (np.sort(np.concatenate([k for k, _ in quality.grams([t, "", "ab"], 4)])) == whole).all()
    finally:
        quality.SLICE = old


# --- 3 ---------------------------------------------------------------

MIT = ("Copyright (c) 2020 Someone\n\n" + licences.SENTENCES["mit-grant"].replace("of this", "of\nthis") + "\n\n" + licences.SENTENCES["mit-notice"]
       + ".\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY\nOF ANY KIND, EXPRESS OR IMPLIED.")


HEADERS = {
    "MPL-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed "
               "with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "GPL-2.0": "# This program is free software; you can redistribute it and/or\n# modify it under the terms of the GNU General Public License\n# as "
               "published by the Free Software Foundation; either version 2\n# of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as "
                "published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as "
                "published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published "
               "by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "Unlicense": "This is free and unencumbered software released into\nthe public domain.\n\nAnyone is free to copy it.",
    "EPL-2.0": " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at x",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-3.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.",
    "all-rights-reserved": "All rights\nreserved.",
    "CC0-1.0": "Released under\nCC0 1.0",
    "LGPL-3.0": "// SPDX-License-Identifier: LGPL-3.0-or-later",
    "Apache-2.0,MIT": "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */",
    "": "It says v. 2 of all.\nNo rights are\nlicensed here.",
}


def test_standard_headers_wrapped_over_lines(spark):
    rows = [(i, t) for i, t in enumerate(HEADERS.values())]
    got = by_id(licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [got[i][0].licences for i, _ in rows] == list(HEADERS)
    assert not any("-1:" in got[i][0].places for i, _ in rows)


def test_licence_rules(spark):
    rows = [(1, "Words. More words.\nReleased under the MIT License.\nMore."), (2, MIT), (3, "All rights reserved."),
            (4, "Copyright 2001 A. B.\nAll rights reserved"), (5, "The license plate. All rights"), (6, None), (7, ""),
            (8, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0. This work is licensed under "
                "the GNU General Public License, version 3."), (8, "All rights reserved.\nAll rights reserved.")]
    got = by_id(licences.scan_licences(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert [r.licences for i in (1, 2, 3, 4, 5, 6, 7) for r in got[i]] == [
        "MIT", "MIT", "all-rights-reserved", "all-rights-reserved", "", "", ""]
    assert sorted(r.licences for r in got[8]) == ["Apache-2.0,CC-BY-NC-4.0,GPL-3.0", "all-rights-reserved"]
    assert got[2][0].sentences == "copyright,mit-grant,mit-notice,as-is"
    assert got[1][0].places == "19:MIT"
    assert licences.scan_licences(empty_docs(spark)).count() == 0
    assert {r.licences for r in licences.scan_licences(edge_docs(spark)).collect()} == {""}


def test_rules_in_order():
    assert licences.recognise(["mit-notice", "mit-grant"]) == []
    assert licences.recognise(["bsd-grant", "bsd-binary", "bsd-name", "mit-line"]) == [
        (0, "BSD-3-Clause", "permissive"), (3, "MIT", "permissive")]
