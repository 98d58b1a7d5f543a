"""Rows whose ids are null, shared or repeated: nothing is lost."""

import pytest

import corpus_pipeline
from rosterline.llm import jaccard, langid
from tests.llm.cases import SCHEMA, empty_docs, words

A = words(36, 1)
B, C = words(60, 2), words(70, 3)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash", 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)


ROWS = [(1, A), (1, B), (2, C), (None, C), (None, C), (None, A + " x")]


def test_links_and_classes_by_text(spark):
    out = jaccard.similar_documents(docs_of(spark, ROWS)).collect()
    assert len(out) == 6
    by = lambda f: {r["class_key"] for r in out if f(r)}
    assert len({r["class_key"] for r in out}) == 3
    linked = [r for r in out if r["n_links"] == 1]
    assert sorted((r["doc_id"] for r in linked), key=repr) == [1, None]            # A and A + x, one of them without an id
    assert {r["class_id"] for r in linked} == {1} and len(by(lambda r: r["n_links"] == 1)) == 1
    assert {r["class_id"] for r in out if r["doc_id"] == 2} == {2}
    copies = [r for r in out if r["class_id"] == 2]
    assert len(copies) == 3 and {r["copy_of"] for r in copies} == {2}


def test_one_row_of_each_class_stays(spark):
    kept = jaccard.drop_near_duplicates(docs_of(spark, [*ROWS, (5, ""), (None, None), (None, None), (7, B), (None, words(50, 8)), (None, words(50, 8))]))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, A), (1, B), (2, C), (5, ""), (None, None), (None, None), (None, words(50, 8))], key=repr)
    assert kept.columns == docs_of(spark, ROWS).columns


def test_expected_recall_counts_the_sketch_filter():
    assert 0.999 < jaccard.expected_recall(0.8) < 1 and jaccard.expected_recall(0.8, runs=1) < jaccard.expected_recall(0.8)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(3, "")], [*ROWS, *ROWS, (1, None), (9, words(400, 9)), (9, words(30_000, 4))]])
def test_pipeline_edges(spark, rows, tmp_path):
    """Empty tables, null and shared ids, repeated rows, empty and very long texts run through every stage."""
    docs = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars") if rows else empty_docs(spark).select(
        "doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, str(tmp_path))
        assert after.columns == docs.columns, name
        assert after.count() <= at.count()
        at = after
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == {r["doc_id"] for r in at.select("doc_id").collect()}


def test_snippets_that_reach_the_driver_are_bounded(spark):
    text = words(40, 11)
    many = docs_of(spark, [(None, text)] * 300 + [(i, words(40, i)) for i in range(20)])
    seen = []
    real = langid.train
    langid.train = lambda seqs, labels, n, **kw: (seen.append(len(seqs)), real(seqs, labels, n, **kw))[1]
    try:
        assert langid.fit(many, per_lang=10)["langs"] == ["en"]
    finally:
        langid.train = real
    assert seen and seen[0] <= 20


def test_private_windows_do_not_depend_on_partitions(spark):
    """The windows a tagger learns from are the same however the table is cut; spans are merged, not compared all with all."""
    from rosterline.llm import pii

    texts = [f"{words(20, i)} mail u{i}@mail.example or 10.0.{i % 250}.1, call +1 743 555 {1000 + i}" for i in range(60)]
    seen = []
    real = pii.train
    pii.train = lambda ids, labels, **kw: seen.append((ids.tolist(), labels.tolist())) or {}
    try:
        for parts in (2, 9):
            pii.fit_from(docs_of(spark, list(enumerate(texts))).repartition(parts), sample=40)
    finally:
        pii.train = real
    assert seen[0] == seen[1] and len(seen[0][0]) == 40


def test_licence_rules_by_brute_force():
    """Rules over random identifier sequences, by trying every rule at every place, longest rule first."""
    import random

    from rosterline.llm import licences

    r = random.Random(6)
    ids = sorted({x for _, _, rule in licences.RULES for x in rule})
    rules = sorted(licences.RULES, key=lambda rule: -len(rule[2]))
    for _ in range(400):
        names = []
        while len(names) < r.randint(1, 14):
            rule = r.choice(licences.RULES)[2]
            names += rule if r.random() < 0.6 else rule[:r.randint(0, len(rule))] if r.random() < 0.5 else [r.choice(ids)]
        free, want = set(range(len(names))), []
        for licence, kind, rule in rules:
            for i in range(len(names)):
                place = set(range(i, i + len(rule)))
                if list(names[i:i + len(rule)]) == list(rule) and place <= free:
                    free -= place
                    want.append((i, licence, kind))
        assert licences.recognise(names) == sorted(want), names


def test_licence_sentences_by_brute_force():
    """Known sentences in a text of lines, told by comparing normalised words with every known sentence."""
    import random

    from rosterline.llm import licences

    r = random.Random(8)
    known = {licences.normalise(s): k for k, s in licences.SENTENCES.items()} if isinstance(licences.SENTENCES, dict) else {}
    plain = [(s, k) for k, s in licences.SENTENCES.items() if licences.identify(s) == k]
    assert len(plain) > 10 and known
    for _ in range(60):
        lines, want, at = [], [], 0
        for _ in range(r.randint(1, 12)):
            if r.random() < 0.5:
                s, name = r.choice(plain)
                s = s if r.random() < 0.5 else s.upper()
                want.append((at, name))
            else:
                s = words(r.randint(1, 9), r.randrange(10 ** 6))
            lines.append(s)
            at += len(s) + 1
        got = [(i, n) for i, n in licences.identified("\n\n".join(lines).replace("\n\n", "\n"))]
        assert [x for x in got if x in want] == want
