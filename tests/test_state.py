"""Stored state: buckets, compaction, single use inside a stream, giant groups and NULL keys."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from rosterline.functions.dialplan import iso_of_prefix
from rosterline.functions.payload import apply_field_map, explode_response
from rosterline.functions.vocab import phone_country
from rosterline.operators import match, upsert
from rosterline.operators.waterfall import union_search
from rosterline.streaming import streams

NOW = "2025-01-01 00:00:00"


def company_rows(spark, keys, ord0=0):
    rows = [(1, ord0 + i, f"Name {k} {ord0}", f"https://c{k}.example", "src") for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "list_id bigint, ord bigint, company_name string, company_domain string, source string")


def files_of(path):
    return [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "/ids/" not in d]


def test_batch_writes_what_it_changed(spark, tmp_path):
    path = str(tmp_path / "companies")
    batch = streams.upsert_batch_fn(spark, path, NOW, companies=True, buckets=16)
    batch(company_rows(spark, range(2000)), 0)
    before = set(files_of(path))
    small = company_rows(spark, [*range(10), *range(2000, 2010)], 10_000)
    batch(small, 1)
    new = [f for f in files_of(path) if f not in before]
    assert spark.read.parquet(*new).count() == 20                      # 1 % of the keys, 1 % of the rows
    now = streams.latest_companies(spark, path)
    assert now.count() == 2010 and now.select("list_id", "id").distinct().count() == 2010
    assert now.agg(F.max("id")).first()[0] == 2010
    assert now.where("company_domain_normalized = 'c3.example'").first()["company_name"] == "Name 3 10000"
    batch(small, 1)                                                    # a replay adds nothing
    assert len(files_of(path)) == len(before) + len(new)


def test_store_equals_batch_upserts_over_compactions(spark, tmp_path):
    path, r = str(tmp_path / "companies"), random.Random(4)
    batch = streams.upsert_batch_fn(spark, path, NOW, companies=True, buckets=4, compact_after=2)
    state = None
    for i in range(7):
        rows = [(r.randint(1, 2), 1000 * i + j, f"N{r.randint(0, 9)}" if r.random() < .8 else None,
                 f"https://c{r.randint(0, 40)}.example" if r.random() < .9 else "", r.choice(["a", "b", None])) for j in range(60)]
        df = spark.createDataFrame(rows, "list_id bigint, ord bigint, company_name string, company_domain string, source string")
        batch(df, i)
        state = upsert.materialize(upsert.upsert_companies(state, df, NOW).drop("_status", "_n_new"), "t")
    cols = ["list_id", "id", "company_domain_normalized", "company_name", "source"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()), key=repr)
    assert key(streams.latest_companies(spark, path)) == key(state)
    store = streams.company_store(spark, path)
    assert any("compact" in v for v in store.versions())
    # A bucket holds its last compaction, what came since, and what that compaction replaced until the next one.
    assert all(len(store._current(vs)) <= 3 for vs in store.folders().values())


def test_contacts_store(spark, tmp_path):
    path = str(tmp_path / "contacts")
    batch = streams.upsert_batch_fn(spark, path, NOW, buckets=4, compact_after=2)
    rows = lambda lo, hi: spark.createDataFrame(
        [(1, i, f"https://linkedin.com/in/u{i % 50}" if i % 10 else None) for i in range(lo, hi)], "list_id bigint, ord bigint, linkedin_url string")
    for i in range(5):
        batch(rows(i * 40, i * 40 + 40), i)
    got = streams.latest_snapshot(spark, path)
    want = upsert.upsert_contacts(None, rows(0, 200), NOW)
    cols = ["list_id", "id", "ord", "linkedin_url_normalized"]
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(map(tuple, want.select(*cols).collect()), key=repr)


def touches(spark, i):
    rows = [(f"https://linkedin.com/in/p{j % 30}", ["contacted", "replied", "bounced", "interested"][(i + j) % 4], f"c{(i * j) % 5}",
             dt.datetime(2024, 1, 1) + dt.timedelta(hours=i, minutes=j), f"F{i}") for j in range(40)]
    return spark.createDataFrame(rows, "linkedin_url string, status string, campaign_id string, ts timestamp_ntz, first_name string")


def test_master_over_many_batches(spark, tmp_path):
    path = str(tmp_path / "master")
    assert streams.master_of(spark, path).count() == 0
    assert "overall_status" in streams.master_of(spark, path).columns
    store = streams.master_store(spark, path, buckets=4, compact_after=3)
    most, every = 0, None
    for i in range(20):
        t = touches(spark, i)
        store.add(streams._partial(t), "run", i)
        every = t if every is None else every.unionByName(t)
        most = max(most, len([n for n in os.listdir(path) if n.startswith("v=")]))
        assert all(len(store._current(vs)) <= 4 for vs in store.folders().values())
    assert most <= 10                                                  # bounded, however many batches there were
    want = match.rollup_master(every)
    got = streams.master_of(spark, path).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_failed_version_is_not_read(spark, tmp_path):
    path = str(tmp_path / "master")
    store = streams.master_store(spark, path, buckets=2)
    store.add(streams._partial(touches(spark, 0)), "run", 0)
    version = store.add(streams._partial(touches(spark, 1)), "run", 1)
    n = streams.master_of(spark, path).agg(F.max("last_contacted_at")).first()[0]
    os.remove(os.path.join(path, version, "_SUCCESS"))                 # as if the writer had died before its commit
    assert not store.has("run", 1) and streams.master_of(spark, path).agg(F.max("last_contacted_at")).first()[0] < n
    store.add(streams._partial(touches(spark, 1)), "run", 1)
    assert streams.master_of(spark, path).agg(F.max("last_contacted_at")).first()[0] == n


# --- giant groups, NULL keys ------------------------------------------------------

def test_giant_company_sources(spark, monkeypatch):
    monkeypatch.setattr(upsert, "SOURCES_BLOCK", 100)
    rows = [(1, i, "https://giant.example" if i % 3 == 0 else f"https://c{i % 200}.example", [f"https://e/{i // 2}", f"https://e/{i}"],
             {"k": str(i), f"k{i % 4}": None if i % 7 == 0 else "v"}) for i in range(3000)]
    df = spark.createDataFrame(rows, "list_id bigint, ord bigint, company_domain string, sources array<string>, intel map<string,string>")
    for got, upto in ((upsert.upsert_companies(None, df, NOW), rows),
                      (upsert.upsert_companies(upsert.materialize(upsert.upsert_companies(None, df.where("ord < 1000"), NOW).drop("_status", "_n_new"), "t"),
                                               df.where("ord >= 1000"), NOW), rows)):
        out = {r["company_domain_normalized"]: r for r in got.collect()}
        want, intel = {}, {}
        for _, _, d, urls, facts in upto:
            k = d.removeprefix("https://")
            want.setdefault(k, {}).update(dict.fromkeys(urls))
            intel.setdefault(k, {}).update(facts)
        assert {k: r["sources"] for k, r in out.items()} == {k: list(v) for k, v in want.items()}
        assert {k: r["intel"] for k, r in out.items()} == intel


def most_rows_of_a_task(df, n=8):
    return max(r[0] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1))).collect())


def test_null_keys_spread(spark):
    """Half of all rows have no key: results are right and no partition of the join holds more than its share."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    n = 4000
    rows = [(1, i, None if i % 2 else f"https://linkedin.com/in/u{i % 40}", None if i % 2 else f"c{i % 20}.example",
             None if i % 2 else f"Co {i % 20}") for i in range(n)]
    df = spark.createDataFrame(rows, "list_id bigint, ord bigint, url string, company_domain string, company_name string")
    master = spark.createDataFrame([(f"https://linkedin.com/in/u{i}", False, False, True, "replied", "F", "L", "C") for i in range(20)],
                                   "linkedin_url_normalized string, has_unsubscribed boolean, has_bounced boolean, has_replied boolean, "
                                   "overall_status string, first_name string, last_name string, company_name string")
    companies = spark.createDataFrame([(1, f"c{i}.example", "x") for i in range(10)], "list_id bigint, company_domain_normalized string, industry string")
    brief = spark.createDataFrame([(f"Co {i}", f"b{i}.example") for i in range(5)], "company_name string, domain string")
    domains = spark.createDataFrame([("c4.example",)], "domain string")
    wf = spark.createDataFrame([("a", 1)], "provider string, rank int")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frames = {
            "j3": match.crossref_master(df, master), "j5": match.with_intel(df, companies), "j8": match.backfill_domain(df, brief),
            "f4": match.mark_exclusions(df, domains=domains),
            "w7": union_search([df.withColumn("source", F.lit("a")).withColumnRenamed("url", "linkedin_url_normalized")], wf)}
        for name, out in frames.items():
            assert most_rows_of_a_task(out) < 0.4 * n, name            # 8 partitions; one held at least n / 2 before
            assert out.count() == n, name
        assert frames["j3"].where("found").count() == sum(1 for r in rows if r[2] and int(r[2].split("/u")[1]) < 20)
        assert frames["j5"].where("account_industry is not null").count() == sum(1 for r in rows if r[3] in {f"c{i}.example" for i in range(10)})
        assert frames["f4"].where("exclusion_reason is not null").count() == sum(1 for r in rows if r[3] == "c4.example")
        assert frames["j8"].where("domain_source is null").count() == n // 2
        assert frames["w7"].where("net_new").count() == n // 2 + len({r[2] for r in rows if r[2]})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- payloads, phones, order ---------------------------------------------------------

def test_paths_of_a_payload(spark):
    df = spark.createDataFrame([(1, '{"a":{"items":[{"id":7,"n":"x","t":[{"name":"p"},{"name":"q"}],"o":{"k":[1, 2]},"b":true,"z":null,"s":"l1\nl2"},5]}}'),
                                (2, '{"a":{}}'), (3, "broken"), (4, None), (5, '{"a":{"items":{}}}')], "i int, p string")
    ex = explode_response(df, "p", "a.items")
    assert [(r["i"], r["pos"]) for r in ex.orderBy("i", "pos").collect()] == [(1, 0), (1, 1)]
    out = apply_field_map(ex, "item", {"id": "provider_ids.x", "n": "name", "t[].name": "tags", "o": "obj", "b": "flag", "z": "none",
                                       "s": "text", "t[0].name": "first"}, "prov", canonical=["name", "email"]).orderBy("pos").collect()
    r = out[0]
    assert (r["provider_ids"], r["name"], r["tags"], r["obj"], r["flag"], r["none"], r["text"], r["first"], r["email"], r["source"]) == (
        {"x": "7"}, "x", '["p","q"]', '{"k":[1,2]}', "true", None, "l1\nl2", "p", None, "prov")
    assert out[1]["name"] is None and out[1]["provider_ids"] == {}
    same = apply_field_map(df, "p", {"a.items[0].n": "name"}, "prov").orderBy("i").collect()      # from text as well
    assert [x["name"] for x in same] == ["x", None, None, None, None]


def test_every_dial_prefix(spark):
    plan, r = iso_of_prefix(), random.Random(1)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    numbers = [*plan, *(p + digits(r.randint(0, 8)) for p in plan for _ in range(2)), *(digits(r.randint(0, 12)) for _ in range(2000))]
    want = lambda x: plan.get(max((p for p in plan if x.startswith(p)), key=len, default=""))
    got = spark.createDataFrame([("+" + x, x) for x in numbers], "p string, x string").select("x", phone_country("p").alias("c")).collect()
    assert [(x["x"], x["c"]) for x in got if x["c"] != want(x["x"])] == []
    named = spark.createDataFrame([("Canada",), ("Kenya",), ("Czech Republic",), ("Nowhere",)], "c string")
    assert [r[0] for r in named.select(phone_country(F.lit("030 1"), "c")).collect()] == ["CA", "KE", "CZ", None]


@pytest.mark.parametrize("small", [True, False])
def test_ids_and_order(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(upsert, "BROADCAST_ROWS", 0)               # the way without a broadcast
    r = random.Random(2)
    rows = [(None if i % 11 == 0 else 1 if i % 3 else r.randint(2, 60), r.choice([None, 1, 5, 7]), r.choice([None, "a", "b"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "list_id bigint, score int, name string, id bigint").repartition(5)
    base = spark.createDataFrame([(1, 100)], "list_id bigint, base bigint")
    got = upsert.assign_ids(df, [upsert.desc("score"), F.coalesce("name", F.lit("")), "id"], "list_id", base, "pos", 16).collect()
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is None, -(x[1] or 0), x[2] or "", x[3]))
    assert [tuple(x)[:4] for x in got] == want
    seen = {}
    for x in got:
        seen[x["list_id"]] = seen.get(x["list_id"], 100 if x["list_id"] == 1 else 0) + 1
        assert x["pos"] == seen[x["list_id"]]
    assert upsert.assign_ids(df.limit(0), ["id"], "list_id").count() == 0


def test_dedup_order_beyond_48_bits(spark):
    from rosterline.operators.dedupe import dedupe_companies

    rows = [("c.example", "A", "x", 2 ** 62), ("c.example", "A", "x", 2 ** 62 - 1), ("c.example", None, None, 5), ("d.example", "B", "x", -3)]
    df = spark.createDataFrame(rows, "company_domain string, company_name string, industry string, ord bigint")
    out = dedupe_companies(df, ["company_domain", "company_name", "industry"]).collect()
    assert sorted(r["ord"] for r in out) == [-3, 2 ** 62 - 1]
