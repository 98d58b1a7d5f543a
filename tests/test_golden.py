"""Golden fixtures and edge cases."""

import datetime as dt
import decimal
import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from rosterline.functions.merge import merge_intel, merge_sources
from rosterline.functions.normalize import (is_member_id, normalize_domain, normalize_linkedin_url,
                                            slug_candidates)
from rosterline.functions.payload import contact_phone, first_nested_phone
from rosterline.operators.activate import export, min_stage, to_lead, usable_leads
from rosterline.operators.match import crossref_master, crm_dedupe, keyword_regex
from rosterline.operators.report import list_summary
from rosterline.operators.upsert import (advance_stage, create_lists, not_found, upsert_companies,
                                         upsert_contacts, upsert_counters, company_counters)
from rosterline.operators.waterfall import (choose_match_key, email_waterfall, estimate_cost,
                                            phone_waterfall, resolve_waterfall, split_submittable)
from rosterline.sources.files import read_companies_csv, read_jsonl
from rosterline.session import checkpoint_dir

NOW = "2025-01-01 00:00:00"


def col_values(df, c):
    return [r[0] for r in df.select(c).collect()]


# --- contacts upsert -------------------------------------------------------

def _small_list(spark):
    """One list of four contacts: two with a key (one of them given twice), two without."""
    rows = [(1, 10, "Ola", "elm.example", "https://linkedin.com/in/ola-b?utm=1"),
            (1, 11, "Ravi", "ash.example", "https://www.LINKEDIN.com/in/ravi".replace("www.", "")),
            (1, 12, "Ola again", None, "https://linkedin.com/in/Ola-B/"),
            (1, 13, "No key", None, None), (1, 14, "None either", "", None)]
    return spark.createDataFrame(rows, "list_id bigint, ord bigint, first_name string, company_domain string, "
                                       "linkedin_url string")


def _people(spark):
    rows = [(7, 0, "Ines", "birch.example", "HTTPS://LinkedIn.com/in/ines-k"),
            (7, 1, "Ole", None, None),
            (7, 2, "Ines K.", "birch.example", "https://linkedin.com/in/ines-k/?src=mail"),
            (7, 3, "Tariq", "larch.example", "https://linkedin.com/in/tariq/"),
            (7, 4, "Bea", "", ""),
            (8, 5, "Ines", "birch.example", "https://linkedin.com/in/ines-k"),
            (None, 6, "Nobody's", None, "https://linkedin.com/in/free"),
            (None, 7, "Nobody's", None, "https://linkedin.com/in/free/")]
    return spark.createDataFrame(rows, "list_id bigint, ord bigint, first_name string, company_domain string, "
                                       "linkedin_url string")


def test_contacts_upsert_advance_export(spark):
    inc = _people(spark)
    out = upsert_contacts(None, inc, NOW)
    cnt = {r["list_id"]: (r["inserted"], r["skipped_duplicates"], r["total"]) for r in upsert_counters(inc, out).collect()}
    assert cnt[7] == (4, 1, 4) and cnt[8] == (1, 0, 1)
    ids = {(r["list_id"], r["first_name"]): r["id"] for r in out.collect()}
    free = ids.pop((None, "Nobody's"))         # without a list there is no key: both rows stay, as ids 1 and 2
    assert ids == {(7, "Ines"): 1, (7, "Ole"): 2, (7, "Tariq"): 3, (7, "Bea"): 4, (8, "Ines"): 1} and free in (1, 2)
    c = out.where("list_id is not null").drop("_inserted")
    upd = spark.createDataFrame([(7, 3, "email_enriched", "t@larch.example", "fullenrich"),
                                 (7, 1, "email_enriched", "i@birch.example", "apollo")] * 2,
                                "list_id bigint, id bigint, stage string, email string, email_source string")
    adv = advance_stage(c, upd, NOW)          # a repeated update is one update
    assert adv.count() == 5 and adv.where("_updated").count() == 2
    clash = upd.unionByName(upd.limit(1).withColumn("email", F.lit("other@x.example")))
    with pytest.raises(Exception, match="differing updates"):
        advance_stage(c, clash, NOW).collect()
    lists = create_lists(None, spark.createDataFrame([(i,) for i in range(7)], "ord bigint"), NOW)
    summ = {r["list_id"]: r for r in list_summary(lists, adv).collect()}
    assert (summ[7]["email_enriched"], summ[7]["sourced"], summ[7]["total_contacts"]) == (2, 2, 4)
    assert summ[1]["total_contacts"] == 0
    assert export(adv, "email_enriched").count() == 2
    master = spark.createDataFrame([], "linkedin_url_normalized string, has_unsubscribed boolean, has_bounced boolean, "
                                       "has_replied boolean, overall_status string, first_name string, last_name string, "
                                       "company_name string")
    urls = spark.createDataFrame([("https://linkedin.com/in/no-one-yet",)], "url string")
    assert crossref_master(urls, master).collect()[0]["status"] == "new"


def test_upsert_twice_is_idempotent(spark):
    inc = _people(spark).where("list_id is not null")
    once = upsert_contacts(None, inc, NOW).drop("_inserted")
    twice = upsert_contacts(once, inc.where("linkedin_url <> ''"), NOW)
    assert twice.where("_inserted").count() == 0
    assert twice.count() == 5


def test_not_found_sorted(spark):
    c = upsert_contacts(None, _people(spark), NOW)
    ids = spark.createDataFrame([(7, 11), (7, 4), (7, 6), (7, 11)], "list_id bigint, id bigint")
    assert [r["id"] for r in not_found(ids, c).collect()] == [6, 11]


# --- companies merge ---------------------------------------------------------

def test_companies_merge(spark):
    schema = ("list_id bigint, ord bigint, company_name string, company_domain string, source string, "
              "intel map<string,string>, sources array<string>, verified boolean, enriched boolean")
    b1 = spark.createDataFrame([(4, 0, "Larch & Co", "http://WWW.larch.example/team?x", "crm", {"size": "40", "hq": "Oslo"}, ["s1"], False, None),
                                (4, 1, "Birch", "birch.example", None, None, None, None, None),
                                (4, 2, "No domain", None, None, None, None, None, None)], schema)
    r1 = upsert_companies(None, b1, NOW)
    assert company_counters(r1).collect()[0]["inserted"] == 3
    b2 = spark.createDataFrame([(4, 3, None, "larch.example", "web", {"size": None, "ceo": "R."}, ["s2", "s1"], True, True),
                                (4, 4, None, "larch.example.", None, None, None, False, None)], schema)
    r2 = upsert_companies(r1.drop("_status", "_n_new"), b2, NOW)
    c = company_counters(r2).collect()[0]
    assert (c["inserted"], c["updated"], c["total"]) == (0, 2, 3)
    larch = r2.where("company_domain_normalized = 'larch.example'").collect()[0]
    assert larch["intel"] == {"size": None, "hq": "Oslo", "ceo": "R."} and larch["company_name"] == "Larch & Co"
    assert larch["company_domain"] == "http://WWW.larch.example/team?x"  # D14: first raw domain kept
    assert larch["sources"] == ["s1", "s2"] and larch["verified"] and larch["enriched"] and larch["source"] == "web"


def test_same_domain_folds_and_verified_or(spark):
    schema = "list_id bigint, ord bigint, company_name string, company_domain string, verified boolean, sources array<string>"
    b = spark.createDataFrame([(1, 0, "A", "a.com", True, ["u1"]), (1, 1, "A2", "www.a.com", False, ["u2", "u1"])], schema)
    r = upsert_companies(None, b, NOW).collect()
    assert len(r) == 1 and r[0]["verified"] is True and r[0]["company_name"] == "A2"
    assert r[0]["sources"] == ["u1", "u2"]  # D12: distinct, first-seen order


# --- §3 / §5 enrichment split, match key, cost ---------------------------------

def test_enrichment_split_and_cost(spark):
    df = spark.createDataFrame([(1, 1, "A", "B", "acme.de", "https://linkedin.com/in/a"),
                                (1, 2, "C", "D", "", None)],
                               "list_id bigint, id bigint, first_name string, last_name string, "
                               "company_domain string, linkedin_url string")
    sub, exc = split_submittable(df)
    assert sub.count() == 1 and col_values(exc, "reason") == ["empty_domain"]
    c = estimate_cost(df).collect()[0]
    assert c["fullenrich_email_credits"] == 1 and c["fullenrich_phone_credits"] == 10
    assert c["aiark_email_credits"] == 2 and c["aiark_phone_credits"] == 1 and c["aiark_phone_excluded"] == 1
    k = choose_match_key(df, "ai-ark", "phone_enrich").orderBy("id").collect()
    assert k[0]["match_key"] == "linkedin_url" and k[1]["excluded"] == "no_phone_key"


def test_search_cost_apify(spark):
    # one company, max 50 profiles, short mode: 0.02 + 50 × 0.004 = 0.22
    df = spark.range(50).select(F.lit(1).alias("list_id"), F.lit("x").alias("first_name"),
                                F.lit(None).cast("string").alias("last_name"),
                                F.lit("x.com").alias("company_domain"), F.lit(None).cast("string").alias("linkedin_url"))
    assert estimate_cost(df).collect()[0]["apify_usd"] == decimal.Decimal("0.22")


# --- §4 leads -------------------------------------------------------------------

def test_leads(spark):
    df = spark.createDataFrame([("a@b.com", None, None), (None, "x", None)],
                               "email string, first_name string, linkedin_url string")
    assert usable_leads(df).count() == 1
    lead = to_lead(df.where("email is not null"), "lemlist").collect()[0]["lead"]
    assert lead == '{"email":"a@b.com"}'


# --- §6 company CSV ---------------------------------------------------------------

def test_company_csv(spark, tmp_path):
    """Each file has its own header; a doubled header gives its first non-blank cell."""
    (tmp_path / "a.csv").write_text("\ufeffAccount;ignored\n".replace(";", ",") + "Larch,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Site,Tier, NAME ,tier\nbirch.example,,Birch,gold\n , , ,bronze\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text('name,site\n"Oak\n& Sons","oak.example"\n', encoding="utf-8")
    comp, skipped = read_companies_csv(spark, str(tmp_path))
    rows = {r["company_name"]: r for r in comp.collect()}
    assert set(rows) == {"Larch", "Birch", "Oak\n& Sons"}
    assert [r["skipped"] for r in skipped.collect()] == [1]
    assert rows["Birch"]["company_domain"] == "birch.example" and rows["Birch"]["extras"] == {"tier": "gold"}
    assert rows["Larch"]["company_domain"] is None and rows["Larch"]["extras"] == {"ignored": "x"}
    with pytest.raises(Exception, match="max_columns"):
        read_companies_csv(spark, str(tmp_path / "b.csv"), max_columns=3)[0].collect()


def _csv_columns(df):
    """Numbers of the CSV columns that a plan names."""
    return {int(n) for n in re.findall(r"\b_c(\d+)#", df._jdf.queryExecution().optimizedPlan().toString())}


def test_company_csv_skipped_reads_own_columns(spark, tmp_path):
    """Rows are parsed into as many columns as their file has: each cell that a row lacks is an exception in the parser."""
    (tmp_path / "a.csv").write_text("name,url,segment\nLarch,larch.example,x\n,,y\n , ,z\n")
    _, skipped = read_companies_csv(spark, str(tmp_path))
    assert [r["skipped"] for r in skipped.collect()] == [2]
    assert _csv_columns(skipped) == {0, 1, 2}


def test_companies_csv_of_different_widths(spark, tmp_path):
    """Files with more and with fewer columns in one folder: each is read by its own number of columns."""
    (tmp_path / "a.csv").write_text("name,site\nLarch,larch.example\n")
    (tmp_path / "b.csv").write_text("\nTier,x,,Tier,LinkedIn,NAME,,\n ,1,no,gold,l,Birch,no,no\nsilver,,,gold\n")
    (tmp_path / "c.csv").write_text("account\nOak\n")
    (tmp_path / "d.csv").write_text("")
    comp, skipped = read_companies_csv(spark, str(tmp_path))
    assert {r["company_name"]: (r["company_domain"], r["linkedin_url"], r["extras"]) for r in comp.collect()} == {
        "Larch": ("larch.example", None, {}), "Birch": (None, "l", {"x": "1", "tier": "gold"}), "Oak": (None, None, {})}
    assert [r["skipped"] for r in skipped.collect()] == [1]
    assert _csv_columns(comp) == set(range(6))


def test_broken_json_line_raises(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int").collect()


# --- §7 CRM check -----------------------------------------------------------------

def test_crm_check(spark):
    vals = spark.createDataFrame([("oak.example ",), ("Larch.Example",), ("larch.example",), ("OAK.example",)], "value string")
    crm = spark.createDataFrame([("larch.example", "88", "Later", 9), ("larch.example", "17", "Larch", 3)],
                                "key string, id string, name string, ord bigint")
    out = {r["value"]: r for r in crm_dedupe(vals, crm).collect()}
    assert len(out) == 2 and out["larch.example"]["id"] == "17" and not out["oak.example"]["exists"]


# --- §10 edge cases -----------------------------------------------------------------

@pytest.mark.parametrize("url,expected", [
    ("a//", "a/"), ("a/?q", "a"), ("HTTPS://X/Y/#f", "https://x/y/#f"), ("?x", ""), ("", None), (None, None)])
def test_n1(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(normalize_linkedin_url("u")).collect()[0][0] == expected


@pytest.mark.parametrize("d,expected", [
    ("HTTPS://www.A.com../p", "a.com"), ("a.com:80/x", "a.com:80"), ("a.com?x=1", "a.com?x=1"),
    ("www.", None), ("https://", None), ("\ta.com\n", "a.com")])
def test_n2(spark, d, expected):
    df = spark.createDataFrame([(d,)], "u string")
    assert df.select(normalize_domain("u")).collect()[0][0] == expected


def test_n4(spark):
    df = spark.createDataFrame([("/in/ACwAAB1",), ("/in/acworth",), (None,)], "u string")
    assert col_values(df.select(is_member_id("u").alias("m")), "m") == [True, True, False]


def test_n8(spark):
    df = spark.createDataFrame([("Foo Bar GmbH",), ("Foo",), ("my.site.de",)], "s string")
    got = [r[0] for r in df.select(slug_candidates("s")).collect()]
    assert got == [["foo-bar-gmbh", "foo-bar"], ["foo", "foo-gmbh"], ["my"]]


def test_n17_n18(spark):
    df = spark.createDataFrame([('[[""],["+1 2"]]',), ('["+3"]',), ("[]",)], "d string")
    assert col_values(df.select(first_nested_phone("d").alias("p")), "p") == ["+12", "+3", None]
    ci = spark.createDataFrame([('{"most_probable_phone":{"number":" "},"phones":[{"number":"+1"}]}',)], "c string")
    assert ci.select(contact_phone("c")).collect()[0][0] is None


def test_n20_n21(spark):
    df = spark.sql("SELECT map('a','1','b','2') AS l, map('a', CAST(NULL AS STRING)) AS r")
    m = df.select(merge_intel("l", "r")).collect()[0][0]
    assert m == {"a": None, "b": "2"}
    df2 = spark.sql("SELECT CAST(NULL AS ARRAY<STRING>) AS l, array('x','y','x') AS r")
    assert df2.select(merge_sources("l", "r")).collect()[0][0] == ["x", "y"]


def test_j3_case_order(spark):
    master = spark.createDataFrame([
        ("u/bounced_replied", False, True, True, "replied"), ("u/unsub", True, True, True, "interested"),
        ("u/nullflags", None, None, None, None), ("u/engaged", False, False, False, "engaged")],
        "linkedin_url_normalized string, has_unsubscribed boolean, has_bounced boolean, has_replied boolean, "
        "overall_status string").withColumn("first_name", F.lit(None).cast("string")) \
        .withColumn("last_name", F.lit(None).cast("string")).withColumn("company_name", F.lit(None).cast("string"))
    urls = spark.createDataFrame([(u,) for u in ["u/bounced_replied", "u/unsub", "u/nullflags", "u/engaged"]], "url string")
    got = {r["url"]: r["status"] for r in crossref_master(urls, master).collect()}
    assert got == {"u/bounced_replied": "replied", "u/unsub": "unsubscribed",
                   "u/nullflags": "previously_contacted", "u/engaged": "previously_contacted"}


def test_t1_keeps_first_timestamp_and_allows_backwards(spark):
    c = upsert_contacts(None, _small_list(spark), NOW).drop("_inserted")
    u = spark.createDataFrame([(1, 1, "qualified")], "list_id bigint, id bigint, stage string")
    a1 = advance_stage(c, u, "2025-01-02 00:00:00").drop("_updated")
    a2 = advance_stage(a1, u, "2025-01-03 00:00:00").drop("_updated")
    r = a2.where("id = 1").collect()[0]
    assert r["qualified_at"] == dt.datetime(2025, 1, 2)
    back = advance_stage(a2, spark.createDataFrame([(1, 1, "sourced")], "list_id bigint, id bigint, stage string"), NOW)
    assert back.where("id = 1").collect()[0]["stage"] == "sourced"


def test_t1_invalid_stage_raises(spark):
    c = upsert_contacts(None, _small_list(spark), NOW).drop("_inserted")
    u = spark.createDataFrame([(1, 1, "bogus")], "list_id bigint, id bigint, stage string")
    with pytest.raises(Exception):
        advance_stage(c, u, NOW).collect()


def test_o1_order(spark):
    rows = [(1, 1, "qualified", None, "Zeta"), (1, 2, "qualified", 5, None), (1, 3, "qualified", 5, "Acme"),
            (1, 4, "skipped", 9, "Acme"), (1, 5, "qualified", 7, "B")]
    df = spark.createDataFrame(rows, "list_id bigint, id bigint, stage string, qualification_score int, company_name string")
    for c in ["first_name", "last_name", "full_name", "title", "seniority", "company_domain", "linkedin_url", "country",
              "location", "email", "phone", "phone_type", "source", "matched_persona"]:
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = export(df, "sourced").collect()
    assert [(r["qualification_score"], r["company_name"]) for r in out] == [(7, "B"), (5, None), (5, "Acme"), (None, "Zeta")]
    with pytest.raises(ValueError):
        min_stage(df, "bogus")


def test_a1_empty_list_zeros(spark):
    lists = create_lists(None, spark.createDataFrame([(1,), (2,)], "ord bigint"), NOW)
    c = upsert_contacts(None, _small_list(spark), NOW)
    rows = {r["list_id"]: r for r in list_summary(lists, c).collect()}
    assert rows[2]["total_contacts"] == 0 and rows[1]["total_contacts"] == 4


def test_w3_waterfall_rules(spark):
    contacts = spark.createDataFrame([(1,), (2,), (3,)], "contact_id bigint")
    ans = spark.createDataFrame([
        (1, "apollo", 1, 1, "guessed", "a@x", "reverified"),   # guessed + confirmed → accepted
        (2, "apollo", 1, 2, "guessed", "b@x", "miss"),         # guessed + unconfirmed → next provider
        (2, "fullenrich", 2, 3, "CATCH_ALL", "b2@x", "flag"),  # catch-all accepted with flag
    ], "contact_id bigint, provider string, rank int, ord bigint, raw_status string, email string, verdict string")
    out = {r["contact_id"]: r for r in email_waterfall(contacts, ans).collect()}
    assert out[1]["email"] == "a@x" and out[1]["email_validation"] == "reverified"
    assert out[2]["email_source"] == "fullenrich" and out[2]["email_validation"] == "accepted_catch_all"
    assert out[2]["email_waterfall_log"] == "apollo:guessed→fullenrich:CATCH_ALL→accepted"
    assert out[3]["email_source"] == "not_found"


def test_w4_mobile_beats_switchboard(spark):
    contacts = spark.createDataFrame([(1,)], "contact_id bigint")
    ans = spark.createDataFrame([(1, "apollo", 1, 1, "+1", "switchboard", "valid"),
                                 (1, "leadmagic", 3, 2, "+2", "mobile", "valid")],
                                "contact_id bigint, provider string, rank int, ord bigint, phone string, "
                                "phone_type string, validation string")
    r = phone_waterfall(contacts, ans).collect()[0]
    assert r["phone"] == "+2" and r["phone_type"] == "mobile" and not r["flagged"]


def test_w8_resolve_waterfall(spark):
    from rosterline.functions.vocab import waterfall_df
    prov = spark.createDataFrame([("apollo", False, False), ("fullenrich", False, True), ("leadmagic", False, True),
                                  ("ai-ark", False, False), ("clearoutphone", False, False)],
                                 "provider string, builtin boolean, has_key boolean")
    out = {r["capability"]: r for r in resolve_waterfall(waterfall_df(spark), prov).collect()}
    assert out["email_enrich"]["resolved"] == ["fullenrich", "leadmagic"]
    assert out["phone_validate"]["no_provider"]


def test_d23_whole_word(spark):
    df = spark.createDataFrame([("Intern",), ("International Sales",)], "t string")
    assert col_values(df.select(F.col("t").rlike(keyword_regex(["intern"])).alias("x")), "x") == [True, False]


def test_d6_url_change_collision(spark):
    c = upsert_contacts(None, _small_list(spark), NOW).drop("_inserted")
    # id 3 takes Ravi's URL (collision → keeps its old URL); id 4 gets a fresh URL.
    u = spark.createDataFrame([(1, 3, "sourced", "https://LinkedIn.com/in/ravi/"),
                               (1, 4, "sourced", "https://linkedin.com/in/new")],
                              "list_id bigint, id bigint, stage string, linkedin_url string")
    out = {r["id"]: r for r in advance_stage(c, u, NOW).collect()}
    assert out[3]["_key_conflict"] and out[3]["linkedin_url"] is None
    assert not out[4]["_key_conflict"] and out[4]["linkedin_url_normalized"] == "https://linkedin.com/in/new"


def test_d1_empty_key_is_a_key(spark):
    rows = [(1, 0, "a", "?x"), (1, 1, "b", "/?y")]
    df = spark.createDataFrame(rows, "list_id bigint, ord bigint, first_name string, linkedin_url string")
    out = upsert_contacts(None, df, NOW).collect()
    assert [r["first_name"] for r in out] == ["a"]


def test_d8_null_stage_becomes_sourced(spark):
    out = upsert_contacts(None, _small_list(spark), NOW).collect()
    assert {r["stage"] for r in out} == {"sourced"}


def test_w3_bonus_data(spark):
    contacts = spark.createDataFrame([(1,)], "contact_id bigint")
    ans = spark.createDataFrame([
        (1, "apollo", 1, 1, "unavailable", None, "miss", "https://linkedin.com/in/v", "Smith"),
        (1, "fullenrich", 2, 2, "DELIVERABLE", "a@x", "accept", None, None)],
        "contact_id bigint, provider string, rank int, ord bigint, raw_status string, email string, verdict string, "
        "resolved_linkedin_url string, resolved_last_name string")
    r = email_waterfall(contacts, ans).collect()[0]
    assert r["email"] == "a@x" and r["resolved_last_name"] == "Smith"


def test_json_envelopes_bounded(spark):
    from rosterline.sources.files import to_json_map, to_json_pages
    df = spark.range(25).select(F.lit(1).cast("bigint").alias("list_id"), F.col("id"),
                                F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    pages = to_json_pages(df, page_size=10)
    assert pages.count() == 3
    m = to_json_map(df.withColumn("status", F.lit("new")), "url", "status", page_size=10)
    assert m.count() == 3


def test_stream_upsert_replay_is_idempotent(spark, tmp_path):
    from rosterline.streaming.streams import latest_snapshot, upsert_batch_fn
    path = str(tmp_path / "snap")
    fn = upsert_batch_fn(spark, path, NOW)
    batch = _small_list(spark)
    fn(batch, 0)
    fn(batch, 0)                      # replay of batch 0: skipped
    assert latest_snapshot(spark, path).count() == 4
    fn(batch.where("linkedin_url is not null"), 1)   # same keys again: nothing new
    assert latest_snapshot(spark, path).count() == 4


def test_sql_surface(spark):
    from rosterline.operators.match import rollup_master
    from rosterline.plans.sql_surface import register_sql_surface
    c = upsert_contacts(None, _small_list(spark), NOW).drop("_inserted")
    for col_ in ["last_name", "full_name", "title", "seniority", "company_name", "country", "location", "email",
                 "phone", "phone_type", "source", "matched_persona"]:
        if col_ not in c.columns:
            c = c.withColumn(col_, F.lit(None).cast("string"))
    touches = spark.createDataFrame([("https://linkedin.com/in/ravi/", "bounced", dt.datetime(2024, 1, 1), 1, "Ravi",
                                      None, None)],
                                    "linkedin_url string, status string, ts timestamp_ntz, campaign_id bigint, "
                                    "first_name string, last_name string, company_name string")
    lists = create_lists(None, spark.createDataFrame([(1,)], "ord bigint"), NOW)
    register_sql_surface(spark, c, lists, rollup_master(touches), prefix="rl_t")
    assert spark.sql("SELECT * FROM pipeline_export(1, 'sourced')").count() == 4
    got = {r["input_url"]: r["status"] for r in
           spark.sql("SELECT * FROM check_linkedin_urls(array('https://linkedin.com/in/ravi', 'x'))").collect()}
    assert got == {"https://linkedin.com/in/ravi": "bounced", "x": "new"}
    assert spark.sql("SELECT total_contacts FROM pipeline_list_summary").collect()[0][0] == 4
    with pytest.raises(Exception):
        spark.sql("SELECT * FROM pipeline_export(1, 'bogus')").collect()


def test_d2_newline_in_url(spark):
    df = spark.createDataFrame([("A?x\ny",), ("a/?q\n",)], "u string")
    got = [r[0] for r in df.select(normalize_linkedin_url("u")).collect()]
    assert got[0] == "a?x\ny"


def test_d22_fullenrich_null_status_invalid(spark):
    from rosterline.functions.vocab import normalize_email_status
    df = spark.createDataFrame([("fullenrich", None, "a@b.c"), ("fullenrich", "DELIVERABLE", None),
                                ("ai-ark", None, "a@b.c"), ("leadmagic", "valid", "a@b.c")],
                               "p string, r string, e string")
    got = [r[0] for r in df.select(normalize_email_status("p", "r", "e", F.lit(True))).collect()]
    assert got == ["invalid", "invalid", "deliverable", "catch_all"]


def test_d17_summary_order(spark):
    lists = spark.createDataFrame([(1, "a", None, "u", "active", dt.datetime(2024, 1, 1)),
                                   (2, "b", None, "u", "active", dt.datetime(2024, 2, 1)),
                                   (3, "c", None, "u", "active", dt.datetime(2024, 2, 1))],
                                  "list_id bigint, list_name string, description string, created_by string, "
                                  "status string, created_at timestamp_ntz")
    c = upsert_contacts(None, _small_list(spark), NOW)
    assert [r["list_id"] for r in list_summary(lists, c).collect()] == [2, 3, 1]


def test_bucketed_snapshots_join_without_shuffle(spark, tmp_path):
    from rosterline.sources.files import write_bucketed_snapshot
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = upsert_contacts(None, _small_list(spark), NOW).drop("_inserted")
        keys = ["list_id", "linkedin_url_normalized"]
        a = write_bucketed_snapshot(c, "rl_bucket_a", str(tmp_path / "a"), keys, 8)
        b = write_bucketed_snapshot(c.select(*keys), "rl_bucket_b", str(tmp_path / "b"), keys, 8)
        j = a.join(b, keys, "left_anti")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert j.count() == 2   # the two NULL-key rows never match
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_q5_without_segments(spark):
    from rosterline.operators.qualify import qualify
    df = spark.createDataFrame([(1, 4, None), (2, 0, None), (3, 2, "excluded_title")],
                               "ord bigint, persona_points int, exclusion_reason string")
    got = {r["ord"]: r["qualification_status"] for r in qualify(df, segments=False).collect()}
    assert got == {1: "QUALIFY", 2: "SKIP", 3: "SKIP"}


def test_f7_counts_and_j15_urls(spark):
    from rosterline.operators.activate import usable_lead_counts
    from rosterline.operators.match import resolve_companies, resolved_urls
    df = spark.createDataFrame([(1, "a@b.c", None), (1, None, None), (1, "", "https://linkedin.com/in/x")],
                               "list_id bigint, email string, linkedin_url string")
    r = usable_lead_counts(df).collect()[0]
    assert (r["usable"], r["skipped_no_identity"]) == (2, 1)
    li = usable_lead_counts(df, "linkedin").collect()[0]
    assert li["usable"] == 1
    comp = spark.createDataFrame([("Foo GmbH",), ("foo gmbh",), ("Bar",)], "company string")
    pages = spark.createDataFrame([("foo-gmbh", "valid"), ("bar-gmbh", "invalid")], "slug string, status string")
    res = resolve_companies(comp, pages)
    assert [r["url"] for r in resolved_urls(res).collect()] == ["https://www.linkedin.com/company/foo-gmbh"]


# --- §8 golden run: the worked example's export and summary --------------------

EXAMPLE_EXPORT = """first_name,last_name,full_name,title,seniority,company_name,company_domain,linkedin_url,country,location,email,phone,phone_type,source,matched_persona,qualification_score
Lena,Hoffmann,Lena Hoffmann,CFO,,Nimbus Pay,nimbuspay.example,https://linkedin.com/in/lena-hoffmann-cfo,Germany,Berlin,lena.hoffmann@nimbuspay.example,+49 30 5550 1234,mobile,apollo,Economic Buyer,9
Marco,Brunner,Marco Brunner,Chief Financial Officer,,Helvetia Ledger,helvetialedger.example,https://linkedin.com/in/marco-brunner,Switzerland,Zurich,marco.brunner@helvetialedger.example,+41 44 555 0199,direct_dial,apollo,Economic Buyer,8
Sophie,Maier,Sophie Maier,CFO,,Tirol Treasury,tiroltreasury.example,https://linkedin.com/in/sophie-maier,Austria,Vienna,sophie.maier@tiroltreasury.example,+43 1 5550 0177,mobile,web_research,Economic Buyer,8
Jonas,Gruber,Jonas Gruber,Head of Compliance,,Tirol Treasury,tiroltreasury.example,https://linkedin.com/in/jonas-gruber,Austria,Vienna,jonas.gruber@tiroltreasury.example,,,web_research,Compliance Champion,6
"""


def test_golden_example_export_and_summary(spark, tmp_path):
    import csv
    import glob
    import io

    from rosterline.schema import EXPORT_COLUMNS
    from rosterline.sources.files import write_export_csv
    rows = list(csv.DictReader(io.StringIO(EXAMPLE_EXPORT)))
    # Inserted in an order different from the export order; two skipped contacts added.
    order = [3, 1, 0, 2]
    recs = []
    for i, k in enumerate(order):
        r = {c: (rows[k][c] or None) for c in EXPORT_COLUMNS}
        r["qualification_score"] = int(rows[k]["qualification_score"])
        recs.append({**r, "list_id": 1, "ord": i, "stage": "phone_enriched"})
    for i, name in enumerate(["Skip1", "Skip2"]):
        recs.append({**{c: None for c in EXPORT_COLUMNS}, "first_name": name, "qualification_score": 9,
                     "list_id": 1, "ord": 10 + i, "stage": "skipped"})
    schema = "list_id bigint, ord bigint, stage string, " + ", ".join(
        f"{c} {'int' if c == 'qualification_score' else 'string'}" for c in EXPORT_COLUMNS)
    inc = spark.createDataFrame([{k: r.get(k) for k in ["list_id", "ord", "stage"] + EXPORT_COLUMNS} for r in recs],
                                schema)
    contacts = upsert_contacts(None, inc, NOW).drop("_inserted")
    lists = create_lists(None, spark.createDataFrame([(1, "dach-fintech-cfos")], "ord bigint, list_name string"), NOW)
    s = list_summary(lists, contacts).collect()[0]
    assert (s["sourced"], s["qualified"], s["email_enriched"], s["phone_enriched"], s["skipped"],
            s["total_contacts"]) == (0, 0, 0, 4, 2, 6)
    out = str(tmp_path / "export")
    write_export_csv(export(contacts, "phone_enriched").coalesce(1), out, partition_col=None)
    text = open(glob.glob(out + "/part-*.csv")[0], encoding="utf-8").read()
    assert text == EXAMPLE_EXPORT


def test_priced_estimate_and_funding_segment(spark):
    from rosterline.functions.vocab import prices_df
    from rosterline.operators.qualify import score_company
    from rosterline.operators.waterfall import priced_estimate
    counts = spark.createDataFrame([("leadmagic", "phone_enrich", 3), ("leadmagic", "email_validate", 8)],
                                   "provider string, capability string, billable bigint")
    got = {r["capability"]: float(r["credits_estimate"]) for r in priced_estimate(counts, prices_df(spark)).collect()}
    assert got == {"phone_enrich": 15.0, "email_validate": 2.0}
    df = spark.createDataFrame([(1, "350", "DACH", "Series C"), (2, "350", "DACH", "Seed"), (3, "120", "DACH", None)],
                               "ord int, employees string, region string, funding_stage string")
    seg = {r["ord"]: r["company_segment"] for r in
           score_company(df, a_region="DACH", a_funding=["Series B", "Series C", "Series D"]).collect()}
    assert seg == {1: "A", 2: "C", 3: "B"}


# --- ties, NULLs and repeated rows -----------------------------------------------------

def test_best_contact_prefers_scored_and_keeps_null_companies(spark):
    from rosterline.operators.waterfall import best_contact
    df = spark.createDataFrame([(1, None, 0, "c"), (2, 9, 1, "c"), (3, 9, 2, "c"), (4, None, 3, None), (5, 1, 4, None)],
                               "id bigint, score int, ord bigint, company string")
    assert sorted(r["id"] for r in best_contact(df, "score", ["company"]).collect()) == [2, 5]


def test_contacts_without_identity_are_never_merged(spark):
    from rosterline.operators.dedupe import dedupe_contacts
    rows = [(0, None, None, None, None, None, {"p": "1"}), (1, None, None, None, None, None, {"p": "2"}),
            (2, "a", "b", None, "x", None, {"p": "3"}), (3, "a", None, "b", "x", None, {"p": "4"}),
            (4, "a", "b", None, "x", None, {"q": "5"})]
    df = spark.createDataFrame(rows, "ord bigint, first_name string, last_name string, company_name string, title string, "
                                     "linkedin_url string, provider_ids map<string,string>")
    out = {r["ord"]: r for r in dedupe_contacts(df, ["first_name", "last_name", "company_name", "title"]).collect()}
    assert sorted(out) == [0, 1, 2, 3] and out[2]["provider_ids"] == {"p": "3", "q": "5"}


def test_accepted_answer_without_address_goes_on(spark):
    a = spark.createDataFrame([(1, "p1", 1, 0, "ok", None, "accept"), (1, "p2", 2, 1, "ok", "a@x.example", "accept")],
                              "contact_id bigint, provider string, rank int, ord bigint, raw_status string, email string, verdict string")
    r = email_waterfall(spark.createDataFrame([(1,)], "contact_id bigint"), a).collect()[0]
    assert (r["email"], r["email_source"]) == ("a@x.example", "p2")


def test_validations_reduce_before_the_join(spark):
    from rosterline.operators.waterfall import reverify
    a = spark.createDataFrame([("a@x.example", "reverify")], "email string, verdict string")
    v = spark.createDataFrame([("a@x.example", "invalid"), ("a@x.example", "valid")], "email string, status string")
    assert [r["verdict"] for r in reverify(a, v).collect()] == ["reverified"]


def test_unranked_provider_is_last(spark):
    from rosterline.operators.waterfall import union_search
    f = [spark.createDataFrame([("u", p, i)], "linkedin_url_normalized string, source string, ord bigint")
         for i, p in enumerate(["stray", "ranked"])]
    wf = spark.createDataFrame([("ranked", 1)], "provider string, rank int")
    assert {r["source"]: r["net_new"] for r in union_search(f, wf).collect()} == {"ranked": True, "stray": False}


def test_null_groups_get_ids(spark):
    from rosterline.operators.upsert import assign_ids
    df = spark.createDataFrame([(None, 3), (None, 1), (5, 2)], "list_id bigint, ord bigint")
    assert sorted((r["ord"], r["id"]) for r in assign_ids(df, ["ord"]).collect()) == [(1, 1), (2, 1), (3, 2)]


def test_unknown_price_blocks(spark):
    from rosterline.operators.waterfall import gate, priced_estimate
    counts = spark.createDataFrame([("p", "x", 10), ("q", "x", 10)], "provider string, capability string, billable bigint")
    prices = spark.createDataFrame([("p", "x", 1.0, "found")], "provider string, capability string, credits double, charged_on string")
    out = {r["provider"]: r for r in gate(priced_estimate(counts, prices), contacts_col="billable", credits_col="credits_estimate").collect()}
    assert out["p"]["decision"] == "proceed" and out["q"]["decision"] == "blocked" and out["q"]["unknown_price"]


def test_scratch_folder_is_for_local_masters_only(monkeypatch):
    from rosterline import session

    class Conf(dict):
        def get(self, k, d=None):
            return d

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://x:7077"})()

    with pytest.raises(ValueError, match="share"):
        session.checkpoint_dir(Fake())
