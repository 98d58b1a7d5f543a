"""The README usage example, executed: brief → list → upsert → suppress → exclude →
qualify → email waterfall → advance → export."""

import os

from pyspark.sql import functions as F


def test_readme_flow(spark, tmp_path):
    from rosterline.operators.activate import export
    from rosterline.operators.match import apply_exclusions, crossref_master, rollup_master, suppress_master
    from rosterline.operators.qualify import (apply_qualification, qualify, score_company, score_completeness,
                                              score_novelty, score_persona)
    from rosterline.operators.report import list_summary
    from rosterline.operators.upsert import advance_stage, create_lists, upsert_contacts
    from rosterline.operators.waterfall import classify_answers, email_waterfall, reverify
    from rosterline.functions.vocab import status_semantics_df
    from rosterline.sources.files import write_export_csv

    now = "2025-01-01 00:00:00"
    people = spark.createDataFrame([
        (1, 0, "Lena", "Hoffmann", "CFO", "CxO", "Nimbus Pay", "nimbuspay.example", "https://linkedin.com/in/lena", 350),
        (1, 1, "Tom", "Roth", "Analyst", "Senior", "Nimbus Pay", "nimbuspay.example", "https://linkedin.com/in/tom", 350),
        (1, 2, "Ana", "Berg", "Head of Compliance", "Director", "Tiny Co", "tiny.example", "https://linkedin.com/in/ana", 20),
    ], "list_id bigint, ord bigint, first_name string, last_name string, title string, seniority string, "
       "company_name string, company_domain string, linkedin_url string, employees int")
    touches = spark.createDataFrame([], "linkedin_url string, status string, ts timestamp_ntz, campaign_id bigint, "
                                        "first_name string, last_name string, company_name string")
    personas = spark.createDataFrame([("Economic Buyer", "CFO"), ("Compliance Champion", "Head of Compliance")],
                                     "role string, title string")
    seniority = spark.createDataFrame([("Economic Buyer", "CxO"), ("Compliance Champion", "Director")],
                                      "role string, seniority string")
    answers = spark.createDataFrame([(1, "apollo", 1, 0, "verified", "lena@nimbuspay.example"),
                                     (3, "apollo", 1, 1, "guessed", "ana@tiny.example")],
                                    "contact_id bigint, provider string, rank int, ord bigint, raw_status string, "
                                    "email string")
    validations = spark.createDataFrame([("ana@tiny.example", "invalid")], "email string, status string")

    # --- the flow ---------------------------------------------------------------
    lists = create_lists(None, spark.createDataFrame([(1, "dach-fintech-cfos")], "ord bigint, list_name string"), now)
    contacts = upsert_contacts(None, people.drop("employees"), now).drop("_inserted")
    checked = suppress_master(crossref_master(contacts.withColumnRenamed("linkedin_url", "url"),
                                              rollup_master(touches), "url")).withColumnRenamed("url", "linkedin_url")
    kept, skipped = apply_exclusions(checked.join(people.select("list_id", "ord", "employees"), ["list_id", "ord"]),
                                     titles=["analyst"])
    scored = qualify(score_novelty(score_completeness(score_company(
        score_persona(kept.unionByName(skipped), personas, seniority))), "status"))
    decided = apply_qualification(scored, F.lit(False))
    contacts = advance_stage(contacts, decided.select("list_id", "id", "stage", "qualification_score",
                                                      "matched_persona", "qualification_notes"), now).drop("_updated")
    semantics = status_semantics_df(spark).where("capability = 'email_enrich'")
    found = email_waterfall(contacts.where("stage = 'qualified'").select(F.col("id").alias("contact_id")),
                            reverify(classify_answers(answers, semantics), validations))
    contacts = advance_stage(contacts, found.select(F.lit(1).cast("bigint").alias("list_id"),
                                                    F.col("contact_id").alias("id"),
                                                    F.lit("email_enriched").alias("stage"), "email", "email_source"),
                             now).drop("_updated")
    out = str(tmp_path / "export")
    write_export_csv(export(contacts, "email_enriched"), out)
    # --------------------------------------------------------------------------------

    summary = list_summary(lists, contacts).collect()[0]
    # Lena and Ana qualify; Tom is excluded. Ana's guessed email fails validation, and
    # she still advances with email_source = not_found.
    assert (summary["email_enriched"], summary["skipped"], summary["total_contacts"]) == (2, 1, 3)
    rows = spark.read.option("header", "true").csv(out).collect()
    assert sorted((r["first_name"], r["email"]) for r in rows) == [("Ana", None), ("Lena", "lena@nimbuspay.example")]
    src = {r["id"]: r["email_source"] for r in contacts.where("stage = 'email_enriched'").collect()}
    assert sorted(src.values()) == ["apollo", "not_found"]
    assert os.path.isdir(out)
