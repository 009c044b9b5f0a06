"""Steps that grew faster than their rows: what a resolved attempt and an unmatched entry take."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import record_eval, validation
from folioforge.plans import queries as plans


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unmatched_entries_are_found_in_their_rows(spark):
    kind = "cand_id string, model string, gt struct<education: array<struct<institution: string, degree: string>>>, pred struct<education: array<struct<institution: string, degree: string>>>"
    lists = [([("a", "x"), ("q", "zzz")], [("a", "x"), ("a", "x")]), ([], [("b", "y")]), (None, None), ([("c", "z")], None), ([(None, "")], [("", None)])]
    pairs = spark.createDataFrame([(f"R-{i}", "m", (a,), (b,)) for i, (a, b) in enumerate(lists)], kind)
    key = record_eval.EDUCATION_KEY
    rows = record_eval.unmatched_in_rows(pairs, "education", key)
    assert sorted((r.cand_id, r.side, r.at) for r in rows.collect()) == [("R-0", "gt", 1), ("R-0", "pred", 1), ("R-1", "pred", 0), ("R-3", "gt", 0)]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, record_eval.unmatched_entries(pairs, record_eval.match_entries(pairs, "education", key), "education").collect()))
    assert "Join" not in _plan(rows)


def test_r6_pairs_profiles_once(spark, tmp_path):
    """The profiles are paired once: their tables are scanned once for each use, not once for each side as well."""
    text = _plan(plans.r6_unmatched_entries(spark, "/root/testdata/sf0.001"))
    assert text.count("Join LeftAnti") == 0
    assert text.count("Relation") == _plan(plans._pairs(spark, "/root/testdata/sf0.001").filter("there").select("cand_id", "model", F.size("gt.education"), F.size("pred.education"))).count("Relation")


def test_only_what_is_asked_for_is_repaired(spark):
    rows = spark.createDataFrame([(1, 1, "no"), (1, 2, '{"personal_information": {"full_name": " A "}}'), (2, 1, "{"), (2, 4, "{}")], "doc_id bigint, attempt int, response string")
    found = validation.first_valid_profiles(rows)
    assert sorted((r.doc_id, r.status, r.attempts, r.n) for r in found.select("doc_id", "status", "attempts", F.col("personal_information.full_name").alias("n")).collect()) == [(1, "success", 2, "A"), (2, "failed", 1, None)]
    for query in (plans.v9_first_valid_profiles, plans.v9_resolve_attempts, plans.v10_attempt_summary):
        text = _plan(query(spark, "/root/testdata/sf0.001"))
        assert "postdoc" not in text and "board_university" not in text


def test_what_is_bare_json_stays_and_the_rest_is_cleaned(spark):
    given = ["{}", " {} ", "```json\n{}\n```", "Output: {1}", "{", "}", "{a} b}", "x{a} b}y", None, "", "{ ``` }", "```{ ``` }"]
    whole = F.coalesce(F.col("t"), F.lit(""))
    row = spark.createDataFrame([(t,) for t in given], "t string").select(validation.clean_response(F.col("t")).alias("a"), validation.slice_object(validation.strip_prefixes(validation.strip_fences(whole))).alias("b")).collect()
    assert [r.a for r in row] == [r.b for r in row]


def test_a_text_is_json_only_to_its_end(spark):
    given = ["{}", "[1], [2", '1], ["x"', "1, 2", '1,"x"', "null", "{} {}", "[]", '{"a": [1, 2]}', ""]
    row = spark.createDataFrame([(t,) for t in given], "t string").select(validation.parse_strict(F.col("t")).cast("string").alias("v"), validation.parse_strict(F.col("t")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in row] == [True, False, False, False, False, True, False, True, True, False]
