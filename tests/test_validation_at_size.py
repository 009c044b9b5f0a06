"""Responses cleaned as before by fewer passes over their texts, and the work that is left out."""

import random

from pyspark.sql import functions as F

from folioforge.functions import degrees as dg
from folioforge.functions.text import WHITE_SPACE
from folioforge.operators import validation
from folioforge.operators.degrees import enrich_profiles


def plain_cleaned(t):
    """clean_response step by step in Python."""
    t = t.strip(WHITE_SPACE)
    if t[:7].lower() == "```json":
        t = t[7:]
    elif t.startswith("```"):
        t = t[3:]
    t = t.strip(WHITE_SPACE).removesuffix("```").strip(WHITE_SPACE)
    for p in validation.PREFIXES:
        if t.lower().startswith(p.lower()):
            t = t[len(p) :].strip(WHITE_SPACE)
    if "{" in t and "}" in t:
        t = t[t.index("{") : max(t.index("{"), t.rindex("}") + 1)]
    return t.strip(WHITE_SPACE)


def test_responses_are_cleaned_step_by_step(spark):
    rng = random.Random(3)
    parts = ["```json", "```", "```JSON", "{", "}", "{}", " ", "\n", "　", "\x85", "a", "ä", "[1]", '{"a": 1}', "Output:", "here IS the json:", "ANSWER:", "K", "İ", "Out"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", validation.clean_response(F.col("t")).alias("c"))
    for t, c in rows.collect():
        assert c == plain_cleaned(t), repr(t)


def test_degree_is_lowered_once_and_named_once(spark):
    rows = spark.createDataFrame([("Ph.D.",)], "degree string").select(F.array(F.struct("degree")).alias("education"))
    plan = enrich_profiles(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(trim(") == 1
    assert enrich_profiles(rows).first().normalized_highest_degree == "Ph.D."
    assert [r.n for r in spark.createDataFrame([(None,), (" ",), ("M.Ed",)], "d string").select(dg.normalize_degree(F.col("d")).alias("n")).collect()] == ["Other", "Other", "M.E."]


def test_an_empty_response_is_not_valid(spark):
    rows = spark.createDataFrame([("",), (" ",), ("[]",), (None,)], "t string").select(validation.parse_strict(F.col("t")).isNotNull().alias("ok"))
    assert [r.ok for r in rows.collect()] == [False, False, True, False]
