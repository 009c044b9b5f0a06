"""Scores of many and of large records and texts, in bounded parts."""

import pandas as pd
from pyspark.sql import functions as F

from folioforge.functions.plan import BATCH_BYTES
from folioforge.operators import record_eval, text_eval

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_parts_of_a_batch_hold_all_rows_once(monkeypatch):
    monkeypatch.setattr(record_eval, "PAIRS_AT_ONCE", 10)
    truth, found = pd.Series([["a"] * n for n in (3, 0, 9, 1, 1)]), pd.Series([["b"] * n for n in (2, 5, 9, 1, 0)])
    parts = [(s.start, s.stop) for s in record_eval._slices(truth, found)]
    assert [i for a, b in parts for i in range(a, b)] == list(range(5)) and len(parts) > 1
    assert [(s.start, s.stop) for s in record_eval._slices(truth[:0], found[:0])] == [(0, 0)]


def test_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    kind = "cand_id int, model string, gt struct<education: array<struct<institution: string, degree: string>>>, pred struct<education: array<struct<institution: string, degree: string>>>"
    entry = lambda i: (f"Institute {i % 7}", f"Degree {i % 3}")
    rows = [(i, "m", ([entry(i + k) for k in range(i % 5)],), ([entry(i + k + 1) for k in range(i % 4)],)) for i in range(60)]
    pairs = spark.createDataFrame(rows, kind).coalesce(1)
    spark.conf.unset(SETTING)
    found = lambda: sorted(map(tuple, record_eval.list_scores(pairs, "education", record_eval.EDUCATION_KEY, ["institution", "degree"]).collect()), key=lambda r: r[0])
    whole = found()
    assert 0 < int(spark.conf.get(SETTING)) <= BATCH_BYTES and len(whole) == 60
    monkeypatch.setattr(record_eval, "PAIRS_AT_ONCE", 3)
    truth, pred = (pd.Series([[f"{a} {b}".lower() for a, b in r[side][0]] for r in rows]) for side in (2, 3))
    together = record_eval._matches(list(zip(truth, pred, strict=True)), 0.5)
    assert [m for s in record_eval._slices(truth, pred) for m in record_eval._matches(list(zip(truth[s], pred[s], strict=True)), 0.5)] == together


def test_texts_are_scored_in_bounded_batches(spark):
    pairs = spark.createDataFrame([(1, "a", "one two", "one two")], "doc_id int, tool string, gt string, pred string")
    for f in (text_eval.score_texts, text_eval.bleu4):
        spark.conf.unset(SETTING)
        assert f(pairs).filter(F.col("bleu") > 0).count() == 1
        assert 0 < int(spark.conf.get(SETTING)) <= BATCH_BYTES
