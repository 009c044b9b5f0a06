"""Stored responses, and attempts that arrive in any order."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.operators import validation
from folioforge.streaming.attempts import resolve_stream

KIND = "doc_id bigint, attempt int, response string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def responses(seed=3, docs=25):
    rng = random.Random(seed)
    return [(d, a, rng.choice(["", "{}", "nope", "[1]", '{"education": 3} x'])) for d in range(docs) for a in range(1, 5)]


@pytest.fixture
def rocks(spark):
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    yield spark
    spark.conf.set(setting, before)


def decided(spark, rows, folder, parts, wait_ms=60_000, answers=None):
    """What the stream says of the rows, which come in ``parts`` batches, with a restart between any two.

    It runs until all rows are read and, if given, so many answers are there.
    """
    kind, step = "doc_id bigint, attempt int, valid boolean", -(-len(rows) // parts)
    for n in range(parts):
        piece, end = rows[n * step : (n + 1) * step], time.time() + 60
        spark.createDataFrame(piece, kind).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = resolve_stream(spark.readStream.schema(kind).parquet(f"{folder}/in"), wait_ms=wait_ms)
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").start()
        read = lambda: spark.read.schema("doc_id bigint, status string, attempts int").parquet(f"{folder}/out")
        while time.time() < end and (sum(p.numInputRows for p in query.recentProgress) < len(piece) or (answers and read().count() < answers)):  # noqa: B023
            time.sleep(0.5)
        query.stop()
    return sorted((r.doc_id, r.status, r.attempts) for r in read().collect())


def test_attempts_in_any_order_with_restarts(rocks, tmp_path):
    raw = rocks.createDataFrame(responses(), KIND)
    checked = validation.parse_responses(raw).select("doc_id", "attempt", "valid")
    want = sorted((r.doc_id, r.status, r.attempts) for r in validation.resolve_attempts(validation.validate_responses(raw)).collect())
    rows = [tuple(r) for r in checked.collect()]
    random.Random(9).shuffle(rows)
    assert decided(rocks, rows, str(tmp_path), 3) == want


def test_documents_that_wait_are_decided_by_a_timer(rocks, tmp_path):
    rows = [(1, 1, False), (2, 2, True), (3, 1, True), (4, 9, True)]
    want = [(1, "failed", 1), (2, "success", 2), (3, "success", 1)]
    assert decided(rocks, rows, str(tmp_path), 1, wait_ms=1, answers=3) == want
    assert decided(rocks, [(1, 2, True), (5, 1, True)], str(tmp_path), 1, wait_ms=1, answers=4) == [*want, (5, "success", 1)]  # the first comes too late


def test_stored_responses(spark, tmp_path):
    raw = spark.createDataFrame(responses(), KIND)
    for _ in range(2):
        validation.store_parsed(validation.parse_responses(raw), str(tmp_path), "night")
    stored = validation.read_parsed(spark, str(tmp_path))
    rows = lambda df: sorted(map(str, df.collect()))
    names = ["doc_id", "attempt", "valid", "education", "publication_summary", "normalized_highest_degree"]
    assert rows(validation.repair_parsed(stored, ["doc_id", "attempt", "valid"]).select(names)) == rows(validation.validate_responses(raw).select(names))
    names = ["doc_id", "status", "attempts", "education", "normalized_highest_degree"]
    assert rows(validation.resolve_parsed(stored).select(names)) == rows(validation.resolve_responses(raw).select(names))


def test_a_response_is_parsed_once(spark, tmp_path, capsys):
    raw = spark.createDataFrame(responses(docs=2), KIND)
    validation.parse_responses(raw).explain()
    assert capsys.readouterr().out.count("parse_json") <= 1
    validation.store_parsed(validation.parse_responses(raw), str(tmp_path), "a")
    validation.read_parsed(spark, str(tmp_path)).select(validation.int_at(F.col("value"), "$.publication_summary.patents").alias("n")).explain()
    plan = capsys.readouterr().out
    assert "parse_json" not in plan and "response" not in plan.split("ReadSchema")[1]


def test_strict_parsing_reads_to_the_end(spark):
    texts = ["1", "[1]", "1] x", "[1] x]", '1,"a"', "1,2", '{"a":1} {"b":2}', '{"a":1}]', '"a', "", " ", None, "null", '{"a":1,"a":2}', '1,"x"] junk', "  {} \n", "tru", "nan", '"\\u00e9"']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    good = {r.i for r in rows.select("i", validation.parse_strict(F.col("t")).isNotNull().alias("ok")).filter("ok").collect()}
    assert {texts[i] for i in good} == {"1", "[1]", "null", '{"a":1,"a":2}', "  {} \n", '"\\u00e9"'}
