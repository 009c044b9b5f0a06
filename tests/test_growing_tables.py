"""The registry and other tables that grow by batches; deduplication against them."""

import hashlib
import random

from pyspark.sql import functions as F

from folioforge.operators import dedup, extraction
from folioforge.sources import files
from folioforge.sources.batches import Batches, key_of
from folioforge.sources.registry import Registry, _log16


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def entries(spark, numbers):
    return spark.createDataFrame([(str(i), sha(i)) for i in numbers], "doc_id string, content_hash string")


def hashes(spark, numbers):
    return spark.createDataFrame([(sha(i),) for i in numbers], "content_hash string")


def test_only_folders_that_may_hold_a_hash_are_read(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    assert registry.folders(hashes(spark, [1])) == [] and registry.rows().count() == 0
    registry.append(entries(spark, range(300)), "a")
    registry.append(entries(spark, range(300, 600)), "b")
    assert registry.folders(hashes(spark, range(10_000, 10_003))) == []
    found = registry.folders(hashes(spark, [5, 450]))
    assert [(f.split("batch=")[1][0], f[-1]) for f in found] == sorted([("a", sha(5)[0]), ("b", sha(450)[0])])
    read = registry.candidates(hashes(spark, [5, 450]))
    assert len(read.inputFiles()) == 2 and len(registry.rows().inputFiles()) > 20
    assert registry.folders(hashes(spark, [5, 450]), without="a") == found[1:]


def test_flags_and_new_entries_equal_those_of_a_plain_table(spark, tmp_path):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, None if i % 50 == 7 else str(rng.randrange(200))) for i in range(300)], "doc_id bigint, text string")
    known = spark.createDataFrame([(str(i), sha(i)) for i in range(0, 250, 2)] + [("n", None)], "doc_id string, content_hash string")
    registry = Registry(spark, str(tmp_path / "r"))
    for odd in (0, 1):
        registry.append(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == odd))
    flags = lambda r: sorted((x.doc_id, x.is_duplicate) for x in dedup.flag_duplicates(docs, r).collect())
    new = lambda r: sorted((x.doc_id, x.content_hash or "") for x in dedup.new_entries(docs, r).collect())
    assert flags(registry) == flags(known) and new(registry) == new(known)
    assert flags(Registry(spark, str(tmp_path / "none"))) == flags(None)


def test_sketches_of_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("folioforge.sources.registry.BLOCK_HASHES", 20)
    monkeypatch.setattr("folioforge.sources.registry.FOLDER_ROWS", 10)
    registry = Registry(spark, str(tmp_path / "r"))
    registry.append(entries(spark, range(2000)), "a")
    registry.append(entries(spark, range(2000, 2010)), "b")
    found = {r.content_hash for r in registry.candidates(hashes(spark, range(1990, 2020))).collect()}
    assert {sha(i) for i in range(1990, 2010)} <= found
    assert any(len(f.rsplit("=", 1)[1]) > 1 for f in registry.folders(hashes(spark, range(100))))
    assert [_log16(x) for x in (0, 1, 2, 16, 17)] == [0, 0, 1, 1, 2]


def test_a_job_that_runs_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "r")
    for _ in range(2):
        files.append_registry(entries(spark, range(20)), path)
        files.append_registry(entries(spark, range(20, 30)), path, "night")
    files.append_registry(entries(spark, range(21, 40)), path, "night")
    assert sorted(int(r.doc_id) for r in files.read_registry(spark, path).collect()) == sorted([*range(20), *range(21, 40)])
    assert files.read_registry(spark, path, "night").count() == 20


def test_compaction_keeps_rows_and_merges_files(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"))
    for i in range(5):
        registry.append(entries(spark, range(10 * i, 10 * i + 10)), f"b{i}")
    before, files_before = sorted(registry.rows().collect()), len(registry.rows().inputFiles())
    registry.compact()
    assert sorted(registry.rows().collect()) == before and len(registry.rows().inputFiles()) < files_before / 2
    assert len(registry.batches.names()) == 1 and registry.folders(hashes(spark, [3])) and not registry.folders(hashes(spark, [777]))


def test_replaced_batches_are_not_read_while_they_are_still_there(spark, tmp_path, monkeypatch):
    table = Batches(spark, str(tmp_path / "t"))
    rows = lambda *x: lambda to: spark.createDataFrame([(i,) for i in x], "i int").write.parquet(to)
    monkeypatch.setattr(Batches, "remove", lambda self, names: None)  # as if the job died before it removed them
    table.publish("a", rows(1, 2))
    table.publish("b", rows(3))
    table.publish("a", rows(1, 4))
    assert sorted(r.i for r in table.read("i int").collect()) == [1, 3, 4]
    table.compact("i int")
    assert sorted(r.i for r in table.read("i int").collect()) == [1, 3, 4] and len(table.names()) == 1
    assert key_of("batch=a-1+00ff") == "a-1"


def test_quarantine_of_a_job_that_runs_again(spark, tmp_path):
    path, kind = str(tmp_path / "q"), "name string, response string"
    rows = spark.createDataFrame([("1_raw", "x"), ("2_raw", "y")], kind)
    for _ in range(2):
        files.write_quarantine(rows, path)
    files.write_quarantine(rows.limit(1), path, "other")
    assert files.read_quarantine(spark, path, kind).count() == 3
    files.compact_quarantine(spark, path, kind)
    again = files.read_quarantine(spark, path, kind)
    assert again.count() == 3 and len(again.inputFiles()) == 1


def test_ties_between_rows_are_decided(spark):
    kind = "doc_id int, text string, extra string"
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "x"), (1, "a", "x"), (2, "a", "z"), (None, "b", None), (3, "b", "q"), (4, None, "w"), (5, None, "w"), (6, "", "w")]
    runs = [sorted(map(str, dedup.dedup_exact(spark.createDataFrame(r, kind).repartition(n), keep=["doc_id", "extra"]).collect())) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert runs[0] == runs[1] and len(runs[0]) == 4
    assert dedup.dedup_exact(spark.createDataFrame([], kind)).count() == 0


def test_no_text_is_sorted(spark, capsys):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    dedup.dedup_exact(docs).explain("formatted")
    plan = capsys.readouterr().out
    sorts = [part for part in plan.split("\n\n") if "Sort" in part.split("\n")[0] and part.startswith("(")]
    assert sorts and not any("text" in s for s in sorts) and "ShuffledHashJoin" in plan


def test_documents_without_text_have_a_row(spark):
    pages = spark.createDataFrame([(1, 1, " "), (1, 2, None), (2, 1, ""), (2, 2, "b ")], "doc_id int, page_no int, text string")
    for skip in (True, False):
        assert {r.doc_id: r.text for r in extraction.assemble_pages(pages, skip).collect()} == {1: "", 2: "b"}
    parts = spark.createDataFrame([(1, "paragraph", 0, 0, " "), (1, "table", 1, 0, None), (2, "table", 0, 0, "x"), (2, "table", 0, 1, " "), (2, "table", 0, 2, "y"), (2, "paragraph", 1, 0, "z")], "doc_id int, kind string, row_no int, cell_no int, text string")
    assert {(r.doc_id, r.text, r.engine) for r in extraction.assemble_blocks(parts, 3).collect()} == {(1, "", "failed"), (2, "z\nx | y", "blocks")}
