"""Readers, writers and the incremental registry."""

import json

from folioforge.sources import files
from folioforge.streaming.ingest import incremental_ingest


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x\r\ny\xff")
    (tmp_path / "b.md").write_text("no")
    rows = files.read_documents(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("a", "x\ny")]


def test_profiles_skip_what_is_not_readable(spark, tmp_path):
    (tmp_path / "R-1.json").write_text(json.dumps({"personal_information": {"full_name": "Ä"}, "education": [], "experience": [], "publication_summary": {"patents": 2}}, indent=1))
    (tmp_path / "R-2.json").write_text("{broken")
    rows = files.read_profiles(spark, str(tmp_path)).collect()
    assert [(r.cand_id, r.personal_information.full_name, r.publication_summary.patents) for r in rows] == [("R-1", "Ä", 2)]


def test_scan_by_suffix(spark, tmp_path):
    for name in ("a.PDF", "b.docx", "c.png"):
        (tmp_path / name).write_bytes(b"1")
    got = {r.doc_id: (r.status, r.content) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a": ("ok", b"1"), "b": ("ok", b"1"), "c": ("unsupported", None)}


def test_report_and_quarantine(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "name string, n int")
    files.write_report(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first().name == "a"
    files.write_quarantine(rows, f"{tmp_path}/q")
    assert spark.read.parquet(f"{tmp_path}/q").count() == 1


def test_second_run_of_the_same_input_adds_nothing(spark, tmp_path):
    source, registry = f"{tmp_path}/in", f"{tmp_path}/registry"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string").write.parquet(source)
    for state in ("s1", "s1", "s2"):
        incremental_ingest(spark, source, registry, f"{tmp_path}/{state}").awaitTermination()
    assert sorted(r.doc_id for r in files.read_registry(spark, registry).collect()) == ["1", "3"]
    spark.createDataFrame([(4, "b"), (5, "c")], "doc_id bigint, text string").write.mode("append").parquet(source)
    incremental_ingest(spark, source, registry, f"{tmp_path}/s1").awaitTermination()
    assert sorted(r.doc_id for r in files.read_registry(spark, registry).collect()) == ["1", "3", "5"]


def test_every_document_is_decoded_and_paired(spark):
    from folioforge.plans import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in queries.QUERIES["s2_decode_lenient"](spark, sf).collect()} == docs
    paired = {(r.doc_id, r.tool) for r in queries.QUERIES["t5_pair_texts"](spark, sf).collect()}
    assert paired == {(i, t) for i in docs for t in ("alpha", "beta", "gamma") if t != "gamma" or i % 5}
