"""What a cleaning query holds in a Python worker, from the query down to the process."""

from __future__ import annotations

import json
import subprocess
import sys
from hashlib import sha256
from pathlib import Path

from folioforge.functions.plan import BATCH_BYTES

RUN = """
import json, os, sys
from pathlib import Path

from folioforge.functions.plan import BATCH_BYTES
from pyspark.sql import SparkSession
import __spark_entry__

folder = Path(sys.argv[1])
conf = {"spark.master": "local[1]", "spark.ui.enabled": "false", "spark.sql.files.maxPartitionBytes": "1g", "spark.sql.warehouse.dir": str(folder / "warehouse")}
spark = SparkSession.builder.config(map=conf).getOrCreate()

def worker():  # peak MB of the largest process below this one that is not a JVM
    below, peaks = {os.getpid()}, [0.0]
    found = {int(p.name): p for p in Path("/proc").iterdir() if p.name.isdigit()}
    for pid in sorted(found):
        try:
            status = dict(l.split(":", 1) for l in (found[pid] / "status").read_text().splitlines())
        except OSError:
            continue
        if int(status["PPid"]) in below:
            below.add(pid)
            if "python" in status["Name"] and "VmHWM" in status:
                peaks.append(int(status["VmHWM"].split()[0]) / 1024)
    return max(peaks)

out = []
for rows in (1_500, 10_000):
    sf_dir = f"{folder}/{rows}"
    docs = spark.range(0, rows, 1, 1).selectExpr("id as doc_id", "repeat('é①x ', 1500) as text", "'en' as lang", "'a' as source", "6000L as n_chars")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    __spark_entry__.queries()["c8_trailing"](spark, sf_dir).write.parquet(f"{sf_dir}/out")
    done = spark.read.parquet(f"{sf_dir}/out")
    out.append([worker(), done.count(), done.filter("doc_id = 0").first().text_hash])
print(json.dumps(out))
"""


def test_a_worker_holds_no_more_of_a_larger_table(tmp_path):
    """One task over 16 MB of text and one over 105 MB, in rows that all need NFKC."""
    ran = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    (small, *first), (large, *second) = json.loads(ran.stdout.splitlines()[-1])
    want = sha256(("é1x " * 1500).rstrip().encode()).hexdigest()
    assert (first, second) == ([1_500, want], [10_000, want])
    assert small > 0 and large < small + 24, (small, large)  # MB


def test_the_session_that_runs_a_query_gets_the_bound(spark):
    """Not the active one, which may be another: that left the batches of the query's own session unbounded."""
    import __spark_entry__

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    for query in ("c8_trailing", "c1_unicode", "c10_clean", "c15_summary", "d6_dedup_text", "flagship"):
        own = spark.newSession()
        df = __spark_entry__.queries()[query](own, "/root/testdata/sf0.001")
        assert df.sparkSession is own
        assert 0 < int(own.conf.get(setting, None) or 0) <= BATCH_BYTES, query
