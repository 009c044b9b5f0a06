"""NFKC in parts of a batch, and stages that look before they work."""

from __future__ import annotations

import subprocess
import sys
import tracemalloc
import unicodedata
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.functions import text as tx


def test_a_batch_is_normalised_in_parts():
    """A worker holds a part of a batch as Python strings, not all of it."""
    texts = ["é①x" * 20_000 + str(i) for i in range(60)]  # 7 MB
    batch = pa.array([None, "", *texts, "ﬁ"])
    tracemalloc.start()
    found = tx._nfkc.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == [None, "", *[unicodedata.normalize("NFKC", t) for t in texts], "fi"]
    assert peak < 6 << 20
    assert tx._nfkc.func(pa.array([], pa.string())).to_pylist() == [] and tx._nfkc.func(pa.array([None], pa.string())).to_pylist() == [None]


KEPT = """
import random
import pyarrow as pa
from folioforge.functions import text as tx

def resident():
    return int(next(l for l in open("/proc/self/status") if l.startswith("VmRSS")).split()[1]) / 1024

def batch(seed):
    rng = random.Random(seed)
    return pa.array(["é①x" * rng.randrange(1, 4_000) for _ in range(640)], pa.string())  # about 8 MB

nothing = pa.array([], pa.string())
tx._nfkc.func(pa.array(["é"]))
before = resident()
for seed in range(12):
    tx._nfkc.func(batch(seed))
tx._nfkc.func(nothing)
print(resident() - before)
"""


def test_a_batch_leaves_no_memory_behind():
    """What a worker holds does not grow with the batches that it has seen."""
    ran = subprocess.run([sys.executable, "-c", KEPT], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert float(ran.stdout) < 8, ran.stdout  # MB


def test_stages_look_before_they_work(spark):
    """Every stage and count as by its plain rule, with and without what it looks for."""
    given = ["", "\n", "a\n", "a\r\nb", "a-\nb-\nc", "a-b", "x  y   z", "•é", "a\n\n\n\nb\n", " ", "a \n", "é \n", "a\x85", "a\r", "​“”", "\t•", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    t = F.col("t")
    row = df.select("i", t, tx.line_count(t).alias("lines"), tx.bullets_to_dashes(t).alias("bullets"), tx.count_bullets(t).alias("n"), tx.count_symbols(t).alias("symbols"), tx.limit_blank_lines(t).alias("blank"), tx.collapse_spaces(t).alias("spaces"), tx.join_hyphens(t).alias("hyphens")).collect()
    for r in row:
        if r.t is None:
            assert (r.lines, r.bullets, r.n, r.blank) == (None, None, None, None)
            continue
        assert r.lines == len(r.t.splitlines()), repr(r.t)
        assert (r.bullets, r.n) == (r.t.replace("•", "-"), r.t.count("•"))
        assert r.symbols == sum(r.t.count(c) for c in tx.REPLACEMENTS)
        assert (r.blank, r.spaces) == (r.t.replace("\n\n\n\n", "\n\n"), r.t.replace("   ", " ").replace("  ", " "))
    assert next(r.hyphens for r in row if r.i == 4) == "ab-\nc"
