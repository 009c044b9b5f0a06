"""Text expressions that stay fast and small on many and on long texts."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.functions.plan import BATCH_BYTES


def test_words_lines_and_nfkc_of_odd_characters(spark):
    rng = random.Random(1)
    odd = [*tx._BLANKS, "\n", "\r\n", "a", "é", "Ā", "日", "\U0001f600", "ﬁ", "​", "‧", "⁠", "᠎", "é", "Ω", "\x00", "ᙿ", "⿿"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", None]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.word_count(c).alias("w"), tx.line_count(c).alias("l"), tx.nfkc(c).alias("n"), tx.trim_lines(c).alias("r"), tx.words(c).alias("ws"))
    for t, *found in rows.collect():
        if t is None:
            assert found == [None] * 5
            continue
        lines = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", t)
        trimmed = "\n".join(x.rstrip(tx._BLANKS) for x in lines)
        want = [len(t.split()), len(t.splitlines()), unicodedata.normalize("NFKC", t), trimmed.removesuffix("\n"), t.split()]
        assert found == want, repr(t)


def test_words_of_a_long_text_take_little_time(spark):
    rows = spark.range(4).select(F.repeat(F.lit("Some words – with ä dash. "), 100_000).alias("t"))
    tx_count = lambda: [r.n for r in rows.select(tx.word_count(F.col("t")).alias("n")).collect()]
    assert tx_count() == [600_000] * 4
    began = time.time()
    tx_count()
    assert time.time() - began < 4  # 2.6 million characters each; a microsecond for each character before


def test_nfkc_bounds_its_batches_and_passes_ascii_texts_by(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(setting)
    rows = spark.createDataFrame([("a" * 100,), ("ﬁ",)], "t string").select(tx.nfkc("t").alias("n"))
    assert 0 < int(spark.conf.get(setting)) <= BATCH_BYTES
    assert [r.n for r in rows.collect()] == ["a" * 100, "fi"]
    assert "octet_length" in rows._jdf.queryExecution().optimizedPlan().toString().split("ArrowEvalPython")[1]
