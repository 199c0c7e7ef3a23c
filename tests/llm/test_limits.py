"""What operators leave on disks and in workers, and what lines meet by."""

import time

import numpy as np

from millrace.llm import linededup, lm
from millrace.llm.shared import CLEANUP, written


def shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_leaves_no_shuffle_files(spark):
    had, conf = shuffled(spark), spark.conf.get(CLEANUP, None)
    df = spark.range(10_000).repartition(3, "id").groupBy("id").count()
    made = written(df, "rows")
    for _ in range(50):
        if not (left := shuffled(spark) - had):
            break
        time.sleep(0.1)
    assert not left and df.count() == made.count() == 10_000 and spark.conf.get(CLEANUP, None) == conf


def test_sketches_of_lines_that_share_enough_agree():
    rng = np.random.default_rng(3)
    n = linededup.BANDS * linededup.WIDTH
    a = rng.random((500, n), np.float32)
    share = rng.permuted(np.arange(n)[None, :].repeat(500, 0), axis=1)
    for shared, least, most in ((linededup.AGREE, 1, 1), (6, 0, 0.03), (4, 0, 0.01)):
        b = np.where(share < shared, a, rng.random((500, n), np.float32))
        part = (linededup.agreeing(linededup.sketches(a), linededup.sketches(b)) >= linededup.AGREE).mean()
        assert least <= part <= most, (shared, part)


def test_words_are_counted_over_several_flushes(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 3)
    df = spark.createDataFrame([(f"w{i} W{i % 7} v{i % 3}",) for i in range(40)] + [(None,)], "text string")
    got = {bytes(r.word): r.c for r in lm.count_words(df).collect()}
    assert got[lm.END] == 41 and sum(got.values()) == 161 and got[b"v0"] == 14 and got[b"w39"] == 1
