"""The table that a stream keeps: its rows, its number of folders, batches that run again or are cut off."""

import os

import pytest
from pyspark.sql import functions as F

from costlens.operators.results import last_wins
from costlens.streaming import log

KEYS = ["k"]


def batch(spark, number, rows=40):
    """Keys of which most come again in each batch, the position rising with the batch."""
    return spark.range(rows).select((F.col("id") * 7 + number % 3).alias("k"), (F.col("id") + F.lit(number) * 1000).alias("seq"), F.lit(number).alias("from_batch"))


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "seq", "from_batch").collect())


def want(spark, numbers):
    out = batch(spark, numbers[0])
    for n in numbers[1:]:
        out = out.unionByName(batch(spark, n))
    return rows(last_wins(out, KEYS))


def test_the_span_of_a_batch_is_the_largest_power_that_divides_the_count():
    assert [log.span_of(n, 2) for n in range(8)] == [1, 2, 1, 4, 1, 2, 1, 8]
    assert log.span_of(63, 8) == 64 and log.span_of(62, 8) == 1


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_live_folders_hold_each_batch_once_and_stay_few(fanout):
    found = []
    for n in range(300):
        span = log.span_of(n, fanout)
        found.append((n + 1 - span, n + 1))
        held = sorted(log.live(found))
        assert [b for first, end in held for b in range(first, end)] == list(range(n + 1))
        digits, m = 0, n + 1
        while m:
            digits, m = digits + 1, m // fanout
        assert len(held) <= (fanout - 1) * digits


def test_a_hundred_batches_leave_few_folders_and_the_last_rows(spark, tmp_path):
    target = str(tmp_path / "t")
    for n in range(100):
        log.write_batch(batch(spark, n), n, target, KEYS, fanout=4, grace=3)
        assert len(os.listdir(target)) <= 3 * 4 + 3 + 4
    assert rows(log.upserted(spark, target, KEYS)) == want(spark, list(range(97, 100)))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    for n in range(8):
        log.write_batch(batch(spark, n), n, target, KEYS, fanout=2, grace=0)
    before, files = rows(log.upserted(spark, target, KEYS)), sorted(os.listdir(target))
    stamps = {f: os.stat(f"{target}/{f}/_SUCCESS").st_mtime_ns for f in files}
    log.write_batch(batch(spark, 7), 7, target, KEYS, fanout=2, grace=0)
    assert rows(log.upserted(spark, target, KEYS)) == before and sorted(os.listdir(target)) == files
    assert stamps == {f: os.stat(f"{target}/{f}/_SUCCESS").st_mtime_ns for f in files}


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    target = str(tmp_path / "t")
    for n in range(3):
        log.write_batch(batch(spark, n), n, target, KEYS, fanout=4, grace=0)
    cut = tmp_path / "t" / "batches=0000000000-0000000004"  # the merge of four, without its mark of success
    cut.mkdir()
    (cut / "part-0.parquet").write_bytes(b"half a file")
    assert rows(log.upserted(spark, target, KEYS)) == want(spark, [0, 1, 2])
    log.write_batch(batch(spark, 3), 3, target, KEYS, fanout=4, grace=0)
    assert rows(log.upserted(spark, target, KEYS)) == want(spark, [0, 1, 2, 3])
    assert sorted(os.listdir(target)) == ["batches=0000000000-0000000004"]


def test_a_restarted_stream_with_state_goes_on(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "t", "p"))
    for n in range(5):
        batch(spark, n).coalesce(1).write.mode("append").parquet(source)
        stream = log.running_last(log.follow(spark, source, batch(spark, 0).schema, 1), KEYS)
        log.upsert(stream, target, progress, KEYS, fanout=2, mode="update").awaitTermination()
    assert rows(log.upserted(spark, target, KEYS)) == want(spark, list(range(5)))


def test_empty_batches_and_no_batches(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no batch"):
        log.upserted(spark, target, KEYS)
    log.write_batch(batch(spark, 0).limit(0), 0, target, KEYS)
    assert rows(log.upserted(spark, target, KEYS)) == []
    with pytest.raises(ValueError, match="fanout"):
        log.upsert(batch(spark, 0), target, target, fanout=1)
