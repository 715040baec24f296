"""Streams over several batches: state that goes with closed windows, and merges that touch few buckets, also after a restart."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import bounded

SCHEMA = "ts timestamp, event_type string, value double, user_id long"
DAY = datetime.datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")


def hours(*h, kind="a", user=1):
    return [(DAY + datetime.timedelta(hours=x), kind, 1.0, user) for x in h]


def test_state_stops_growing(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for k in range(6):  # four hours in each batch, a kind for each
        write(spark, folder, f"p{k}", [r for h in range(4) for r in hours(4 * k + h + 0.5, kind="ab"[h % 2]) * 3])
    query = bounded.append_to(bounded.closed_windows(stream(spark, folder)), f"{folder}/out")
    held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert len(held) >= 6 and max(held) <= 8 and held[-1] <= 3
    got = {(r["started"].hour, r["n"]) for r in spark.read.parquet(f"{folder}/out/rows").collect()}
    assert got == {(h, 3) for h in range(21)}  # the watermark is 21:30: windows that end later are open


def test_late_rows_and_a_restart(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write(spark, folder, "p0", hours(0.5, 9.5))
    bounded.append_to(bounded.closed_windows(stream(spark, folder)), f"{folder}/out")
    write(spark, folder, "p1", hours(0.6, 8.5, 20.5))  # the first is too late, its window was written
    bounded.append_to(bounded.closed_windows(stream(spark, folder)), f"{folder}/out")
    got = sorted((r["started"].hour, r["n"]) for r in spark.read.parquet(f"{folder}/out/rows").collect())
    assert got == [(0, 1), (8, 1), (9, 1)]


@pytest.fixture
def table(spark, tmp_path):
    return bounded.LatestTable(spark, f"file://{tmp_path}/t", "k", "at", buckets=8)


def rows(spark, *r):
    return spark.createDataFrame(list(r), "k long, at long, text string")


def content(spark, table):
    return sorted(tuple(r) for r in table.read("k long, at long, text string").collect())


def test_a_batch_rewrites_what_it_touches(spark, table):
    assert content(spark, table) == [] and table.vacuum() == 0
    table.merge(rows(spark, *[(k, 1, f"a{k}") for k in range(40)], (None, 9, "x"), (3, 5, "new")), 0)
    touched = table.merge(rows(spark, (1, 2, "b1"), (3, 4, "old"), (100, 1, "c")), 1)
    assert 1 <= len(touched) <= 3 and {b for b, v in table.versions().items() if v == 1} == set(touched)
    want = sorted([*((k, 1, f"a{k}") for k in range(40) if k not in (1, 3)), (1, 2, "b1"), (3, 5, "new"), (100, 1, "c")])
    assert content(spark, table) == want
    assert table.vacuum() == len([b for b in touched if b in range(8)]) and content(spark, table) == want


def test_a_batch_that_dies_or_comes_again(spark, table):
    table.merge(rows(spark, (1, 1, "a"), (2, 1, "b")), 0)
    bad = rows(spark, (1, 2, "z")).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, 1)
    again = bounded.LatestTable(spark, table.base, "k", "at", buckets=8)  # another process
    assert content(spark, again) == [(1, 1, "a"), (2, 1, "b")]
    assert again.merge(rows(spark, (1, 2, "c")), 1) and again.merge(rows(spark, (1, 3, "d")), 1) == []
    assert content(spark, table) == [(1, 2, "c"), (2, 1, "b")]


def test_follow_after_a_restart(spark, tmp_path):
    folder = f"file://{tmp_path}"
    for name, batch in (("p0", hours(1, user=1) + hours(2, user=2)), ("p1", hours(5, user=1))):
        write(spark, folder, name, batch)
        table = bounded.LatestTable(spark, f"{folder}/t", "user_id", "ts", buckets=4)
        table.follow(stream(spark, folder).select("user_id", "ts"))
    assert {(r["user_id"], r["ts"].hour) for r in table.read("user_id long, ts timestamp").collect()} == {(1, 5), (2, 2)}
