"""Sinks that resume, streams that keep bounded state, and greedy choice in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from overfly.operators import fit
from overfly.sources import ledger
from overfly.streaming.extremes import extremes_stream


def test_ledger_writes_each_key_once_though_a_run_dies(spark, tmp_path, monkeypatch):
    at, d = str(tmp_path / "l"), spark.createDataFrame([(i, f"v{i}") for i in range(50)] + [(7, "other"), (None, "n"), (None, "n2")], "k int, v string")
    assert ledger.append(d.filter("k < 10"), at, ["k"], 8) == 10
    # Data without a commit: nobody reads it, and the next run deletes it.
    name, n = ledger.write_batch(d, at, ["k"], 8)
    assert n == 41 and ledger.committed(spark, at, d.schema).count() == 10
    assert ledger.append(d, at, ["k"], 8) == 41
    assert ledger.append(d, at, ["k"], 8) == 0
    got = [r["k"] for r in ledger.committed(spark, at, d.schema).collect()]
    assert sorted(x for x in got if x is not None) == list(range(50)) and got.count(None) == 1
    assert name not in str(list((tmp_path / "l" / "data").iterdir()))
    assert ledger.committed(spark, str(tmp_path / "none"), d.schema).count() == 0


def test_a_batch_meets_only_its_buckets(spark, tmp_path):
    at, d = str(tmp_path / "l"), spark.range(2000).withColumnRenamed("id", "k")
    ledger.append(d, at, ["k"], 16)
    c = ledger.committed(spark, at, d.schema)
    plan = c.filter(F.col("_bucket").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert 0 < c.filter("_bucket = 3").count() < 400 and c.select("_bucket").distinct().count() == 16


def test_stream_keeps_the_extremes_over_a_restart(spark, tmp_path):
    r = random.Random(3)
    rows = [(m, "01", f"f{i}", i, r.randrange(20)) for m in ("a", "b") for i in range(200)]
    schema = "method string, flight string, filename string, seq long, inliers long"
    last = {}

    def each(batch, _):
        for x in batch.collect():
            last.setdefault((x["method"], x["side"]), {})
        got = {}
        for x in batch.collect():
            got.setdefault((x["method"], x["side"]), []).append((x["place"], x["inliers"], x["seq"]))
        last.update(got)

    def run():
        extremes_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "state"), each).awaitTermination()

    def wanted(rows):
        out = {}
        for m in ("a", "b"):
            mine = {x[3]: x for x in rows if x[0] == m}.values()
            for side, key in (("best", lambda x: (-x[4], x[3])), ("worst", lambda x: (x[4], x[3]))):
                out[m, side] = [(i + 1, x[4], x[3]) for i, x in enumerate(sorted(mine, key=key)[:3])]
        return out

    spark.createDataFrame(rows[:120] + rows[200:260], schema).repartition(3).write.parquet(str(tmp_path / "in"))
    run()
    assert {k: sorted(v) for k, v in last.items()} == wanted(rows[:120] + rows[200:260])
    # Repeats of what was seen, and the rest, after a stop.
    spark.createDataFrame(rows[100:200] + rows[250:] + rows[:5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert {k: sorted(v) for k, v in last.items()} == wanted(rows)


@pytest.mark.parametrize("limit", [60, 5])
def test_rounds_choose_as_row_by_row(spark, limit):
    r = random.Random(limit)
    rows = [(p, r.uniform(0, 90), r.uniform(0, 90), r.uniform(0, 90), r.uniform(0, 90), None if r.random() < 0.02 else r.randrange(12) / 12, i, 0, 0) for p, n in ((1, 400), (2, 30), (3, 150)) for i in range(n)]
    d = spark.createDataFrame(rows, "pair long, x0 double, y0 double, x1 double, y1 double, conf double, k1 long, k2 long, k3 long").repartition(4)
    key = lambda x: sorted((r["pair"], r["k1"]) for r in x.collect())
    want = key(fit._greedy(d, "pair", 8.0, ("k1", "k2", "k3")))
    assert key(fit.greedy_one_to_one(d, limit=limit)) == want and len(want) < len(rows)
