from __future__ import annotations

from pyspark.sql import functions as F

from fieldweave.functions.rounding import half_up
from fieldweave.sources import tables as S


def test_sums_are_added_in_the_order_of_the_key(spark, tmp_path):
    """0.1 + 0.2 + 0.3 and 0.3 + 0.2 + 0.1 differ in the last bit; which one a day gets must not hang on where its rows lie."""
    rows = [(k, f"2024-01-0{day} 00:00:00", user, value) for day in (1, 2) for user in (5, 7) for k, value in enumerate((0.1, 0.2, 0.3))]
    ev = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.to_timestamp("ts"))
    for name, order in (("rising", F.col("event_id")), ("falling", F.desc("event_id"))):
        ev.orderBy(order).coalesce(1).write.parquet(f"{tmp_path}/{name}/events.parquet")
        found = {r["v"] for r in S.field_daily(spark, f"{tmp_path}/{name}").collect()}
        assert found == {0.1 + 0.2 + 0.3} != {0.3 + 0.2 + 0.1}


def test_halves_are_those_of_the_double(spark):
    x = [0.20325, 0.00005, -0.00005, 0.49994999, 1.00015, -2.5, 1e300]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    mine = [r[0] for r in df.select(half_up(F.col("x"), 4)).collect()]
    c_round = lambda v: (abs(v) * 1e4 // 1 + (abs(v) * 1e4 % 1 >= 0.5)) / 1e4 * (1 if v > 0 else -1) if abs(v) < 1e9 else v
    assert mine == [c_round(v) for v in x]
    assert 0.20325 * 1e4 < 2032.5 and mine[0] == 0.2032
    assert spark.range(1).select(half_up(F.lit(None).cast("double"), 4).alias("x")).first()[0] is None


def test_block_products_come_in_strips(spark, monkeypatch):
    """A product of two large blocks is never whole in a task: it comes in strips, which give all pairs once."""
    import numpy as np
    import pandas as pd

    from fieldweave.operators import similarity

    monkeypatch.setattr(similarity, "STRIP", 700)
    n, z = 120, np.random.RandomState(0).randn(120, 9)
    for blocks, pairs in (((0, 0), n * (n - 1) // 2), ((0, 1), (n // 2) ** 2)):
        pdf = pd.DataFrame({"block": 0 if blocks == (0, 0) else np.arange(n) % 2, "node": np.arange(n), "ts": [np.arange(9)] * n, "zs": list(z)})
        strips = list(similarity._strips(blocks, iter([pdf[:50], pdf[50:]])))
        assert len(strips) > 4 and max(r.size for _, _, r, _ in strips) <= 700
        assert sum(int(own.sum()) for *_, own in strips) == pairs
