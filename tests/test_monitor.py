"""Check statistics on hand-made events."""

import datetime as dt

from ledgerflow.plans import q_monitor as qm


def test_check_stats_and_health(spark, tmp_path):
    t = dt.datetime(2024, 1, 30, 11)
    rows = [(1, t, 10, "error", 4.0, None), (2, t - dt.timedelta(hours=1), 10, "view", 2.0, None), (3, t, 11, "view", 6.0, None),
            (4, t, 15, "click", None, None), (5, t - dt.timedelta(days=20), 11, "error", 1.0, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    got = {r["task_id"]: tuple(r)[1:] for r in qm.a29_check_stats(spark, str(tmp_path)).collect()}
    assert got == {"task_0": (2, 1, 1, 3.0, 4.0, 2.0, 50.0), "task_1": (1, 1, 0, 6.0, 6.0, 6.0, 100.0)}
    health = qm.c15_overall_health(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in health] == [(1, 1, 1, "critical")]
