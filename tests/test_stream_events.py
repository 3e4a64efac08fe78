"""The registered streams read every event the batch queries read."""

from callbrook.plans import call_queries as cq
from callbrook.plans import stream_queries as sq


def test_streams_read_partial_and_final_events(spark, sf):
    events = sq._events(spark, sf)
    kinds = {r["is_final"]: r["count"] for r in events.groupBy("is_final").count().collect()}
    n = cq.turns(spark, sf).count()
    assert kinds == {True: n, False: n}


def test_stream_sql_is_the_batch_sql_over_all_events():
    for name in ("signals_stream", "nudges_stream", "expired_nudges_stream", "session_counters_stream"):
        assert cq.SQL_EVENTS in sq.ORACLE[name]
