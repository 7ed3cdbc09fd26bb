"""The lifecycle stream with hook events: against ticks of the batch operators over a replay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import capture, lifecycle
from talkmill.operators.store import session_id
from talkmill.streaming.lifecycle import hook_events
from talkmill.streaming.lifecycle import lifecycle as lifecycle_stream

MINUTE = 60_000


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def fold(events, until):
    """Changes of one session, minute by minute: (state, event, at)."""
    state, since, out, todo = None, None, [], sorted(events)
    for now in range(0, until + 1):
        if state == "active" and now > since + 10:
            state, since = "pending_end", since + 10
            out.append((state, "IDLE_TIMEOUT", since * MINUTE, None))
        if state == "pending_end" and now > since + 360:
            state, since = "confirmed", since + 360
            out.append((state, "COOLDOWN_ELAPSED", since * MINUTE, "extract"))
        while todo and todo[0][0] == now:
            _, event = todo.pop(0)
            if event == "NEW_LINE":
                state, since = "active", now
            elif state is None or state == "active":
                state, since = "pending_end", now
            out.append((state, event, now * MINUTE, None))
    return out


def test_stream_with_hooks_is_the_fold_of_each_session(spark, tmp_path):
    rng = random.Random(3)
    events = {f"k{i}": sorted({(rng.randrange(0, 3000), "NEW_LINE") for _ in range(rng.randrange(1, 9))}) for i in range(12)}
    ends = {k: {(t + rng.randrange(1, 400), "END_SIGNAL") for t, _ in v if rng.random() < 0.4} for k, v in events.items()}
    ends = {k: {(t, e) for t, e in v if t < 3000} for k, v in ends.items()}
    lines, hooks, out = str(tmp_path / "lines"), str(tmp_path / "hooks"), str(tmp_path / "out")
    schema = "sid string, event string, t long"
    # A last event of each input moves the watermark on.
    for low, high in ((0, 900), (900, 2000), (2000, 3001), (9000, 9001)):
        some = [(k, e, t) for k, v in events.items() for t, e in v if low <= t < high] + [("last", "NEW_LINE", high - 1)]
        told = [(json.dumps({"event": "session-end", "sid": k, "ts": "1970-01-01T00:00:00Z"}), t) for k, v in ends.items() for t, _ in v if low <= t < high]
        told += [(json.dumps({"event": "session-end", "sid": "last", "ts": ""}), high - 1), ("{bad", 1), (json.dumps({"event": "session-start", "sid": "k1", "ts": ""}), 5)]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(lines)
        stamped = spark.createDataFrame(told, "line string, t long")
        when = F.date_format(F.timestamp_millis(F.col("t") * MINUTE), "yyyy-MM-dd'T'HH:mm:ss")
        stamped.select(F.regexp_replace("line", '"ts": "[^"]*"', F.concat(F.lit('"ts": "'), when, F.lit('"'))).alias("line")).coalesce(1).write.mode("append").parquet(hooks)
        e = spark.readStream.schema(schema).parquet(lines).select(session_id(F.lit("s"), F.col("sid")).alias("session_id"), "event", F.timestamp_millis(F.col("t") * MINUTE).alias("ts"))
        stream = lifecycle_stream(e, late="1 minute", hooks=hook_events(spark.readStream.schema("line string").parquet(hooks), "s"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
    ids = {r.id: r.k for r in spark.createDataFrame([(k,) for k in events], "k string").select("k", session_id(F.lit("s"), F.col("k")).alias("id")).collect()}
    got = {}
    for r in spark.read.parquet(out).orderBy("at_ms").collect():
        if r.session_id in ids:
            got.setdefault(ids[r.session_id], []).append((r.state, r.event, r.at_ms, r.work))
    want = {k: fold([*events[k], *ends[k]], 8999) for k in events}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert any("COOLDOWN_ELAPSED" in str(v) for v in want.values()) and any("END_SIGNAL" in str(v) for v in want.values())


def test_the_fold_is_that_of_ticks(spark):
    """The same by the batch operators: judge every minute that something is due, end_signals at each signal."""
    stamp = lambda t: f"1970-01-{1 + t // 1440:02d}T{t % 1440 // 60:02d}:{t % 60:02d}:00"
    events = [(5, "NEW_LINE"), (9, "END_SIGNAL"), (12, "END_SIGNAL"), (380, "NEW_LINE"), (400, "END_SIGNAL")]
    s = spark.createDataFrame([("a", "a", "active", stamp(5), None, None)], "session_id string, source_session_id string, state string, last_event_at string, pending_at string, confirmed_at string")
    states = []
    for t in sorted({5, 9, 12, 16, 369, 370, 380, 391, 400, 752, 900}):
        for at, event in events:
            if at == t and event == "END_SIGNAL":
                s = capture.end_signals(s, spark.createDataFrame([('{"event":"session-end","sid":"a"}',)], "line string"), stamp(t))
            elif at == t:
                s = s.withColumns({"state": F.lit("active"), "last_event_at": F.lit(stamp(t)), "pending_at": F.lit(None).cast("string")})
        s = lifecycle.judge(s, stamp(t))
        s = spark.createDataFrame(s.collect(), s.schema)
        states.append((t, s.first().state))
    changes = fold(events, 900)
    for t, state in states:
        assert state == [c for c in changes if c[2] <= t * MINUTE][-1][0] or any(c[2] == t * MINUTE for c in changes), (t, state)
