"""Sources, streams, text and scope on small fixtures."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from talkmill.functions import text as X
from talkmill.functions.scope import Scope, assemble, merge
from talkmill.operators import extract, lifecycle, related, search, store
from talkmill.sources import chat_logs, discovery
from talkmill.streaming.lifecycle import lifecycle as lifecycle_stream

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MESSAGES = "session_id string, seq_num long, role string, content string, created_at string"


def test_parse_query():
    assert search.parse_query('fix "hot path" build') == [["hot", "path"], ["fix"], ["build"]]
    assert search.parse_query("Ｆｏｏ　bar") == [["foo"], ["bar"]]
    assert search.parse_query("数据库 库") == [["数", "据", "库"]] and search.parse_query("库") == [["库"]] and search.parse_query("  ") == []


def test_phrases_are_counted_by_position(spark):
    texts = ["a b a b c", "b a", "", None, "a a a", "ab a.B/a_b", "库a 数据 库，数据库x", "xa b", "a bx", "Ａ　Ｂ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    units = [["a", "b"], ["a"], ["a", "a"], ["数", "据", "库"], ["库", "a"]]
    got = [tuple(r.c) for r in rows.select("id", X.term_counts(F.col("t"), units).alias("c")).orderBy("id").collect()]

    def want(text):
        terms = search.TERM.findall((text or "").replace("Ａ", "a").replace("Ｂ", "b").lower())
        return (len(terms), *(sum(terms[i : i + len(u)] == u for i in range(len(terms))) for u in units))

    assert got == [want(t) for t in texts]


def test_search_limits(spark):
    m = spark.createDataFrame([("s1", 1, "user", "alpha beta", None)], MESSAGES)
    s = spark.createDataFrame([("s1", "t", "")], "session_id string, title string, meta_text string")
    assert search.search_sessions(m, s, "", None).count() == 0 and search.search_sessions(m, s, "alpha", None, 0).count() == 0
    assert [r.session_id for r in search.search_sessions(m, s, "alpha", None).collect()] == ["s1"]
    with pytest.raises(ValueError):
        search.search_sessions(m, s, "alpha", None, -1)


def test_segments_of_mixed_text(spark):
    row = spark.range(1).select(X.segment(F.lit("修复 src/App.ts 数据"), False).alias("q"), X.segment(F.lit("修复 a_b"), True).alias("i")).first()
    assert row.q == ["修复", "src/app.ts", "数据"] and row.i == ["修", "复", "a_b"]


def test_scope(spark):
    rows = spark.createDataFrame(
        [("a", ["x"], None, ["src/A_b.ts"], "s0", "2024-01-02"), ("b", None, ["k"], None, "s1", None)],
        "session_id string, topics array<string>, user_tags array<string>, files_mentioned array<string>, source string, created_at string",
    )
    ids = lambda c: [r.session_id for r in rows.filter(c).orderBy("session_id").collect()]
    assert ids(Scope(topics=("x", "z")).column()) == ["a"] and ids(Scope(files=("SRC/a_",)).column()) == ["a"] and ids(Scope(files=("src/a%",)).column()) == []
    assert ids(Scope(since="2024-01-01").column()) == ["a"] and ids(Scope(tags=("k",)).negated()) == ["a"]
    assert ids(assemble(Scope(topics=("x",)), ignore=Scope(sources=("s1",)), full=True)) == ["a"] and ids(assemble()) == ["a", "b"]
    assert merge(Scope(topics=("a",), since="1"), Scope(topics=("b", "a"), since="2")) == Scope(topics=("a", "b"), since="2")


def test_typed_lines(spark):
    lines = ['{"type":"user","message":{"content":"hi"}}', "{oops", '{"type":"user","isSidechain":true,"message":{"content":"no"}}', '{"type":"system","message":{"content":"x"}}',
             '{"type":"assistant","message":{"content":[{"type":"text","text":"a"},{"type":"tool_use"},{"type":"text","text":"b"}]}}', '{"type":"user","message":{"content":"  "}}']
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines, 1)], "source_file string, line_no long, line string")
    got = chat_logs.typed_lines(rows).orderBy("seq_num").collect()
    assert [r.kind for r in got] == ["message", "bad", "skip", "skip", "message", "skip"] and got[0].content == "hi" and got[4].content == "a\nb"


def test_glob_rules(spark):
    rows = spark.createDataFrame([("s", "1", None, "a/b/c.jsonl"), ("s", "2", "keep", "a/x.jsonl"), ("t", "3", "top secret", "d\\e.txt")], "source string, source_session_id string, title string, source_file string")
    kept = lambda rules: [r[0] for r in rows.filter(~chat_logs.ignored(rules)).select("source_session_id").orderBy("source_session_id").collect()]
    assert kept(["a/*.jsonl"]) == ["1", "3"] and kept(["a/**"]) == ["3"] and kept(["d/"]) == ["1", "2"]
    assert kept(["title:secret"]) == ["1", "2"] and kept(["session:s/1", "# x", ""]) == ["2", "3"] and kept([]) == ["1", "2", "3"]


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 5)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" if i % 7 else "\n" for i in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = chat_logs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == sum(1 for n in (3000, 5) for i in range(1, n + 1) if i % 7)
    assert all(r.line.endswith(f" {r.line_no}") and r.source_file.endswith(r.line.split(" ")[0]) for r in rows)


def test_related_to_an_unknown_session(spark):
    s = spark.createDataFrame([("a", "t", "confirmed", ["x"], ["y"], ["f"])], "session_id string, title string, state string, topics array<string>, user_tags array<string>, files_mentioned array<string>")
    v = spark.createDataFrame([("a", [1.0, 0.0])], "session_id string, vec array<float>")
    assert related.related(s, v, "absent").count() == 0 and related.semantic_hits(None, "x") is None


def test_sources_are_checked(spark):
    sources = discovery.Sources()
    for name, fn in (("", lambda: None), ("x", None)):
        with pytest.raises(ValueError):
            sources.register(name, fn)
    with pytest.raises(KeyError):
        sources.all(["absent"])


def test_a_held_part_is_read_again(spark):
    m = spark.createDataFrame([("a", i, f"m{i}", t, '{"role":"user"}') for i, t in ((1, 10), (2, 900_000), (3, 900_001))], "session_id string, rowid long, id string, time_created long, data string")
    text = lambda *ids: spark.createDataFrame([(f"m{i}", 0, '{"type":"text","text":"t%d"}' % i) for i in ids], "message_id string, sequence int, data string")
    given, cursors = chat_logs.joined_parts(m, text(1, 3), 1_000_000)
    assert sorted(r.content for r in given.collect()) == ["t1", "t3"] and cursors.first().cursor == 1
    given, cursors = chat_logs.joined_parts(m, text(1, 2, 3), 1_000_000, cursors)
    assert sorted(r.content for r in given.collect()) == ["t2", "t3"] and cursors.first().cursor == 3
    given, cursors = chat_logs.joined_parts(m, text(1, 3), 2_000_000)
    assert cursors.first().cursor == 3  # too old to wait for


def test_lifecycle_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session_id string, event string, ts timestamp"

    def step(rows):
        spark.createDataFrame(rows, "session_id string, event string, at string").selectExpr("session_id", "event", "cast(at as timestamp) ts").coalesce(1).write.mode("append").parquet(source)
        stream = lifecycle_stream(spark.readStream.schema(schema).parquet(source), late="1 minute")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)

    step([("a", "NEW_LINE", "2024-01-01 10:00:00")])
    step([("b", "NEW_LINE", "2024-01-01 23:00:00")])
    got = [(r.state, r.event) for r in spark.read.schema("session_id string, state string, event string, at_ms long").parquet(out).filter("session_id = 'a'").orderBy("at_ms").collect()]
    assert ("pending_end", "IDLE_TIMEOUT") in got and got[-1] == ("confirmed", "COOLDOWN_ELAPSED")


def test_replay_counts_illegal_events(spark):
    events = spark.createDataFrame([("a", "1", "IDLE_TIMEOUT"), ("a", "2", "COOLDOWN_ELAPSED"), ("a", "3", "COOLDOWN_ELAPSED")], "session_id string, ts string, event string")
    row = lifecycle.replay(events).first()
    assert row.state == "confirmed" and row.events == 3 and row.illegal == 1


def test_new_messages_keep_one_of_each_key(spark):
    rows = spark.createDataFrame([("a", 1, "user", "x", None), ("a", 1, "user", "b", None), ("a", 2, "user", None, None)], MESSAGES)
    assert sorted((r.seq_num, r.content) for r in store.new_messages(rows).collect()) == [(1, "b"), (2, None)]
    assert store.new_messages(rows, rows).count() == 0


@pytest.mark.parametrize("extractor", [extract.files, extract.topics, extract.decisions, extract.questions, extract.code_blocks, extract.key_exchanges])
def test_extractors_take_nulls_and_empty_tables(spark, extractor):
    rows = spark.createDataFrame([("a", 1, "user", None, None), ("a", 2, None, "", None), (None, 3, "user", "x", None)], MESSAGES)
    extractor(rows).collect()
    assert extractor(rows.limit(0)).count() == 0


def test_entry_works_without_the_training_data_subpackage(tmp_path):
    code = "import sys; sys.modules['talkmill.llm'] = None; sys.path.insert(0, %r); import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))" % REPO
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout.split()
    assert int(said[-2]) > 80 and said[-1] == "False"
