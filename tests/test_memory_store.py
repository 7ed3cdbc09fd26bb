"""Ingest of growing log files into versioned tables: each line once, all tables or none, stale previews refused."""

import json
import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import memory_store
from talkmill.operators.commits import Change, Commits, Conflict, Tables
from talkmill.operators.memory_store import StalePreview, commit_batch, open_memory
from talkmill.operators.store import session_id
from talkmill.sources.log_tail import LogTail, TailReader, line_numbers
from talkmill.streaming.ingest import from_log_lines, ingest

ROWS = "source string, source_session_id string, project_id string, seq_num long, role string, content string, created_at string, source_file string, position long"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def messages(spark, rows):
    return spark.createDataFrame([("s", sid, "p", n, "user", text, f"2024-01-01T00:00:0{n % 10}", f"{sid}.jsonl", 10 * n) for sid, n, text in rows], ROWS).coalesce(1)


def held(tables):
    sessions = {r.source_session_id: (r.state, r.message_count) for r in tables.read("sessions").collect()}
    return sessions, sorted((r.session_id, r.seq_num, r.content) for r in tables.read("messages").collect()), {r.source_file: (r.position, r.lines) for r in tables.read("cursors").collect()}


# --- the tail source ---------------------------------------------------------------------------


def told(reader, start, end):
    return sorted((b["source_file"][i], b["position"][i], b["line"][i]) for p in reader.partitions(start, end) for batch in reader.read(p) for b in [batch.to_pydict()] for i in range(batch.num_rows))


def test_ten_growing_files_each_line_once(tmp_path):
    rng = random.Random(4)
    reader, at, got = TailReader(str(tmp_path), "*.jsonl", 3000, 170), {}, []
    assert reader.initialOffset() == {} and reader.latestOffset() == {}
    want, texts = [], {f"{i}/log{i}.jsonl": "" for i in range(10)}
    for step in range(12):
        for name in texts:
            if rng.random() < 0.7:
                new = "".join(f"{name} {step} {n} é" + "x" * rng.randrange(90) + rng.choice(["\n", "\n", "\n\n", "\r\n"]) for n in range(rng.randrange(9)))
                if name.startswith("3") and step == 4:
                    new += "long " * 5000 + "\n"
                if name.startswith("5") and step == 7:
                    texts[name], new = "", "written anew\n"
                path = tmp_path / name
                path.parent.mkdir(exist_ok=True)
                texts[name] += new
                # The last line comes in two parts.
                path.write_text(texts[name] + ("unfinished" if step < 11 else ""), newline="")
                want += [(str(path), line) for line in new.split("\n")[:-1]]
        (tmp_path / "ignored.txt").write_text("no\n")
        while (end := reader.latestOffset()) != at:
            assert sum(end[f]["bytes"] - at.get(f, {"bytes": 0})["bytes"] for f in end) < 30_000
            got += [(f, line) for f, _, line in told(reader, at, end)]
            at = json.loads(json.dumps(end))
    assert sorted(got) == sorted(want) and ("x" * 9 in str(want))
    fresh = TailReader(str(tmp_path), "*.jsonl", 3000, 170)
    assert fresh.latestOffset() == at or told(fresh, at, fresh.latestOffset()) == []


def test_stretches_of_any_length_find_the_same_lines(tmp_path):
    lines = ["", "a", "bb" * 30, "é" * 7, "", "c" * 200, "d"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines * 5) + "\nrest")
    for stretch in (1, 2, 3, 7, 64, 10_000):
        reader = TailReader(str(tmp_path / "x.jsonl"), "*", 1 << 20, stretch)
        reader.initialOffset()
        assert [x[2] for x in told(reader, {}, reader.latestOffset())] == lines * 5


def test_an_unfinished_line_is_not_searched_twice(tmp_path, monkeypatch):
    log = tmp_path / "x.jsonl"
    log.write_text("z" * 300_000)
    reader, read = TailReader(str(log), "*", 1000, 500), []
    reader.initialOffset()
    plain = TailReader._read
    monkeypatch.setattr(TailReader, "_read", staticmethod(lambda f, a, n: read.append(n) or plain(f, a, n)))
    assert reader.latestOffset()[str(log)]["bytes"] == 0
    first = sum(read)
    read.clear()
    with log.open("a") as f:
        f.write("z\nshort\n")
    assert reader.latestOffset()[str(log)]["bytes"] == 300_002 and sum(read) < 10_000 < first


def test_lines_are_numbered_by_counts(spark):
    rows = spark.createDataFrame([("f", 0, 1, 5), ("f", 0, 2, 9), ("f", 64, 1, 70), ("g", 100, 1, 120), ("g", 200, 1, 220), ("h", 0, 1, 4)], "source_file string, stretch long, place long, position long")
    cursors = spark.createDataFrame([("g", 100, 7), ("h", 50, 3), ("other", 1, 1)], "source_file string, position long, lines long")
    assert {(r.source_file, r.position): r.line_no for r in line_numbers(rows, cursors).collect()} == {("f", 5): 1, ("f", 9): 2, ("f", 70): 3, ("g", 120): 8, ("g", 220): 9, ("h", 4): 1}


# --- from the files to the tables --------------------------------------------------------------


def test_files_to_tables_through_a_kill_and_a_rewrite(spark, tmp_path, monkeypatch):
    spark.dataSource.register(LogTail)
    logs, where, check = tmp_path / "logs", str(tmp_path / "memory"), str(tmp_path / "check")
    logs.mkdir()
    line = lambda sid, n: json.dumps({"sid": sid, "seq": n, "role": "user", "text": f"{sid} says {n}", "ts": f"2024-01-01T00:00:0{n}"}) + "\n"

    def run():
        stream = spark.readStream.format("log_tail").option("path", str(logs)).option("maxBytesPerBatch", 200).option("stretchBytes", 50).load()
        q = ingest(stream, where, check, from_log_lines("chat"), available_now=False)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for i in range(4):
        (logs / f"{i}.jsonl").write_text(line(f"k{i}", 1) + ("{bad\n" if i == 2 else "") + line(f"k{i}", 2) + line(f"k{i}", 3)[:20])
    kill, left = Commits.commit, [2]

    def killed(self, expected, state):
        left[0] -= 1
        if left[0] == 0:
            raise RuntimeError("killed between the writes and the commit")
        return kill(self, expected, state)

    monkeypatch.setattr(Commits, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        run()
    monkeypatch.setattr(Commits, "commit", kill)
    tables = open_memory(spark, where)
    assert held(tables)[:2] == ({}, [])
    run()
    sessions, rows, cursors = held(tables)
    assert sessions == {f"k{i}": ("active", 2) for i in range(4)} and len(rows) == 8
    assert {k.rsplit("/")[-1]: n for k, (_, n) in cursors.items()} == {f"{i}.jsonl": 3 if i == 2 else 2 for i in range(4)}
    assert {r.bad_lines for r in tables.read("cursors").collect()} == {0, 1}
    for i in range(2):
        (logs / f"{i}.jsonl").write_text(line(f"k{i}", 1) + line(f"k{i}", 2) + line(f"k{i}", 3))
    (logs / "3.jsonl").write_text(line("new", 1))
    (logs / "4.jsonl").write_text(line("k0", 4))
    run()
    sessions, rows, cursors = held(tables)
    assert sessions == {"k0": ("active", 4), "k1": ("active", 3), "k2": ("active", 2), "k3": ("active", 2), "new": ("active", 1)} and len(rows) == 12 == len(set(rows))
    assert {k.rsplit("/")[-1]: n for k, (_, n) in cursors.items()} == {"0.jsonl": 3, "1.jsonl": 3, "2.jsonl": 3, "3.jsonl": 1, "4.jsonl": 1}


def test_a_batch_is_committed_once(spark, tmp_path, monkeypatch):
    tables = open_memory(spark, str(tmp_path))
    assert commit_batch(tables, messages(spark, [("a", 1, "x"), ("a", 1, "x"), ("b", 1, "y")]), 0, "w") == 1
    before = held(tables)
    assert commit_batch(tables, messages(spark, [("c", 1, "z")]), 0, "w") == 1 and held(tables) == before
    assert commit_batch(tables, messages(spark, [("a", 1, "x"), ("a", 2, "z")]), 0, "other") == 2
    assert held(tables)[0] == {"a": ("active", 2), "b": ("active", 1)}
    # Another commit comes between this one's reads and its own; it is tried anew on top.
    change, raced = Tables.change, []

    def late(self, *a, **k):
        if not raced:
            raced.append(commit_batch(open_memory(spark, str(tmp_path)), messages(spark, [("d", 1, "d"), ("a", 3, "first")]), 5, "racer")) if raced.append(0) is None else None
        return change(self, *a, **k)

    monkeypatch.setattr(Tables, "change", late)
    assert commit_batch(tables, messages(spark, [("a", 3, "second"), ("e", 1, "e")]), 1, "w") == 4
    sessions, rows, _ = held(tables)
    assert sessions == {"a": ("active", 3), "b": ("active", 1), "d": ("active", 1), "e": ("active", 1)} and [x[2] for x in rows if x[1] == 3] == ["first"]


def test_modes_and_states(spark, tmp_path):
    tables = open_memory(spark, str(tmp_path))
    commit_batch(tables, messages(spark, [("a", 1, "x")]), 0, "w", mode="meta")
    assert held(tables) == ({"a": ("active", 1)}, [], {"a.jsonl": (10, 1)})
    commit_batch(tables, messages(spark, [("b", 1, "x")]), 1, "w", mode="off")
    assert held(tables) == ({"a": ("active", 1)}, [], {"a.jsonl": (10, 1), "b.jsonl": (10, 1)})
    version, state = tables.latest()
    ids = tables.read("sessions").select("session_id", F.lit("m").alias("model"), F.lit(1).alias("dim"), F.array(F.lit(1.0).cast("float")).alias("vec"), F.lit("x").alias("embedded_at"))
    done = tables.read("sessions").withColumn("state", F.lit("confirmed"))
    tables.change({"vectors": Change(ids), "sessions": Change(done, True)}, version, state)
    commit_batch(tables, messages(spark, [("a", 2, "y"), ("c", 1, "z")]), 2, "w", blocked=F.col("source_session_id") == "c")
    assert held(tables)[0] == {"a": ("active", 2)} and tables.read("vectors").count() == 0
    commit_batch(tables, messages(spark, []), 3, "w")
    assert held(tables)[0] == {"a": ("active", 2)}


def test_folders_are_written_anew_before_they_are_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Tables, "MOST_PARTS", 3)
    monkeypatch.setattr(Tables, "FOLDERS", 2)
    tables = open_memory(spark, str(tmp_path))
    for i in range(6):
        commit_batch(tables, messages(spark, [("a", i, f"{i}"), (f"s{i}", 1, "x")]), i, "w")
    assert held(tables)[0]["a"] == ("active", 6) and len(held(tables)[1]) == 12
    assert all(len(p) <= 3 for p in tables.latest()[1]["tables"]["messages"]["parts"].values())
    assert tables.tidy(keep=1, grace=-1) > 0 and len(held(tables)[1]) == 12


def test_rebuild_swaps_all_or_nothing(spark, tmp_path, monkeypatch):
    tables = open_memory(spark, str(tmp_path))
    commit_batch(tables, messages(spark, [("a", 1, "wrong"), ("gone", 1, "x")]), 0, "w")
    rows = messages(spark, [("a", 1, "right"), ("a", 2, "more")])
    took = memory_store.arrived(rows)
    memory_store.rebuild(tables, took.found, took.messages, "2024-03-01T00:00:00")
    assert held(tables)[0] == {"a": ("confirmed", 2)} and [x[2] for x in held(tables)[1]] == ["right", "more"]
    change = Tables.change

    def late(self, *a, **k):
        monkeypatch.setattr(Tables, "change", change)
        commit_batch(tables, messages(spark, [("b", 1, "between")]), 1, "w")
        return change(self, *a, **k)

    monkeypatch.setattr(Tables, "change", late)
    with pytest.raises(Conflict):
        memory_store.rebuild(tables, took.found, took.messages, "2024-03-01T00:00:00")
    assert set(held(tables)[0]) == {"a", "b"}


def test_a_stale_preview_is_refused(spark, tmp_path):
    tables = open_memory(spark, str(tmp_path))
    commit_batch(tables, messages(spark, [("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")]), 0, "w")
    seen = spark.createDataFrame(memory_store.preview(tables, F.col("source_session_id") != "c").collect())
    commit_batch(tables, messages(spark, [("a", 2, "new")]), 1, "w")
    with pytest.raises(StalePreview, match="changed"):
        memory_store.forget(tables, seen, "2024-02-01", "asked")
    assert set(held(tables)[0]) == {"a", "b", "c"}
    seen = spark.createDataFrame(memory_store.preview(tables, F.col("source_session_id") != "c").collect())
    memory_store.forget(tables, seen, "2024-02-01", "asked")
    assert set(held(tables)[0]) == {"c"} and len(held(tables)[1]) == 1
    assert sorted(r.messages_deleted for r in tables.read("audit").collect()) == [1, 2]
    with pytest.raises(StalePreview, match="gone"):
        memory_store.forget(tables, seen, "2024-02-01", "asked")
    # What is forgotten doesn't come back.
    commit_batch(tables, messages(spark, [("a", 9, "again"), ("d", 1, "x")]), 2, "w")
    assert set(held(tables)[0]) == {"c", "d"}
    assert tables.read("tombstones").select(session_id(F.col("source"), F.col("source_session_id"))).count() == 2
