"""Extraction that grows with new messages: after any batches it is what all messages together give."""

import random

import pytest
from pyspark.sql import functions as F

from talkmill.operators import extract, memory_store
from talkmill.operators.memory_store import commit_batch, open_memory

MESSAGES = "session_id string, seq_num long, role string, content string, created_at string"
PARTS = ["决定采用方案{n}号存储引擎。", "为什么要选这个第{n}个方案呢？", "see src/db/file{n}.ts and lib/x{n}.py", "```py\nx\n```", "sharding topic{n} sharding", "还没定 what about {n} 是否可以？", "plain words here", "改\n为 postgres{n} 引擎方案。", "x" * 101, "我们的存储方案定为列存{n}。"]


def conversation(seed, sessions=6, most=45):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for n in range(1, rng.randrange(2, most)):
            text = " ".join(rng.choice(PARTS).format(n=rng.randrange(9)) for _ in range(rng.randrange(4)))
            rows.append((f"s{s}", n, rng.choice(["user", "assistant", "user", "tool"]), rng.choice([text, text, text, None]), f"2024-01-01T00:00:{n:02d}"))
    return rows


def listed(df):
    return {r.session_id: r.asDict(True) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_after_batches_is_that_of_all_messages(spark, seed):
    rows = conversation(seed)
    frame = lambda some: spark.createDataFrame(some, MESSAGES).coalesce(1)
    rng, cuts = random.Random(seed), {}
    for r in rows:
        cuts.setdefault(r[0], sorted(rng.randrange(60) for _ in range(2)))
    batch_of = lambda r: sum(r[1] > c for c in cuts[r[0]])
    state = None
    for batch in range(3):
        new = [r for r in rows if batch_of(r) == batch]
        if state is None:
            state = extract.state_of(extract.features(frame(new)))
        else:
            assert extract.late_sessions(state, frame(new)).count() == 0
            state = extract.grown(state, extract.features(frame(new)))
        state = {k: spark.createDataFrame(v.collect(), v.schema).coalesce(1) for k, v in state.items()}
    got, want = listed(extract.told(state)), listed(extract.bundle(frame(rows)))
    assert got == want and any(x["code_changes"]["key_exchanges"] for x in want.values()) and all(len(x["topics"]) <= 8 for x in want.values())
    late = [("s0", 1, "user", "late", None), ("s1", 10_000, "user", "new", None), ("other", 1, "user", "x", None)]
    assert [r.session_id for r in extract.late_sessions(state, frame(late)).collect()] == ["s0"]


def test_no_sentence_of_a_decision_is_overlooked(spark):
    texts = ["决定采用x方案引擎", "我们最终用 sqlite 存储。", "数据格式敲定 parquet 作准", "直接用 sqlite 就好了。", "统一用列存格式作准。", "决\n定改用列存引擎。", "no han 决", "改为使用缓存的方案好", "换成 spark 引擎吧好的", None, ""]
    rows = spark.createDataFrame([("s", i, "user", t, None) for i, t in enumerate(texts)], MESSAGES)
    from talkmill.functions import fixed_values as fixed
    from talkmill.functions.text import sentences

    s = rows.select("seq_num", F.explode(sentences(F.col("content"))).alias("x"))
    every = s.filter(" or ".join(f"x rlike '{p}'" for p in [p.replace("\\", "\\\\") for p in fixed.DECISION_PATTERNS]))
    hinted = s.filter(F.col("x").rlike(fixed.DECISION_HINT))
    assert {r.seq_num for r in every.collect()} <= {r.seq_num for r in hinted.collect()} and every.count() >= 7


def test_confirming_extracts(spark, tmp_path):
    rows = [("s", "a", "p", n, r, t, f"2024-01-01T00:00:0{n}", "f", n) for n, r, t in [(1, "user", "为什么要选这个第1个方案呢？ src/db/file1.ts"), (2, "assistant", "决定采用方案1号存储引擎。")]]
    rows.append(("s", "b", "p", 1, "user", "fresh words", "2024-01-09T00:00:00", "f", 9))
    batch = spark.createDataFrame(rows, "source string, source_session_id string, project_id string, seq_num long, role string, content string, created_at string, source_file string, position long")
    tables = open_memory(spark, str(tmp_path))
    commit_batch(tables, batch.coalesce(1), 0, "w")
    assert memory_store.tick(tables, "2024-01-01T00:30:00") is not None
    assert {r.source_session_id: r.state for r in tables.read("sessions").collect()} == {"a": "pending_end", "b": "active"}
    memory_store.tick(tables, "2024-01-02T00:00:00")
    got = {r.source_session_id: r for r in tables.read("sessions").collect()}
    assert got["a"].state == "confirmed" and got["a"].files_mentioned == ["src/db/file1.ts"] and got["a"].decisions[0].text == "决定采用方案1号存储引擎"
    assert "决策（1）" in got["a"].summary_rule and got["a"].meta_text and got["b"].state == "active" and got["b"].files_mentioned is None
    version = tables.latest()[0]
    assert memory_store.tick(tables, "2024-01-02T00:00:01") is None and tables.latest()[0] == version
