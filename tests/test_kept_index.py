"""The kept index and session search over it: against brute force and the scan, after additions, changes, removals and merges."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkmill.operators import search, session_index, text_index
from talkmill.operators.commits import Commits, Conflict
from talkmill.operators.session_index import SessionIndex
from talkmill.operators.text_index import TextIndex, View
from talkmill.plans import own_queries
from talkmill.sources.shared import shared_dir

WORDS = ["alpha", "beta", "gamma", "the", "of", "数据", "ｗｉｄｅ", "x1"]
ROWS = "key string, seq long, text string"


def terms(text):
    plain = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text or "").lower()
    return re.findall(r"[㐀-䶿一-鿿豈-﫿]|[a-z0-9]+", plain)


def count(found, unit):
    return sum(found[i : i + len(unit)] == unit for i in range(len(found) - len(unit) + 1))


def bests(rows, units):
    """{(unit, key): (score, seq)} over all rows, by brute force."""
    known = {k: terms(t) for k, t in rows.items()}
    mean = sum(map(len, known.values())) / len(known) or 1.0
    out = {}
    for i, unit in enumerate(units):
        tf = {k: count(t, unit) for k, t in known.items()}
        n = sum(x > 0 for x in tf.values())
        idf = math.log((len(known) - n + 0.5) / (n + 0.5))
        idf = idf if idf > 0 else 1e-6
        for (key, seq), x in tf.items():
            if x:
                score = idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(known[key, seq]) / mean))
                old = out.get((i, key))
                if old is None or (score, -seq) > (old[0], -old[1]):
                    out[i, key] = (score, seq)
    return out


def same_bests(view: View, rows, queries=("alpha", "gamma the", '"of the" beta', "数据 x1", "absent", "wide")):
    for q in queries:
        units = search.parse_query(q)
        hits = view.hits(units)
        got = {(r.unit, r.key): (round(r.best.s, 9), -r.best.m) for r in view.scored(hits, view.holding(hits, len(units))).collect()}
        assert got == {k: (round(s, 9), seq) for k, (s, seq) in bests(rows, units).items()}, q


def texts(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_index_after_any_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "ROWS_PER_FILE", 40)
    monkeypatch.setattr(text_index, "MOST_SEGMENTS", 4)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng, index, rows = random.Random(3), TextIndex(spark, str(tmp_path / "index")), {}
    frame = lambda new: spark.createDataFrame([(k, s, t) for (k, s), t in new.items()], ROWS)

    def folders():
        return {p for p in (tmp_path / "index/data").glob("*/*/*")}

    same_bests(index.view(), {("none", 0): ""}, ["alpha"])
    for step in range(7):
        before, old = folders() if (tmp_path / "index/data").exists() else set(), {p: p.read_bytes() for p in (tmp_path / "index/data").rglob("*.parquet")} if step else {}
        kind = ["add", "add", "replace", "remove", "add", "replace", "add"][step]
        keys = [f"k{rng.randrange(30)}" for _ in range(12)]
        if kind == "remove":
            index.remove(spark.createDataFrame([(k,) for k in [*keys, *keys, "unknown"]], "key string"), "key")
            rows = {k: t for k, t in rows.items() if k[0] not in keys}
        else:
            new = {(k, rng.randrange(5) + (0 if kind == "replace" else 10 * step + 10)): rng.choice([texts(rng, rng.randrange(1, 40)), None, "..."]) for k in keys}
            (index.add if kind == "add" else index.replace)(frame(new), "key", "text", "seq")
            rows = ({k: t for k, t in rows.items() if k[0] not in keys} if kind == "replace" else rows) | new
        assert all(p.read_bytes() == b for p, b in old.items()) and before <= folders()
        view = index.view()
        assert (view.state["rows"], view.state["length"]) == (len(rows), sum(len(terms(t)) for t in rows.values()))
        assert len(view.segments) <= 4
        if step in (3, 5):
            same_bests(view, rows, ["alpha", '"of the" beta'])
    same_bests(index.view(), rows)
    want = collections.Counter(t for x in rows.values() for t in set(terms(x)))
    n = collections.Counter(t for x in rows.values() for t in terms(x))
    assert {r.term: (r.rows, r.n) for r in index.view().statistics().collect()} == {t: (want[t], n[t]) for t in want}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    files = [p for p in (tmp_path / "index/data").rglob("*.parquet") if "postings" in str(p)]
    assert len(files) > 9 and all(spark.read.parquet(str(p)).count() <= 40 for p in files)


def test_a_search_opens_the_files_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "ROWS_PER_FILE", 50)
    index = TextIndex(spark, str(tmp_path))
    rows = spark.range(60).select(F.col("id").cast("string").alias("key"), F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") % 20)) for w in "abcdefgh"], F.lit("common")).alias("text"))
    index.add(rows, "key", "text")
    view = index.view()
    every = view.live("heads").inputFiles()
    rare, common = view.live("heads", ["a7"]), view.live("heads", ["common"])
    assert len(every) > 10 and len(rare.inputFiles()) <= 2 and rare.count() == 3
    assert 2 <= len(common.inputFiles()) <= 4 and common.count() == 60


def test_repeated_rows_and_odd_tables(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    assert index.view().rank("alpha").count() == 0
    index.remove(spark.createDataFrame([("x",)], "key string"), "key")
    index.add(spark.createDataFrame([("a", 1, "alpha"), ("a", 1, "alpha beta"), (None, 1, "alpha")], ROWS), "key", "text", "seq")
    assert index.view().corpus().rows == 1 and index.merge() >= 0
    assert [r.key for r in index.view().rank("alpha").collect()] == ["a"] and index.view().rank("alpha beta").count() == 0


def test_of_two_writers_one_succeeds(spark, tmp_path):
    index, other = TextIndex(spark, str(tmp_path)), TextIndex(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1, "alpha")], ROWS)
    index.add(rows, "key", "text", "seq")
    late = other.state()
    index.add(rows.withColumn("key", F.lit("b")), "key", "text", "seq")
    other.state = lambda: late
    with pytest.raises(Conflict):
        other.add(rows.withColumn("key", F.lit("c")), "key", "text", "seq")
    assert {r.key for r in index.view().rank("alpha").collect()} == {"a", "b"}
    assert index.commits.tidy(keep=1, grace=-1) > 0
    assert {r.key for r in index.view().rank("alpha").collect()} == {"a", "b"}


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    """(index, messages, sessions), all of them in the index."""
    rng, home = random.Random(5), tmp_path_factory.mktemp("sessions")
    m = spark.createDataFrame([(f"s{i}", n, texts(rng, rng.randrange(1, 25)) + f" {i}") for i in range(40) for n in range(rng.randrange(1, 6))], "session_id string, seq_num long, content string")
    s = spark.createDataFrame([(f"s{i}", f"Title{i}", f"title{i} {texts(rng, 3)}", f"p{i % 3}") for i in range(44)], "session_id string, title string, meta_text string, project_id string")
    m, s = m.coalesce(1), s.coalesce(1)
    index = SessionIndex(TextIndex(spark, str(home / "b")), TextIndex(spark, str(home / "m")))
    index.add(m.filter("seq_num < 2"), s)
    index.add(m.filter("seq_num >= 2"), s.limit(5))
    return index, m, s


@pytest.mark.parametrize("query, where, limit", [("alpha beta", None, 3), ("absent alpha", "p1", 1000), ('"of the" gamma', "p1", 1000), ("数据", None, 1000), ("absent", None, 5), ("beta title9 x1", None, 1000)])
def test_session_search_is_that_of_the_scan(spark, searched, query, where, limit):
    index, m, s = searched
    semantic = spark.createDataFrame([("s1", 0.9), ("s43", 0.4), ("gone", 0.5)], "session_id string, score double")
    where = None if where is None else F.col("project_id") == where
    want, got = search.search_sessions(m, s, query, where, limit, semantic), session_index.search(index, m, s, query, where, limit, semantic)
    told = lambda df: sorted((r.position, r.session_id, round(r.score, 9), r.coverage, r.seq, r.snippet, r.via) for r in df.collect())
    assert told(got) == told(want)
    assert session_index.search(index, m, s, query, where, 0).count() == 0


def test_removed_sessions_are_not_found(spark, searched):
    index, m, s = searched
    index.remove(s.filter("project_id = 'p1'"))
    assert {int(r.session_id[1:]) % 3 for r in session_index.search(index, m, s, "alpha beta", None, 100).collect()} == {0, 2}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_deletions_are_joined_to_the_segments_they_touch(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    frame = lambda *ks: spark.createDataFrame([(k, 1, f"alpha {k}") for k in ks], ROWS)
    index.add(frame("a"), "key", "text", "seq")
    index.add(frame("b", "c"), "key", "text", "seq")
    index.replace(frame("a", "d"), "key", "text", "seq")
    view = index.view()
    assert view.segments[2]["touches"] == [view.segments[0]["folder"]]
    assert "Join" in plan(view.live("postings")) and "Join" not in plan(view.live("postings", start=1))
    index.remove(spark.createDataFrame([("a",), ("c",), ("x",)], "key string"), "key")
    view = index.view()
    assert set(view.segments[3]["touches"]) == {view.segments[1]["folder"], view.segments[2]["folder"]}
    assert {r.term: (r.rows, r.n) for r in view.statistics().collect()} == {"alpha": (2, 2), "b": (1, 1), "d": (1, 1)}


def test_postings_are_made_where_rows_are_read(spark):
    rows = spark.createDataFrame([("a", 1, "x y x"), ("a", 2, None), ("b", 1, "y")], ROWS).repartition(3).localCheckpoint()
    same, n = text_index.once(rows)
    ranges = text_index.ranges_of(same, n)
    made = text_index.postings_of(same, ranges)
    assert n == 3 and "Exchange" not in plan(made)
    assert sorted(tuple(r)[:-1] for r in made.collect()) == [("", "a", 2, 0, True, []), ("x", "a", 1, 3, True, [0, 2]), ("y", "a", 1, 3, False, [1]), ("y", "b", 1, 1, True, [0])]
    twice, n = text_index.once(rows.unionByName(rows.filter("key = 'b'").withColumn("text", F.lit("a"))))
    assert n == 3 and sorted((r.key, r.seq, r.text) for r in twice.collect() if r.text) == [("a", 1, "x y x"), ("b", 1, "a")]


def test_heads_that_batches_cut_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_BYTES", 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rng, index = random.Random(9), TextIndex(spark, str(tmp_path))
    rows = {(f"k{i}", s): texts(rng, rng.randrange(1, 30)) for i in range(4) for s in range(9)}
    index.add(spark.createDataFrame([(k, s, t) for (k, s), t in rows.items()], ROWS), "key", "text", "seq")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert index.view().live("heads", ["alpha"]).count() > 4
    same_bests(index.view(), rows, ["alpha beta", '"of the" gamma'])


def test_a_frequent_term_has_several_ranges(monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_BYTES", 100)
    ranges = text_index.Ranges([("a", 90), ("m", 600), ("z", 90), ("y", 20)], 1)
    names = pa.array(["a", "m", "n", "z", "zz", ""])
    of = lambda i: {p for d in range(-50, 50) for p in ranges.of(names, np.array([i]), np.array([d])).to_pylist()}
    assert ranges.count == 8 and len(of(1)) >= 6 and max(of(0)) <= min(of(1)) and min(of(3)) >= max(of(1)) and of(5) == {0} and of(4) == {7}
    assert text_index.Ranges([], 1).of(names, np.arange(6), np.arange(6)).to_pylist() == [0] * 6


def test_postings_travel_in_blocks_and_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "RANGE_BYTES", 20_000)
    said = {(f"k{i % 7}", i): f"x {'y ' * (i % 3)}z{i % 2} x" if i % 100 else None for i in range(1200)}
    rows = spark.createDataFrame([(k, s, t) for (k, s), t in said.items()], ROWS).coalesce(1)
    ranges = text_index.ranges_of(rows, len(said))
    blocks = text_index.blocks_of(rows, ranges)
    met = blocks.select("term", "part", F.size("keys").alias("n")).collect()
    assert ranges.count > 2 and len(met) < 30 and max(r.n for r in met) <= text_index.BLOCK and len({r.part for r in met if r.term == "x"}) > 1
    want = [(t, k, s, len(ts := terms(x)), not ts or ts[0] == t, [i for i, w in enumerate(ts) if w == t]) for (k, s), x in said.items() for t in set(terms(x)) or {""}]
    assert sorted(tuple(r)[:-1] for r in text_index.opened(blocks).collect()) == sorted(want)
    index = TextIndex(spark, str(tmp_path))
    index.add(rows, "key", "text", "seq")
    assert {p.name for p in (tmp_path / "data").glob("segment-*/*")} == {"postings", "sizes", "files"}
    same_bests(index.view(), said, ["x y", '"y z1" x', "absent"])


def test_an_index_of_another_format_is_refused(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path))
    index.commits.commit(-1, {"segments": [], "rows": 0, "length": 0, "key": None})
    with pytest.raises(ValueError, match="format 1"):
        index.view()


def test_a_search_of_bodies_builds_no_metadata(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").filter("conv_id < 12").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    state = lambda: set(Commits(spark, f"{shared_dir(spark)}/talkmill-kept").latest()[1])
    before = state()
    own_queries()[0]["fts_or_fallback"](spark, str(tmp_path)).count()
    (made,) = state() - before
    assert made.startswith("bodies-all-")
    own_queries()[0]["search_body_and_meta"](spark, str(tmp_path)).count()
    (more,) = state() - before - {made}
    assert more.startswith("metadata-")


def test_a_key_has_one_entry_for_each_count_however_postings_are_cut(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    index, said = TextIndex(spark, str(tmp_path)), {("k", s): "of the and " * (1 + s % 2) + "x " * (s % 5) for s in range(40)}
    index.add(spark.createDataFrame([(k, s, t) for (k, s), t in said.items()], ROWS), "key", "text", "seq")
    got = {r.unit: (r.n, sorted(tuple(e) for e in r.entries)) for r in index.view().hits([["of", "the"], ["and"]]).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {u: (40, [(1, 3, 0), (2, 6, 5)]) for u in (0, 1)}
    same_bests(index.view(), said, ['"of the" and'])


def test_rows_of_one_row_group_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "FEW_ROWS", 20)
    said = {(f"k{i % 50}", i): f"alpha {'beta ' * (i % 3)}of the x{i % 9}" if i % 40 else None for i in range(400)}
    rows = spark.createDataFrame([(k, s, t) for (k, s), t in said.items()], ROWS)
    rows.coalesce(1).write.parquet(str(tmp_path / "one"))
    one, even = spark.read.parquet(str(tmp_path / "one")), rows.repartition(8).localCheckpoint()
    assert text_index.spread(even) is even and text_index.spread(one.limit(15)).rdd.getNumPartitions() == 1 and text_index.spread(one.limit(0)).count() == 0
    made = []
    monkeypatch.setattr(text_index, "blocks_of", lambda rows, ranges, real=text_index.blocks_of: made.append(rows) or real(rows, ranges))
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(one, "key", "text", "seq")
    held = made[0].groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
    assert held[0] >= 8 and held[1] <= 100
    same_bests(index.view(), said, ["alpha x1", '"of the" beta'])


def test_sessions_are_filtered_once(spark, searched, monkeypatch):
    index, m, s = searched
    labels = []
    monkeypatch.setattr(session_index, "written", lambda rows, label, real=session_index.written: labels.append(label) or real(rows, label))
    found = session_index.best_of_index(index.body.view(), s, search.parse_query('"of the" gamma'), F.col("project_id") == "p2")
    assert labels == ["phrase-hits", "session-bests"] and "Join" not in plan(found) and found.count() > 0
