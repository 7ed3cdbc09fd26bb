"""The registered queries on small tables of their own: against their SQL in DuckDB, or brute force; hot keys and extreme ids."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline as pipeline
from talkmill.llm import chat_format, common, fingerprints, near_dups, neighbours, quality, queries, url_filter
from talkmill.llm.common import table

SMALL = "/root/testdata/sf0.01"


def same_as_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for f in os.listdir(tmp_path):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{tmp_path}/{f}/*.parquet')")
    df = queries.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    said = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(columns).collect()))) == sorted(map(repr, said))
    return said


def documents(spark, tmp_path, texts):
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))


def some_texts():
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(["wort", "mot", "é", "数据", "x!", "The", "THE"]) + str(rng.randrange(30)) for _ in range(n))
    passage, copy = make(70), make(90)
    near = copy.split(" ")
    near[3] = "other"
    texts = [None, "", " \t", "one two", "ONE two", "a" * 450, copy, copy, " ".join(near), make(10) + passage + "數" + make(12), "é" + passage + make(3), passage[:120] + make(30)]
    return list(enumerate(texts + [make(rng.randrange(1, 80)) for _ in range(15)] + ["a" * 199, "b" * 200, "b" * 201]))


@pytest.mark.parametrize("name", ["op5_repeats", "op10_near_duplicates"])
def test_whole_queries_against_sql(spark, tmp_path, name):
    documents(spark, tmp_path, some_texts())
    said = same_as_sql(spark, tmp_path, name)
    assert len(said) == len(some_texts())


def test_chats_with_faults_and_a_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS_PER_BUCKET", 16)
    roles = lambda i, t: ["user", "assistant", "system", "assistant", "user"][(t * 7 + i) % 5]
    rows = [(i, t, roles(i, t), None if t % 31 == 5 else f'say "{t}"\n€') for i, n in enumerate((900, 3, 40, 1)) for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    said = same_as_sql(spark, tmp_path, "op8_chat_format")
    assert len(said) == len(rows)
    largest = max(r["count"] for r in chat_format._bucketed(table(spark, str(tmp_path), "conversations"), "turn").groupBy("_conv", "_bucket").count().collect())
    assert largest <= 16


def test_schemas_too_many_to_broadcast(spark, monkeypatch):
    rows = [("f", '{"x":1}'), ("f", "{}"), ("g", "{}"), ("f", None), ("f", '{"x":"1","y":true}')] * 3
    calls = spark.createDataFrame(rows, "call_name string, call_arguments string")
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "x", "integer", True)], "tool string, parameter string, type string, required boolean")
    found = lambda: sorted(map(repr, chat_format.validate_arguments(calls, schemas).collect()))
    near = found()
    monkeypatch.setattr(chat_format, "BROADCAST_SCHEMAS", 0)
    assert found() == near and len(near) == 15


def test_rules_of_many_shapes(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: rng.choice("abc")
    urls = [f"http://{'.'.join(word() for _ in range(rng.randrange(1, 5)))}/{word() * rng.randrange(4)}/{word()}" for _ in range(300)] + ["http://a/"] * 200
    rules = list({(".".join(word() for _ in range(rng.randrange(1, 4))), "/" + word() * rng.randrange(4)): rng.choice(["allow", "block"]) for _ in range(40)}.items())
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)
    frame = spark.createDataFrame([(*k, v) for k, v in rules], "host string, path string, verdict string")
    judged = lambda: sorted(map(tuple, url_filter.judge_urls(pages, frame).collect()))
    in_place = judged()
    monkeypatch.setattr(url_filter, "PLACES", 0)
    assert judged() == in_place
    monkeypatch.setattr(common, "HOT_SHARE", 1 / 3)
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 0)
    assert judged() == in_place
    for _, url, host, path, rule, verdict in in_place:
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (rule, verdict) == (max(fits)[2:] if fits else (None, "allow")), url


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        out.append((k, len(t), hashlib.sha256((t[: len(t) - len(t) // 4] + after[: len(t) // 4]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("kind", ["extreme", "outlier", "one"])
def test_fingerprints_of_any_ids(spark, tmp_path, kind):
    rng = random.Random(1)
    make = lambda: " ".join(rng.choice(["aa", "bb", "ü"]) + str(rng.randrange(99)) for _ in range(rng.randrange(1, 20)))
    rows = {
        "extreme": lambda: [(9 * 10**18, make()), (-9 * 10**18, make()), (-(2**63), make()), (2**63 - 1, None), (0, make()), (None, make()), (None, None), (5, "")],
        "outlier": lambda: [(i, make()) for i in range(1500)] + [(10**15, make())], "one": lambda: [(1, "abcd")],
    }[kind]()
    documents(spark, tmp_path, rows)
    got = queries.QUERIES["op2_fingerprints"](spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == sorted(edited(rows), key=repr)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    ids = sorted(by_id)
    for a, b in zip(ids, ids[1:], strict=False):
        if kind == "outlier":
            assert by_id[a].near_next == 1 - (int(by_id[a].fingerprint, 16) ^ int(by_id[b].fingerprint, 16)).bit_count() / 64
    largest = max(r["count"] for r in fingerprints.numbered(table(spark, str(tmp_path), "documents"), "doc_id").groupBy("_bucket").count().collect())
    assert largest <= 3 * fingerprints.ROWS_PER_BUCKET // 2


def test_neighbours_where_lists_are_left_out(spark, monkeypatch):
    """Lists longer than the short list, few of them probed: recall against brute force."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 8000)] + rng.normal(size=(8000, 16)) * 0.6
    frame = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, score double").repartition(4)
    index = {}
    fit = neighbours.fit
    monkeypatch.setattr(neighbours, "fit", lambda *a, **k: index.setdefault("it", fit(*a, **k)))
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(neighbours, "RERANK", 100)
    near = {}
    for r in neighbours.search(frame, frame.filter("vec_id % 100 = 0")).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert index["it"].n_probes * 2 < len(index["it"].centres) and 8000 / len(index["it"].centres) > 100
    hits = 0
    for q in range(0, 8000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & near[q])
    assert hits / 800 >= 0.9


def test_groups_of_several_blocks(spark, monkeypatch):
    """A chain in which hardly anything is near the hub, beside a group of its near copies."""
    monkeypatch.setattr(near_dups, "SHINGLES_PER_UNIT", 400)
    words = [f"w{i}" for i in range(60)]
    chain = []
    for i in range(25):
        words = [*words[:-1], f"c{i}"] if i % 2 else [f"d{i}", *words[1:]]
        chain.append(" ".join(words))
        words = words[1:] + [f"e{i}"]
    copies = [" ".join([*(f"k{j}" for j in range(70)), f"z{i}"]) for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(chain + copies)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame, 80).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in chain + copies]
    label = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert [got[i] for i in range(len(sets))] == label


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables are absent")
def test_quality_on_held_out_labels(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    scored = {r.doc_id: r for r in queries.QUERIES["op6_quality"](spark, SMALL).collect()}
    assert len(scored) == docs.count()
    held = [(r.quality, scored[r.doc_id]) for r in labels.filter("quality is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(s.held_out and (s.score >= 0.7) == bool(s.predicted) for _, s in held)
    good, bad = [s.score for q, s in held if q == 1], [s.score for q, s in held if q == 0]
    assert np.mean([bool(s.predicted) == (q == 1) for q, s in held]) >= 0.97
    assert np.mean([a > b for a in good for b in bad]) >= 0.98
    assert quality.N_FEATURES == 13 + quality.WORD_BINS


def test_quality_and_repeat_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join(word() + "$$$" for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", None, 0) for i, t in enumerate(good + bad)] + [(None, good[0], "en", "s", 0), (3, good[3], "en", "s", 0), (None, None, None, None, None)]
    spark.createDataFrame([(i, int(i < 80)) for i in range(120)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = pipeline.quality_stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    texts = [r.text for r in kept.collect()]
    assert kept.columns == pipeline.COLUMNS and sum(t in set(good) for t in texts) >= 80 and not set(bad) & set(texts)
    assert pipeline.quality_stage(spark, spark.createDataFrame([], schema), str(tmp_path)).count() == 0

    passage = "".join(rng.choice("abcdefgh") for _ in range(230))
    odd = [(1, "real � char", "en", "s", 0), (2, "ü" + passage + "é�", "en", "s", 0), (None, "x" + passage + "y", None, None, 0), (4, None, "en", "s", 0), (5, "", "en", "s", 0)]
    cut = pipeline.repeats_stage(spark, spark.createDataFrame(odd, schema), "").collect()
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars) for r in cut) == [(0, "xy", 2), (1, "real � char", 11), (2, "üé�", 3), (4, "", 0), (5, "", 0)]
    # Strings that share the second byte of a character are cut there, and the character goes whole.
    split = [(1, "é" + "n" * 5 + passage, "en", "s", 0), (2, "ĩ" + "n" * 5 + passage, "en", "s", 0)]
    assert sorted(r.text for r in pipeline.repeats_stage(spark, spark.createDataFrame(split, schema), "").collect()) == ["", ""]
    assert pipeline.repeats_stage(spark, spark.createDataFrame([], schema), "").count() == 0
