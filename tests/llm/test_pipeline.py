"""The pipeline's stages on tables with repeated rows, null ids and several texts under one id."""

import collections
import random
import re

import pytest

import corpus_pipeline as pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(source=lambda i: "s"):
    """Rows, and those of them that near-dedup keeps: (doc_id, text)."""
    rng = random.Random(5)
    make = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d, e, f, g = (make() for _ in range(7))
    near = b.split(" ")
    near[0] = "changed"
    rows = [(1, a), (1, a), (1, a), (3, b), (2, " ".join(near)), (None, c), (None, c), (None, d), (7, e), (7, b), (9, f), (None, f), (None, g), (11, "one two"), (None, None), (12, "")]
    kept = [(1, a), (2, " ".join(near)), (None, c), (None, d), (7, e), (9, f), (None, g), (11, "one two"), (None, None), (12, "")]
    return [(i, t, "en", source(k), len(t or "")) for k, (i, t) in enumerate(rows)], kept


def counted(rows):
    return collections.Counter((r[0], r[1]) for r in rows)


@pytest.mark.parametrize("parts", [1, 4])
def test_one_row_of_each_group_of_copies_stays(spark, parts):
    rows, kept = make_rows()
    left = pipeline.near_dup_stage(spark, spark.createDataFrame(rows, DOCS).repartition(parts), "").select(pipeline.COLUMNS)
    assert counted(left.select("doc_id", "text").collect()) == counted(kept)
    # No survivor loses bytes to a copy of itself.
    cut = pipeline.repeats_stage(spark, left, "").select("doc_id", "text").collect()
    assert counted((i, t or None) for i, t in cut) == counted((i, t or None) for i, t in kept)
    assert pipeline.near_dup_stage(spark, left.limit(0), "").count() == 0


def test_each_row_is_mixed_by_itself(spark):
    rng = random.Random(8)
    texts = [" ".join(["w"] * rng.randrange(1, 60)) + f" x{i}" for i in range(60)]
    rows = [(None if i % 3 == 0 else i % 5, t, "en", [None, "a", "b"][i % 7 % 3], len(t)) for i, t in enumerate(texts)] + [(None, None, "en", "a", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    took = lambda df: collections.Counter((r.doc_id, r.text, r.source) for r in pipeline.mixing_stage(spark, df, "").select(pipeline.COLUMNS).collect())
    got = took(frame.repartition(3))
    words = lambda t: len(re.findall(r"\S+", t or ""))
    goals = {r["source"]: r.target for r in pipeline.mixing.mix(frame).select("source", "target").distinct().collect()}
    for s, goal in goals.items():
        sums = 1
        for r in rows:
            for _ in range(3 if r[3] == s else 0):
                sums |= sums << words(r[1])
        taken = sum(n * words(t) for (_, t, x), n in got.items() if x == s)
        assert taken == (sums & ((1 << (round(goal) + 1)) - 1)).bit_length() - 1
    assert set(got) <= {(r[0], r[1], r[3]) for r in rows} and max(got.values()) <= 3
    assert took(frame.repartition(5)) == got


def test_run_packs_every_survivor_once(spark, tmp_path, monkeypatch):
    """With one source the target is the whole, so each row that near-dedup keeps and that has words comes once."""
    rows, kept = make_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(pipeline, "STAGES", [("quality classifier", lambda s, docs, d: docs.select(pipeline.COLUMNS)), *pipeline.STAGES[1:]])
    heads = lambda df: collections.Counter((r.doc_id, r.doc_tokens) for r in df.filter("start = 0").select("doc_id", "doc_tokens").collect())
    want = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in kept if t], DOCS)
    assert heads(pipeline.run(spark, str(tmp_path))) == heads(pipeline.packing_stage(spark, want, ""))
