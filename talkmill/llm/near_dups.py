"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import durable, free_caches, join_skewed, table
from talkmill.llm.components import connected_components
from talkmill.llm.hashing import Base, draw, in_slices, mix, shingle_sets

SHINGLE = 5
#: Symbols (of 8 bits) of a chunk, and how many of them may differ.
CHUNK, ERRORS = 8, 1
#: Chance that a pair at the threshold shares no chunk within the allowed errors.
MISS = 1e-12
#: Reps whose keys fill one bucket task.
REPS_PER_BUCKET = 5_000
#: Shingles that one verifying task holds.
SHINGLES_PER_UNIT = 500_000

_U = np.uint64


def n_chunks(percent: int) -> int:
    """Chunks such that a pair at the threshold is missed with a chance of MISS at most."""
    j = percent / 100
    hit = sum(math.comb(CHUNK, e) * j ** (CHUNK - e) * (1 - j) ** e for e in range(ERRORS + 1))
    return math.ceil(math.log(MISS) / math.log(1 - hit))


def signatures(sets: list[np.ndarray], symbols: int) -> list[bytes | None]:
    """One byte of each of ``symbols`` minimum hashes; None for an empty set."""
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    out: list[bytes | None] = [None] * len(sets)
    if len(full):
        values = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        factors = mix(np.arange(1, symbols + 1, dtype=_U)) | _U(1)
        sig = np.empty((len(full), symbols), np.uint8)
        for k in range(symbols):
            sig[:, k] = mix(np.minimum.reduceat(values * factors[k], starts)) >> _U(56)
        for i, row in zip(full.tolist(), sig, strict=True):
            out[i] = row.tobytes()
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, keys): each chunk with each allowed choice of ERRORS symbols blanked out, one by one.

    Two signatures that differ in at most ``chunks * (ERRORS + 1) - 1`` symbols share a key: by the
    pigeonhole principle some chunk holds at most ERRORS of the differences, and blanking them makes it equal.
    """
    chunks = sig.reshape(len(sig), -1, CHUNK).copy().view(_U)[:, :, 0]
    blanks = np.array([~np.uint64(0xFF << (8 * i)) & _U(0xFFFFFFFFFFFFFFFF) for i in range(CHUNK)], _U)
    tags = mix(np.arange(chunks.shape[1] * CHUNK, dtype=_U)).reshape(1, chunks.shape[1], CHUNK)
    return mix((chunks[:, :, None] & blanks) ^ tags).reshape(len(sig), -1)


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(distinct keys, smallest id of each, edges from the other ids to it)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    hub = ids[new][np.cumsum(new) - 1]
    other = ids != hub
    pairs = np.unique(np.stack([ids[other], hub[other]], 1), axis=0)
    return keys[new], ids[new], pairs[:, 0], pairs[:, 1]


def sketch(docs: DataFrame, percent: int, key: str, text: str, base: Base) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sig): size, 128-bit digest and signature of each text's set."""
    symbols = n_chunks(percent) * CHUNK

    def run(batches):
        free_caches()
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).to_pylist()]
            for at, to in in_slices(texts):
                sets = shingle_sets(texts[at:to], base, SHINGLE)
                sums = [(int(s.sum()), int((mix(s + _U(1))).sum())) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()),
                        *[pa.array(np.array([x[i] for x in sums], _U).view(np.int64)) for i in (0, 1)], pa.array(signatures(sets, symbols), pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as binary) text").mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary"
    )


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): for every key that several signatures share, an edge from each to the smallest of them.

    All that share a key are so connected. A map task joins its own first and sends each key once, so a
    bucket gets a key from a task at most once, however many share it.
    """
    buckets = max(8, reps.count() // REPS_PER_BUCKET)

    def send(keys, ids):
        keys, ids, a, b = stars(keys, ids)
        to = (keys % _U(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(buckets + 1))
        for i in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[i] : edges[i + 1]]
            last = i == np.flatnonzero(np.diff(edges))[-1]
            yield pa.RecordBatch.from_pydict(
                {"bucket": [i], "keys": [keys[own].tobytes()], "ids": [ids[own].tobytes()], "a": [a.tobytes() if last else b""], "b": [b.tobytes() if last else b""]},
                pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("keys", "ids", "a", "b")]]),
            )

    def index(batches):
        ids, sigs, n = [], [], 0
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sigs.append(chunk_keys(own))
            n += batch.num_rows
            if n >= REPS_PER_BUCKET:
                yield from send(np.concatenate(sigs).ravel(), np.concatenate([np.repeat(i, s.shape[1]) for i, s in zip(ids, sigs, strict=True)]))
                ids, sigs, n = [], [], 0
        if n:
            yield from send(np.concatenate(sigs).ravel(), np.concatenate([np.repeat(i, s.shape[1]) for i, s in zip(ids, sigs, strict=True)]))

    def meet(group: pa.Table) -> pa.Table:
        got = {c: np.frombuffer(b"".join(group.column(c).to_pylist()), _U if c == "keys" else np.int64) for c in ("keys", "ids", "a", "b")}
        _, _, a, b = stars(got["keys"], got["ids"])
        pairs = np.unique(np.stack([np.concatenate([a, got["a"]]), np.concatenate([b, got["b"]])], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    sent = reps.select("doc_id", "sig").mapInArrow(index, "bucket int, keys binary, ids binary, a binary, b binary")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long")


def links_within(texts: list[bytes], blocks: np.ndarray, percent: int, base: Base) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by exact counts over posting lists.

    If there are two blocks, only pairs of both are counted.
    """
    sets = [s for at, to in in_slices(texts) for s in shingle_sets(texts[at:to], base, SHINGLE)]
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if len(sets) else np.zeros(0, _U)
    order = np.argsort(values, kind="stable")
    post = who[order]
    new = np.flatnonzero(np.concatenate([[True], values[order][1:] != values[order][:-1]])) if len(values) else np.zeros(0, int)
    run = np.diff(np.append(new, len(values)))
    start_of, run_of = np.empty(len(values), np.int64), np.empty(len(values), np.int64)
    start_of[order], run_of[order] = np.repeat(new, run), np.repeat(run, run)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest, at = [], 0
    apart = len(set(blocks.tolist())) > 1
    for i, n in enumerate(sizes.tolist()):
        runs, starts = run_of[at : at + n], start_of[at : at + n]
        at += n
        starts, runs = starts[runs > 1], runs[runs > 1]
        if not len(runs):
            continue
        jump = np.arange(int(runs.sum())) + np.repeat(starts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs)
        both = np.bincount(post[jump], minlength=len(sets))[:i]
        near = 100 * both >= percent * (sizes[:i] + n - both)
        if apart:
            near &= blocks[:i] != blocks[i]
        for j in np.flatnonzero(near & (both > 0)).tolist():
            if (x := root(i)) != (y := root(j)):
                parent[x] = y
                forest.append((i, j))
    return forest


def _apart(members: DataFrame, links: DataFrame, unit: list) -> DataFrame:
    """Units for groups of several blocks, whose blocks have each been compared within and with the group's hub, its smallest id.

    What the hub is linked to, over others too, is one component already, whatever its block. Only the rest is sent to
    the other blocks: a group of copies of its hub costs as much as its size, not as much as the square of it.
    """
    found = connected_components(links).select(F.col("id").alias("_id"), F.col("component").alias("_label"))
    label = F.coalesce("_label", "id").alias("label")
    known = members.join(found, F.col("id") == F.col("_id"), "left").select("id", "component", "block", "n_blocks", label)
    hub = known.filter("id = component").select("component", F.col("label").alias("hub"))
    rest = known.join(hub, "component").filter("label != hub").select("id", "component", "block", "n_blocks")
    away = rest.select("id", "component", "n_blocks", F.col("block").alias("home"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block")).filter("block != home")
    with_rest = rest.select("component").distinct()
    stay = members.join(with_rest, "component", "left_semi").select(F.col("id").alias("rep_id"), *unit, "block")
    return stay.unionByName(away.select(F.col("id").alias("rep_id"), *unit, F.col("home").alias("block")))


def near_duplicates(docs: DataFrame, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: near-duplicates by 5-word shingles.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets. Rows
    with equal sets are one class, its smallest doc_id stands for it. Signatures name candidates: a
    linked pair at the threshold is missed with a chance of MISS, nearer ones with a smaller one. Every candidate group is then compared
    in full: small ones many to a task, large ones block by block, with what isn't linked to the group's
    hub sent to the other blocks too, each task giving no more than a spanning forest. Null or empty texts have no shingles and are linked with nothing. Rows with the
    same doc_id are the same document. Rows with a null doc_id are returned with a null component_id
    and kept, linked with nothing. Other columns are not read; an empty table gives an empty result.
    """
    base = draw()
    known = durable(sketch(docs, percent, key, text, base), "sketch")
    classes = known.filter("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    full = known.filter("n_shingles > 0").alias("k")
    reps = full.join(classes.alias("c"), F.expr("k.doc_id = c.rep and k.set_a = c.set_a and k.set_b = c.set_b"), "left_semi").dropDuplicates(["doc_id", "set_a"])
    reps = durable(reps.select("doc_id", "n_shingles", "sig"), "reps")
    groups = connected_components(candidate_edges(reps))
    sized = groups.join(reps.select("doc_id", "n_shingles"), F.col("id") == F.col("doc_id")).select("id", "component", "n_shingles")
    totals = sized.groupBy("component").agg(F.sum("n_shingles").alias("total"))
    half = SHINGLES_PER_UNIT // 2
    totals = durable(totals.withColumn("n_blocks", F.when(F.col("total") <= SHINGLES_PER_UNIT, 1).otherwise(F.ceil(F.col("total") / half)).cast("int")), "groups")
    small_total = totals.filter("n_blocks = 1").agg(F.sum("total")).first()[0] or 0
    bins = max(8, math.ceil(small_total / half))
    placed = groups.join(totals, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    texts = docs.selectExpr(f"cast(`{key}` as long) doc_id", f"cast(`{text}` as binary) text")

    def verify(group: pa.Table) -> pa.Table:
        ids = group.column("doc_id").to_numpy()
        forest = links_within([x or b"" for x in group.column("text").to_pylist()], group.column("block").to_numpy(), percent, base)
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in forest], pa.int64()), "b": pa.array([int(ids[j]) for _, j in forest], pa.int64())})

    def compared(units: DataFrame, label: str) -> DataFrame:
        """Links within each unit (rep_id, cut, unit, block): of different blocks if it has several."""
        joined = texts.join(units, F.col("doc_id") == F.col("rep_id")).select("unit", "cut", "doc_id", "block", "text")
        return durable(joined.groupBy("cut", "unit").applyInArrow(verify, "a long, b long"), label)

    own_unit = F.when(F.col("n_blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "block"))
    unit = [(F.col("n_blocks") > 1).alias("cut"), own_unit.alias("unit")]
    own = placed.select(F.col("id").alias("rep_id"), *unit, F.lit(0).alias("block"))
    each_block = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    cut = totals.filter("n_blocks > 1")
    hubs = cut.withColumn("block", each_block).select(F.col("component").alias("rep_id"), *unit, F.lit(0).alias("block"))
    links = compared(own.unionByName(hubs).dropDuplicates(["rep_id", "cut", "unit"]), "links")
    if not cut.isEmpty():
        links = links.unionByName(compared(_apart(placed.filter("n_blocks > 1"), links, unit), "more-links"))
    found = connected_components(links)
    labels = classes.join(found, F.col("rep") == F.col("id"), "left").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"), F.coalesce("component", "rep").alias("component_id"))
    is_text = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    labelled = join_skewed(known.filter(is_text).select("doc_id", "n_shingles", "set_a", "set_b"), labels, {"set_a": "a", "set_b": "b"})
    alone = known.filter(~is_text).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = labelled.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP10_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS other FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(x.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(l.component_id, d.doc_id), true) AS kept
FROM documents d LEFT JOIN sizes x ON x.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id
"""


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)
