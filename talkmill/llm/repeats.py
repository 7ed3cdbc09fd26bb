"""Suffix-array dedup of repeated byte strings: difference-cover samples, then suffix buckets one at a time.

Suffixes matter only to the depth ``length``: two are in the same class if they start with the same
``length`` bytes. A suffix could be in a class with another only if, within the cover's period, both meet
sampled positions whose shorter strings are equal, whatever the two offsets are. So the sample's classes
are found first (the ranks of the cover), and the suffixes that no repeated sample reaches are never
sorted. The others are dealt to buckets by the leading bits of their strings' 64-bit fingerprint and each
bucket is sorted by itself; equal fingerprints are taken for equal strings. The fingerprint is a polynomial modulo
2 ** 61 - 1 in a base drawn for each run: any two different strings, whatever they hold, match with a chance
of LENGTH / 2 ** 61 at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import durable, free_caches, scratch_table, table
from talkmill.llm.hashing import draw, in_slices, windows

LENGTH = 200
#: A perfect difference cover: every difference modulo PERIOD is that of two members.
PERIOD = 133
COVER = [0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109]
#: Bytes of text that make a batch (one Python call) and that make a suffix bucket.
BATCH_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Groups in which the batches' own candidate runs pass the second exchange.
RUN_GROUPS = 1 << 16

_U = np.uint64
MESSAGE = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("keys", pa.binary()), ("many", pa.binary())])
REPLY = pa.schema([("batch", pa.int64()), ("stage", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("bits", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


class Batch:
    """The texts of one batch, in slices that fit a cache."""

    def __init__(self, texts: list[bytes], base: int):
        self.slices, self.base = [], base
        for at, to in in_slices(texts):
            ends = np.cumsum([len(t) for t in texts[at:to]])
            self.slices.append((np.frombuffer(b"".join(texts[at:to]), np.uint8), np.concatenate([[0], ends[:-1]]), ends))

    def samples(self):
        """Per slice: ascending sampled positions whose short string lies in the document; all short strings' hashes."""
        short, where, keys = LENGTH - PERIOD + 1, [], []
        for buf, starts, ends in self.slices:
            periods = np.maximum(0, -(-(ends - starts) // PERIOD))
            base = np.repeat(starts, periods) + PERIOD * (np.arange(int(periods.sum())) - np.repeat(np.cumsum(periods) - periods, periods))
            at = (base[:, None] + np.array(COVER)).ravel()
            at = at[at + short <= np.repeat(np.repeat(ends, periods), len(COVER))]
            where.append(at)
            keys.append(windows(buf, at, short, self.base))
        return where, np.concatenate(keys) if keys else np.zeros(0, _U)

    def candidates(self, where: list, repeated: np.ndarray):
        """Per slice: positions from which a repeated sample is less than a period away and LENGTH bytes are left."""
        at, out = 0, []
        for (buf, starts, ends), own in zip(self.slices, where, strict=True):
            hits = own[repeated[at : at + len(own)]]
            at += len(own)
            if not len(hits):
                out.append(hits)
                continue
            mark = np.zeros(len(buf) + 1, np.int32)
            low = np.maximum(hits - PERIOD + 1, starts[np.searchsorted(starts, hits, "right") - 1])
            np.add.at(mark, low, 1)
            np.add.at(mark, hits + 1, -1)
            p = np.flatnonzero(np.cumsum(mark[:-1]))
            out.append(p[p + LENGTH <= ends[np.searchsorted(ends, p, "right")]])
        return out

    def hashes(self, positions: list) -> np.ndarray:
        found = [windows(buf, p, LENGTH, self.base) for (buf, _, _), p in zip(self.slices, positions, strict=True)]
        return np.concatenate(found) if found else np.zeros(0, _U)


def texts_of(group: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The batch's texts in the order they were dealt, and that order."""
    order = np.argsort(group.column("row").to_numpy(), kind="stable")
    texts = group.column("body").to_pylist()
    return [texts[i] or b"" for i in order.tolist()], order


def shares(keys: np.ndarray, buckets: int):
    """Of sorted keys: the slice of each bucket that has any; buckets are equal ranges of the hash."""
    cuts = np.array([i * (1 << 64) // buckets for i in range(1, buckets)], _U)
    edges = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]]).tolist()
    return [(i, edges[i], edges[i + 1]) for i in range(buckets) if edges[i] < edges[i + 1]]


def messages(batch: int, keys: np.ndarray, counts: np.ndarray, buckets: int, exact: bool) -> pa.Table:
    """Distinct sorted keys, by bucket: gaps of 6 bytes if exact, else the 32 bits below the bucket's own."""
    rows = {c: [] for c in MESSAGE.names}
    for i, at, to in shares(keys, buckets):
        own = keys[at:to]
        if exact:
            gaps = np.diff(own)
            wide = len(gaps) and int(gaps.max()) >> 48
            packed = own.tobytes() if wide else gaps.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        else:
            packed = ((own - _U(i * (1 << 64) // buckets)) >> _U(max(0, 33 - buckets.bit_length()))).astype(np.uint32).tobytes()
        for c, x in zip(MESSAGE.names, (i, batch, to - at, int(own[:1].view(np.int64)[0]), packed, np.packbits(counts[at:to] > 1).tobytes()), strict=True):
            rows[c].append(x)
    return pa.table(rows, MESSAGE)


def unpacked(n: int, first: int, keys: bytes, exact: bool) -> np.ndarray:
    if not exact:
        return np.frombuffer(keys, np.uint32)
    if len(keys) == 8 * n:
        return np.frombuffer(keys, _U)
    out = np.zeros((n, 8), np.uint8)
    out[1:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
    out = out.view(_U).ravel()
    out[0] = np.array([first], np.int64).view(_U)[0]
    return np.cumsum(out, dtype=_U)


def bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def sort_bucket(group: pa.Table, stage: int) -> pa.Table:
    """Sorts one bucket; for each batch a bit for each of its keys: it is there twice, or in another batch."""
    rows = group.to_pylist()
    if rows[0]["bucket"] < 0:
        return pa.Table.from_pylist([{"batch": r["batch"], "stage": stage, "bucket": -1, "n": 0, "bits": r["keys"]} for r in rows], REPLY)
    keys = [unpacked(r["n"], r["first"], r["keys"], stage == 2) for r in rows]
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    last = every[order]
    same = np.concatenate([[False], last[1:] == last[:-1], [False]])
    again = np.empty(len(every), bool)
    again[order] = same[1:] | same[:-1]
    many = np.concatenate([bits(r["many"], r["n"]) for r in rows])
    # A key that one batch alone holds, but twice, is repeated; so is one beside an equal key.
    again |= many
    at, out = 0, {c: [] for c in REPLY.names}
    for r in rows:
        for c, x in zip(REPLY.names, (r["batch"], stage, r["bucket"], r["n"], np.packbits(again[at : at + r["n"]]).tobytes()), strict=True):
            out[c].append(x)
        at += r["n"]
    return pa.table(out, REPLY)


def flags(replies: pa.Table, stage: int, n: int) -> np.ndarray:
    """The replies' bits for the sorted distinct keys of a batch; its buckets are in order."""
    rows = sorted((r for r in replies.to_pylist() if r["stage"] == stage and r["bucket"] >= 0), key=lambda r: r["bucket"])
    return np.concatenate([bits(r["bits"], r["n"]) for r in rows]) if rows else np.zeros(n, bool)


def spans_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that strings of LENGTH from ``starts`` (ascending) cover."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], np.diff(starts) > LENGTH]))
    ends = np.append(starts[new[1:] - 1], starts[-1]) + LENGTH
    return list(zip(starts[new].tolist(), ends.tolist(), strict=True))


def dealt(docs: DataFrame, text: str) -> tuple[DataFrame, int]:
    """``docs`` with body, batch and row, written once and bucketed by batch: later passes read it without a shuffle."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    with_body = docs.withColumn("body", F.col(text).cast("binary")).drop(text)

    def deal(batches):
        from pyspark import TaskContext

        part, k, row, size = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            lengths = batch.column(batch.schema.names.index("body")).to_pylist()
            ids, rows = [], []
            for x in lengths:
                if size >= BATCH_BYTES:
                    k, row, size = k + 1, 0, 0
                ids.append((part << 24) + k)
                rows.append(row)
                row, size = row + 1, size + len(x or b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], [*batch.schema.names, "batch", "row"])

    schema = T.StructType([*with_body.schema, T.StructField("batch", T.LongType()), T.StructField("row", T.LongType())])
    name, path = scratch_table(spark, "repeats")
    tables = min(max(1, total // BATCH_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    (
        with_body.mapInArrow(deal, schema).write.format("parquet").option("compression", "zstd").option("path", path)
        .bucketBy(tables, "batch").saveAsTable(name)
    )
    return spark.table(name), max(8, total // BUCKET_BYTES)


def remove_repeats(docs: DataFrame, text: str = "text", whole_characters: bool = False) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, spans (array of start, end) and kept (binary: the bytes outside the spans).

    With ``whole_characters`` kept has no part of a character that a span's edge cuts.

    A byte is removed if a string of LENGTH bytes that covers it starts anywhere else in the table too,
    in the same document or another, overlaps included, judged on the input. Matches never cross
    documents. A null text is an empty one. Rows are documents, whatever their columns hold: repeated
    rows of LENGTH bytes or more remove each other. Columns named body, batch, row, n_bytes, spans and
    kept are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in ("body", "batch", "row", "n_bytes", "spans", "kept") if c != text])
    stored, buckets = dealt(docs, text)
    bodies, base = stored.select("batch", "row", "body"), draw().byte

    def sample(group: pa.Table) -> pa.Table:
        free_caches()
        texts, _ = texts_of(group)
        keys, counts = np.unique(Batch(texts, base).samples()[1], return_counts=True)
        return messages(group.column("batch")[0].as_py(), keys, counts, buckets, False)

    def suffixes(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return pa.table({c: [] for c in MESSAGE.names}, MESSAGE)
        own = Batch(texts_of(group)[0], base)
        where, keys = own.samples()
        distinct, back = np.unique(keys, return_inverse=True)
        found = own.candidates(where, flags(replies, 1, len(distinct))[back])
        keys, counts = np.unique(own.hashes(found), return_counts=True)
        batch = group.column("batch")[0].as_py()
        # The batch's own candidates travel with the messages, and come back to it with the replies.
        runs = pa.table([[-1 - batch % RUN_GROUPS], [batch], [len(found)], [0], [pack_runs(found)], [b""]], schema=MESSAGE)
        return pa.concat_tables([messages(batch, keys, counts, buckets, True), runs])

    def cut(group: pa.Table, replies: pa.Table) -> pa.Table:
        texts, order = texts_of(group)
        own = Batch(texts, base)
        runs = [r["bits"] for r in replies.to_pylist() if r["bucket"] == -1]
        found = unpack_runs(runs[0]) if runs else [np.zeros(0, np.int64)] * len(own.slices)
        distinct, back = np.unique(own.hashes(found), return_inverse=True)
        repeated, at, spans, kept = flags(replies, 2, len(distinct))[back], 0, [], []
        for (buf, starts, ends), p in zip(own.slices, found, strict=True):
            hits = p[repeated[at : at + len(p)]]
            at += len(p)
            edges = np.searchsorted(hits, np.append(starts, ends[-1] if len(ends) else 0))
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                doc = spans_of(hits[edges[i] : edges[i + 1]] - a)
                spans.append(doc)
                body = buf[a:b].tobytes()
                if doc:
                    edges_of = [0, *(e for span in doc for e in span), b - a]
                    parts = [body[x:y] for x, y in zip(edges_of[::2], edges_of[1::2], strict=True)]
                    body = b"".join([p.decode("utf-8", "ignore").encode() for p in parts] if whole_characters else parts)
                kept.append(body)
        rest = group.drop_columns(["body", "batch", "row"]).take(pa.array(order))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return (
            rest.append_column("n_bytes", pa.array([len(t) for t in texts], pa.int64()))
            .append_column("spans", pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], span))
            .append_column("kept", pa.array(kept, pa.binary()))
        )

    first = bodies.groupBy("batch").applyInArrow(sample, ddl(MESSAGE))
    ranks = durable(first.groupBy("bucket").applyInArrow(lambda g: sort_bucket(g, 1), ddl(REPLY)), "ranks")
    sent = bodies.groupBy("batch").cogroup(ranks.groupBy("batch")).applyInArrow(suffixes, ddl(MESSAGE))
    replies = durable(sent.groupBy("bucket").applyInArrow(lambda g: sort_bucket(g, 2), ddl(REPLY)), "classes")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    out = T.StructType([*docs.drop(text).schema, *added])
    return stored.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, out)


def pack_runs(positions: list) -> bytes:
    """Ascending positions of each slice as runs: counts of runs by slice, then starts, then lengths."""
    counts, starts, lengths = [], [], []
    for p in positions:
        new = np.flatnonzero(np.concatenate([[True], np.diff(p) != 1])) if len(p) else np.zeros(0, np.int64)
        counts.append(len(new))
        starts.append(p[new])
        lengths.append(np.diff(np.append(new, len(p))))
    parts = [np.array([len(counts), *counts], np.int64), *starts, *lengths]
    return np.concatenate(parts).astype(np.int64).tobytes()


def unpack_runs(data: bytes) -> list:
    x = np.frombuffer(data, np.int64)
    counts = x[1 : 1 + x[0]]
    n = int(counts.sum())
    starts, lengths = x[1 + x[0] : 1 + x[0] + n], x[1 + x[0] + n :]
    out, at = [], 0
    for c in counts.tolist():
        s, k = starts[at : at + c], lengths[at : at + c]
        at += c
        out.append(np.repeat(s - (np.cumsum(k) - k), k) + np.arange(int(k.sum())))
    return out


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP5_SQL = """
WITH bytes AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT k, pos, substr(h, 1 + 2 * pos, 2 * (1024 + 199)) AS p FROM (SELECT k, h, unnest(range(0, greatest(0, len(h) // 2 - 199), 1024)) AS pos FROM bytes)),
strings AS (SELECT k, pos + i AS start, substr(p, 1 + 2 * i, 400) AS s FROM (SELECT k, pos, p, unnest(range(0, least(1024, len(p) // 2 - 199))) AS i FROM parts)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
starts AS (SELECT k, start FROM strings JOIN twice USING (s)),
marked AS (SELECT k, start, CASE WHEN start - lag(start) OVER (PARTITION BY k ORDER BY start) <= 200 THEN 0 ELSE 1 END AS new FROM starts),
runs AS (SELECT k, start, sum(new) OVER (PARTITION BY k ORDER BY start) AS run FROM marked),
spans AS (SELECT k, run, min(start) AS a, max(start) + 200 AS b FROM runs GROUP BY ALL),
gaps AS (SELECT k, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS x, a AS y FROM spans UNION ALL SELECT k, max(b), NULL FROM spans GROUP BY k),
kept AS (SELECT g.k, string_agg(CASE WHEN y IS NULL THEN substr(h, 1 + 2 * x) ELSE substr(h, 1 + 2 * x, 2 * (y - x)) END, '' ORDER BY x) AS h FROM gaps g JOIN bytes b ON b.k = g.k GROUP BY g.k),
counted AS (SELECT k, count(*) AS n, sum(b - a)::BIGINT AS removed FROM spans GROUP BY k)
SELECT doc_id, len(b.h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256
FROM bytes b LEFT JOIN counted USING (k) LEFT JOIN kept USING (k)
"""
