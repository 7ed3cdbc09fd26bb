"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talkmill.llm.common import durable, table

#: Vectors that the index is fitted on, at most; chosen by hash.
TRAIN_ROWS = 20_000
#: Vectors of the sample that a list is fitted on, at least: there are at most TRAIN_ROWS over this lists, and about a quarter of the root of all rows.
ROWS_PER_LIST = 8
SUBSPACES, CODES = 16, 256
#: Share of true neighbours, among the sample, whose lists a query must probe; queries of the table, and of the sample, it is measured with.
PROBE_RECALL, PROBE_QUERIES = 0.98, 300
#: Vectors of a block that are reranked exactly before bounds tell which others must be.
RERANK = 256
BLOCK_ROWS = 20_000
#: Queries that one task compares with a block.
BLOCK_QUERIES = 5_000


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.stack([np.bincount(own, column, len(centres)) for column in x.T], 1)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    middle = y.mean(0)
    x, y = x - middle, y - middle
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


@dataclass(frozen=True)
class Index:
    """Coarse centroids, for each subspace a codebook of residuals, and how far towards other lists a query looks."""

    centres: np.ndarray
    books: list
    cuts: list
    reach: float

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each vector's list, codes, and distance from what the codes say."""
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        codes = [nearest(rest[:, a:b], book) for book, (a, b) in zip(self.books, self.cuts, strict=True)]
        told = np.concatenate([book[c] for book, c in zip(self.books, codes, strict=True)], 1)
        return own, np.stack(codes, 1).astype(np.uint8), np.sqrt(((rest - told) ** 2).sum(1))

    def probes(self, q: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) pairs: the lists whose border is within ``reach`` times the distance in which a query's neighbours lie."""
        return np.nonzero(borders(q, self.centres) <= self.reach * far[:, None])

    def tables(self, q: np.ndarray, cell: int) -> list[np.ndarray]:
        """Asymmetric distances: of each query's residual to all codes, by subspace."""
        rest = q - self.centres[cell]
        return [squared(rest[:, a:b], book) for book, (a, b) in zip(self.books, self.cuts, strict=True)]


def fit(sample: np.ndarray, rows: int, asked: np.ndarray, k: int = 10, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    lists = int(min(max(1, np.sqrt(rows) / 4), max(1, len(sample) / ROWS_PER_LIST)))
    centres = kmeans(sample, max(1, lists), 12, rng)
    rest = sample - centres[nearest(sample, centres)]
    edges = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int).tolist()
    cuts = list(zip(edges[:-1], edges[1:], strict=True))
    some = sample[rng.choice(len(sample), min(PROBE_QUERIES, len(sample)), replace=False)]
    reach = max(reach_needed(sample, q, centres, k) for q in (some, asked))
    return Index(centres, [kmeans(rest[:, a:b], CODES, 8, rng) for a, b in cuts], cuts, reach)


def borders(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each list is from each query at least: the distance to the plane midway between the list's centre and the query's nearest one."""
    to = squared(q, centres)
    first = to.argmin(1)
    gap, between = to - to.min(1)[:, None], np.sqrt(np.maximum(squared(centres[first], centres), 0))
    return np.divide(gap, 2 * between, out=np.zeros_like(gap), where=between > 0)


def farthest(q: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A distance in which each query has ``k`` neighbours, itself not counted; any distance if the sample is too small to tell."""
    if len(sample) <= k:
        return np.full(len(q), np.inf)
    parts = [np.partition(squared(q[i : i + 256], sample), k, 1)[:, k] for i in range(0, len(q), 256)]
    return np.sqrt(np.maximum(np.concatenate(parts), 0))


def reach_needed(sample: np.ndarray, asked: np.ndarray, centres: np.ndarray, k: int) -> float:
    """The smallest reach that takes in PROBE_RECALL of the true neighbours, among the sample, of the vectors asked; 1 takes in all."""
    if len(sample) <= k:
        return 1.0
    if not len(asked):
        return 0.0
    to = squared(asked, sample)
    true = np.argsort(to, 1, kind="stable")[:, 1 : k + 1]
    far = np.sqrt(np.maximum(np.take_along_axis(to, true[:, -1:], 1), 0))
    border = np.take_along_axis(borders(asked, centres), nearest(sample, centres)[true], 1)
    share = np.divide(border, far, out=np.where(border > 0, 1.0, 0.0), where=far > 0)
    return float(min(1.0, np.quantile(share, PROBE_RECALL, method="higher")))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that is not null, not zero, and holds only finite numbers."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(fine & F.col("vec_id").isNotNull())


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, by Euclidean distance, ties to the smaller vec_id.

    All vectors are indexed; the index is fitted on TRAIN_ROWS of them, and on PROBE_QUERIES of the queries. Of equal vectors the k + 1
    smallest ids are kept, which is all that any answer can hold, and they are searched once; so are
    equal queries. A list is searched in blocks of BLOCK_ROWS, each with BLOCK_QUERIES of the queries that probe it at a time:
    asymmetric distances choose RERANK of the block, whose exact double distances tell how near others must be; all that may be, by
    their asymmetric distance and their distance from their codes, are reranked too. So a list that is probed loses no neighbour. A
    query probes the lists whose border is near enough, measured by the distance in which it has k neighbours in the sample.
    Vectors of another length than the most frequent one, null ids, and null, zero or non-finite
    vectors take no part. Rows with the query's own id are no candidates. Fewer candidates give fewer
    rows; an empty table gives an empty result. Other columns are not read.
    """
    rows = usable(vectors, key, vector)
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1
    total = widths[0]["count"] if widths else 0
    rows = rows.filter(F.size("v") == width)
    asked = usable(queries, key, vector).filter(F.size("v") == width).distinct()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAIN_ROWS).select("v").toPandas()["v"]
    if not total:
        return rows.selectExpr("vec_id query_id", "cast(0 as int) rank", "vec_id", "cast(0 as double) score").limit(0)
    trained = np.unique(np.array(sample.tolist(), float), axis=0)
    tried = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBE_QUERIES).select("v").toPandas()["v"]
    index = fit(trained, total, np.array(tried.tolist(), float).reshape(-1, width), k)

    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k + 1)
    groups = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))

    def encode(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                cells, codes, error = index.encode(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], ["v", "ids", "cell", "code", "error"])

    def probe(batches):
        for batch in batches:
            q = matrix(batch.column(0))
            if len(q):
                again, cells = index.probes(q, farthest(q, trained, k))
                for i in range(0, len(again), 10_000):
                    some = pa.array(again[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(cells[i : i + 10_000], pa.int32())], ["q", "qid", "cell"])

    coded = durable(groups.mapInArrow(encode, "v array<double>, ids array<long>, cell int, code binary, error double"), "index")
    blocks = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64(F.col("ids")[0]), F.col("n_blocks")).cast("int")
    once = durable(asked.groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    wanted = once.mapInArrow(probe, "q array<double>, qid long, cell int")
    asks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("n_parts"))
    grid = durable(blocks.join(asks, "cell"), "grid")
    # Each block meets each part of the queries that probe its list.
    stored = coded.join(grid, "cell").withColumn("block", block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_blocks", "n_parts")
    wanted = wanted.join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("n_parts")).cast("int"))
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks", "n_parts")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("qid", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        x, q = matrix(left.column("v")), matrix(right.column("q"))
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        error, ids = left.column("error").to_numpy(), left.column("ids").to_pylist()
        low = np.array([i[0] for i in ids])
        first_ones = max(RERANK, k + 1)
        qids, cell, out = right.column("qid").to_pylist(), left.column("cell")[0].as_py(), ([], [], [])
        for at in range(0, len(q), 32):
            some = q[at : at + 32]
            about = np.maximum(sum(t[:, codes[:, j]] for j, t in enumerate(index.tables(some, cell))), 0)
            rounding = 1e-7 * np.sqrt(((some - index.centres[cell]) ** 2).sum(1))
            for i, row in enumerate(about):
                short = np.argpartition(row + error**2, first_ones)[:first_ones] if len(row) > first_ones else np.arange(len(row))
                exact = np.sqrt(((x[short] - some[i]) ** 2).sum(1))
                if len(row) > first_ones:
                    may = np.sqrt(row) - error <= np.partition(exact, k)[k] + rounding[i]
                    may[short] = False
                    more = np.flatnonzero(may)
                    short, exact = np.concatenate([short, more]), np.concatenate([exact, np.sqrt(((x[more] - some[i]) ** 2).sum(1))])
                for j in np.lexsort((low[short], exact))[: k + 1]:
                    out[0].append(qids[at + i])
                    out[1].append(float(exact[j]))
                    out[2].append(ids[short[j]])
        return pa.table([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], kinds)

    found = stored.groupBy("cell", "block", "part").cogroup(wanted.groupBy("cell", "block", "part")).applyInArrow(scan, "qid long, score double, ids array<long>")
    near = found.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("score", F.col("ids")[0]))).filter(F.col("rn") <= k + 1)
    answers = asked.join(once.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("vec_id").alias("query_id"), "qid")
    named = answers.join(near, "qid").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))
