"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import free_caches, table
from talkmill.llm.hashing import FIXED_BASE, in_slices, mix, word_hashes

#: Labelled rows that the model is fitted on, at most; chosen by hash.
TRAIN_ROWS = 20_000
PAIRS = 20_000
RIDGE = 1e-3
CUT_SCORE = 0.7

#: Byte classes whose shares of a text are features: 1 upper case, 2 "!", 3 other symbols, 4 "|", 5 digits, 6 ". ,", 7 line feeds.
CLASS = np.zeros(256, np.uint8)
for _name, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!", "#$%&*+<=>@\\^_`{}~[]/", "|", "0123456789", ".,", "\n"], 1):
    CLASS[list(_chars.encode())] = _name
#: Hashed words, besides.
WORD_BINS = 128
N_FEATURES = 13 + WORD_BINS


def features(texts: list[bytes]) -> np.ndarray:
    """(texts, N_FEATURES): roots of the byte classes' shares, repetition of words and lines, word length, length; roots of the hashed words' shares."""
    out = np.zeros((len(texts), N_FEATURES))
    for at, to in in_slices(texts):
        hashes, counts = word_hashes(texts[at:to], FIXED_BASE)
        hashes = mix(hashes)
        ends = np.cumsum(counts)
        for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True), at):
            text = texts[i]
            size = max(1, len(text))
            out[i, :7] = np.sqrt(np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=8)[1:] / size)
            words = hashes[end - n : end]
            lines = text.split(b"\n")
            out[i, 7] = np.mean(words[1:] == words[:-1]) if n > 1 else 0
            out[i, 8] = len(np.unique(words)) / n if n else 0
            out[i, 9] = np.log1p(len(np.unique(words))) / np.log1p(n) if n else 0
            out[i, 10] = 1 - len(set(lines)) / len(lines)
            out[i, 11] = np.log1p(size / (n + 1))
            out[i, 12] = np.log1p(n) / 10
            out[i, 13:] = np.sqrt(np.bincount((words >> np.uint64(40)) % np.uint64(WORD_BINS), minlength=WORD_BINS) / max(1, n))
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    spread: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, rising with the raw score; CUT_SCORE at the cut."""
        z = (self.raw(x) - self.cut) / self.spread + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-z.clip(-500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Bradley-Terry: the chance that a document of label 1 beats one of label 0 is the logistic of their scores'
    difference; Newton steps on the pairs' feature differences. The cut is the score quantile, of those tried, with
    the best accuracy on the sample, in the middle of the best run. With one label alone all scores are alike."""
    n = x.shape[1] if x.ndim == 2 else N_FEATURES
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        one = 0.0 if len(good) or not len(y) else 50.0
        return Model(np.zeros(n), np.ones(n), np.zeros(n), one, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = ((x - mean) / scale).clip(-8, 8)
    rng = np.random.default_rng(seed)
    diff = z[rng.choice(good, PAIRS)] - z[rng.choice(bad, PAIRS)]
    w = np.zeros(n)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(diff @ w).clip(-30, 30)))
        gradient = diff.T @ (1 - p) / PAIRS - RIDGE * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / PAIRS + RIDGE * np.eye(n)
        step = np.linalg.solve(curve, gradient)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    raw = z @ w
    tried = np.quantile(raw, np.linspace(0.0, 1.0, 2001))
    mids = (tried[1:] + tried[:-1]) / 2
    order = np.sort(raw[bad]), np.sort(raw[good])
    right = np.searchsorted(order[0], mids) + len(good) - np.searchsorted(order[1], mids)
    best = mids[right == right.max()]
    return Model(mean, scale, w, float((best[0] + best[-1]) / 2), float(max(raw.std() / 4, 1e-9)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``most`` labelled documents, those with the smallest hash of doc_id, held-out ones never.

    A document labelled twice counts with its smallest label; null labels don't count. Of rows with the same
    doc_id the one with the smallest hash of its text counts, so no more rows than labels reach the driver.
    """
    chosen = (
        labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def measure(batches):
        for batch in batches:
            x = features([t or b"" for t in batch.column(1).to_pylist()])
            told = pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), batch.column(3), told], ["doc_id", "quality", "h", "x"])

    measured = rows.select("doc_id", "text", "quality", F.xxhash64("text").alias("h")).mapInArrow(measure, "doc_id long, quality int, h long, x binary")
    got = measured.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("one")).select("one.quality", "one.x").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES).astype(float)
    order = np.lexsort(x.T)  # the order in which rows arrive doesn't matter
    return fit(x[order], got["quality"].to_numpy()[order])


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from CUT_SCORE on); one pass, no shuffle.

    A null text is scored as an empty one. Columns named score and predicted are replaced; all rows
    stay, repeated ones too; an empty table gives an empty result.
    """
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text)

    def run(batches):
        free_caches()
        for batch in batches:
            s = model.score(features([t.encode() if isinstance(t, str) else t or b"" for t in batch.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, pa.float64()), pa.array((s >= CUT_SCORE).astype(np.int32), pa.int32())], [*batch.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
