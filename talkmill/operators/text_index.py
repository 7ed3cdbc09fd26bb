"""An inverted index that is kept: immutable segments of postings, deletions apart, statistics in the manifest.

Rows (key, seq, text) are documents, or messages of a session: a key may have many. Each commit adds one segment:

- ``postings`` (term, key, seq, length, lead, positions, tf), side by side for each term, and dealt by ranges of terms, drawn from a sample of
  the rows: a frequent term is cut by key, and no file has more than ROWS_PER_FILE rows. ``files`` lists each file's range, so a query
  opens the files of its terms alone.
- ``heads`` (term, key, n, entries) are what ranking needs. They are not stored: they are columns of the postings, which are read without the
  positions. The best score of a key follows from them whatever the corpus statistics are by then, without a look at its rows.
- ``sizes`` (key, rows, length), and ``deleted`` (key): keys of earlier segments that are gone or have come anew. The manifest
  names the segments that a deletion ``touches``; the others are read without a look at it.

A row's postings are made where the row is read, and travel once, to their range, in blocks: up to BLOCK postings of a term that one Arrow
batch holds. So blocks are sorted, not postings, and a term travels once a block. Rows that few tasks would read are dealt out before.

Adding, changing and removing write one new segment and read, of earlier ones, the sizes of the keys that go. The newest
segments are merged before they are many; a merge drops what is deleted.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.functions.text import index_terms
from talkmill.operators.commits import Commits
from talkmill.operators.search import Corpus, bm25, parse_query
from talkmill.sources.shared import written

#: Rows of a file, at most.
ROWS_PER_FILE = 1_000_000
#: Segments from which the newest are merged; a merge takes in an older segment unless that is so many times larger than the newer ones together.
MOST_SEGMENTS, LARGER = 8, 4

#: Rows whose terms tell the ranges, about; chosen by hash. A range holds about so many bytes of postings.
SAMPLE_ROWS, RANGE_BYTES = 5_000, 16 << 20

#: Postings of a block, at most.
BLOCK = 512

#: Rows of a task that are few enough whatever its share is, and rows of a task where they are dealt out.
FEW_ROWS, ROWS_PER_TASK = 10_000, 50_000

#: How segments are laid out; an index of another format is refused.
FORMAT = 2
STORED = "seq long, length int, lead boolean, positions array<int>, tf int"


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt out if a task has more than twice its share of them: readers don't cut the row groups of a file, and a table may have few.

    Only then texts are moved, which are a fraction of their postings. Neighbours stay together, as keys in order take less room."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    most, n = rows.groupBy(F.spark_partition_id().alias("part")).count().agg(F.max("count"), F.sum("count")).first()
    if not n or most <= max(FEW_ROWS, 2 * n / cores):
        return rows
    return rows.repartitionByRange(max(2 * cores, n // ROWS_PER_TASK), "key", "seq")


def once(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row for each (key, seq), and how many: of a repeated one the smallest text counts. Only repeated rows are moved."""
    met = rows.groupBy("key", "seq").agg(F.count("*").alias("n"))
    n, most = met.agg(F.count("*"), F.max("n")).first()
    if (most or 1) == 1:
        return rows, n
    again = written(met.filter("n > 1").select(F.col("key").alias("_key"), F.col("seq").alias("_seq")), "repeated-rows")
    same = F.col("key").eqNullSafe(F.col("_key")) & F.col("seq").eqNullSafe(F.col("_seq"))
    least = rows.join(again, same, "left_semi").groupBy("key", "seq").agg(F.min("text").alias("text"))
    return rows.join(again, same, "left_anti").unionByName(least), n


class Ranges:
    """Ranges of terms of about RANGE_BYTES each: a term with more than that has several, and its keys are dealt among them."""

    def __init__(self, weights: list[tuple[str, int]], times: float):
        """``weights``: bytes of each term's postings in a sample; ``times``: what they are to be multiplied by."""
        ordered = sorted(weights)
        ends = np.cumsum([w for _, w in ordered])
        self.count = max(1, int(np.ceil(ends[-1] * times / RANGE_BYTES))) if ordered else 1
        terms = np.array([t for t, _ in ordered] or [""], object)
        at = np.searchsorted(ends, ends[-1] * np.arange(1, self.count) / self.count) if ordered else []
        self.bounds = terms[np.asarray(at, int)].tolist()

    def of(self, terms: pa.Array, which: np.ndarray, deal: np.ndarray) -> pa.Array:
        """The range of each row: its term is ``terms[which]``, ``deal`` a hash of its key."""
        names, bounds = np.array(terms.to_pylist(), object), np.array(self.bounds, object)
        low, high = np.searchsorted(bounds, names, "left"), np.searchsorted(bounds, names, "right")
        return pa.array((low[which] + deal % (high - low + 1)[which]).astype(np.int32), pa.int32())


def ranges_of(rows: DataFrame, n: int) -> Ranges:
    """From the terms of about SAMPLE_ROWS of ``n`` rows."""
    times = max(1, n // SAMPLE_ROWS)
    some = rows.filter(F.pmod(F.xxhash64("key", "seq"), F.lit(times)) == 0)
    met = some.select(F.explode(index_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return Ranges([(r.term, 24 * min(r.n, SAMPLE_ROWS) + 4 * r.n) for r in met.collect()], times)


def _block_schema(key: T.DataType) -> str:
    return f"term string, part int, keys array<{key.simpleString()}>, seqs array<long>, lengths array<int>, tfs array<int>, starts array<int>, places array<int>"


def _blocks(names: pa.Array, which: np.ndarray, part: np.ndarray, key: pa.Array, seq: pa.Array, length: pa.Array, positions: pa.ListArray) -> pa.RecordBatch:
    """Blocks of postings, whose terms are ``names[which]``: ``places`` are the positions of all of them, ``starts`` and ``tfs`` whose are where."""
    order = np.lexsort((part, which))
    which, part = which[order], part[order]
    key, seq, length, positions = (c.take(pa.array(order)) for c in (key, seq, length, positions))
    ends = positions.offsets.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], (np.diff(which) != 0) | (np.diff(part) != 0)]))
    at = np.arange(len(which)) - np.repeat(first, np.diff(np.append(first, len(which))))
    block = np.flatnonzero(at % BLOCK == 0)
    bounds = np.append(block, len(which))
    starts = ends[:-1] - np.repeat(ends[block], np.diff(bounds))
    cut = lambda values, to=bounds: pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), values)
    tfs, starts = (pa.array(x.astype(np.int32)) for x in (np.diff(ends), starts))
    columns = [names.take(pa.array(which[block])), pa.array(part[block]), cut(key), cut(seq), cut(length), cut(tfs), cut(starts), cut(positions.flatten(), ends[bounds] - ends[0])]
    return pa.RecordBatch.from_arrays(columns, ["term", "part", "keys", "seqs", "lengths", "tfs", "starts", "places"])


def blocks_of(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """The postings of ``rows`` in blocks; a row without terms has one with an empty term. ``part`` is a block's range."""
    cut = rows.select("key", "seq", F.xxhash64("key").alias("deal"), index_terms(F.col("text")).alias("terms"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            key, seq, deal, terms = batch.columns
            lengths, words = np.diff(terms.offsets.to_numpy()), terms.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lengths)), lengths)
            position = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            known = words.dictionary
            word = words.indices.to_numpy(zero_copy_only=False)
            pair = word * np.int64(len(lengths)) + row
            order = np.argsort(pair, kind="stable")
            first = np.flatnonzero(np.diff(pair[order], prepend=-1))
            bare = np.flatnonzero(lengths == 0)
            owner = np.concatenate([row[order[first]], bare])
            which = np.concatenate([word[order[first]], np.full(len(bare), len(known))])
            names = pa.concat_arrays([known.cast(pa.string()), pa.array([""])])
            places = pa.ListArray.from_arrays(np.concatenate([first, np.full(len(bare) + 1, len(row))]).astype(np.int32), pa.array(position[order].astype(np.int32)))
            part = ranges.of(names, which, deal.to_numpy()[owner]).to_numpy()
            mine = pa.array(owner)
            yield _blocks(names, which, part, key.take(mine), seq.take(mine), pa.array(lengths[owner].astype(np.int32)), places)

    return cut.mapInArrow(run, _block_schema(rows.schema["key"].dataType))


def opened(blocks: DataFrame) -> DataFrame:
    """(term, key, seq, length, lead, positions, part) of each posting of ``blocks``, in their order; ``lead`` marks one posting of each row."""
    of = lambda name: F.col(name)[F.col("i")]
    each = blocks.select("term", "part", F.posexplode("keys").alias("i", "key"), "seqs", "lengths", "tfs", "starts", "places")
    met = each.select("term", "key", of("seqs").alias("seq"), of("lengths").alias("length"), F.slice("places", of("starts") + 1, of("tfs")).alias("positions"), "part")
    return met.select("term", "key", "seq", "length", F.coalesce(F.get("positions", F.lit(0)) == 0, F.lit(True)).alias("lead"), "positions", "part")


def postings_of(rows: DataFrame, ranges: Ranges) -> DataFrame:
    """(term, key, seq, length, lead, positions, part) of all ``rows``, where they are read."""
    return opened(blocks_of(rows, ranges))


def ranges_of_postings(postings: DataFrame, n: int) -> Ranges:
    """From the postings of about SAMPLE_ROWS of ``n`` rows."""
    times = max(1, n // SAMPLE_ROWS)
    some = postings.filter(F.pmod(F.xxhash64("key", "seq"), F.lit(times)) == 0)
    met = some.groupBy("term").agg((24 * F.count("*") + 4 * F.sum(F.size("positions"))).alias("n"))
    return Ranges([(r.term, r.n) for r in met.collect()], times)


def dealt(postings: DataFrame, ranges: Ranges) -> DataFrame:
    """Stored ``postings`` in blocks."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            term, deal, key, seq, length, positions = batch.columns
            words = term.dictionary_encode()
            names, which = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
            part = ranges.of(names, which, deal.to_numpy()).to_numpy()
            yield _blocks(names, which, part, key, seq, length, positions)

    cut = postings.select("term", F.xxhash64("key").alias("deal"), "key", "seq", "length", "positions")
    return cut.mapInArrow(run, _block_schema(postings.schema["key"].dataType))


def sizes_of(postings: DataFrame) -> DataFrame:
    return postings.filter("lead").groupBy("key").agg(F.count("*").alias("rows"), F.sum("length").alias("length"))


class View:
    """One version of an index, for reading."""

    def __init__(self, spark: SparkSession, path: str, state: dict):
        self.spark, self.path, self.state = spark, path, state
        self.segments = state["segments"]

    def corpus(self) -> Corpus:
        """Rows and mean length of what is live, from the manifest alone."""
        return Corpus(self.state["rows"], self.state["length"] / self.state["rows"] if self.state["rows"] else 1.0, ())

    def _open(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{folder}")

    def live(self, kind: str, terms: list[str] | None = None, start: int = 0, columns: list | None = None) -> DataFrame:
        """Rows of one kind from the segments from ``start`` on, without keys that a later segment deletes; of ``terms``, only their files are opened.

        ``columns``, the key among them, are what is read of each row; ``_at``, its segment's number, may be one."""
        if kind == "heads":
            own = ["term", "key", F.lit(1).cast("long").alias("n"), F.array(F.struct("tf", "length", "seq")).alias("entries")]
            return self.live("postings", terms, start, own).filter("term != ''")
        files = self._files(self.segments[start:], terms) if terms is not None else None
        parts = []
        for i, s in enumerate(self.segments[start:], start):
            where = f"{self.path}/{s['folder']}/{kind}"
            if files is None:
                rows = self.spark.read.schema(self._schema(kind)).parquet(where)
            elif own := files.get(s["folder"]):
                rows = self.spark.read.schema(self._schema(kind)).parquet(*[f"{where}/{f}" for f in own]).filter(F.col("term").isin(*terms))
            else:
                continue
            rows = rows.withColumn("_at", F.lit(i)).select(*columns) if columns else rows
            if later := [self._open(t["deleted"]) for t in self.segments[i + 1 :] if t["deleted"] and s["folder"] in t.get("touches", [s["folder"]])]:
                dead = reduce(DataFrame.unionByName, later).select(F.col("key").alias("_gone")).distinct()
                rows = rows.join(dead, F.col("key") == F.col("_gone"), "left_anti")
            parts.append(rows)
        if not parts:
            rows = self.spark.createDataFrame([], self._schema(kind))
            return rows.withColumn("_at", F.lit(0)).select(*columns) if columns else rows
        return reduce(DataFrame.unionByName, parts)

    def _schema(self, kind: str) -> T.StructType:
        key = self.state["key"] or "string"
        return T.StructType.fromDDL(f"key {key}, rows long, length long" if kind == "sizes" else f"term string, key {key}, {STORED}")

    def _files(self, segments: list[dict], terms: list[str]) -> dict[str, list[str]]:
        """For each segment the files whose range takes in one of ``terms``."""
        if not segments or not terms:
            return {}
        listed = [self._open(f"{s['folder']}/files").withColumn("folder", F.lit(s["folder"])) for s in segments]
        within = reduce(lambda a, b: a | b, [(F.col("low") <= t) & (F.col("high") >= t) for t in sorted(set(terms))])
        out: dict[str, list[str]] = {}
        for r in reduce(DataFrame.unionByName, listed).filter(within).select("folder", "file").collect():
            out.setdefault(r.folder, []).append(r.file)
        return out

    def postings(self) -> DataFrame:
        """All live postings (term, key, seq, length, lead, positions, tf)."""
        return self.live("postings").filter("term != ''")

    def statistics(self) -> DataFrame:
        """(term, rows, n): rows that hold each term, and its occurrences."""
        met = self.live("postings", columns=["term", "key", F.col("tf").alias("n")]).filter("term != ''")
        return met.groupBy("term").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))

    def hits(self, units: list[list[str]]) -> DataFrame:
        """(unit, key, n, entries) of each key that holds a unit: single terms from the heads, terms side by side from their positions."""
        single = [(u[0], i) for i, u in enumerate(units) if len(u) == 1]
        found = []
        if single:
            heads = self.live("heads", sorted({t for t, _ in single}))
            whose = F.filter(F.array(*[F.when(F.col("term") == t, F.lit(i)) for t, i in single]), lambda i: i.isNotNull())
            found.append(heads.select(F.explode(whose).alias("unit"), "key", "entries").select("unit", "key", F.inline("entries")))
        for i, unit in enumerate(units):
            if len(unit) > 1:
                found.append(self._side_by_side(unit).select(F.lit(i).alias("unit"), "key", "tf", "length", "seq"))
        # Of a key's rows with the same count the shortest is the best one, then the one with the smallest seq.
        counts = reduce(DataFrame.unionByName, found).groupBy("unit", "key", "tf").agg(F.count("*").alias("n"), F.min(F.struct("length", "seq")).alias("least"))
        entry = F.struct("tf", F.col("least.length").alias("length"), F.col("least.seq").alias("seq"))
        return counts.groupBy("unit", "key").agg(F.sum("n").alias("n"), F.collect_list(entry).alias("entries"))

    def _side_by_side(self, unit: list[str]) -> DataFrame:
        """(key, seq, length, tf) of the rows in which the terms stand side by side, and how often."""
        terms = sorted(set(unit))
        each = self.live("postings", terms).groupBy("key", "seq").agg(F.max("length").alias("length"), F.collect_list(F.struct("term", "positions")).alias("met"))
        places = lambda i: F.transform(F.element_at(F.filter("met", lambda m: m["term"] == unit[i]), 1)["positions"], lambda p: p - i)
        starts = reduce(F.array_intersect, [places(i) for i in range(len(unit))])
        return each.filter(F.size("met") == len(terms)).select("key", "seq", "length", F.size(starts).alias("tf")).filter("tf > 0")

    def holding(self, hits: DataFrame, units: int) -> list[int]:
        """For each unit the rows of the whole index that hold it."""
        known = {r.unit: r.n for r in hits.groupBy("unit").agg(F.sum("n").alias("n")).collect()}
        return [known.get(i, 0) for i in range(units)]

    def scored(self, hits: DataFrame, holding: list[int]) -> DataFrame:
        """(unit, key, best): the best row of each key for each unit, as struct(s, m) of its score and minus its seq."""
        corpus = self.corpus()
        score = lambda i: F.transform("entries", lambda e: F.struct(bm25(e["tf"], e["length"], corpus, holding[i]).alias("s"), (-e["seq"]).alias("m")))
        best: Column = F.coalesce(*[F.when(F.col("unit") == i, F.array_max(score(i))) for i in range(len(holding))])
        return hits.select("unit", "key", best.alias("best"))

    def rank(self, query: str, limit: int = 10) -> DataFrame:
        """(key, score): keys that hold every unit, by summed BM25 of their best rows, ties to the smaller key."""
        units = parse_query(query)
        hits = self.hits(units)
        scored = self.scored(hits, self.holding(hits, len(units)))
        whole = scored.groupBy("key").agg(F.sum("best.s").alias("score"), F.count("*").alias("k")).filter(F.col("k") == len(units))
        return whole.orderBy(F.desc("score"), "key").limit(limit).select("key", "score")


class TextIndex:
    """The index below ``path``: each change makes the latest version the next one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)

    # --- versions ------------------------------------------------------------------------------

    def state(self) -> tuple[int, dict]:
        version, state = self.commits.latest()
        if state and state.get("format") != FORMAT:
            raise ValueError(f"the index at {self.commits.path} has format {state.get('format', 1)}, not {FORMAT}; build it anew")
        return version, state or {"segments": [], "rows": 0, "length": 0, "key": None, "format": FORMAT}

    def view(self) -> View:
        """The latest version."""
        return View(self.spark, self.commits.path, self.state()[1])

    def _open(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.commits.path}/{folder}")

    def _segment(self, blocks: DataFrame, ranges: Ranges) -> dict:
        """Writes a segment; sizes and ranges are read off the postings that have been written."""
        where = self.commits.folder("segment")
        dealt = opened(blocks.repartitionById(ranges.count, F.col("part")).sortWithinPartitions("term")).drop("part")
        dealt.withColumn("tf", F.size("positions")).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.commits.path}/{where}/postings")
        stored = self._open(f"{where}/postings")
        sizes_of(stored).write.parquet(f"{self.commits.path}/{where}/sizes")
        # Counted by term first, which a hash table does; the least and the last of strings would need a sort of all rows.
        listed = stored.groupBy(F.col("_metadata.file_name").alias("file"), "term").agg(F.count("*").alias("rows"))
        listed = listed.groupBy("file").agg(F.min("term").alias("low"), F.max("term").alias("high"), F.sum("rows").alias("rows"))
        listed.coalesce(1).write.parquet(f"{self.commits.path}/{where}/files")
        told = self._open(f"{where}/sizes").agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return {"folder": where, "rows": told[0], "length": told[1], "deleted": None}

    def _deleted(self, keys: DataFrame) -> str:
        where = self.commits.folder("deleted")
        keys.distinct().write.parquet(f"{self.commits.path}/{where}")
        return where

    # --- changes -------------------------------------------------------------------------------

    def add(self, rows: DataFrame, key: str, text: str, seq: str | None = None) -> int:
        """Rows that the index doesn't have yet, of new or known keys. A null text is a row without terms."""
        return self._change(self._named(rows, key, text, seq), None)

    def replace(self, rows: DataFrame, key: str, text: str, seq: str | None = None) -> int:
        """All rows of the keys that ``rows`` names, known or new: what the index had of them goes."""
        new = self._named(rows, key, text, seq)
        return self._change(new, new.select("key"))

    def remove(self, keys: DataFrame, key: str) -> int:
        """Takes keys out; unknown ones don't matter."""
        return self._change(None, keys.select(F.col(key).alias("key")))

    @staticmethod
    def _named(rows: DataFrame, key: str, text: str, seq: str | None) -> DataFrame:
        return rows.select(F.col(key).alias("key"), (F.col(seq).cast("long") if seq else F.lit(0).cast("long")).alias("seq"), F.col(text).alias("text")).filter("key is not null")

    def _change(self, rows: DataFrame | None, gone: DataFrame | None) -> int:
        version, state = self.state()
        if rows is None:
            rows = self.spark.createDataFrame([], f"key {state['key'] or 'string'}, seq long, text string")
        rows, n = once(spread(rows))
        ranges = ranges_of(rows, n)
        segment = self._segment(blocks_of(rows, ranges), ranges)
        lost = (0, 0)
        if gone is not None and state["segments"]:
            segment["deleted"] = self._deleted(gone)
            sizes = View(self.spark, self.commits.path, state).live("sizes", columns=["key", "rows", "length", "_at"])
            told = sizes.join(self._open(segment["deleted"]), "key", "left_semi").groupBy("_at").agg(F.sum("rows").alias("rows"), F.sum("length").alias("length")).collect()
            lost = (sum(r.rows for r in told), sum(r.length for r in told))
            segment["touches"] = [state["segments"][r["_at"]]["folder"] for r in told]
        new = {
            "segments": [*state["segments"], segment], "rows": state["rows"] + segment["rows"] - lost[0], "length": state["length"] + segment["length"] - lost[1],
            "key": rows.schema["key"].dataType.simpleString(), "format": FORMAT,
        }
        version = self.commits.commit(version, new)
        return self.merge() if len(new["segments"]) > MOST_SEGMENTS else version

    def merge(self) -> int:
        """Makes the newest segments one, without what is deleted by now; older ones stay where they are much larger. Answers stay the same."""
        version, state = self.state()
        segments = state["segments"]
        at, size = len(segments) - 1, segments[-1]["rows"] if segments else 0
        while at > 0 and (segments[at - 1]["rows"] <= LARGER * size or at > MOST_SEGMENTS // 2):
            at -= 1
            size += segments[at]["rows"]
        if at >= len(segments) - 1:
            return version
        live = View(self.spark, self.commits.path, state).live("postings", start=at)
        ranges = ranges_of_postings(live, size)
        whole = self._segment(dealt(live, ranges), ranges)
        gone = [s for s in segments[at:] if s["deleted"]]
        if at and gone:
            whole["deleted"] = self._deleted(reduce(DataFrame.unionByName, [self._open(s["deleted"]) for s in gone]))
            before = [s["folder"] for s in segments[:at]]
            whole["touches"] = sorted({f for s in gone for f in s.get("touches", before)} & set(before))
        return self.commits.commit(version, {**state, "segments": [*segments[:at], whole]})
