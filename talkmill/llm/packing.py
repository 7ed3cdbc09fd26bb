"""Packing: bounded-space best fit into fixed windows, then leftovers merged."""

from __future__ import annotations

import zlib

import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkmill.llm.common import durable, table
from talkmill.llm.tokens import DEFAULT_TOKENIZER, encoder, slices

WINDOW = 4096
OPEN_WINDOWS = 16
#: A text is cut to fill a closing window only where this many tokens or more fit.
LEAST_PIECE = 16
END_ID = 2
#: Partitions whose leftovers are merged by one task.
MERGE = 64

PIECE = "`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Windows:
    """At most ``most`` open windows. A piece goes where it fits best; where none fits, the fullest is filled and closed.

    Pieces are [key, start, ids, doc_tokens]; closed windows are lists of pieces, in order.
    """

    def __init__(self, size: int, most: int, least: int):
        self.size, self.most, self.least, self.open = size, most, least, []

    def put(self, key, ids: bytes):
        """Places one document; yields the windows that this closes."""
        total = len(ids) // 4
        at = 0
        while total - at >= self.size:
            yield [[key, at, ids[4 * at : 4 * (at + self.size)], total]]
            at += self.size
        while at < total:
            n = total - at
            fits = [w for w in self.open if self.size - w[0] >= n]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                n = self.size - best[0]
                self.open.remove(best)
                if n >= self.least:
                    best[1].append([key, at, ids[4 * at : 4 * (at + n)], total])
                    at += n
                yield best[1]
                continue
            best[1].append([key, at, ids[4 * at : 4 * total], total])
            best[0] += n
            at = total
            if best[0] == self.size:
                self.open.remove(best)
                yield best[1]


def pack(docs: DataFrame, tokenizer: str, size: int = WINDOW, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then ``end_id``; a null text is an empty one. Each partition keeps
    OPEN_WINDOWS windows open, so its memory doesn't grow; closed windows leave at once. The windows
    open at the end, of MERGE partitions at a time, are laid end to end and cut at ``size``, so at most
    one sequence for MERGE partitions is far from full. Others lack fewer than LEAST_PIECE tokens.
    Null keys and repeated rows are documents like any; other columns are not read; an empty table
    gives an empty result. Sequence ids are unique, not dense.
    """
    kind = docs.schema[key].dataType.simpleString()

    def rows(windows, first_id: int, leftover: bool, keys_type):
        out = []
        for k, pieces in enumerate(windows):
            offset = 0
            for key_, start, ids, total in pieces:
                out.append((key_, start, len(ids) // 4, zlib.crc32(ids), total, first_id + k, offset, ids if leftover else None))
                offset += len(ids) // 4
        cols = list(zip(*out, strict=True)) or [[]] * 8
        kinds = [keys_type, *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [key, *FIELDS, "ids"])

    def place(batches):
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, windows, done, kept = end_id.to_bytes(4, "little"), Windows(size, OPEN_WINDOWS, LEAST_PIECE), 0, None
        for batch, texts in slices(batches, 1):
            kept = batch.schema.field(0).type
            closed = [w for k, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True) for w in windows.put(k, ids + end)]
            yield rows(closed, (part << 32) + done, False, kept)
            done += len(closed)
        if kept is not None:
            yield rows([w[1] for w in sorted(windows.open, key=lambda w: -w[0])], (part << 32) + done, True, kept)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sequence_id", "offset"])
        first = (1 << 62) + (int(group["sequence_id"].iloc[0]) >> 32 << 32)
        out, used, k = [], 0, 0
        for row in group.itertuples(index=False):
            ids, start = row.ids, row.start
            while ids:
                n = min(len(ids) // 4, size - used)
                out.append((row[0], start, n, zlib.crc32(ids[: 4 * n]), row.doc_tokens, first + k, used))
                ids, start, used = ids[4 * n :], start + n, used + n
                if used == size:
                    used, k = 0, k + 1
        return pd.DataFrame(out, columns=[key, *FIELDS])

    piece = PIECE.format(key=key, kind=kind)
    placed = durable(docs.selectExpr(f"`{key}`", f"cast(`{text}` as binary)").mapInArrow(place, f"{piece}, ids binary"), "packed")
    loose = placed.filter("ids is not null").groupBy(F.expr(f"shiftright(sequence_id, 32) div {MERGE}")).applyInPandas(merge, piece)
    return placed.filter("ids is null").drop("ids").unionByName(loose)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_TOKENIZER))
