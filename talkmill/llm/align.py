"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often they do so in the corpus.

Both token sequences of a text end at byte offsets. The union of the two arrays of ends cuts the text into elementary intervals;
each has one owner in either sequence, found by searchsorted, and is one overlap. An end that both share closes a group;
the tokens of a group are linked, each of one side with each of the other, as products of the group's distinct ids.

The links are counted over the corpus without sending them document by document: a batch of documents keeps its distinct
pairs as a sorted list, of which documents hold positions only. The lists are counted by pair, and the
counts come back to each batch as a list of the same order.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkmill.llm.common import WORKER_CACHES, durable, free_caches, scratch_table, table
from talkmill.llm.hashing import in_slices

#: Bytes of text of a batch, and of what is taken apart at once.
BATCH_BYTES, SLICE_BYTES = 16 << 20, 1 << 20
#: Units, and pairs of theirs, that a worker remembers before it starts anew.
MOST_UNITS, MOST_PAIRS = 300_000, 3_000_000
#: Units that are encoded together.
CHUNK = 256
#: Pairs that are expanded at once.
BLOCK_PAIRS = 1 << 20
#: Bits of a token id; a pair of ids and a document's place in its slice fit a long.
ID_BITS, PLACE_BITS = 20, 40
PAIR_MASK = (1 << (2 * ID_BITS)) - 1
#: A space after what isn't white space, with something after it; and where spaces aren't all of that kind.
_UNIT, _RUN = re.compile(r"(?<=\S) (?=.)", re.DOTALL), re.compile(r"(?:\s|^) | $")
#: Separators after a token of a group: within a side, between the sides, after the group, at the text's end.
SEPARATORS = [",", "|", ";", ""]

_U4 = np.dtype("<u4")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two tokenizers: byte-level BPE from a .json file, applied to a space and the text, and a sentencepiece .model, which adds the space itself.

    If their files prove that no token reaches from a character that isn't white space into the space after it, a text is cut there into units,
    each a space and what follows: tokens, groups and links of a text are those of its units one after another, so each
    distinct unit is encoded and aligned once and remembered.
    """

    def __init__(self, path_a: str, path_b: str, cut: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet, size = byte_alphabet(), max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.bytes_a = [bytes(alphabet.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(size, len(pieces)) >= 1 << ID_BITS:
            raise ValueError(f"token ids of more than {ID_BITS} bits")
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        with open(path_a, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        parted = before.get("type") == "ByteLevel" and before.get("use_regex") and not said.get("normalizer")
        self.cuts = cut and parted and not any(re.search("[^▁]▁", p) for p in pieces)
        self.said_a = [f"{i}{s}" for i in range(size) for s in SEPARATORS]
        self.said_b = [f"{i}{s}" for i in range(len(pieces)) for s in SEPARATORS]
        self.forget()

    def forget(self) -> None:
        #: Place of each unit in the lists; the lists' rows; where each unit's pairs begin.
        self.place: dict[str, int] = {}
        self.numbers, self.told = np.zeros((0, 5), np.int64), []
        self.pairs, self.links, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def units(self, text: str) -> list[str]:
        """What follows the leading space of each unit of a space and ``text``."""
        if not self.cuts:
            return [text]
        return _UNIT.split(text) if _RUN.search(text) else text.split(" ")

    def encoded(self, side: int, texts: list[str]) -> list[list[int]]:
        """Ids of a space and each text."""
        if side:
            return self.b.encode(texts, num_threads=1)
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def ids(self, units: list[str]) -> tuple:
        """(whether its tokens' bytes are the unit's, (ids, tokens) by either tokenizer) of each unit; a unit that isn't given back has no tokens.

        Units are encoded CHUNK at a time, joined by their spaces; where a chunk isn't given back, or has a unit that ends in white space, each by itself.
        """
        good = np.ones(len(units), bool)
        ids, sizes = ([], []), ([], [])
        chunks = [units[i : i + CHUNK] for i in range(0, len(units), CHUNK)]
        joined = [" ".join(own) for own in chunks]
        found = [self.encoded(side, joined) for side in (0, 1)]
        known = [(self.bytes_a, self.lengths_a), (self.bytes_b, self.lengths_b)]
        for k, own in enumerate(chunks):
            want = b" " + joined[k].encode()
            stops = np.cumsum([1 + len(u.encode()) for u in own])
            both = [found[side][k] for side in (0, 1)]
            counts = []
            for some, (parts, lengths) in zip(both, known, strict=True):
                if b"".join(map(parts.__getitem__, some)) == want:
                    ends = np.cumsum(lengths[some])
                    at = np.searchsorted(ends, stops)
                    if (ends[at] == stops).all():
                        counts.append(np.diff(at + 1, prepend=0))
            if len(counts) < 2 or (len(own) > 1 and any(not u or u[-1].isspace() for u in own)):
                both, counts = ([], []), ([], [])
                for i, (unit, *each) in enumerate(zip(own, *(self.encoded(side, own) for side in (0, 1)), strict=True)):
                    same = all(b"".join(map(parts.__getitem__, some)) == b" " + unit.encode() for some, (parts, _) in zip(each, known, strict=True))
                    good[k * CHUNK + i] = same
                    for side in (0, 1):
                        both[side].extend(each[side] if same else [])
                        counts[side].append(len(each[side]) if same else 0)
            for side in (0, 1):
                ids[side].append(np.array(both[side], np.int64))
                sizes[side].append(np.array(counts[side], np.int64))
        return good, *((np.concatenate(ids[side]), np.concatenate(sizes[side])) for side in (0, 1))

    def learn(self, units: list[str]) -> None:
        """Adds units to the lists: (n_a, n_b, n_groups, n_links, 1 if its bytes aren't given back), groups as text, pairs and their links."""
        units = sorted(units, key=lambda u: not u or u[-1].isspace())
        good, (a, n_a), (b, n_b) = self.ids(units)
        numbers, counts, told = np.zeros((len(units), 5), np.int64), np.zeros(len(units), np.int64), [""] * len(units)
        numbers[~good, 4] = 1
        if good.any():
            numbers[good, :4], said, pairs, links, edges = self.aligned(a, b, np.cumsum(n_a[good]), np.cumsum(n_b[good]))
            counts[good] = np.diff(edges)
            for i, x in zip(np.flatnonzero(good).tolist(), said, strict=True):
                told[i] = x
            self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])
        self.place.update(zip(units, range(len(self.told), len(self.told) + len(units)), strict=True))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])
        self.numbers, self.told = np.concatenate([self.numbers, numbers]), self.told + told

    def aligned(self, a: np.ndarray, b: np.ndarray, stops_a: np.ndarray, stops_b: np.ndarray) -> tuple:
        """(numbers, groups as text, pairs, their links, where each unit's pairs begin and end) of units by their ids and the places where they stop."""
        ends_a, ends_b = np.cumsum(self.lengths_a[a]), np.cumsum(self.lengths_b[b])
        ends = np.union1d(ends_a, ends_b)
        owner_a, owner_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[owner_a] == ends) & (ends_b[owner_b] == ends)
        group = np.cumsum(shared) - shared
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[owner_a], group_b[owner_b] = group, group
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        # Units end where both end, so each group lies in one.
        stops = group_a[stops_a - 1] + 1
        n_groups = np.diff(stops, prepend=0)
        n_links = np.diff(np.concatenate([[0], np.cumsum(n_a * n_b)])[np.concatenate([[0], stops])])
        numbers = np.stack([np.diff(stops_a, prepend=0), np.diff(stops_b, prepend=0), n_groups, n_links], 1)
        pairs, links = expanded(a, b, group_a, group_b, np.repeat(np.arange(len(stops)), n_groups))
        edges = np.searchsorted(pairs >> (2 * ID_BITS), np.arange(len(stops) + 1))
        return numbers, self.said(a, b, group_a, group_b, n_a, n_b, stops_a, stops_b), pairs & PAIR_MASK, links, edges

    def said(self, a, b, group_a, group_b, n_a, n_b, stops_a, stops_b) -> list[str]:
        """Each unit's groups as ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = np.cumsum(n_a), np.cumsum(n_b)
        place_a = np.arange(len(a)) + (ends_b - n_b)[group_a]
        place_b = np.arange(len(b)) + ends_a[group_b]
        after_a, after_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        after_a[ends_a - 1], after_b[ends_b - 1] = 1, 2
        after_b[stops_b - 1] = 3
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a], code[place_b] = 4 * a + after_a, 4 * b + after_b + len(self.said_a)
        get_a, get_b, first_b = self.said_a, self.said_b, len(self.said_a)
        words = [get_a[c] if c < first_b else get_b[c - first_b] for c in code.tolist()]
        out, at = [], 0
        for stop in (stops_a + stops_b).tolist():
            out.append("".join(words[at:stop]))
            at = stop
        return out

    def documents(self, texts: list[bytes]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, digest, distinct pairs, their links) of each text."""
        out = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
        some = [(i, t.decode("utf-8", "replace")) for i, t in enumerate(texts) if t]
        if not some:
            return out
        cut = [self.units(t) for _, t in some]
        if len(self.place) > MOST_UNITS or len(self.pairs) > MOST_PAIRS:
            self.forget()
        if missing := list(set().union(*cut).difference(self.place)):
            self.learn(missing)
        stops = np.cumsum([len(own) for own in cut])
        every = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, stops[-1])
        sums = np.add.reduceat(self.numbers[every], np.concatenate([[0], stops[:-1]]), axis=0)
        # Bytes that are no UTF-8 aren't given back either.
        good = (sums[:, 4] == 0) & np.array(["\ufffd" not in t or texts[i] == t.encode() for i, t in some])
        doc, links, pairs = self.spread(every, np.repeat(np.arange(len(some)), np.diff(stops, prepend=0)))
        edges = np.searchsorted(doc, np.arange(len(some) + 1))
        get, every = self.told.__getitem__, every.tolist()
        for k, (i, _) in enumerate(some):
            if good[k]:
                digest = hashlib.sha256(";".join(map(get, every[stops[k - 1] if k else 0 : stops[k]])).encode()).hexdigest()
                out[i] = (*sums[k, :4].tolist(), digest, pairs[edges[k] : edges[k + 1]], links[edges[k] : edges[k + 1]])
        return out

    def spread(self, units: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, links, pair), ascending, each once, of the documents' units."""
        units, n = np.unique(doc << PLACE_BITS | units, return_counts=True)
        doc, units = units >> PLACE_BITS, units & ((1 << PLACE_BITS) - 1)
        size = self.start[units + 1] - self.start[units]
        flat = np.arange(int(size.sum())) + np.repeat(self.start[units] - (np.cumsum(size) - size), size)
        key = np.repeat(doc, size) << (2 * ID_BITS) | self.pairs[flat]
        order = np.argsort(key, kind="stable")
        key, links = key[order], (self.links[flat] * np.repeat(n, size))[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        key = key[new]
        return key >> (2 * ID_BITS), np.add.reduceat(links, new) if len(new) else links, key & PAIR_MASK


def expanded(a, b, group_a, group_b, doc) -> tuple[np.ndarray, np.ndarray]:
    """(distinct document and pair of ids, ascending; its links), BLOCK_PAIRS products of distinct ids at a time."""
    key_a, times_a = np.unique(group_a << ID_BITS | a, return_counts=True)
    key_b, times_b = np.unique(group_b << ID_BITS | b, return_counts=True)
    mask = (1 << ID_BITS) - 1
    many_a, many_b = np.bincount(key_a >> ID_BITS), np.bincount(key_b >> ID_BITS)
    from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
    upto = np.cumsum(many_a * many_b)
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for low in range(0, int(upto[-1]), BLOCK_PAIRS):
        flat = np.arange(low, min(low + BLOCK_PAIRS, int(upto[-1])))
        g = np.searchsorted(upto, flat, "right")
        within = flat - (upto[g] - many_a[g] * many_b[g])
        i, j = from_a[g] + within // many_b[g], from_b[g] + within % many_b[g]
        found = (doc[g] << ID_BITS | key_a[i] & mask) << ID_BITS | key_b[j] & mask
        keys, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        links = np.concatenate([sums, times_a[i] * times_b[j]])
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, links)
    return keys, sums


PAIRS: dict[tuple, Pair] = {}
WORKER_CACHES.append(PAIRS)


def pair_of(path_a: str, path_b: str) -> Pair:
    if (path_a, path_b) not in PAIRS:
        free_caches()
        PAIRS[path_a, path_b] = Pair(path_a, path_b)
    return PAIRS[path_a, path_b]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def stored(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each of ``docs`` (_key, _text), and one for each batch of them with its distinct pairs; written once, bucketed by batch.

    A document's row has the places of its pairs in the batch's list, and their links.
    """
    spark = docs.sparkSession
    kind = docs.schema["_key"].dataType
    schema = T.StructType(
        [T.StructField("_key", kind), T.StructField("batch", T.LongType()), *[T.StructField(c, T.LongType()) for c in NUMBERS], T.StructField("digest", T.StringType())]
        + [T.StructField(c, T.BinaryType()) for c in ("places", "links", "pairs", "holds")]
    )

    def run(batches):
        from pyspark import TaskContext

        both, part, k, size, keys, rows = pair_of(path_a, path_b), TaskContext.get().partitionId(), 0, 0, [], []

        def flush():
            pairs, places = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True)
            edges = np.cumsum([0, *[len(r[5]) for r in rows]]).tolist()
            at = [places[x:y].astype(_U4).tobytes() for x, y in zip(edges, edges[1:], strict=False)]
            holds = np.bincount(places, minlength=len(pairs)).astype(_U4).tobytes()
            n, nothing = len(rows) + 1, [None] * len(rows)
            # The links of one pair in one text are fewer than 2 ** 63; most are one.
            links = [r[6].astype("<i8" if r[6].max(initial=0) > 255 else "u1").tobytes() for r in rows]
            numbers = [pa.array([*[r[c] for r in rows], 0], pa.int64()) for c in range(4)]
            told = pa.array([*[r[4] for r in rows], None], pa.string())
            binary = [pa.array(x, pa.binary()) for x in ([*at, None], [*links, None], [*nothing, pairs.tobytes()], [*nothing, holds])]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([*keys, pa.nulls(1, keys[0].type)]), pa.array([(part << 24) + k] * n, pa.int64()), *numbers, told, *binary], schema.names)

        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for at, to in in_slices(texts, SLICE_BYTES):
                rows += both.documents(texts[at:to])
                keys.append(batch.column(0).slice(at, to - at))
                size += sum(map(len, texts[at:to]))
                if size >= BATCH_BYTES:
                    yield from flush()
                    k, size, keys, rows = k + 1, 0, [], []
        if rows:
            yield from flush()

    total = docs.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    name, path = scratch_table(spark, "alignment")
    tables = min(max(1, total // BATCH_BYTES), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    docs.mapInArrow(run, schema).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(tables, "batch").saveAsTable(name)
    return spark.table(name)


def listed(batches):
    """The lists of pairs as rows."""
    for batch in batches:
        for number, pairs, holds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pairs, holds = np.frombuffer(pairs, np.int64), np.frombuffer(holds, _U4)
            for at in range(0, len(pairs), 1 << 17):
                own = pairs[at : at + (1 << 17)]
                places = np.arange(at, at + len(own), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), number)), pa.array(places), pa.array(own), pa.array(holds[at : at + len(own)].astype(np.int64))], ["batch", "place", "pair", "n"]
                )


def align_tokens(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    ``path_a`` is a byte-level .json of ``tokenizers``, applied to a space and the text, ``path_b`` a .model of ``sentencepiece``,
    applied to the text; both without special tokens, whose strings inside texts are plain text. Every executor has both
    files. An id pair's count is the number of rows of ``docs`` in which it is linked; ``count_sum`` sums it over a row's
    links, ``n_best`` counts the links whose count is the highest of their first id.

    A null or empty text, and one that either tokenizer's bytes don't give back, has no tokens: zeros and an empty digest.
    Rows are documents: null keys and repeated rows count as any row. Other columns are not read; an empty table gives an empty result.
    A text without spaces is encoded whole.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("binary").alias("_text"))
    kept = stored(rows, path_a, path_b)
    pairs = kept.filter("pairs is not null").select("batch", "pairs", "holds").mapInArrow(listed, "batch long, place int, pair long, n long")
    first_id = F.shiftright("pair", ID_BITS).alias("a")
    counts = durable(pairs.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    # One row for each id of the first tokenizer: its vocabulary is the bound.
    most = F.broadcast(counts.groupBy(first_id).agg(F.max("n").alias("most")))
    valued = counts.withColumn("a", first_id).join(most, "a").select("pair", F.expr("2 * n + int(n = most)").alias("value"))
    answers = pairs.select("batch", "place", "pair").join(valued, "pair").select("batch", "place", "value")
    kind = docs.schema[key].dataType
    names = ["_key", *NUMBERS, "n_best", "count_sum", "groups_sha256"]

    def finish(group: pa.Table, told: pa.Table) -> pa.Table:
        value = np.zeros(told.num_rows, np.int64)
        value[told.column("place").to_numpy()] = told.column("value").to_numpy()
        best, total = [], []
        for places, links in zip(group.column("places").to_pylist(), group.column("links").to_pylist(), strict=True):
            at = np.frombuffer(places, _U4)
            n = np.frombuffer(links, np.uint8 if len(links) == len(at) else np.dtype("<i8")).astype(np.int64)
            own = value[at]
            best.append(int(n[(own & 1) == 1].sum()))
            total.append(int((n * (own >> 1)).sum()))
        columns = [group.column(c) for c in ("_key", *NUMBERS)]
        return pa.table([*columns, pa.array(best, pa.int64()), pa.array(total, pa.int64()), group.column("digest")], names=names)

    out = T.StructType([T.StructField("_key", kind), *[T.StructField(c, T.LongType()) for c in names[1:-1]], T.StructField("groups_sha256", T.StringType())])
    done = kept.filter("pairs is null").drop("pairs", "holds").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, out)
    return done.withColumnRenamed("_key", key)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
