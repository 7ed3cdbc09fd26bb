"""Token counts: whole texts are encoded, huge ones in overlapping chunks spliced at common boundaries."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from talkmill.llm.common import WORKER_CACHES, table

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Texts of more code points than this are encoded in chunks.
HUGE_CHARS = 65_536
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
#: Tokens that must agree on each side of a splice.
AGREE = 8
#: Words that a worker remembers in each of two generations (about 200 bytes each); those not met while a generation fills are forgotten.
CACHE_WORDS = 400_000
DOCS_PER_SLICE = 128
#: A split pattern whose matches never hold white space, under "Removed" and "invert": what white space parts is encoded apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = " \t\n\x0b\x0c\r"


class Encoder:
    """Token ids of whole texts, as the tokenizer's own library gives them with no special tokens added.

    ``path`` is a .json file of ``tokenizers`` or a .model file of ``sentencepiece``. If the file's
    pre-tokenizer proves that white space parts words, each distinct word is encoded once and remembered.
    """

    def __init__(self, path: str, huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.huge, self.chunk, self.overlap, self.apart = huge, chunk, overlap, False
        self.cache, self.older = {}, {}
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.piece, self.json = None, Tokenizer.from_file(path)
        self.json.no_truncation()
        self.json.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        splits = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        first = splits[0]
        normal = {x["type"] for x in (said.get("normalizer") or {}).get("normalizers", [])}
        self.apart = (
            first.get("type") == "Split" and first.get("pattern") == {"Regex": WORD_PATTERN} and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and normal <= {"NFC", "Replace", "Lowercase"} and said["model"].get("end_of_word_suffix") == "</w>"
        )
        if self.apart:
            self.specials = [x["content"].encode() for x in said["added_tokens"]]
            self.lowers = "Lowercase" in normal
            self.ends = np.zeros(1 + max(said["model"]["vocab"].values()), bool)
            self.ends[[i for w, i in said["model"]["vocab"].items() if w.endswith("</w>")]] = True

    def with_offsets(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of each token, in code points of ``text``."""
        if self.piece:
            found = self.piece.encode(text, return_type="proto", num_threads=1)
            # The library counts bytes.
            lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
            at = np.concatenate([[0], np.cumsum(lead)]).tolist()
            return [(p.id, at[p.begin], at[p.end]) for p in found.pieces]
        e = self.json.encode(text, add_special_tokens=False)
        return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]

    def direct(self, text: str) -> array:
        if self.piece:
            return array("I", self.piece.encode(text, num_threads=1))
        return array("I", self.json.encode(text, add_special_tokens=False).ids)

    def chunked(self, text: str) -> array:
        """Ids of a huge text: each chunk starts ``overlap`` before the last one's end; the two are spliced after a
        token that both hold with AGREE equal neighbours on either side and that white space follows or begins.
        Where none is found the overlap doubles, until the chunk starts where the one before it did."""
        done: list = []
        start, end = 0, min(len(text), self.chunk)
        last = self.with_offsets(text[:end])
        while end < len(text):
            nxt, overlap = min(len(text), end + self.chunk), self.overlap
            while True:
                begin = max(start, end - overlap)
                new = [(i, a + begin, b + begin) for i, a, b in self.with_offsets(text[begin:nxt])]
                if begin == start:
                    last = new
                    break
                if at := splice(last, new, text):
                    done += [t[0] for t in last[: at[0]]]
                    last, start = new[at[1] :], new[at[1]][1]
                    break
                overlap *= 2
            end = nxt
        return array("I", done + [t[0] for t in last])

    def ids(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of a text that isn't huge or has to be encoded by itself."""
        said = text.decode("utf-8", "replace")
        return (self.chunked(said) if len(said) > self.huge else self.direct(said)).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """``ids`` of each text. A text that holds a special token's string, or is huge, is never cut into words."""
        if not self.apart:
            return [self.ids(t) for t in texts]
        whole = [len(t) > self.huge and len(t.decode("utf-8", "replace")) > self.huge or any(s in t for s in self.specials) for t in texts]
        words = [[] if w else self.split(t) for w, t in zip(whole, texts, strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.older = {}, self.cache
        if missing := set().union(*words).difference(self.cache):
            known = missing & self.older.keys()
            self.cache.update({w: self.older[w] for w in known})
            self.learn(missing - known)
        get = self.cache.__getitem__
        return [self.ids(t) if w else b"".join(map(get, ws)) for w, t, ws in zip(whole, texts, words, strict=True)]

    def split(self, text: bytes) -> list[bytes]:
        # Lower-casing first could change a composition only where a combining mark follows (U+0300 to U+036F).
        return (text.lower() if self.lowers and b"\xcc" not in text and b"\xcd" not in text else text).split()

    def learn(self, missing: set[bytes]) -> None:
        # Closing punctuation is a token run of its own after a letter.
        stems, cut = set(), {}
        for w in missing:
            stem = w.rstrip(b".,!?;:$%&*#")
            if stem and len(stem) < len(w) and (c := stem.decode("utf-8", "replace")[-1]).isascii() and c.isalpha():
                cut[w] = stem
                stems |= {stem, w[len(stem) :]}
            else:
                stems.add(w)
        new = {w: w.decode("utf-8", "replace") for w in stems if w not in self.cache}
        plain = [w for w, s in new.items() if s.isascii() and s.isalpha()]
        for i in range(0, len(plain), 512):
            some = plain[i : i + 512]
            ids = np.array(self.json.encode(" ".join([new[w] for w in some]), add_special_tokens=False).ids, np.uint32)
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) == len(some):
                raw = ids.tobytes()
                at = 0
                for w, stop in zip(some, stops, strict=True):
                    self.cache[w] = raw[4 * at : 4 * stop]
                    at = stop
        rest = [w for w in new if w not in self.cache]
        for w, e in zip(rest, self.json.encode_batch([new[w] for w in rest], add_special_tokens=False), strict=True):
            self.cache[w] = array("I", e.ids).tobytes()
        for w, stem in cut.items():
            self.cache[w] = self.cache[stem] + self.cache[w[len(stem) :]]


def splice(left: list, right: list, text: str) -> tuple[int, int] | None:
    """(tokens of ``left`` to keep, tokens of ``right`` to skip) at a proven common boundary, the latest one; else None."""
    places = {t: j for j, t in enumerate(right)}
    for i in range(len(left) - 1 - AGREE, AGREE - 1, -1):
        j = places.get(left[i])
        if j is None:
            if left[i][2] <= right[0][1]:
                return None
            continue
        stop, begin = left[i][2], left[i + 1][1]
        apart = stop < begin or text[stop - 1 : stop] in SPACE or text[begin : begin + 1] in SPACE
        if apart and j >= AGREE and j + 1 < len(right) and left[i - AGREE : i + AGREE + 1] == right[j - AGREE : j + AGREE + 1]:
            return i + 1, j + 1
    return None


ENCODERS: dict[tuple, Encoder] = {}
WORKER_CACHES.append(ENCODERS)


def encoder(path: str, *sizes: int) -> Encoder:
    """One encoder for each file and Python worker."""
    if (path, *sizes) not in ENCODERS:
        ENCODERS[path, *sizes] = Encoder(path, *sizes)
    return ENCODERS[path, *sizes]


def slices(batches, column: int, rows: int = DOCS_PER_SLICE):
    """Each Arrow batch in slices of few rows, with the texts of a binary column; null is empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, [x if x is not None else b"" for x in part.column(column).to_pylist()]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``docs``, in one pass without a shuffle.

    ``tokenizer`` is a file that every executor has. A null text is an empty one, of 0 tokens. Special
    tokens' strings inside texts are handled as the library does by default. Null keys and repeated
    rows are counted as any row; other columns are not read; an empty table gives an empty result.
    """

    def count(batches):
        enc = encoder(tokenizer)
        for part, texts in slices(batches, 1):
            n = [len(x) // 4 for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}`", f"cast(`{text}` as binary)").mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(DEFAULT_TOKENIZER))
