"""License scans, source divergence and cross-tokenizer alignment: against SQL in DuckDB or brute force, on small tables of their own."""

import collections
import hashlib
import random
import re

import duckdb
import public_tokenizers
import pytest

from talkmill.llm import align, divergence, license_scan, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    df = queries.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    said = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, said))
    return df


# 11 ----------------------------------------------------------------------------------------------

ALIGNED = [
    "Hello world, naïve café — 数据 testing", "Hello world", "", None, " leading", "trailing  \n", "<|endoftext|> and <s> tokens <unk>", "a", "tabs\tand\r\nlines", "½ ﬁ ligature",
    "▁ lower block", "emoji 👩‍👩‍👧 x" * 20, "数" * 300, "Hello world, naïve café — 数据 testing", "antidisestablishmentarianism " * 40, "\x00null", "é combining",
]


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    # The byte-level alphabet.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    docs, holds = [], collections.Counter()
    for text in texts:
        want = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)) if text else ([], [])
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append(([], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        groups, low = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= cut], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= cut]))
            low = cut
        docs.append((ids_a, ids_b, groups))
        holds.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = collections.Counter()
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for ids_a, ids_b, groups in docs:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        told = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        best = sum(holds[p] == most[p[0]] for p in links)
        digest = hashlib.sha256(told.encode()).hexdigest() if ids_a else ""
        out.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(holds[p] for p in links), digest))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_alignment_against_brute_force(spark, tmp_path, small, monkeypatch):
    if small:
        for name, value in {"BATCH_BYTES": 400, "SLICE_BYTES": 300, "MOST_UNITS": 20, "BLOCK_PAIRS": 3}.items():
            monkeypatch.setattr(align, name, value)
    rng = random.Random(5)
    texts = ALIGNED + [" ".join(rng.choice(ALIGNED[0].split() + ["über", "Straße", "l'été"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    rows = [(i if i % 9 else None, t, "en", "s") for i, t in enumerate(texts)] + [(3, texts[0], "en", "s")]
    got = queries.QUERIES["op11_token_alignment"](spark, written(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = brute_alignment([r[1] for r in rows])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r[0], *w)) for r, w in zip(rows, want, strict=True))


def test_alignment_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    known = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert align.align_tokens(empty, *known).count() == 0
    clash = spark.createDataFrame([("x", "one two", 1, 2)], "doc_id string, text string, batch int, n_a int")
    assert [r.doc_id for r in align.align_tokens(clash, *known).collect()] == ["x"]


def test_a_text_is_cut_where_both_tokenizers_part():
    rng = random.Random(2)
    spaces = [" ", "  ", "\n", "\n ", " \n", "\u3000", "\u3000 ", "\xa0 ", "\t ", "   "]
    texts = ["".join(rng.choice(["word", "naïve", "数据", "x", "end.", "\u200b", "é", "1", "ß", "…"]) + rng.choice(spaces) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    texts += [rng.choice(spaces) + t for t in texts[:50]] + [t.rstrip() for t in texts[50:99]] + spaces
    whole, cut = (align.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), cut=c) for c in (False, True))
    want, got = (x.documents([t.encode() for t in texts]) for x in (whole, cut))
    assert [x[:5] for x in want] == [x[:5] for x in got] and sum(x[0] > 0 for x in got) > 300
    assert all((x[5] == y[5]).all() and (x[6] == y[6]).all() for x, y in zip(want, got, strict=True))
    assert len(cut.place) > 100 and sum(len(cut.units(t)) > 1 for t in texts) > 250
    assert cut.documents([b"\xff bad", b"\xff bad".decode("utf-8", "replace").encode()])[0][0] == 0


# 12 ----------------------------------------------------------------------------------------------


def licensed():
    rng = random.Random(8)
    word = lambda: rng.choice(["alpha", "the", "license", "of", "under", "work", "is", "données", "数据", "2", "cc", "by", "gnu", "general", "public", "mit", "apache"])
    fill = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", "...", "cc by", "CC-BY cc by", "mit license", "MIT LicenseX", "ﬀ cc by", "the GNU General\nPublic   License v3"]
    for _, t in license_scan.TEMPLATES:
        some = t.split(" ")
        out += [fill(rng.randrange(200)) + " " + t + " " + fill(rng.randrange(200)), " ".join(w for w in some if rng.random() < 0.85), fill(31) + " " + " ".join(reversed(some)), fill(40) + t[: len(t) // 2] + fill(70) + t[len(t) // 2 :]]
    return out + [fill(rng.randrange(300)) for _ in range(20)] + ["cc by " * 500]


def test_licenses_against_sql(spark, tmp_path):
    texts = licensed()
    rows = [(i if i % 7 else None, t, "en", "s") for i, t in enumerate(texts)] + [(1, texts[12], None, None)] * 3
    df = same_as_sql(spark, written(spark, tmp_path, rows), "op12_license_scan")
    found = df.filter("labels != base_labels").count()
    assert found >= len(license_scan.TEMPLATES)
    for op in ("PythonUDF", "MapInArrow", "ArrowEval", "BatchEval"):
        assert op not in df._jdf.queryExecution().toString()


def test_every_template_is_found_and_no_other(spark):
    docs = spark.createDataFrame([(i, f"before it {t} and after") for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs, phrases={}).collect()}
    assert [(got[i].labels, got[i].score) for i in range(len(license_scan.TEMPLATES))] == [(label, 1.0) for label, _ in license_scan.TEMPLATES]


def test_licenses_of_odd_tables(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).count() == 0
    none = license_scan.template_table(spark, [("x", "...")])
    clash = spark.createDataFrame([("k", "mit license", 5)], "doc_id string, text string, labels int")
    assert [(r.doc_id, r.labels, r.first_word) for r in license_scan.scan(clash, none).collect()] == [("k", "mit", 0)]
    monkeypatch.setattr(license_scan, "MOST_TOKENS", 3)
    with pytest.raises(ValueError, match="distinct tokens"):
        license_scan.scan(clash)


# 13 ----------------------------------------------------------------------------------------------


def spoken():
    rng = random.Random(11)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Été", "数据", "THE", "the"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ü", "c", None, "\U0001f600"])
        n = rng.randrange(25)
        rows.append((i, "1".join(words[int(len(words) * rng.random() ** (1 + len(source or "")))] for _ in range(n)) if n else None, lang, source))
    return rows + [(900 + i, "never kept", "xx", s) for i, s in enumerate(["a", "b", None])] + [(990, "1 2 3", "en", "dry"), (991, None, None, None), (991, None, None, None), (992, "alone", "yy", "a")]


@pytest.mark.parametrize("small", [True, False])
def test_divergence_against_sql(spark, tmp_path, small, monkeypatch):
    if small:
        for name, value in {"FLUSH_TERMS": 7, "SOURCES_PER_BLOCK": 2, "PIECE": 9}.items():
            monkeypatch.setattr(divergence, name, value)
    df = same_as_sql(spark, written(spark, tmp_path, spoken()), "op13_source_divergence")
    parts = collections.Counter(r.part for r in df.collect())
    assert parts["pair"] > 40 and parts["term"] > 40


def test_terms_of_a_long_text_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 10)
    rng = random.Random(1)
    text = "".join(rng.choice(["a", "b", " ", "é", "9", "long", "."]) for _ in range(500)).encode()
    assert divergence.terms_of(text) == collections.Counter(re.findall(rb"[a-z\x80-\xff]+", text))


def test_divergence_of_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    assert divergence.audit(spark.createDataFrame([("en", "a", "x y", 3), ("en", "b", "x", 4)], "lang string, source string, text string, p int"), min_docs=1).count() == 4


def test_counts_beyond_a_long_are_exact(spark):
    row = spark.range(1).selectExpr("4000000000000000L n", "9000000000000000L total", "7L v").select(divergence.share("n", "total").alias("p")).first()
    assert row.p == 1 + 10**9 * (4 * 10**15 + 2) // (9 * 10**15 + 14)

