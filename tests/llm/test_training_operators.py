"""Brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from talkmill.llm import chat_format, components, fingerprints, hashing, mixing, near_dups, neighbours, packing, quality, repeats, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, body string, batch string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_texts():
    rng = random.Random(3)
    words = ["ab", "the", "Zürich", "naïve", "don't", "x1", "foo.", "BAR!!", "日本", "e\u0301t", "J\u030c", "a|b", "…", "long" * 6]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", str(rng.randrange(40))]) for _ in range(n))
    base = make(150)
    near = base.split(" ")
    near[75] = "changed"
    passage = make(60)
    texts = [None, "", " \t\n", "one two", "one  TWO", base, base, " ".join(near), make(40) + " " + passage + " " + make(30), make(20) + "\n" + passage + make(9)]
    texts += [make(12), "aaaa" * 300, "x<|endoftext|>y <|ENDOFTEXT|> z", "\x1c\x1d a\x1cb", "no\xa0break\u3000wide", make(4000), make(700)]
    return texts + [make(rng.randrange(1, 60)) for _ in range(20)]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), 0.5, "b", "c") for i, t in enumerate(make_texts())]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *keys):
    return sorted(df.collect(), key=lambda r: tuple(repr(r[k]) for k in keys))


# 1 -----------------------------------------------------------------------------------------------


def judged(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://A.Example.COM/en/x?y=/q", "https://www.example.com/en/1#z", "http://b.net/es/", "http://b.net", "ftp://net/fr/a", "x://", "http://com/", "http://notexample.com/en/", "http://example.com/english", "http://" + "a." * 3000 + "net/es/" + "p" * 9000]
    pages = spark.createDataFrame([(i % 11, u, "h", "own") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in url_filter.judge_urls(pages, rules).collect())
    want = sorted((u or "", *((x or "") for x in judged(u, url_filter.RULES))) for u in urls * 2)
    assert got == want
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 2 -----------------------------------------------------------------------------------------------


def simhash_of(text):
    import xxhash

    votes = [0] * 64
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        if w:
            h, weight = xxhash.xxh64(w.encode(), seed=42).intdigest(), min(len(w), 16) ** 2
            for j in range(64):
                votes[j] += weight if h >> j & 1 else -weight
    return sum(1 << j for j in range(64) if votes[j] > 0)


def test_fingerprints(docs, empty, rows):
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(docs).collect()}
    texts = [r[1] or "" for r in rows]
    prints = [simhash_of(t) for t in texts]
    for i, t in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        r = got[i]
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (f"{prints[i]:016x}", f"{simhash_of(edited):016x}")
        assert (r.near_edited, r.near_next) == (like(prints[i], simhash_of(edited)), like(prints[i], prints[(i + 1) % len(texts)]))
        assert r.n_close == sum(0 < (prints[i] ^ p).bit_count() <= 3 for p in set(prints))
    assert fingerprints.fingerprint_documents(empty).count() == 0


def test_permuted_tables(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in values[:30]:
        for _ in range(rng.randrange(5)):
            v ^= 1 << rng.randrange(64)
        values.append(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in [*values, values[0]]]
    got = {(r.fp_a, r.fp_b, r.distance) for r in fingerprints.within_radius(spark.createDataFrame([(v,) for v in signed] + [(None,)], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b, ((a ^ b) & mask).bit_count()) for a in set(signed) for b in set(signed) if a < b and ((a ^ b) & mask).bit_count() <= 3}
    assert got == want and want


# 3, 4 --------------------------------------------------------------------------------------------


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_token_counts(docs, empty, rows):
    got = {r.doc_id: r for r in tokens.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=50).collect()}
    for r in rows:
        n = len(library_ids(r[1] or ""))
        assert (got[r[0]].n_bytes, got[r[0]].n_tokens, got[r[0]].over_limit) == (len((r[1] or "").encode()), n, n > 50), r[1]
    assert tokens.count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_chunks_splice_to_the_whole(name):
    texts = [t for t in make_texts() if t and "<|" not in t]
    path = public_tokenizers.path(name)
    whole, cut = tokens.Encoder(path, huge=1 << 30), tokens.Encoder(path, huge=300, chunk=200, overlap=16)
    for t in [*texts, "word" * 500, "a b " * 400, " " * 900 + "end"]:
        assert cut.ids(t.encode()) == whole.direct(t).tobytes(), t[:60]


def test_packing(docs, empty, rows):
    size = 256
    pieces = [r.asDict() for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size).collect()]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for r in rows:
        ids, at = np.array([*library_ids(r[1] or ""), 2], "<u4"), 0
        for p in sorted(by_doc[r[0]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
    total = sum(p["length"] for p in pieces)
    assert len(by_sequence) * size < 1.08 * total + size
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


# 5 -----------------------------------------------------------------------------------------------


def test_cover_meets_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


@pytest.mark.parametrize("batch", [3_000, 16 << 20])
def test_repeats(docs, empty, rows, batch, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 4_000)
    bodies = {r[0]: (r[1] or "").encode() for r in rows}
    seen = collections.Counter(b[i : i + 200] for b in bodies.values() for i in range(len(b) - 199))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert len(got) == len(bodies)
    some = 0
    for k, b in bodies.items():
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(int)))
        assert [(s.start, s.end) for s in got[k].spans] == list(zip(edges[::2], edges[1::2], strict=True))
        assert bytes(got[k].kept) == bytes(np.frombuffer(b, np.uint8)[~gone[:-1]]) and got[k].n_bytes == len(b)
        some += bool(len(edges))
    assert some >= 5
    assert repeats.remove_repeats(empty).count() == 0


# 6 -----------------------------------------------------------------------------------------------


def test_quality(spark, docs, empty):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(80)) + ".\n" for _ in range(60)]
    bad = [" ".join(word() + "$$$" for _ in range(80)) for _ in range(30)] + [f"{word()} " * 90 for _ in range(30)]
    table = [(i, t, "q") for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (500, None)], "doc_id long, quality int")
    frame = spark.createDataFrame(table, "doc_id long, text string, predicted string")
    got = quality.score_documents(frame, quality.train(frame, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 15 and sum(r.predicted == (r.doc_id < 60) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and (r.score >= 0.7) == bool(r.predicted) for r in got)
    model = quality.train(docs, labels.limit(0))
    assert quality.score_documents(docs, model).count() == docs.count() and quality.score_documents(empty, model).count() == 0


# 7 -----------------------------------------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).round(3)
    table = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(600 + i, [float(v) for v in x[7]]) for i in range(40)]
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None] * 8), (904, [float("inf")] * 8), (905, [1.0]), (None, [1.0] * 8)]
    vectors = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(vectors, vectors.filter("vec_id % 20 = 0 or vec_id = 7")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    asked = [i for i, _ in table if i % 20 == 0 or i == 7]
    for q in asked:
        v = np.array(dict(table)[q])
        true = sorted((float(np.sqrt(((np.array(y) - v) ** 2).sum())), i) for i, y in table if i != q)[:10]
        hits += len({i for _, i in true} & {i for i, _ in got[q]})
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
    assert hits / (10 * len(asked)) >= 0.9
    assert [i for i, _ in got[7]] == list(range(600, 610))
    assert neighbours.search(vectors.limit(0), vectors).count() == 0


@pytest.mark.parametrize("kind", ["queries apart", "many scales"])
def test_neighbours_of_uneven_vectors(spark, kind):
    """Queries that lie between the lists, not in them; vectors so near each other that their codes are the same."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    if kind == "queries apart":
        x[np.arange(8000) % 100 > 0] = (rng.normal(size=(40, 64))[rng.integers(0, 40, 8000)] + 0.05 * x)[np.arange(8000) % 100 > 0]
    else:
        x *= np.exp(4 * rng.normal(size=(8000, 1)))
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.search(vectors, vectors.filter("vec_id % 100 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 8000, 100):
        near = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")
        hits += len(set(near[near != q][:10].tolist()) & got[q])
    assert hits / (10 * 80) >= 0.95


# 8 -----------------------------------------------------------------------------------------------


def test_chat_format(spark):
    schemas = spark.createDataFrame([("f", "x", "integer", True), ("f", "y", "number", False)], "tool string, parameter string, type string, required boolean")
    m = [
        (1, 0, "tool", "early", "a", None, None, "z"), (1, 1, "assistant", "go", "a", "f", '{"y": 2, "x": 1}', "z"), (1, 2, "assistant", None, "b", "f", '{"x": "1", "q": null}', "z"),
        (1, 3, "assistant", "", "c", "g", "not json", "z"), (1, 4, "tool", "r", "nobody", None, None, "z"), (2, 0, None, None, None, None, None, "z"), (2, 0, None, None, None, None, None, "z"),
    ]
    frame = spark.createDataFrame(m, "conv_id long, turn long, role string, text string, call_id string, call_name string, call_arguments string, link string")
    got = sorted(chat_format.format_chats(frame, schemas).collect(), key=lambda r: (r.conv_id, r.position))
    assert [r.turn for r in got] == [1, 0, 2, 3, 4, 0, 0]
    assert [r.link for r in got] == ["call", "result", "open call", "open call", "orphan result", None, None]
    assert got[0].errors is None and got[0].n_errors == 0
    assert got[2].errors == ["q: unknown", "x: string for integer"] and got[3].errors == ["arguments: not an object"]
    assert got[0].message == '{"content":"go","role":"assistant","tool_call":{"arguments":"{\\"x\\":1,\\"y\\":2}","id":"a","name":"f"}}'
    assert chat_format.format_chats(frame.limit(0), schemas).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def test_mixing(docs, empty, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r["size"] == sizes[r.doc_id] and r["source"] == source[r.doc_id] and 0 <= r["copies"] <= 3
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    names = sorted((s for s in totals if s is not None)) + [None]
    left, free, want = sum(totals.values()), dict(zip(names, [1, 2, 3, 1], strict=True)), {}
    while True:
        level = left / sum(free.values())
        over = [s for s in free if level * free[s] > 3 * totals[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * totals[s]
            left -= want[s]
            del free[s]
    want |= {s: level * w for s, w in free.items()}
    for r in got:
        assert r.source_size == totals[r["source"]] and r.target == pytest.approx(want[r["source"]])
    for s in names:
        sums = 1
        for i, n in sizes.items():
            for _ in range(3 if source[i] == s else 0):
                sums |= sums << n
        goal = round(want[s])
        assert taken[s] == (sums & ((1 << (goal + 1)) - 1)).bit_length() - 1  # the largest sum of up to three copies each
    assert mixing.mix(empty).count() == 0


def test_choose_fits_budgets():
    rng = np.random.default_rng(4)
    lengths = np.arange(1, 200, 3)
    counts = rng.integers(1, 9, len(lengths))
    for budget in (0, 1, 777, 12_345, int((lengths * counts).sum())):
        n = mixing.choose(lengths, counts, budget)
        assert (n >= 0).all() and (n <= counts).all() and int((n * lengths).sum()) == budget
    assert mixing.choose(np.array([7]), np.array([3]), 10).tolist() == [1]


# 10 ----------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def linked(texts, percent):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("unit", [300, 2_000_000])
def test_near_duplicates(spark, docs, empty, rows, unit, monkeypatch):
    monkeypatch.setattr(near_dups, "SHINGLES_PER_UNIT", unit)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [r[1] for r in rows]
    for _ in range(25):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(120)] = f"v{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[-1], "y")], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in near_dups.near_duplicates(frame, 85).collect()}
    want = linked(texts, 85)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (i == c) for i, (_, c) in enumerate(want))
    assert got[None].component_id is None and got[None].kept
    assert near_dups.near_duplicates(empty).count() == 0


def test_pigeonhole():
    rng = np.random.default_rng(6)
    chunks = near_dups.n_chunks(85)
    for _ in range(200):
        a = rng.integers(0, 256, chunks * near_dups.CHUNK, dtype=np.uint8)
        b = a.copy()
        b[rng.choice(len(a), 2 * chunks - 1, replace=False)] ^= 1
        keys = near_dups.chunk_keys(np.stack([a, b]))
        assert set(keys[0].tolist()) & set(keys[1].tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100), (200, 100), (None, 3)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_windows_hash_equal_bytes_alike():
    buf = np.frombuffer(b"abcabcabd" * 50, np.uint8)
    starts = np.arange(len(buf) - 20)
    for chunk in (7, 1 << 19):
        h = hashing.windows(buf, starts, 20, hashing.draw().byte, chunk)
        groups = collections.defaultdict(set)
        for i in starts:
            groups[bytes(buf[i : i + 20])].add(int(h[i]))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_hash_is_the_polynomial(monkeypatch):
    monkeypatch.setattr(hashing, "LONGEST_SUM", 7)
    base, data = hashing.draw().byte, bytes(random.Random(3).randbytes(300))
    starts, ends = np.array([0, 5, 5, 250, 299]), np.array([300, 5, 17, 299, 300])
    want = [sum((x + 1) * pow(base, i, hashing.PRIME) for i, x in enumerate(data[a:b])) % hashing.PRIME for a, b in zip(starts, ends, strict=True)]
    assert hashing.spans(np.frombuffer(data, np.uint8), starts, ends, base).tolist() == want
    a, b = (np.random.default_rng(i).integers(0, hashing.PRIME, 500, dtype=np.uint64) for i in (1, 2))
    assert hashing.times(a, b).tolist() == [x * y % hashing.PRIME for x, y in zip(a.tolist(), b.tolist(), strict=True)]


#: Thue-Morse ordered bytes, for which polynomials modulo a power of two are equal whatever the base.
MORSE_TEXTS = [
    "abcdeo..o.oo..oo.o..o.oo.o..oo..o.oo.U::U:UU::UU:U::U:UU:U::UU::U:UU:qccqcqqccqqcqccqcqqcqccqqccqcqqcr&&r&rr&&rr&r&&r&rr&r&&rr&&r&rr&The quick brown fox jumps over the lazy dog, then sleeps near a river. O",
    "abcde.oo.o..oo..o.oo.o..o.oo..oo.o..o:UU:U::UU::U:UU:U::U:UU::UU:U::Ucqqcqccqqccqcqqcqccqcqqccqqcqccq&rr&r&&rr&&r&rr&r&&r&rr&&rr&r&&rThe quick brown fox jumps over the lazy dog, then sleeps near a river. O",
]
MORSE_WORDS = [
    "q33q3qq33qq3q33q3qq3q33qq33q3qq33qq3q33qq33q3qq3q33q3qq33qq3q33q*uu*u**uu**u*uu*u**u*uu**uu*u**uu**u*uu**uu*u**u*uu*u**uu**u*uu*#..#.##..##.#..#.##.#..##..#.##..##.#..##..#.##.#..#.##..##.#..#",
    "3qq3q33qq33q3qq3q33q3qq33qq3q33qq33q3qq33qq3q33q3qq3q33qq33q3qq3u**u*uu**uu*u**u*uu*u**uu**u*uu**uu*u**uu**u*uu*u**u*uu**uu*u**u.##.#..##..#.##.#..#.##..##.#..##..##.#..##.#..##.#..##..#.##.",
]


def test_ordered_texts_are_told_apart(spark):
    frame = spark.createDataFrame(list(enumerate(MORSE_TEXTS)), "doc_id long, text string")
    assert [(r.spans, bytes(r.kept).decode()) for r in repeats.remove_repeats(frame).orderBy("doc_id").collect()] == [([], t) for t in MORSE_TEXTS]
    words = spark.createDataFrame([(i, f"one two {w} four five six seven") for i, w in enumerate(MORSE_WORDS)], "doc_id long, text string")
    assert [r.component_id for r in near_dups.near_duplicates(words, 80).orderBy("doc_id").collect()] == [0, 1]


def test_quality_is_trained_on_one_row_a_document(spark):
    docs = spark.createDataFrame([(i, f"word {i} " * 9) for i in range(40)] + [(1, f"again {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    sizes = []
    fit, quality.fit = quality.fit, lambda x, y: sizes.append(len(y)) or fit(x, y)
    try:
        quality.train(docs, labels)
    finally:
        quality.fit = fit
    assert sizes and sizes[0] <= 40


def test_arguments_of_any_number_and_depth(spark):
    schemas = [("f", "n", "integer", True), ("f", "x", "number", False), ("f", "a", "object", False), ("f", "a.b", "string", True), ("f", "a.c", "array", False), ("f", "a.c[]", "object", False), ("f", "a.c[].d", "integer", True), ("f", "free", "object", False)]
    frame = spark.createDataFrame(schemas, "tool string, parameter string, type string, required boolean")
    cases = {
        '{"n":99999999999999999999}': [], '{"n":1.0}': [], '{"n":1e2,"x":3}': [], '{"n":-0.0,"x":1.5}': [], '{"n":1.5}': ["n: number for integer"], '{"n":1e-2}': ["n: number for integer"], '{"n":1,"n":2}': ["arguments: repeated key"],
        '{"n":1,"a":{"b":1,"b":2}}': ["arguments: repeated key"], "{bad": ["arguments: not an object"], "[1]": ["arguments: not an object"], "{}": ["n: missing"], '{"n":1,"a":{}}': ["a.b: missing"],
        '{"n":1,"a":{"b":"x","c":[]}}': [], '{"n":1,"a":{"b":"x","c":[{"d":1},{"d":2.0}]}}': [], '{"n":1,"a":{"b":"x","c":[{"d":1},{},{"d":"2"}]}}': ["a.c[].d: missing", "a.c[].d: string for integer"],
        '{"n":1,"a":{"b":"x","c":[3,[]],"z":1}}': ["a.c[]: array for object", "a.c[]: integer for object", "a.z: unknown"], '{"n":1,"a":null}': ["a: null for object"], '{"n":1,"free":{"any":{"thing":1}},"w":1}': ["w: unknown"],
    }
    calls = spark.createDataFrame([("f", k) for k in cases] + [("g", "{}"), ("f", None)], "call_name string, call_arguments string")
    got = {(r.call_name, r.call_arguments): r.errors for r in chat_format.validate_arguments(calls, frame).collect()}
    assert {k: got["f", k] for k in cases} == cases and got["g", "{}"] == ["name: unknown tool"] and got["f", None] == ["n: missing"]
