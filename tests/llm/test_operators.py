"""Each operator against SQL or brute force, on small tables and on edge cases."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tracewell.llm import bpe, components, decontamination, entries, near_dedup, quality_classifier, quality_rules, secrets, sharding, sql, super_kmers, suffix_array, warc
from tracewell.llm.shared_windows import Units

from tests.conftest import same_rows

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(4000))

#: nulls in every column, empty and long texts, repeated rows, ties, clashing column names
EDGES = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "alpha beta gamma delta epsilon zeta", "en", "s", 1),
    (4, " \t\n", "en", "s", 3),
    (5, LONG, "en", "s", 1),
    (6, LONG, "en", "s", 1),
    (7, "É password = hunter2hunter2 " + "z" * 5000, "fr", "s", 1),
    (1, "another text of the same id", "en", "s", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    extra = ["n_words", "spans", "key", "h", "score", "ids", "kept", "shard", "digest"]
    return spark.createDataFrame(EDGES, DOC).withColumns({c: F.lit("clash") for c in extra})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(spark, entries.queries()[name], sql.ORACLES[name], SF)


# ---- 1 near-dedup ------------------------------------------------------------------


def brute_components(texts: dict, n: int, percent: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng: random.Random, n_bases: int = 6, copies: int = 25) -> dict:
    out, i = {}, 0
    for b in range(n_bases):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 18)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            out[i] = " ".join(w)
            i += 1
    return out


def test_near_duplicates_equal_brute_force(spark, docs):
    for texts in (docs, edited(random.Random(4))):
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, shingle=4).collect()}
        assert got == brute_components(texts, 4)


def twins(rng: random.Random, pairs: int = 60) -> dict:
    """Copies of one text edited at places of their own, two at each: linked in pairs, seldom with others."""
    base, out = [f"w{rng.randrange(5000)}" for _ in range(150)], {}
    for i in range(pairs):
        places = rng.sample(range(4, 146), 3)
        for j in (2 * i, 2 * i + 1):
            w = list(base)
            for at in places:
                w[at] = f"e{rng.randrange(10**6)}"
            out[j] = " ".join(w)
    return out


def test_near_duplicates_far_from_hubs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 20, raising=False)
    # all documents share every bucket, where most pairs have no hub
    monkeypatch.setattr(near_dedup, "band_keys", lambda regs: np.tile(np.arange(near_dedup.BANDS, dtype=np.uint64), (len(regs), 1)))
    texts = twins(random.Random(8))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, shingle=4).collect()}
    want = {i: c for i, (_, c) in brute_components(texts, 4).items()}
    assert len(set(want.values())) > 1
    assert got == want


def test_near_duplicates_of_repeated_keys(spark):
    """All texts of a key count: 1 comes with two, each near another document."""
    a, b = ([f"{x}{i}" for i in range(120)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, "quite another text of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df, shingle=4).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    names = df.selectExpr("concat('k', doc_id) AS doc_id", "text")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(names, shingle=4).collect()} == {("k1", "k1"), ("k2", "k1"), ("k3", "k1"), ("k4", "k4")}


def test_roots(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 20), (50, 51)], "a long, b long")
    got = {r.node: r.root for r in components.roots(links).collect()}
    assert got == {**{i: 20 for i in range(20)}, 100: 20, 50: 51}
    assert components.roots(links.limit(0)).count() == 0


def test_near_duplicates_edges(spark, edges, nothing):
    rows = near_dedup.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[2] == {(2, True)} and by[3] == {(3, True)} and by[4] == {(4, True)}
    assert by[None] == {(None, True)} and by[5] == {(5, True)} and by[6] == {(5, False)}
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


def test_hyperminhash_estimates(spark):
    rng = random.Random(3)
    base = [f"s{i}" for i in range(3000)]
    for share in (0.5, 0.8, 0.95):
        other = [x if rng.random() < share else x + "y" for x in base]
        h, b = near_dedup.shingle_sets(pa.array([" ".join(base), " ".join(other)]), 1)
        r = near_dedup.registers(h, b)
        exact = len(set(base) & set(other)) / len(set(base) | set(other))
        assert abs(near_dedup.estimate(r[:1], r[1:])[0][0] - exact) < 0.15


# ---- 2 secrets ---------------------------------------------------------------------

BASE = [
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]


def base_spans(text: str) -> list:
    out = []
    for k, (kind, rx, group, least) in enumerate(BASE):
        for m in re.finditer(rx, text, re.IGNORECASE if k == 0 else 0):
            if len(m[group]) >= least:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_secrets_equal_brute_force(spark, docs):
    rng = random.Random(7)
    bits = ["password", "Secret", "api_key", "APIKEY", "token", ": ", "=", "'", '"', " ", "AKIA", "ABCD1234EFGH", "0123456789abcdef", "deadbeef" * 4, "é", "x", "\n", "hunter2hunter2"]
    texts = dict(docs) | {10_000 + i: "".join(rng.choice(bits) for _ in range(30)) for i in range(300)} | {20_000: "secret:token: abcdefghij", 20_001: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in secrets.scan(df).collect():
        got = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r.spans if s["kind"] in secrets.BASE]
        assert got == base_spans(texts[r.doc_id]), texts[r.doc_id]


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{32,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigram_query(secrets.RULES[0].pattern)


def test_secret_edges(spark, edges, nothing):
    rows = secrets.scan(edges).collect()
    assert len(rows) == len(EDGES)
    assert [len(r.spans) for r in rows if r.doc_id == 7] == [1] and all(not r.spans for r in rows if r.doc_id != 7)
    clean = secrets.redact(edges)
    assert clean.columns == edges.columns and clean.count() == len(EDGES)
    assert clean.where("doc_id = 7").first().text == "É [SECRET] " + "z" * 5000
    assert clean.where("doc_id = 2").first().text is None
    assert secrets.scan(nothing).count() == 0


# ---- 3 quality classifier ----------------------------------------------------------


def test_classifier_holds_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in entries.queries()["op3_quality_classifier"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    out = [(rows[i].predicted, q) for i, q in labels.items() if i in rows and rows[i].held_out]
    assert sum(p == q for p, q in out) / len(out) > 0.93


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 0, 0), (7, 1, 0), (None, 1, 0), (2, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(edges, labels)
    assert quality_classifier.score(edges, model).where("score between 0 and 1").count() == len(EDGES)
    bare = quality_classifier.fit(nothing, labels.limit(0))
    assert {r.score for r in quality_classifier.score(edges, bare).collect()} == {0.5}


def test_network_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality_classifier.Network.fit(x[:500], y[:500]).calibrate(x[500:], y[500:])
    assert ((net.probability(x[500:]) >= 0.5) == y[500:]).mean() > 0.85


# ---- 4 and 9 repeated passages -----------------------------------------------------


def brute_windows(texts: dict, units: Units) -> dict:
    first, bodies = {}, {i: units.split((t or "").encode()) for i, t in texts.items()}
    join = lambda b, j: units.join(b[j : j + units.k])
    for i in sorted(texts):
        for j in range(len(bodies[i]) - units.k + 1):
            first.setdefault(join(bodies[i], j), i)
    out = {}
    for i, b in bodies.items():
        gone = [False] * len(b)
        for j in range(len(b) - units.k + 1):
            if first[join(b, j)] < i:
                gone[j : j + units.k] = [True] * units.k
        left = [b[j] for j in range(len(b)) if not gone[j]]
        out[i] = (len(b), sum(gone), hashlib.sha256(units.join(left)).hexdigest())
    return out


def passages(rng: random.Random) -> dict:
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 7)))
    shared = [" ".join(word() for _ in range(n)) for n in (49, 50, 51, 80, 200)] + ["ha " * 120]
    out = {}
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 60)))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(shared), rng.choice(["", "  ", "\n"]) + " ".join(word() for _ in range(rng.randrange(0, 30)))]
        out[i] = " ".join(parts)
    return out | {100: out[3], 101: "", 102: None}


@pytest.mark.parametrize(("operator", "units"), [(super_kmers.substring_dedup, Units(words=True)), (suffix_array.exact_dedup, Units(words=False))])
def test_repeats_equal_brute_force(spark, operator, units, monkeypatch):
    from tracewell.llm import shared_windows

    texts = passages(random.Random(11))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for part in (2_000, 3):  # with and without buckets dealt out in parts
        monkeypatch.setattr(shared_windows, "PART", part)
        got = {r.doc_id: (r.n_units, r.n_removed, r.kept_sha256) for r in operator(df).collect()}
        assert got == brute_windows(texts, units)


@pytest.mark.parametrize(("finder", "units"), [(super_kmers.sorted_windows(50), Units(words=True)), (suffix_array.repeated_substrings(50), Units(words=False))])
def test_parts_of_one_bucket_share_strings(spark, finder, units):
    from tracewell.llm import shared_windows

    same = " ".join(f"w{i}" for i in range(60)).encode()
    n = len(units.split(same)) - units.k + 1
    # docs 5 and 9 end in the same passage, doc 7 holds it with text after it
    held = [(0, 1, 0, True, 9, 90, 0, n, same), (0, 1, 0, True, 7, 70, 0, n + 6, same + b" a b c"), (0, 1, 1, True, 5, 50, 0, n, same)]
    strings = spark.createDataFrame(held, shared_windows._STRINGS).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        hits = shared_windows._buckets(strings, units, finder).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    gone = {(r.doc, r.start + j) for r in hits if r.kind == 1 for j in range(r.n)}
    first = defaultdict(list)
    for r in hits:
        if r.kind == 2:
            first[bytes(r.digest)].append((r.doc, r.start))
    gone |= {x for xs in first.values() for x in xs if x[0] > min(xs)[0]}
    assert gone == {(d, j) for d in (7, 9) for j in range(n)}


@pytest.mark.parametrize("operator", [super_kmers.substring_dedup, suffix_array.exact_dedup])
def test_repeat_edges(spark, edges, nothing, operator):
    rows = operator(edges).collect()
    assert len(rows) == len(EDGES)
    assert {(r.doc_id, r.n_removed > 0) for r in rows} == {(1, False), (2, False), (3, False), (4, False), (5, False), (6, True), (7, False), (None, False)}
    assert operator(nothing).count() == 0


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(1, rng.choice([2, 3, 6])) for _ in range(rng.randrange(1, 60))] + [0]
        assert suffix_array.suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_many_symbols():
    """Large alphabets, with repeats of many symbols: no suffix is looked at alone."""
    rng = np.random.default_rng(5)
    part = rng.integers(1, 3000, 400)
    for body in (rng.integers(1, 5000, 3000), np.concatenate([part, part, rng.integers(1, 3000, 50), part]), np.append(np.tile([7, 9], 300), 2000)):
        s = [*body.tolist(), 0]
        assert suffix_array._by_doubling(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])



# ---- 5 BPE -------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = dict(docs) | {1000: "", 1001: None, 1002: "ΑΣΣ İstanbul ß é I'LL don't", 1003: "a<|endoftext|>b", 1004: "x" * 20_000, 1005: "😀😁 ١٢٣ ½\x85 \x1c"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        want = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == t.decode(want, skip_special_tokens=False)


def test_bpe_edges(spark, edges, nothing):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode(bpe.encode(edges, path), path)
    assert out.count() == len(EDGES) and out.where("doc_id = 2").first().ids == []
    assert bpe.encode(nothing, path).count() == 0


# ---- 6 decontamination -------------------------------------------------------------


def test_blocks_find_the_same(spark):
    d, b = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "benchmark"))
    one = decontamination.mark(d, b, keep=["doc_id"]).orderBy("doc_id").collect()
    many = decontamination.mark(d, b, keep=["doc_id"], block_ngrams=300).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in one] == [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in many]


def test_items_without_id_mark_words(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "beta gamma x")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "two three"), ("b", "beta gamma")], "item_id string, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], r["items"]) for r in decontamination.mark(d, bench).collect()}
    assert got == {1: ([(1, 3)], []), 2: ([(0, 2)], ["b"])}


def test_spans_are_cut(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "beta gamma"), (2, None), (None, "x"), (3, ""), (1, "beta gamma")], "item_id long, text string")
    clean = decontamination.remove_spans(edges, bench)
    assert clean.columns == edges.columns and clean.count() == len(EDGES)
    assert {r.text for r in clean.where("doc_id = 1").collect()} == {"alpha  delta epsilon zeta", "another text of the same id"}
    assert decontamination.remove_documents(edges, bench).count() == len(EDGES) - 3
    assert decontamination.mark(edges, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontamination.mark(nothing, bench).count() == 0


# ---- 7 WARC ------------------------------------------------------------------------


def test_archives_are_checked(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200), (2, "http://b\n", "x" * 200), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", "x" * 200), (1, "http://a", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    typed = warc.with_types(df, "page_id", "url", "html")
    paths = warc.write_archives(typed, f"file://{tmp_path}/w", b"a dictionary of some bytes" * 9)
    paths.write.parquet(f"{tmp_path}/p")
    back = warc.read_archives(warc.archive_paths(spark, f"{tmp_path}/w")).collect()
    got = sorted((r.key, r.record_type, r.refers_to, r.payload_bytes, bytes(r.payload or b"")) for r in back)
    full = b"x" * 200
    assert got == sorted([("", "revisit", "1", 200, b""), ("1", "response", None, 200, full), ("1", "response", None, 200, full), ("2", "revisit", "1", 200, b""), ("3", "response", None, 5, b"short"), ("4", "response", None, 5, b"short"), ("5", "response", None, 0, b"")])
    one = warc.record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), "response", None)
    assert warc.parse(one)[2] == 5
    for broken in (one.replace(b"hello", b"hellp"), one[:-1], one.replace(b"WARC/1.1", b"WARC/9.9"), one.replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)
    assert warc.with_types(df.limit(0), "page_id", "url", "html").count() == 0


def test_records_of_other_writers():
    body = b"HTTP/1.1 404 Not Found\r\nServer: x\r\n\r\ngone"
    digest = base64.b32encode(hashlib.sha1(b"gone").digest()).decode()

    def made(kind: str, block: bytes, *more: str, version: str = "WARC/1.0") -> bytes:
        head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", *more, f"Content-Length: {len(block)}"]
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    r = warc.parse(made("response", body, f"WARC-Payload-Digest: sha1:{digest}"))
    assert r == ("urn:uuid:1", None, 4, hashlib.sha256(b"gone").hexdigest(), "response", None, b"gone")
    assert warc.parse(made("warcinfo", b"software: x\r\n")) is None and warc.parse(made("request", b"GET / HTTP/1.1\r\n\r\n")) is None
    assert warc.parse(made("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:0>"))[2:6] == (None, None, "revisit", "urn:uuid:0")
    for broken in (made("response", body.replace(b"gone", b"gonf"), f"WARC-Payload-Digest: sha1:{digest}"), made("response", body, "WARC-Payload-Digest: md5:00"), made("response", b"no http")):
        with pytest.raises(warc.WarcError):
            warc.parse(broken)


def test_frames_of_all_sizes():
    import io

    rng = random.Random(6)
    bodies = [rng.randbytes(rng.choice([0, 1, 10, 5000, 40_000])) for _ in range(200)]
    packed = b"".join(zstandard.ZstdCompressor().compress(b) for b in bodies)
    for block in (1, 3, 1000, 1 << 20):
        assert list(warc.frames(io.BytesIO(packed), block)) == bodies
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(packed[:-1])))


# ---- 8 quality rules ---------------------------------------------------------------


def test_rule_statistics_equal_brute_force(spark, docs):
    texts = dict(docs) | {1000: "", 1001: None, 1002: "a b c a b c a b c", 1003: "x\n x\nx\n\n\nx \n"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality_rules.rule_stats(df).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        again = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        assert [r[s] for s in quality_rules.STATS[:5]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)]


def test_forest_isolates():
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(8, 1, size=(20, 3))])
    good = np.arange(520) < 500
    forest = quality_rules.IsolationForest.fit(x).calibrate(x, good, 0.01)
    bad = forest.score(x) > forest.threshold
    assert bad[~good].all() and bad[good].mean() <= 0.01


def test_forest_paths_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    forest = quality_rules.IsolationForest.fit(x[:300], n_trees=20)
    got = forest.score(x[300:340])
    for row, s in zip(x[300:340], got, strict=True):
        total = 0.0
        for feature, cut, left, path in forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] + (row[feature[node]] > cut[node])
            total += path[node]
        assert abs(s - 2.0 ** (-total / 20 / forest.scale)) < 1e-12


def test_rules_catch_and_lose(spark):
    """Verdicts of the query on labelled rows: few good ones lost, most bad ones caught."""
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in entries.queries()["op8_quality_rules"](spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows}
    assert all(not r.kept for r in rows.values() if r.base_failed)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows.values())
    rest = [(rows[i].kept, q) for i, q in labels.items() if not rows[i].base_failed]
    lost = [not k for k, q in rest if q == 1]
    caught = [not rows[i].kept for i, q in labels.items() if q == 0]
    assert sum(lost) <= 0.03 * len(lost) and sum(caught) >= 0.9 * len(caught)


def test_one_python_worker_for_each_core(spark, edges):
    """Passages are marked and cut in one pass of Python; in blocks the cut comes out the same."""
    bench = spark.createDataFrame([("a", "b c d e f g h i j k l m"), ("b", "some words of a benchmark item that is not long")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k z"), (2, "no hit"), (3, None), (4, "it has some Words of a benchmark item that is not long, yes")], "doc_id long, text string")
    once, blocks = decontamination.remove_spans(docs, bench), decontamination.remove_spans(docs, bench, block_ngrams=1)
    assert once._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, blocks.collect()), key=str)
    assert {r.doc_id: r.text for r in once.collect()} == {1: "x a  z", 2: "no hit", 3: None, 4: "it has , yes"}


def test_every_labelled_row_takes_part(spark, monkeypatch):
    """More labelled rows than a bounded sample would hold: all reach a tree or the threshold."""
    n, seen, split = 24_000, [], quality_rules.Growing.split
    monkeypatch.setattr(quality_rules.Growing, "split", lambda self, node, count, low, high: seen.append(int(count.sum())) or split(self, node, count, low, high))
    rng = np.random.default_rng(3)
    bad = np.arange(n) % 7 == 0
    stats = {"doc_id": np.arange(n), **{s: rng.integers(100, 200, n) + 900 * (s == "n_symbols") * (bad & (rng.random(n) < 0.8)) for s in quality_rules.STATS}}
    stats["n_repeat_words"] = np.zeros(n, dtype=np.int64)
    df = spark.createDataFrame(pd.DataFrame(stats))
    labels = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(n), "quality": (~bad).astype(int)}))
    forest = quality_rules.forest_of(df, labels)
    fit = range(0, n, 2)
    copies = -(-quality_rules.N_TREES * quality_rules.TREE_ROWS // len(fit))
    assert len(fit) > 10_000 and seen[0] == copies * len(fit)
    threshold, rest = forest.threshold, np.arange(n) % 2 == 1
    x = quality_rules.features(np.column_stack([stats[s] for s in quality_rules.STATS]))[rest]
    assert np.isfinite(threshold) and forest.calibrate(x, ~bad[rest], 0.01).threshold == threshold


def test_rules_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for forest in (quality_rules.fit_forest(edges, labels), quality_rules.fit_forest(nothing, labels.limit(0))):
        out = quality_rules.judge(edges, forest)
        assert out.count() == len(EDGES) and out.where("base_failed and kept").count() == 0
    assert quality_rules.judge(nothing, None).count() == 0


# ---- 10 sharding -------------------------------------------------------------------


def test_sharding_law(spark):
    rows = entries.queries()["op10_rendezvous"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_have_the_highest_score(spark):
    import struct

    import xxhash

    def best(key: int, n: int) -> int:
        scores = []
        for shard in range(n):
            h = xxhash.xxh64(str(key).encode(), 42).intdigest()
            for part in (shard, sharding.SEED):
                h = xxhash.xxh64(struct.pack("<i", part), h).intdigest()
            scores.append((h - (1 << 64) if h >> 63 else h, shard))
        return max(scores)[1]

    for r in entries.queries()["op10_rendezvous"](spark, SF).collect():
        assert (r.shard, r.grown_shard) == (best(r.doc_id, 40), best(r.doc_id, 41))


def test_weights_and_edges(spark, edges, nothing):
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r.shard: r["count"] for r in sharding.assign_shards(big, "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 2.7 < n[1] / n[0] < 3.3
    rows = sharding.assign_shards(edges, "doc_id", [1.0] * 3).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == len(EDGES) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(nothing, "doc_id", [1.0] * 3).count() == 0


# ---- pipeline ----------------------------------------------------------------------


def test_pipeline_stages(spark, edges, nothing):
    from tracewell.llm import pipeline as p

    sf = SF
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, edges, sf)
        assert out.columns == edges.columns, name
        assert out.count() <= len(EDGES)
        assert stage(spark, nothing, sf).count() == 0
    name, last = p.STAGES[-1]
    assert last(spark, edges, sf).count() == len(EDGES)


def cut_benchmark(text: str, items: list) -> str:
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    rx = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = list(re.finditer(rx, lower))
    hit = [False] * len(words)
    said = [m[0] for m in words]
    for item in items:
        w = re.findall(rx, re.sub("[A-Z]+", lambda m: m[0].lower(), item))
        grams = {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
        n = min(10, len(w))
        for i in range(len(said) - n + 1 if n else 0):
            if tuple(said[i : i + n]) in grams:
                hit[i : i + n] = [True] * n
    out, pos = [], 0
    for i, h in enumerate(hit):
        if h and (i == 0 or not hit[i - 1]):
            out.append(text[pos : words[i].start()])
        if h:
            pos = words[i].end()
    return "".join(out) + text[pos:]


def cut_secrets(text: str) -> str:
    spans = [(a, z) for a, _, _, z in base_spans(text)] + [m.span() for m in re.finditer(secrets.RULES[3].pattern, text)]
    out, at = "", 0
    for a, z in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, z)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    from tracewell.llm import pipeline as p

    kept = {r.doc_id: r.text for r in p.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    assert 100 < len(kept) < len(docs)
    apart = {i for i, (_, c) in brute_components(kept, 5).items() if c == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in apart:
        ids = t.encode(cut_secrets(cut_benchmark(kept[i] or "", items)), add_special_tokens=False).ids
        want[i] = (len(ids), ids, t.decode(ids, skip_special_tokens=False))
    rows = p.run(spark, SF).collect()
    assert len(rows) == len(want) and {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in rows} == want


def test_last_stage_replaces_clashing_columns(spark, edges):
    from tracewell.llm import pipeline as p

    out = p.tokenize(spark, edges.withColumn("decoded", F.lit("clash")).withColumn("n_tokens", F.lit("clash")), SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.where("decoded = 'clash'").count() == 0
