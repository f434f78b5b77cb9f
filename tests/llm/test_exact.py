"""Equality on bytes, where 64-bit hashes agree, and texts of megabytes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tracewell.llm import decontamination, near_dedup, quality_rules
from tracewell.llm import kernels as K


def thue_morse(n: int, pair: str = "ab") -> str:
    return "".join(pair[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 65_536])
def test_words_of_equal_polynomials_are_told_apart(spark, n):
    one, other = thue_morse(n), thue_morse(n, "ba")
    df = spark.createDataFrame([(1, one), (2, other), (3, f"{one} x"), (4, f"{other} x")], "doc_id long, text string")
    for shingle in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, shingle=shingle).collect()}
        assert got == {i: (1, i, True) for i in (1, 2, 3, 4)}
    text = "\n".join([one, other, f"{one} x y", f"{other} x y"])
    (r,) = quality_rules.rule_stats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_words, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.n_distinct_words) == (8, 4, 0, 0, 4)


@pytest.mark.parametrize("bits", [0, 3])
def test_any_hash_may_collide(spark, monkeypatch, bits):
    """With hashes of a few bits everything that is decided on bytes stays right."""
    from tests.llm.test_operators import brute_components, edited

    rng = random.Random(5)
    texts = edited(rng, 3, 8) | {100: "a b c d e f g h", 101: "a b c d e f g i", 102: ""}
    column = pa.array([texts[i] for i in sorted(texts)])
    want = {i: n for i, (n, _) in brute_components(texts, 4).items()}
    full = K.word_hash
    monkeypatch.setattr(K, "word_hash", lambda *a: full(*a) & np.uint64((1 << bits) - 1))
    _, borders = near_dedup.shingle_sets(column, 4)
    assert dict(zip(sorted(texts), np.diff(borders).tolist(), strict=True)) == want
    one = texts[0].encode()
    others = [texts[i].encode() for i in sorted(texts) if texts[i]]
    said = near_dedup._confirmed(one, others, 4, 80).tolist()
    sets = [{tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for t in others]
    assert said == [100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets]
    lines = pa.array(["x y z\nx y z\nx y q\n" * 3, "p q r s p q r t", None])
    stats = np.column_stack(quality_rules.text_stats(lines))
    assert stats[:, [0, 3, 4, 8]].tolist() == [[27, 7, 27, 4], [8, 0, 6, 5], [0, 0, 0, 0]]


def test_long_words_and_spans():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 7, 8, 9, 16, 255, 256, 257, 3000]))) for _ in range(300)]
    words += words[:100]
    c = K.chunk(pa.array([b" ".join(words)]))
    starts, ends, _ = c.words(K.SPACED)
    ids = K.exact_ids(c.data, starts, ends, K.word_hash(c.data, starts, ends))
    seen = {}
    assert ids.tolist() == [seen.setdefault(w, i) for i, w in enumerate(words)]


def test_hot_ngrams_are_dealt_to_blocks(spark, monkeypatch):
    """An n-gram of very many items: no block holds more rows than asked for, and all items are named."""
    bench = spark.range(5000).selectExpr("id AS item_id", "CASE WHEN id % 5 = 4 THEN concat('own text ', id) ELSE 'the common line' END AS text")
    docs = spark.createDataFrame([(1, "see the common line here"), (2, "own text 9 and the common"), (3, None)], "doc_id long, text string")
    grams = decontamination.benchmark_ngrams(bench)
    limits, share = decontamination._blocks(grams, 1000)
    sizes = [grams.where(share.between(a, z)).count() for a, z in limits]
    assert sum(sizes) == grams.count() and max(sizes) <= 1000 and len(sizes) <= 7
    got = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], set(r["items"])) for r in decontamination.mark(docs, bench, block_ngrams=1000).collect()}
    assert got == {1: (5, [(1, 4)], {str(i) for i in range(5000) if i % 5 != 4}), 2: (6, [(0, 3)], {"9"}), 3: (0, [], set())}
