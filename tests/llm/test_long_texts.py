"""Texts of 3 MB and 20 MB through every operator and every stage of the pipeline."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from tracewell.llm import bpe, decontamination, html_text, near_dedup, pipeline, quality_classifier, quality_rules, secrets, sharding, super_kmers, suffix_array, warc

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "password = hunter2hunter2"


def long_text(size: int, seed: int) -> str:
    rng = random.Random(seed)
    words = [f"w{rng.randrange(50_000)}" for _ in range(size // 7)]
    words[len(words) // 2] = SECRET
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    a, b = long_text(3 << 20, 1), long_text(20 << 20, 2)
    return {1: a, 2: b, 3: a + " and a little more", 4: "short"}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], DOC).repartition(4).cache()


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def test_near_duplicates_and_rules(docs, texts):
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
    for r in quality_rules.rule_stats(docs, keep=["doc_id"]).collect():
        w = texts[r.doc_id].split()
        assert (r.n_words, r.word_chars, r.n_distinct_words) == (len(w), sum(map(len, w)), len(set(w)))


def test_secrets_and_benchmark(spark, docs, texts):
    for r in secrets.scan(docs).collect():
        at = texts[r.doc_id].find(SECRET)
        assert [(s.start, s.end) for s in r.spans] == ([(at, at + len(SECRET))] if at >= 0 else [])
    item = " ".join(texts[2].split()[-40:-20])
    bench = spark.createDataFrame([("b", item)], "item_id string, text string")
    found = {r.doc_id: (r.n_words, list(r["items"])) for r in decontamination.mark(docs, bench, keep=["doc_id"]).collect()}
    assert found[2][1] == ["b"] and found[1][1] == []
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(docs, bench).collect()}
    assert len(cut[2]) < len(texts[2]) and cut[1] == texts[1]


@pytest.mark.parametrize("operator", [super_kmers.substring_dedup, suffix_array.exact_dedup])
def test_repeats(docs, texts, operator):
    got = {r.doc_id: (r.n_removed > 0, r.kept_sha256) for r in operator(docs).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == [False, False, True, False]
    assert got[1][1] == sha(texts[1]) and got[2][1] == sha(texts[2])


def test_tokens_and_scores(spark, docs, texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = {r.doc_id: r.decoded for r in bpe.encode(docs.where("doc_id <> 2"), path, keep=["doc_id"], decoded="decoded").collect()}
    assert re.sub(r"\s", "", out[1]) == re.sub(r"\s", "", texts[1].lower()) or len(out[1]) > 1 << 20
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.score(docs, model).where("score between 0 and 1").count() == 4


def test_shards_pages_and_archives(spark, docs, texts, tmp_path):
    for r in sharding.assign_shards(docs.select("doc_id", "text"), "doc_id", [1.0] * 4).collect():
        assert 0 <= r.shard < 4
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<nav>x</nav><article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert {r.page_id: zlib.crc32(r.text.encode()) for r in html_text.main_text(pages).collect()} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
    typed = warc.with_types(pages, "page_id", "url", "html")
    paths = warc.write_archives(typed, f"file://{tmp_path}/w", b"a dictionary of some bytes" * 9)
    paths.write.parquet(f"{tmp_path}/p")
    back = {int(r["key"]): r["payload_bytes"] for r in warc.read_archives(warc.archive_paths(spark, f"{tmp_path}/w")).collect()}
    assert back == {i: len(t) + 38 for i, t in texts.items()}


def test_stages(spark, docs, texts):
    few = docs.where("doc_id <> 2")  # the whole pipeline's stages on 3 MB, 20 MB go through the operators above
    for name, stage in pipeline.STAGES:
        out = stage(spark, few, SF)
        assert 1 <= out.count() <= 3, name


def test_a_task_gives_its_memory_back():
    """What a task no longer uses doesn't stay with its worker."""
    import numpy as np
    from tracewell.llm.frames import give_back

    resident = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024
    give_back()
    before = resident()
    held = [np.ones(12_000) for _ in range(1500)]  # pieces of 96 KB, which no free() alone returns
    last = np.ones(10)
    assert resident() > before + 100
    del held
    give_back()
    assert resident() < before + 40 and len(last) == 10
