"""Substring deduplication over word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to its
bucket; there the windows are sorted, so that equal ones meet and are counted
exactly.  See shared_windows for how the strings get there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tracewell.llm.frames import read
from tracewell.llm.shared_windows import Units, deduplicate, runs_of


def sorted_windows(k: int):
    """Finder: sort the windows of k words of all strings, and compare keys in each run of equal ones."""

    def find(strings: list[bytes], docs: list[int], hot: list[bool]):
        windows = []
        for i, s in enumerate(strings):
            at = np.flatnonzero(np.frombuffer(s, dtype=np.uint8) == 0x20) + 1
            at = [0, *at.tolist(), len(s) + 1]
            doc = docs[i]
            windows += [(s[at[j] : at[j + k] - 1], doc, i, j) for j in range(len(at) - k)]
        windows.sort()
        hits, firsts = [], []
        last, least = None, 0
        for w, doc, i, j in windows:
            if w != last:
                last, least = w, doc
            if doc > least:
                hits.append((i, j))
            elif hot[i]:
                firsts.append((i, j))
        hits.sort()
        return runs_of(np.array(hits, dtype=np.int64).reshape(-1, 2)), firsts

    return find


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 50, m: int = 12) -> DataFrame:
    """Remove words covered by a window of k words that starts in a document of a smaller key too.

    (key, n_units, n_removed, n_spans, kept_sha256, kept); the kept words are
    joined by one space.  Windows are judged on the input.
    """
    return deduplicate(docs, Units(words=True, k=k, m=m), sorted_windows(k), key, text)


def op4_substring_dedup(spark, sf_dir):
    """Words of every document that repeat passages of earlier ones."""
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", out["n_units"].alias("n_words"), "n_removed", "kept_sha256")
