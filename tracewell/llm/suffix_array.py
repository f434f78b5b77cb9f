"""Exact substring deduplication over bytes with suffix arrays.

A shard's strings are laid end to end, a separator behind each.  The suffix
array comes from induced sorting: suffixes are classified as smaller or larger
than their successor, the leftmost-smaller substrings are sorted (where they
repeat, by recursion or, if they have many names, by doubling), and all other
suffixes are induced from them in two linear scans.  Common prefixes are computed in text order (permuted), and runs of
suffixes that share k bytes or more inside their strings are the repeats.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tracewell.llm.frames import read
from tracewell.llm.shared_windows import Units, deduplicate, runs_of


SMALL_ALPHABET = 1024  # up to here suffixes are induced


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its successor, and the leftmost-smaller positions."""
    n = len(s)
    # equal neighbours have the type of the next different one
    differ = np.append(s[1:] != s[:-1], True)
    rises = np.append(s[:-1] < s[1:], True)
    nxt = np.flatnonzero(differ)
    smaller = np.repeat(rises[nxt], np.diff(nxt, prepend=-1))
    return smaller, np.flatnonzero(smaller & ~np.append(True, smaller[:-1]))


def _induced(s: np.ndarray, smaller: np.ndarray, order: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array from leftmost-smaller suffixes in `order`, a bucket of one first symbol at a time.

    A bucket's larger suffixes come from those scanned before, its smaller ones from those scanned
    after them; suffixes that a bucket induces in itself follow round by round.
    """
    by = order[np.argsort(s[order], kind="stable")]
    edge = np.searchsorted(s[by], np.arange(alphabet + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    small: list[list[np.ndarray]] = [[] for _ in range(alphabet)]

    def spread(found: list[np.ndarray], to: list[list[np.ndarray]]) -> None:
        every = np.concatenate(found)
        symbol = s[every]
        at = np.argsort(symbol, kind="stable")
        every, symbol = every[at], symbol[at]
        cut = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for a, z in zip(np.append(0, cut).tolist(), np.append(cut, len(every)).tolist(), strict=True):
            to[symbol[a]].append(every[a:z])

    def scan(c: int, start: list[np.ndarray], last: np.ndarray, kind: bool, to: list[list[np.ndarray]]) -> np.ndarray:
        """Scan a bucket: what it got so far, what that induces in the bucket itself, then `last`."""
        got, found = [], []
        now = np.concatenate(start) if start else last[:0]
        while len(now):
            got.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before] == kind]
            own = s[before] == c
            found.append(before[~own])
            now = before[own]
        before = last[last > 0] - 1
        found.append(before[smaller[before] == kind])
        if sum(map(len, found)):
            spread(found, to)
        return np.concatenate(got) if got else last[:0]

    for c in range(alphabet):
        larger[c] = [scan(c, larger[c], by[edge[c] : edge[c + 1]], False, larger)]
    out = []
    small[int(s[-1])].append(np.array([len(s) - 1]))
    for c in range(alphabet - 1, -1, -1):
        mine = scan(c, small[c], larger[c][0][::-1], True, small)
        out += [mine[::-1], larger[c][0]]
    return np.concatenate(out[::-1])


def _by_doubling(s: np.ndarray) -> np.ndarray:
    """Suffix array for large alphabets: sorted by 1, 2, 4, ... symbols, of which only suffixes still equal are sorted again.

    The rank of a suffix is the place of the first one that equals it so far.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    key = s[order].astype(np.int64)
    rank = np.empty(n, dtype=np.int64)
    live, reach = np.arange(n), 0
    while True:
        new = np.append(True, key[1:] != key[:-1])
        at = order[live]
        rank[at] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        equal = ~(new & np.append(new[1:], True))
        live, at = live[equal], at[equal]
        if not len(live):
            return order
        reach = 2 * reach or 1
        then = at + reach
        key = rank[at] * (n + 1)
        inside = then < n
        key[inside] += rank[then[inside]] + 1
        by = np.argsort(key, kind="stable")
        order[live], key = at[by], key[by]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers whose last one is smallest and occurs once."""
    n, alphabet = len(s), int(s.max()) + 1
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    if alphabet > SMALL_ALPHABET:
        return _by_doubling(s)
    s = s.astype(np.int16)
    smaller, leftmost = _types(s)
    if len(leftmost) <= 1:
        return _induced(s, smaller, leftmost, alphabet)
    place = np.full(n, -1, dtype=np.int64)
    place[leftmost] = np.arange(len(leftmost))
    order = place[_induced(s, smaller, leftmost, alphabet)]
    order = order[order >= 0]
    # leftmost-smaller substrings, each up to the next one's first symbol, in order: equal neighbours get one name
    length = np.diff(np.append(leftmost, n - 1)) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    step = 0
    while len(left):
        equal = s[leftmost[a[left]] + step] == s[leftmost[b[left]] + step]
        same[left[~equal]] = False
        step += 1
        left = left[equal]
        left = left[length[a[left]] > step]
    name = np.append(0, np.cumsum(~same))
    if name[-1] + 1 < len(leftmost):
        reduced = np.empty(len(leftmost), dtype=np.int64)
        reduced[order] = name
        order = suffix_array(reduced)
    return _induced(s, smaller, leftmost[order], alphabet)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, in text order, the length it has in common with its predecessor in the suffix array.

    A position whose symbol before it is the predecessor's too has one less
    than the position before it; only the others are compared.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    known = (before < 1) | (at < 1)
    known[~known] = s[at[~known] - 1] != s[before[~known] - 1]
    start = np.flatnonzero(known)
    length = np.zeros(len(start), dtype=np.int64)
    live = np.flatnonzero(before[start] >= 0)
    # eight symbols a step, then one by one
    word = np.lib.stride_tricks.sliding_window_view(np.append(s, np.zeros(8, s.dtype)), 8)
    while len(live):
        x, y = start[live] + length[live], before[start[live]] + length[live]
        ok = np.maximum(x, y) + 8 <= n
        ok[ok] = (word[x[ok]] == word[y[ok]]).all(axis=1)
        length[live[ok]] += 8
        rest = live[~ok]
        while len(rest):
            rest = rest[s[start[rest] + length[rest]] == s[before[start[rest]] + length[rest]]]
            length[rest] += 1
        live = live[ok]
    own = np.cumsum(known) - 1
    return np.maximum(length[own] - (at - start[own]), 0)


def repeated_substrings(k: int):
    """Finder: runs of suffixes with k bytes in common, from the shard's suffix array."""

    def find(strings: list[bytes], docs: list[int], hot: list[bool]):
        q = len(strings)
        sizes = np.array([len(x) for x in strings])
        starts = np.cumsum(sizes + 1) - sizes - 1
        # bytes from 2, 1 behind each string, 0 behind all: what follows a separator never counts
        s = np.ones(int(sizes.sum()) + q + 1, dtype=np.int16)
        inside = np.ones(len(s), dtype=bool)
        inside[starts + sizes] = inside[-1] = False
        s[inside] = np.frombuffer(b"".join(strings), dtype=np.uint8).astype(np.int16) + 2
        s[-1] = 0
        sa = suffix_array(s)
        common = permuted_prefixes(s, sa)[sa]
        row = np.repeat(np.arange(q + 1), [*(sizes + 1), 1])[sa]
        whole = np.append(starts + sizes, 0)[row] - sa >= k  # bytes to the separator
        sa, common, row = sa[whole], common[whole], row[whole]
        # suffixes too short for a window never lie between two that share k bytes
        at = np.flatnonzero(common < k)
        if not len(at) or at[0] != 0:
            at = np.append(0, at)
        doc = np.array(docs, dtype=np.int64)[row]
        least = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(sa)))) if len(sa) else doc
        place = sa - starts[row]
        hit = doc > least
        pairs = np.column_stack([row[hit], place[hit]])
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        first = ~hit & np.array(hot, dtype=bool)[row]
        return runs_of(pairs), list(zip(row[first].tolist(), place[first].tolist(), strict=True))

    return find


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 50, m: int = 18) -> DataFrame:
    """Remove bytes covered by a k-byte string that starts in a document of a smaller key too.

    (key, n_units, n_removed, n_spans, kept_sha256, kept).  Texts are UTF-8;
    what is kept may not be.  Matches lie within one document each, and are
    judged on the input.
    """
    return deduplicate(docs, Units(words=False, k=k, m=m), repeated_substrings(k), key, text)


def op9_suffix_array_dedup(spark, sf_dir):
    """Bytes of every document that repeat those of earlier ones."""
    out = exact_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", out["n_units"].alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
