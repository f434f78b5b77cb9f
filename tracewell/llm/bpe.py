"""Byte-pair encoding and decoding with a public vocabulary file.

A piece of text is a doubly linked list of symbols.  A priority queue holds
the rank of every adjacent pair that can merge; the lowest rank, leftmost
first, merges next, and entries whose symbols have changed since are skipped.
Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.frames import col, map_text, read

_SPACE = r"\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = re.compile(rf"[{_SPACE}]+")
#: What Python's split() takes for spaces, beyond those of the vocabulary.
_INFORMATION = re.compile(r"[\x1c-\x1f]")

#: Words up to this long are remembered, and twice as many of them at most, per task.
CACHE_WORD, CACHE_SIZE = 48, 80_000
#: Texts that are encoded at once, in bytes: a task holds their ids and what they decode to.
SLICE_BYTES = 1 << 18


#: Letters and numbers that Unicode 16 added, which the tokenizers library knows and an older Python doesn't.
ADDED_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
ADDED_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Capitals of Unicode 16 and 17 (first, last, distance to the small letter).
ADDED_CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
]
_SMALL = {c: c + by for a, z, by in ADDED_CAPITALS for c in range(a, z + 1)}
_CAPITAL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def _class(kind: str, added: list[tuple[int, int]]) -> str:
    """The characters of a general category, as ranges of a character class."""
    of = np.array([unicodedata.category(chr(c))[0] == kind for c in range(0x110000)])
    for a, z in added:
        of[a : z + 1] = True
    edges = np.flatnonzero(np.diff(of, prepend=False, append=False))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2).tolist())


@cache
def pieces(ascii_only: bool) -> re.Pattern:
    """How the vocabulary cuts a word (fixed by its file): contractions, letters, single digits, others."""
    letter, number = ("a-zA-Z", "0-9") if ascii_only else (_class("L", ADDED_LETTERS), _class("N", ADDED_NUMBERS))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")


class Remembered:
    """What was last computed for short strings: two generations, of which the older is dropped when the younger is full.

    Ids are four bytes each: smaller than tuples, and the garbage collector needn't walk through them.
    """

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        if (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= CACHE_WORD:
            if len(self.young) >= CACHE_SIZE:
                self.old = dict(self.young)
                self.young.clear()  # in place: encode() holds it
            self.young[key] = ids


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself, or the next one from 256."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Vocabulary:
    """Strings, ids and merge ranks of a tokenizer file, with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = dict(model["vocab"])
        size = max([*ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = s
        self.ranks, self.left, self.right, self.made = {}, [], [], []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.ranks[ids[a], ids[b]] = rank
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
        alphabet = byte_alphabet()
        self.inner = [ids[c] for c in alphabet]
        self.last = [ids[c + self.end] for c in alphabet]
        found = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({found})") if found else None

    def merge(self, piece: str) -> tuple[int, ...]:
        """Token ids of one piece.  A queue entry is the rank of a pair and the place of its left symbol."""
        data = piece.encode("utf-8", "surrogatepass")
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        if n == 1:
            return tuple(ids)
        rank, left, right, made_of = self.ranks.get, self.left, self.right, self.made
        heap = [r * n + i for i, r in enumerate(map(rank, pairwise(ids))) if r is not None]
        if not heap:
            return tuple(ids)
        heapify(heap)
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] != left[r] or j < 0 or ids[j] != right[r]:
                continue  # stale: one of the two has merged since
            made = ids[i] = made_of[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank((made, ids[k]))) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank((ids[h], made))) is not None:
                heappush(heap, r * n + h)
        return tuple([x for x in ids if x >= 0])

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


class Encoder:
    """Encodes texts for one task, and remembers words and pieces as long."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.words, self.parts = Remembered(), Remembered()

    def word(self, word: str) -> bytes:
        """Token ids of a run of text without spaces or special tokens."""
        if (ids := self.words.get(word)) is not None:
            return ids
        if word.isascii():
            text = word.lower()
        else:
            text = unicodedata.normalize("NFC", word)
            # lower case of each character alone: no rule for a last sigma
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
            if _CAPITAL.search(text):
                text = text.translate(_SMALL)
        found, parts = [], self.parts
        known = parts.young
        for piece in pieces(text.isascii()).findall(text):
            got = known.get(piece) or parts.get(piece)
            if got is None:
                got = array("i", self.vocabulary.merge(piece)).tobytes()
                parts.put(piece, got)
            found.append(got)
        ids = b"".join(found)
        self.words.put(word, ids)
        return ids

    def encoded(self, text: str) -> bytes:
        """Token ids of a whole text, four bytes each.

        Pieces, lower case and canonical composition never reach across a
        space, so words are encoded, and remembered, one by one.
        """
        out: list[bytes] = []
        known, word = self.words.young.get, self.word
        cut, special = self.vocabulary.cut, self.vocabulary.special
        for part in cut.split(text) if cut else [text]:
            if part in special:
                out.append(array("i", [special[part]]).tobytes())
                continue
            out += [known(w) or word(w) for w in (part.split() if not _INFORMATION.search(part) else SPACES.split(part))]
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return np.frombuffer(self.encoded(text), np.intc).tolist()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.intc)))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add `ids` (array of int): the whole text's tokens, without added ones.

    Null and empty texts have no tokens.  A column called `ids` is replaced.
    With `decoded` the text that the ids decode to is added under that name in
    the same pass, so that they needn't travel to Python again.
    """

    def setup():
        words = vocabulary(path)
        coder = Encoder(words)

        def work(texts: pa.Array) -> list[pa.Array]:
            rows = [coder.encoded(t) if t else b"" for t in texts.to_pylist()]
            out = [_lists(rows)]
            return out if decoded is None else [*out, pa.array((words.decode(np.frombuffer(r, np.intc).tolist()) for r in rows), pa.string())]

        return work

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return map_text(df, text, setup, fields, keep, SLICE_BYTES)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add `decoded`: the vocabulary strings of `ids`, joined as the file says
    (it names no decoder: by single spaces).  Null ids give an empty text."""
    kept = [c for c in df.columns if c != decoded]
    source = df.select(*[col(c) for c in kept])
    schema = T.StructType([*source.schema.fields, T.StructField(decoded, T.StringType())])
    at = kept.index(ids)

    def run(batches):
        words = vocabulary(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [words.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in schema])

    return source.mapInArrow(run, schema)


def op5_bpe(spark, sf_dir):
    """Tokens and the decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(read(spark, sf_dir, "documents"), path, keep=["doc_id"], decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
