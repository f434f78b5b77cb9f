"""WARC archives in Zstandard: one frame a record, a dictionary in the first frame.

Archives are written by tasks into a shared folder and read back with a
streaming reader: it loads the dictionary from the leading skippable frame,
decodes one frame a record, and checks headers, lengths and digests.

Equal payloads (of 100 bytes or more) are stored once: the record with the
smallest key is a response, the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.frames import col, read
from tracewell.sources.shared import new_folder

#: skippable frame that holds the dictionary of the archive
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
LEAST_BYTES = 100
STEP = 1 << 13
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PREFIX = "urn:page:"


# ---- which records are revisits ------------------------------------------------


def with_types(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(key, url, payload, digest, n_bytes, record_type, refers_to) for every row.

    Null payloads are empty.  The response of a digest is the smallest non-null
    key; every row that bears it is a response, and so are rows of payloads
    whose keys are all null.  A row with a null key beside it is a revisit.

    A digest may belong to a third of all rows.  Its smallest key is found by a
    grouped minimum that tasks pre-aggregate; the answer, for digests that
    occur more than once only, is repeated under SALTS salts so that the rows
    of a hot digest spread over as many join groups.
    """
    body = F.coalesce(col(payload), F.lit(""))
    rows = pages.select(
        col(key).alias("key"), col(url).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")
    )
    first = (
        rows.where(F.col("n_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("key").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select(F.col("digest").alias("_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    )
    salted = rows.withColumn("_row_salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, (F.col("digest") == F.col("_digest")) & (F.col("_row_salt") == F.col("_salt")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return joined.select(
        "key",
        "url",
        "payload",
        "digest",
        "n_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


# ---- records --------------------------------------------------------------------


def _line(text: str) -> str:
    """A header value: line breaks and controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(key, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_PREFIX}{'' if key is None else key}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{_PREFIX}{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcError(ValueError):
    """A record or frame that breaks the format."""


VERSION, STATUS = re.compile(r"WARC/1\.[01]"), re.compile(r"HTTP/\d(\.\d)? \d{3}( .*)?")
#: Digests that payloads are checked against, and their sizes in bytes.
DIGESTS = {"sha256": 32, "sha1": 20}


def _headers(data: bytes, first: re.Pattern) -> dict[str, str]:
    lines = data.decode("utf-8").split("\r\n")
    if not first.fullmatch(lines[0]):
        raise WarcError(f"not {first.pattern}: {lines[0][:40]!r}")
    out = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header: {x[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def _key(ident: str) -> str:
    """What an id names: the key of our own records, the whole id of others."""
    if not (ident.startswith("<") and ident.endswith(">")):
        raise WarcError(f"not an id: {ident[:40]!r}")
    return ident[1:-1].removeprefix(_PREFIX)


def _digest(said: str) -> tuple[str, bytes]:
    name, _, value = said.partition(":")
    if name not in DIGESTS:
        raise WarcError(f"unknown digest {name[:20]!r}")
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * DIGESTS[name] else base64.b32decode(value)
    except ValueError as e:
        raise WarcError(f"malformed digest: {e}") from e
    return name, raw


def parse(data: bytes) -> tuple[str, str | None, int | None, str | None, str, str | None, bytes] | None:
    """key, url, payload bytes, sha256, type, refers_to, payload of one record, all checked.

    None for records that are neither responses nor revisits (their headers and
    length are checked).  Any HTTP status counts; ids of other writers come back
    whole.  A revisit without its payload's length or sha256 has NULL there.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of headers")
    h = _headers(head, VERSION)
    try:
        n, kind, ident = int(h["content-length"]), h["warc-type"], _key(h["warc-record-id"])
    except (KeyError, ValueError) as e:
        raise WarcError(f"header missing or malformed: {e}") from e
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {n} declared")
    if kind not in ("response", "revisit"):
        return None
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of HTTP headers")
    length = _headers(http, STATUS).get("content-length")
    said = _digest(h["warc-payload-digest"]) if "warc-payload-digest" in h else None
    if kind == "revisit":
        refers = h.get("warc-refers-to", "")
        if not refers or payload:
            raise WarcError(f"revisit {ident} without what it refers to, or with a payload")
        return ident, h.get("warc-target-uri"), int(length) if length else None, said[1].hex() if said and said[0] == "sha256" else None, kind, _key(refers), payload
    if length is not None and len(payload) != int(length) or said and hashlib.new(said[0], payload).digest() != said[1]:
        raise WarcError(f"payload of {ident} differs from its length or digest")
    digest = said[1].hex() if said and said[0] == "sha256" else hashlib.sha256(payload).hexdigest()
    return ident, h.get("warc-target-uri"), len(payload), digest, kind, None, payload


# ---- archives -------------------------------------------------------------------


def _sink(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(name)


def _source(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(name)


def train_dictionary(samples: list[bytes], size: int = 64 << 10) -> bytes:
    """A dictionary from sample records; plain sample bytes where training is impossible."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_archives(typed: DataFrame, folder: str, dictionary: bytes = b"", roll_bytes: int = 64 << 20) -> DataFrame:
    """Write the rows of `with_types` into .warc.zst files; one row (path) per file.

    A task starts another file after `roll_bytes` of compressed records.  Files
    of a task that was repeated have names of their own: only the returned
    paths, of the attempts that count, belong to the archive.
    """
    columns = ["key", "url", "payload", "digest", "record_type", "refers_to"]

    def run(batches):
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=6, dict_data=zdict, write_checksum=True, write_content_size=True)
        out, path, done = None, "", 0
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = [c.slice(start, 256).to_pylist() for c in b.columns]
                for key, url, payload, digest, kind, refers in zip(*part, strict=True):
                    if out is None:
                        path, done = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0
                        out = _sink(path)
                        if dictionary:
                            out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    frame = pack.compress(record(key, url, payload.encode(), digest, kind, refers))
                    out.write(frame)
                    done += len(frame)
                    if done >= roll_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    return typed.select(*columns).mapInArrow(run, "path string")


def frames(source, block: int = 1 << 20) -> Iterator[bytes]:
    """The decoded frames of an archive, one after another, in bounded memory."""
    held = io.BytesIO()

    def fill(n: int) -> bytes:
        got = source.read(n)
        return got or b""

    data = fill(block)
    zdict = None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        while len(data) < 8 + n:
            more = fill(block)
            if not more:
                raise WarcError("dictionary cut short")
            data += more
        raw, data = data[8 : 8 + n], data[8 + n :]
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        zdict = zstandard.ZstdCompressionDict(raw)
    unpack = zstandard.ZstdDecompressor(dict_data=zdict)
    at = 0
    while True:
        while len(data) - at < 4 and (more := fill(block)):
            data, at = data[at:] + more, 0
        if at == len(data):
            return
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise WarcError("not a Zstandard frame")
        one = unpack.decompressobj()
        held.seek(0)
        held.truncate()
        while not one.eof:
            if at >= len(data):
                data, at = fill(block), 0
                if not data:
                    raise WarcError("frame cut short")
            # a little at a time: what a frame leaves over is given back, and copied
            part = data[at : at + STEP]
            try:
                held.write(one.decompress(part))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
            at += len(part) - len(one.unused_data)
        yield held.getvalue()


RECORD = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """One RECORD row per response or revisit of the archives in column `path`.

    A null key comes back as an empty string.  Any broken frame, header,
    length or digest raises WarcError.  With `payloads` false the payload is
    checked but not returned.
    """
    names = RECORD.names

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with _source(path) as source:
                    for frame in frames(source):
                        if (r := parse(frame)) is None:
                            continue
                        rows.append(r if payloads else (*r[:6], None))
                        size += len(r[6]) if payloads else 64
                        if size > 4 << 20:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return paths.select("path").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of all archives under a folder (listed by Spark; contents aren't read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(folder).select("path")


def op7_warc(spark, sf_dir):
    """All pages into archives and back."""
    pages = read(spark, sf_dir, "pages")
    typed = with_types(pages, "page_id", "url", "html")
    # a compression aid only: at most 64 pages of at most 64 kB
    few = pages.where((F.octet_length("html") < 1 << 16) & (F.octet_length("html") > 0)).select("page_id", "url", "html").limit(64).collect()
    dictionary = train_dictionary([record(r.page_id, r.url, b := r.html.encode(), hashlib.sha256(b).hexdigest(), "response", None) for r in few])
    folder = new_folder(spark, "warc")
    written = write_archives(typed, f"{folder}/archives", dictionary)
    # the paths of the attempts that count; one row per file
    written.write.parquet(f"{folder}/paths")
    paths = spark.read.schema("path string").parquet(f"{folder}/paths")
    n = max(1, paths.count())
    back = read_archives(paths.repartition(n), payloads=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return back.select(number("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
