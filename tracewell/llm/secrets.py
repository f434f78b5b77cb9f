"""Secret scan with a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression:
every match must contain all trigrams of one of some strings.  The index holds
a posting (trigram, record) for the trigrams that the rules ask for.  Postings
of a clause are intersected per record, and only records that satisfy a query
are searched with the rule's expression.  Rules without a mandatory trigram
search every record.  Built-in functions only.

No text is shuffled: postings hold ids, and the ids that satisfy a query set bits
of a bitmap of fixed size, which is broadcast.  A text whose bit is set is
verified where it is read.  Bits that ids share make more texts be verified, but
a text that holds no rule's trigrams matches none, so they change no result.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.frames import col, read, small_table


@dataclass(frozen=True)
class Rule:
    """kind, expression, the group whose length counts, and that length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base rules; order breaks ties of position.
#: `{12,}` and `{32,}` find what `+` finds, less the runs that are too short.
RULES = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"),
)
BASE = ("assign", "access", "hex")

_MANY = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of lower-case trigrams, one of which every match contains whole.

    None if nothing is mandatory.
    """
    strings, wanted = {""}, []

    def close() -> None:
        nonlocal strings
        if strings and min(map(len, strings)) >= 3:
            wanted.append(strings)
        strings = {""}

    def exact(items) -> set[str] | None:
        """All strings that the items can match, if they are few."""
        out = {""}
        for op, arg in items:
            if op is C.LITERAL:
                more = {chr(arg).lower()}
            elif op is C.IN and arg[0][0] is not C.NEGATE and all(o is C.LITERAL for o, _ in arg):
                more = {chr(x).lower() for _, x in arg}
            elif op is C.SUBPATTERN:
                more = exact(arg[-1])
            elif op is C.BRANCH:
                parts = [exact(x) for x in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is C.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
                more = exact(arg[2])
                more = None if more is None else more | {""}
            elif op is C.MAX_REPEAT and arg[0] == arg[1] and (one := exact(arg[2])) is not None and len(one) == 1:
                more = {next(iter(one)) * int(arg[0])}
            else:
                return None
            if more is None or len(out) * len(more) > _MANY:
                return None
            out = {a + b for a in out for b in more}
        return out

    for item in parser.parse(pattern):
        found = exact([item])
        if found is None or len(strings) * len(found) > _MANY:
            close()
        if found is not None:
            strings = {a + b for a in strings for b in found}
    close()
    clauses = {frozenset()}
    for alternatives in wanted:
        grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in alternatives}
        if len(clauses) * len(grams) <= _MANY:
            clauses = {a | b for a in clauses for b in grams}
    clauses = {c for c in clauses if not any(d < c for d in clauses)}
    return None if frozenset() in clauses else sorted(clauses, key=sorted)


def _keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text (never null) and what tells records apart."""
    body = F.coalesce(col(text), F.lit(""))
    return df.select(col(key).alias("key"), body.alias("text"), F.xxhash64(body).alias("h"), F.octet_length(body).alias("size"))


_ID = ["key", "h", "size"]


def build_index(records: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, key, h, size) for the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for c in trigram_query(r.pattern) or [] for g in c})
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams])) if grams else F.array().cast("array<string>")
    # lower-cased once: a generator's expression shares nothing between the trigrams
    return records.select(F.lower("text").alias("low"), *_ID).select(F.explode(held).alias("trigram"), *_ID)


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Records that satisfy the query of some rule: key, h, size, kinds.

    A clause's postings are intersected by counting them per record, so a
    trigram that most records hold makes no large group.
    """
    clauses = [(r.kind, i, g, len(c)) for r in rules for i, c in enumerate(trigram_query(r.pattern) or []) for g in c]
    spark = index.sparkSession
    table = small_table(spark, clauses, "kind string, clause int, trigram string, n int")
    return (
        index.distinct()
        .join(F.broadcast(table), "trigram")
        .groupBy(*_ID, "kind", "clause", "n")
        .count()
        .where(F.col("count") == F.col("n"))
        .groupBy(*_ID)
        .agg(F.collect_set("kind").alias("kinds"))
    )


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of the leftmost matches that don't overlap and are long enough.

    Code points, end exclusive.  The pieces between matches and the matches
    alternate, so positions are running sums of their lengths.
    """
    rx = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    counted = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else whole
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    parts = F.zip_with(
        F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("n"))),
        counted,
        lambda x, v: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), (F.length(v) >= rule.least).alias("ok")),
    )

    def step(done, x):
        start = done["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["ok"], F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    none = F.array().cast(_SPANS)
    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda x: x["spans"])
    return F.when(text.rlike(rule.pattern), folded).otherwise(none)


BITS = 1 << 24  # 2 MB: the size of what is broadcast, whatever the number of records
_MAP_BITS = 1 << 15  # bits of one row


def marks(chosen: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the chosen ids in rows of 4 kB, BITS / 2^15 rows at most."""
    place = F.pmod(F.xxhash64(*_ID), F.lit(BITS))
    return chosen.select(place.alias("p")).select(F.shiftright("p", 15).alias("bucket"), (F.col("p") % _MAP_BITS).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def _with_spans(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(row, spans): every row of `df` as a struct, with the spans of its text."""
    asked = [(i, r) for i, r in enumerate(rules) if trigram_query(r.pattern)]
    free = [(i, r) for i, r in enumerate(rules) if not trigram_query(r.pattern)]
    body, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast(_SPANS)
    rows = df.select(F.struct(*[col(c) for c in df.columns]).alias("row"), col(key).alias("key"), col(text).alias("text"))
    found = [rule_spans(body, r, i) for i, r in free]
    if asked:
        place = F.pmod(F.xxhash64("key", F.xxhash64(body), F.octet_length(body)), F.lit(BITS))
        bits = marks(candidates(build_index(_keys(df, key, text), rules), rules)).withColumnRenamed("bucket", "_bucket")
        rows = rows.withColumn("p", place).join(F.broadcast(bits), F.shiftright("p", 15) == F.col("_bucket"), "left")
        at = F.col("p") % _MAP_BITS
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        marked = F.col("bits").isNotNull() & (F.expr("shiftright(_byte, cast(p % 8 as int)) & 1") == 1)
        rows = rows.withColumn("_byte", byte).withColumn("marked", F.coalesce(marked, F.lit(False)))
        found += [F.when(F.col("marked"), rule_spans(body, r, i)).otherwise(none) for i, r in asked]
    return rows.select("row", F.array_sort(F.concat(none, *found)).alias("spans"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `df`: its key (under its name) and `spans`, by start, then rule.

    Null and empty texts have no spans.  Repeated rows each get theirs; rows
    with a null key count like others.
    """
    own = "`" + key.replace("`", "``") + "`"
    return _with_spans(df.select(col(key), col(text)), key, text, rules).select(F.col(f"row.{own}").alias(key), "spans")


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The rows of `df` with every found span replaced by `mark` (overlapping spans by one).

    Rows without a find keep their text, a null text included; repeated rows are
    redacted alike.
    """
    quoted = lambda c: F.col("row.`" + c.replace("`", "``") + "`")
    body = quoted(text)

    def step(done, s):
        gap = F.substring(body, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        fresh = s["start"] >= done["at"]
        return F.struct(F.when(fresh, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    clean = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda d: F.concat(d["out"], F.substring(body, d["at"] + 1, F.length(body))))
    told = _with_spans(df, key, text, rules)
    return told.select(*[F.when(F.size("spans") > 0, clean).otherwise(quoted(c)).alias(c) if c == text else quoted(c).alias(c) for c in df.columns])


def op2_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(read(spark, sf_dir, "documents")).select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(spans).alias("spans"))
