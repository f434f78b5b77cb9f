"""Routing of store questions: which data they need, and which camera or person they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns decide the labels, so they are given as they are.
DATA = [
    r"\b(how many|quantas?|quantos?)\b",
    r"\b(count\b|contar|contagem)\b",
    r"\b(where is|onde (est[aá]|fica|est[aã]o))\b",
    r"\b(who is|quem (est[aá]|é|s[aã]o))\b",
    r"\b(how long|h[aá] quanto tempo|faz quanto tempo|desde quando)\b",
    r"\b(occupancy|ocupa[cç][aã]o|lota[cç][aã]o)\b",
    r"\b(total|number of|n[uú]mero de)\b",
    r"\b(list\b|listar)\b",
    r"\b(currently|agora|no momento|right now)\b",
    r"\b(pessoa|person)\s+\d+\b",
    r"\b(where has|por onde (andou|passou|foi))\b",
    r"\b(journey|trajeto|percurso|caminho)\b",
]
TEMPORAL = [
    r"\b(today|hoje|this morning|esta manh[ãa])\b",
    r"\b(yesterday|ontem)\b",
    r"\b(peak|pico|rush hour|hor[aá]rio de pico|busiest)\b",
    r"\b(average|m[eé]dia|typically|normalmente|usually)\b",
    r"\b(last hour|[uú]ltima hora|last \d+ min)\b",
    r"\b(trend|tend[eê]ncia|compared|comparado)\b",
    r"\b(how many.*came|quantas?.*entr)\b",
]
VISUAL = [
    r"\b(wearing|vestindo|usando|roupa|outfit)\b",
    r"\b(doing|fazendo|comportamento|behavior)\b",
    r"\b(carrying|carregando|segurando|holding)\b",
    r"\b(describe|descreva?|como (está|parece|ficou))\b",
    r"\b(suspicious|suspeito|estranh|weird)\b",
    r"\b(interact|interagindo|conversando|talking)\b",
    r"\b(what.{0,25}(happen|going on|ocorrendo|acontecendo))\b",
    r"\b(o que (está acontecendo|acontece|está rolando))\b",
    r"\b(analyze|analisar|análise)\b",
    r"\b(look like|parece|aparência|appearance)\b",
    r"\b(show me|me mostre|me conta sobre)\b",
    r"\b(queue|fila|crowded|lotado|busy)\b",
]
TRAIL = [
    r"\b(where has|por onde (andou|passou|foi))\b",
    r"\b(journey|trajeto|percurso|caminho)\b",
    r"\b(been to|visitou|passou por)\b",
    r"\b(history|hist[oó]rico)\b",
]


#: How a camera's and a person's number are told.
CAMERA_NUMBER = r"(?U)\bcam(?:era|[aâ]ra|)[\s_-]?(\d+)\b"
PERSON_NUMBER = r"(?U)\b(?:person|pessoa|id|gid|track|individual)[\s#_\-]?(\d+)\b"


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether one of the patterns is found; words and boundaries are those of Unicode."""
    return text.rlike("(?U)" + "|".join(patterns))


def classify_questions(df: DataFrame, text: str, cameras: DataFrame) -> DataFrame:
    """Add camera_id, person_id, is_data, is_visual, is_temporal, is_trail, type and needs_vlm.

    cameras: idx (order), camera_id, names (array of name, aliases and the first
    word of the area).  A numbered camera comes before a named one; of named
    ones the first in order.  The few cameras travel as one array.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    known = cameras.agg(F.array_sort(F.collect_list(F.struct("idx", "camera_id", F.transform("names", F.lower).alias("names")))).alias("_cams"))
    d = df.crossJoin(known).withColumn("_low", low)  # one row
    hit = F.filter("_cams", lambda c: F.exists(c["names"], lambda n: (n != "") & F.contains(F.col("_low"), n)))
    number, person = F.regexp_extract("_low", CAMERA_NUMBER, 1), F.regexp_extract("_low", PERSON_NUMBER, 1)
    d = d.withColumn("camera_id", F.when(number != "", F.concat(F.lit("camera_"), number)).otherwise(F.try_element_at(hit, F.lit(1))["camera_id"]))
    d = d.withColumn("person_id", F.when(person != "", person))
    d = d.withColumn("is_data", any_of(F.col("_low"), DATA + TEMPORAL)).withColumn("is_visual", any_of(F.col("_low"), VISUAL)).withColumn("is_temporal", any_of(F.col("_low"), TEMPORAL))
    d = d.withColumn("is_trail", F.col("person_id").isNotNull() & any_of(F.col("_low"), TRAIL))
    kind = F.when(F.col("is_trail"), "trail").when(F.col("is_temporal"), "historical").when(F.col("person_id").isNotNull(), "person").when(F.col("camera_id").isNotNull(), "scene").otherwise("store")
    return d.withColumn("type", kind).withColumn("needs_vlm", F.col("is_visual") | ~F.col("is_data")).drop("_cams", "_low")
