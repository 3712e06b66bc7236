"""Readers of dictionary exports, rule cards and model responses kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon_xml(exports: DataFrame, source: str) -> DataFrame:
    """Lexicon rows of XML texts (column ``xml``, one ``<item>`` each); items with a blank word go.

    Files are read with ``spark.read.format("xml").option("rowTag", "item")``; this form takes texts.
    """
    item = F.from_xml("xml", F.lit("word string, pos string, word_type string, register string"))
    return exports.select(item.alias("i")).select(*[F.trim(F.coalesce(f"i.{c}", F.lit(""))).alias(c) for c in ("word", "pos", "word_type", "register")]).where("word <> ''").withColumn("source", F.lit(source))


def lexicon_json(exports: DataFrame) -> DataFrame:
    """Lexicon rows of JSON exports (column ``body``); a text that cannot be parsed gives none."""
    schema = "struct<channel:struct<item:array<struct<wordinfo:struct<word:string,word_type:string>,senseinfo:struct<pos:string>>>>>"
    items = exports.select(F.explode(F.from_json("body", schema)["channel"]["item"]).alias("i"))
    return items.select("i.wordinfo.word", "i.senseinfo.pos", "i.wordinfo.word_type", F.lit("").alias("register"), F.lit("opendict").alias("source")).where("word is not null")


def rules_jsonl(lines: DataFrame) -> DataFrame:
    """Rule cards of JSON lines (file, line, body): malformed ones and ones without an id go, the first of an id stays."""
    cards = lines.select("file", "line", F.from_json("body", "struct<rule_id:string,rule_text:string,triggers:array<string>>").alias("c")).where("c.rule_id is not null")
    return cards.groupBy(F.col("c.rule_id").alias("rule_id")).agg(F.min_by("c", F.struct("file", "line")).alias("c")).select("rule_id", "c.rule_text", F.array_join(F.coalesce("c.triggers", F.array().cast("array<string>")), ",").alias("triggers"))


def model_response_parse(responses: DataFrame) -> DataFrame:
    """Corrections in raw model responses: fences stripped, the array parsed, else repaired, else its whole objects.

    Objects without both texts, or with equal ones, go; confidence is high where none is given.
    """
    kind = "array<struct<original:string,corrected:string,confidence:string>>"
    body = F.regexp_replace("raw", "(?s)^.*?(\\[)", "$1")
    body = F.regexp_replace(body, "(?s)```\\s*$", "")
    repaired = F.regexp_replace(F.regexp_replace(body, r",\s*\]", "]"), r"\}\s*\{", "},{")
    whole = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0)), ","), F.lit("]"))
    each = responses.select("doc_id", F.explode(F.coalesce(F.from_json(body, kind), F.from_json(repaired, kind), F.from_json(whole, kind))).alias("c"))
    good = "c.original <> '' and c.corrected is not null and c.original <> c.corrected"
    return each.where(good).select("doc_id", "c.original", "c.corrected", F.coalesce("c.confidence", F.lit("high")).alias("confidence"))
