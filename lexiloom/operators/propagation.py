"""Passes that carry decisions to other words, and checks of corrections against the rest of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import base_form


def scope_normalise(exceptions: DataFrame) -> DataFrame:
    """Exceptions of two characters or more with a known scope (else ``all``), each once."""
    scope = F.when(F.col("scope").isin("spacing", "spelling", "all"), F.col("scope")).otherwise("all")
    return exceptions.where(F.length("term") >= 2).select("term", scope.alias("scope")).distinct()


def chunk_terms(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """The suspicious words that occur as words in each chunk."""
    inside = chunks.select("doc_id", "chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("word"))
    return inside.join(words.select("doc_id", "word").distinct(), ["doc_id", "word"], "left_semi")


def covered_suppress(flags: DataFrame, corrections: DataFrame) -> DataFrame:
    """Dictionary flags with whether a live correction of the document covers the word, either containing the other."""
    c = corrections.select("doc_id", F.lower("original").alias("original")).distinct()
    met = flags.join(c, "doc_id").where(F.contains("original", "word") | F.contains("word", "original")).select("doc_id", "word").distinct()
    return flags.join(met.withColumn("held", F.lit(True)), ["doc_id", "word"], "left").select("doc_id", "word", F.coalesce("held", F.lit(False)).alias("held"))


def overlap_resolve(occurrences: DataFrame) -> DataFrame:
    """Greedy choice among overlapping occurrences, the longest first, then the first; losers are shadowed.

    A sweep in order of place cuts a document's occurrences into clusters that overlap; only a cluster's few are folded.
    """
    o = occurrences.where("pos is not null").select("doc_id", "pos", "end").distinct()
    w = Window.partitionBy("doc_id").orderBy("pos", "end")
    furthest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = o.withColumn("first", (F.coalesce(furthest, F.lit(-1)) <= F.col("pos")).cast("int")).withColumn("cluster", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = o.groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(F.struct((F.col("pos") - F.col("end")).alias("n"), "pos", "end"))).alias("spans"))
    none = F.array().cast("array<struct<n:bigint,pos:bigint,end:bigint>>")
    kept = F.aggregate("spans", none, lambda a, x: F.when(F.exists(a, lambda y: (y["pos"] < x["end"]) & (x["pos"] < y["end"])), a).otherwise(F.concat(a, F.array(x))))
    each = rows.withColumn("kept", kept).select("doc_id", "kept", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.pos", "s.end", (~F.array_contains("kept", F.col("s"))).alias("shadowed"))


def apply_reclassify(errata: DataFrame, containment: DataFrame) -> DataFrame:
    """Rows that were not applied but lie in an applied longer original of the document become ``consumed``."""
    longer = containment.join(errata.where("outcome = 'applied'").select("doc_id", F.col("original").alias("longer")).distinct(), ["doc_id", "longer"], "left_semi").select("doc_id", "original").withColumn("inside", F.lit(True)).distinct()
    out = errata.join(longer, ["doc_id", "original"], "left")
    state = F.when((F.col("outcome") != "applied") & F.col("inside"), "consumed").otherwise(F.col("outcome"))
    return out.select("doc_id", "seq", "original", state.alias("outcome"))


def realword_verified(candidates: DataFrame, verdicts: DataFrame, covered: DataFrame) -> DataFrame:
    """Candidates that a verdict confirms and no correction covers; without a verdict nothing passes."""
    yes = verdicts.where("verdict = 'yes'").select("rare", "common")
    return candidates.join(yes, ["rare", "common"], "left_semi").join(covered.select(F.lower("original").alias("rare")), "rare", "left_anti")


def junction_redirect(corrections: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Space-only corrections sent to the clear winner of their key, or dropped if that is the original."""
    squeeze = lambda col: F.lower(F.replace(col, F.lit(" "), F.lit("")))
    spacing = corrections.where("category = 'spacing'").withColumn("key", squeeze(F.col("original"))).where(F.col("key") == squeeze(F.col("corrected")))
    both = spacing.join(verdicts.where("verdict = 'clear'").select("key", "winner"), "key", "left")
    action = F.when(F.col("winner").isNull(), "kept").when(F.col("winner") == F.lower("original"), "dropped").when(F.col("winner") == F.lower("corrected"), "kept").otherwise("redirected")
    return both.select("doc_id", "seq", "original", F.coalesce("winner", "corrected").alias("corrected"), action.alias("action"))


def propagate_particle(corrections: DataFrame, tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """High-confidence spelling corrections carried to document words of the same base with another ending."""
    c = corrections.where("confidence = 'high' and category = 'spelling' and trim(corrected) <> '' and original <> corrected and not contains(corrected, '\n')")
    c = c.withColumn("base", base_form(F.lower("original"))).groupBy("doc_id", "base").agg(F.min_by(F.struct("original", "corrected"), "seq").alias("c"))
    words = tokens.select("doc_id", F.lower("surface").alias("word")).distinct().withColumn("base", base_form(F.col("word")))
    met = words.join(c, ["doc_id", "base"]).where("word <> lower(c.original)").join(lexicon.select("word"), "word", "left_anti")
    return met.select("doc_id", F.col("word").alias("original"), F.concat(base_form(F.lower("c.corrected")), F.expr("substring(word, length(base) + 1)")).alias("corrected")).where("original <> corrected")


def propagate_substring(corrections: DataFrame, tokens: DataFrame, lexicon: DataFrame, high: int = 4) -> DataFrame:
    """Short corrections (two to ``high`` characters) carried to longer words of the document that start with them."""
    c = corrections.where(f"length(original) between 2 and {high} and trim(corrected) <> '' and original <> corrected and category = 'spelling' and not contains(corrected, '\n')").select("doc_id", F.lower("original").alias("part"), F.lower("corrected").alias("new")).distinct()
    words = tokens.select("doc_id", F.lower("surface").alias("word")).distinct().where(f"length(word) > {high}")
    keyed = words.select("doc_id", "word", F.explode(F.expr(f"transform(sequence(2, {high}), n -> substring(word, 1, n))")).alias("part"))
    met = keyed.join(c, ["doc_id", "part"]).join(lexicon.select("word"), "word", "left_anti")
    return met.select("doc_id", F.col("word").alias("original"), F.concat("new", F.expr("substring(word, length(part) + 1)")).alias("corrected"), F.lit("low").alias("confidence")).where("original <> corrected")


def drop_expansion(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """Corrections that only lengthen a fragment to a form that already stands in the document."""
    c = corrections.where(F.startswith("corrected", "original") & (F.length("corrected") > F.length("original")))
    return c.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "corrected")).select("doc_id", "seq", "original", "corrected")


def drop_abbrev_expansion(corrections: DataFrame, declared: DataFrame) -> DataFrame:
    """Corrections whose base the author has declared as a short form are left out."""
    c = corrections.withColumn("term", base_form(F.lower("original")))
    return c.join(declared.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti").select("doc_id", "seq", "original", "corrected")


def drop_destandardise(corrections: DataFrame, lexicon: DataFrame, near: int = 2) -> DataFrame:
    """Registered words changed into an unregistered near variant."""
    c = corrections.select("doc_id", "seq", F.lower("original").alias("o"), F.lower("corrected").alias("c")).where("o <> c and c <> ''")
    bad = c.join(lexicon.select(F.col("word").alias("o")), "o", "left_semi").join(lexicon.select(F.col("word").alias("c")), "c", "left_anti")
    return bad.where(F.levenshtein("o", "c") <= near).select("doc_id", "seq")


def compound_component(tokens: DataFrame, pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(document, pair key) that is only part of a longer registered word of the document: all substrings meet the keys."""
    words = tokens.select("doc_id", F.lower("surface").alias("word")).distinct()
    known = words.select("word").distinct().join(lexicon.select("word"), "word", "left_semi")
    subs = known.select("word", F.explode(F.expr("flatten(transform(sequence(1, length(word)), i -> transform(sequence(i, length(word)), j -> substring(word, i, j - i + 1))))")).alias("nonstd")).where("length(nonstd) >= 2 and nonstd <> word").distinct()
    inner = subs.join(pairs.select("nonstd").distinct(), "nonstd", "left_semi")
    return words.join(inner, "word").select("doc_id", "nonstd").distinct()


def rule_examples(lines: DataFrame) -> DataFrame:
    """Example words of lines "a: b": the left side wrong, the right side right, each once, wrong without right."""
    pair = lines.select("doc_id", F.regexp_extract("text", r"(\p{L}+): (\p{L}+)", 1).alias("wrong"), F.regexp_extract("text", r"(\p{L}+): (\p{L}+)", 2).alias("right")).where("wrong <> ''")
    by = pair.groupBy("doc_id").agg(F.collect_set("wrong").alias("w"), F.collect_set("right").alias("r"))
    return by.select("doc_id", F.explode(F.concat(F.transform("r", lambda x: F.struct(F.lit("right").alias("kind"), x.alias("word"))), F.transform(F.array_except("w", "r"), lambda x: F.struct(F.lit("wrong").alias("kind"), x.alias("word"))))).alias("e")).select("doc_id", "e.*")
