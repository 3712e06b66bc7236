"""Lexicon tables: cleaning, lookups, guarded pairs, publishing and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import NOTABLE_REGISTERS, base_form, normalise_text


def headword_normalise(words: DataFrame, col: str = "word") -> DataFrame:
    """NFC, no boundary marks, cut at a bracket, trimmed; blank headwords go."""
    w = F.trim(F.substring_index(F.translate(normalise_text(F.col(col)), "-^", ""), "(", 1))
    return words.withColumn(col, w).where(F.col(col) != "")


def single_token(col: str) -> Column:
    return ~F.col(col).rlike(r"\s") & (F.length(col) >= 2) & F.col(col).rlike(r"\p{L}")


def single_token_filter(pairs: DataFrame) -> DataFrame:
    """Pairs of two different single tokens."""
    return pairs.where(single_token("nonstd") & single_token("norm") & (F.col("nonstd") != F.col("norm")))


def lexicon_exact(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words with exists, and source and register of one matching row (the smallest source, then register).

    Distinct words only are looked up; the join side is reduced to a row a word before the shuffle.
    """
    first = lexicon.groupBy("word").agg(F.min(F.struct("source", "register")).alias("m"))
    return words.select("word").distinct().join(first, "word", "left").select("word", F.col("m").isNotNull().alias("exists"), F.col("m.source").alias("source"), F.col("m.register").alias("register"))


def lexicon_fallback(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Existence with ordered fallback: exact, without a two-digit homograph suffix, then the base form."""
    w = words.select("word").distinct().withColumn("base", base_form(F.col("word")))
    names = lexicon.select(F.regexp_replace("word", "[0-9]{2}$", "").alias("k"), F.col("word").rlike("[0-9]{2}$").alias("numbered")).groupBy("k").agg(F.bool_or(~F.col("numbered")).alias("plain"))
    out = w.join(names.select(F.col("k").alias("word"), "plain"), "word", "left").join(names.select(F.col("k").alias("base"), F.lit(True).alias("stem")), "base", "left")
    kind = F.when(F.length("word") < 2, "short").when(F.col("plain"), "exact").when(F.col("plain").isNotNull(), "homograph").when(F.col("stem"), "base")
    return out.select("word", kind.isNotNull().alias("exists"), F.coalesce(kind, F.lit("none")).alias("match_kind"))


def noun_headword(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Distinct words that are noun or pronoun headwords."""
    nouns = lexicon.where(F.col("pos").isin("noun", "pronoun")).select(F.regexp_replace("word", "[0-9]{2}$", "").alias("word"))
    return words.select("word").distinct().join(nouns, "word", "left_semi")


def register_filter(hits: DataFrame) -> DataFrame:
    """Hits with their register class; only rows of the open dictionary can be flagged."""
    flagged = (F.col("source") == "opendict") & F.col("register").isin(*NOTABLE_REGISTERS)
    return hits.withColumn("register_class", F.when(flagged, "notable").otherwise("plain"))


def dictionary_screen(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """By document, words that are not in the lexicon in any way, or only with a notable register, with the reason."""
    words = tokens.groupBy("doc_id", F.lower("surface").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("length(word) >= 2")
    known = lexicon_fallback(words, lexicon).join(register_filter(lexicon_exact(words, lexicon)).select("word", "register_class"), "word")
    reason = F.when(~F.col("exists"), "unknown").when(F.col("register_class") == "notable", "register")
    return words.join(known.select("word", reason.alias("reason")).where("reason is not null"), "word").select("doc_id", "word", "n", "reason")


def norm_pair_lookup(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Corrections of tokens that are a non-standard form, or whose base is one; the ending is put back."""
    words = tokens.groupBy(F.lower("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    keyed = words.withColumn("base", base_form(F.col("word"))).select("word", "n", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("word").alias("nonstd")), F.struct(F.lit(1).alias("rank"), F.col("base").alias("nonstd")))).alias("k"))
    hits = keyed.select("word", "n", "k.rank", "k.nonstd").join(pairs, "nonstd").groupBy("word", "n").agg(F.min_by(F.struct("nonstd", "norm"), F.struct("rank", "norm")).alias("h"))
    return hits.select("word", "n", F.concat("h.norm", F.expr("substring(word, length(h.nonstd) + 1)")).alias("corrected"))


def norm_map_build(senses: DataFrame) -> DataFrame:
    """(nonstd, norm) from definitions of the form "variant of X"; words with a real sense as well are left out."""
    s = senses.withColumn("norm", F.regexp_extract("definition", r"^variant of (\p{L}+)", 1))
    real = s.where("norm = ''").select("word")
    return s.where("norm <> ''").join(real, "word", "left_anti").groupBy(F.col("word").alias("nonstd")).agg(F.min_by("norm", F.struct("order", "norm")).alias("norm"))


def pair_guard(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Pairs with ok and reason: the first form must not be a standard headword, the second must be one."""
    standard = lexicon.where(~F.col("register").isin(*NOTABLE_REGISTERS)).select(F.col("word").alias("nonstd"), F.lit(True).alias("is_standard")).distinct()
    exists = lexicon.select(F.col("word").alias("norm"), F.lit(True).alias("norm_exists")).distinct()
    reason = F.when(F.col("is_standard"), "nonstd_is_standard").when(F.col("norm_exists").isNull(), "norm_missing").otherwise("ok")
    return pairs.join(standard, "nonstd", "left").join(exists, "norm", "left").select("nonstd", "norm", (reason == "ok").alias("ok"), reason.alias("reason"))


def pair_publish(guarded: DataFrame) -> DataFrame:
    """For each first form with an admitted pair: the published second form, and how many others conflict with it."""
    return guarded.where("ok").groupBy("nonstd").agg(F.min("norm").alias("norm"), (F.countDistinct("norm") - 1).alias("conflicts"))


def house_vs_standard(house: DataFrame, standard: DataFrame) -> DataFrame:
    """House pairs with the standard table's form; a house pair loses where the two differ."""
    both = house.join(standard.select("nonstd", F.col("norm").alias("standard_norm")), "nonstd", "left")
    return both.withColumn("conflict", F.coalesce(F.col("norm") != F.col("standard_norm"), F.lit(False))).withColumn("used", F.coalesce("standard_norm", "norm"))


def component_of_pair(words: DataFrame, pairs: DataFrame, low: int = 2, high: int | None = None) -> DataFrame:
    """Words that contain a pair key: all substrings meet the keys in an equi-join.

    ``high`` is the length of the longest key unless given; one aggregate finds it.
    """
    if high is None:
        high = pairs.agg(F.max(F.length("nonstd"))).first()[0] or 0
    w = words.select("word").distinct()
    starts = w.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    ends = starts.where(F.least(F.length("word") - F.col("i") + 1, F.lit(high)) >= low).select("word", "i", F.explode(F.sequence(F.lit(low), F.least(F.length("word") - F.col("i") + 1, F.lit(high)))).alias("n"))
    parts = ends.select("word", F.expr("substring(word, i, n)").alias("nonstd"))
    return parts.join(pairs.select("nonstd").distinct(), "nonstd", "left_semi").select("word").distinct()


def exception_suppress(findings: DataFrame, exceptions: DataFrame, scope: str) -> DataFrame:
    """Findings whose term is not on the exception list for ``scope`` or all."""
    return findings.join(exceptions.where(F.col("scope").isin(scope, "all")).select("term"), "term", "left_anti")


def lookup_cache(words: DataFrame, cache: DataFrame) -> DataFrame:
    """Words with what the cache knows; found is null for the misses still to fetch."""
    return words.select("word").distinct().join(cache, "word", "left")


def source_swap(lexicon: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """The lexicon with all rows of one source replaced."""
    return lexicon.where(F.col("source") != source).unionByName(new.where(F.col("source") == source))


def lexicon_gap(new: DataFrame, old: DataFrame) -> DataFrame:
    """Words of ``new`` that ``old`` does not have."""
    return new.select("word").distinct().join(old, "word", "left_anti")


def source_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows by source and register before and after."""
    count = lambda df, name: df.groupBy("source", "register").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "n_before").join(count(after, "n_after"), ["source", "register"], "full_outer")
    return both.select("source", "register", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def publish_gate(candidate: DataFrame, previous: DataFrame, least: int, kept_source: str) -> DataFrame:
    """Checks a new lexicon must pass: enough headwords, an unchanged other source, no blank headword, no lost source."""
    one = lambda df, name, value: df.agg(value.cast("long").alias("actual")).select(F.lit(name).alias("check"), "actual")
    kept = F.count_if(F.col("source") == kept_source)
    wanted = one(previous, "kept_source", kept).unionByName(one(previous, "sources", F.countDistinct("source"))).withColumnRenamed("actual", "limit")
    wanted = wanted.unionByName(previous.sparkSession.createDataFrame([("headwords", least), ("blank", 0)], "check string, limit long"))
    found = one(candidate, "headwords", F.countDistinct("word")).unionByName(one(candidate, "blank", F.count_if(F.trim("word") == ""))).unionByName(one(candidate, "kept_source", kept)).unionByName(one(candidate, "sources", F.countDistinct("source")))
    passed = F.when(F.col("check") == "headwords", F.col("actual") >= F.col("limit")).otherwise(F.col("actual") == F.col("limit"))
    return found.join(F.broadcast(wanted), "check").select("check", "actual", "limit", passed.alias("pass"))


def lexicon_status(lexicon: DataFrame) -> DataFrame:
    """Rows, words and readings by source."""
    return lexicon.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("word").alias("words"), F.count_if(F.col("register") != "").alias("with_register"))


def latest_export(versioned: DataFrame, col: str = "version") -> DataFrame:
    """Rows of the largest version only; on a table partitioned by version the other partitions are not read."""
    last = versioned.agg(F.max(col).alias(col))
    return versioned.join(F.broadcast(last), col, "left_semi")


def table_publish(rows: DataFrame, key: str, order: str, policy: str) -> DataFrame:
    """One row a key: the ``first`` or the ``last`` in ``order``. Aggregation with map-side combine, no window."""
    pick = F.min_by if policy == "first" else F.max_by
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(pick(F.struct(*others), F.col(order)).alias("r")).select(key, "r.*")


def headword_sample(lexicon: DataFrame, n: int) -> DataFrame:
    """The first ``n`` standard headwords of at least two characters."""
    return lexicon.where(~F.col("register").isin(*NOTABLE_REGISTERS) & (F.length("word") >= 2)).select("word").distinct().orderBy("word").limit(n)


def trigger_explode(cards: DataFrame) -> DataFrame:
    """Inverted index (surface, rule_id) of triggers and wrong examples that are single tokens."""
    each = cards.select("rule_id", F.explode(F.array_union("triggers", "wrong")).alias("surface")).withColumn("surface", F.trim(F.substring_index("surface", "(", 1)))
    return each.where(single_token("surface")).select("surface", "rule_id").distinct()


def rule_retrieve(tokens: DataFrame, triggers: DataFrame, rules: DataFrame, most: int = 12) -> DataFrame:
    """For each document the rules whose trigger occurs in it, by priority, then hits, then id: a top-k report."""
    words = tokens.groupBy("doc_id", F.lower("surface").alias("surface")).agg(F.count(F.lit(1)).alias("n"))
    hits = words.join(triggers, "surface").groupBy("doc_id", "rule_id").agg(F.sum("n").alias("hits")).join(rules.select("rule_id", "priority"), "rule_id")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("priority", F.desc("hits"), "rule_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "rule_id", "hits", "rank")


def no_change_gate(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """Words that must not change but which the pairs would rewrite."""
    return norm_pair_lookup(words.select(F.col("word").alias("surface")), pairs).where("corrected <> word").select("word", "corrected")
