"""Checks of single corrections against a lexicon, a document or tags, and survivors after applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import KO_PARTICLES, base_form
from lexiloom.operators.corrections import apply_to_corpus

# Surnames of two-to-four-syllable person names.
SURNAMES = ("김", "이", "박", "최", "정", "강", "조", "윤", "장", "임")


def _words(col: str):
    return F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), F.lit(0))


def occurrence_survivors(occurrences: DataFrame, containment: DataFrame) -> DataFrame:
    """Occurrences left when those inside an accepted longer one vanish, numbered anew from 0."""
    o = occurrences.where("pos is not null")
    taken = containment.join(o.where("status = 'accepted'").select("doc_id", F.col("pos").alias("o_pos"), F.col("end").alias("o_end")).distinct(), ["doc_id", "o_pos", "o_end"], "left_semi")
    left = o.join(taken.select("doc_id", "pos", "end"), ["doc_id", "pos", "end"], "left_anti")
    number = F.row_number().over(Window.partitionBy("doc_id", "original").orderBy("pos")) - 1
    return left.select("doc_id", "original", "pos", number.alias("occ"))


def duplicate_particle(docs: DataFrame) -> DataFrame:
    """A comitative particle standing alone after a word that already ends in one."""
    words = docs.select("doc_id", F.posexplode(F.split("text", "[ \n]")).alias("i", "w"))
    x = words.withColumn("before", F.lag("w").over(Window.partitionBy("doc_id").orderBy("i")))
    return x.where(F.col("w").isin("와", "과") & F.col("before").rlike("[와과]$")).select("doc_id", F.concat_ws(" ", "before", "w").alias("original"), F.col("before").alias("corrected"))


def paren_attach(docs: DataFrame) -> DataFrame:
    """A sentence-final word and an opening bracket after one space are attached, unless the content is a number."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\S*다 \([^)]*\)"), F.lit(0))).alias("original"))
    return found.where(~F.col("original").rlike(r"\([0-9]+\)$")).select("doc_id", "original", F.replace("original", F.lit("다 ("), F.lit("다(")).alias("corrected"))


def likely_typo(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unlisted Hangul words that are not shaped like a person name (surname and two to four syllables)."""
    name = F.length("word").between(2, 4) & F.left("word", F.lit(1)).isin(*SURNAMES)
    return words.select("word").distinct().where(F.col("word").rlike("^[가-힣]+$") & ~name).join(lexicon.select("word"), "word", "left_anti")


def drop_false_consistency(corrections: DataFrame, tokens: DataFrame) -> DataFrame:
    """Spacing corrections whose first two spaced words never stand next to each other in the document."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    pairs = tokens.withColumn("next", F.lead("surface").over(w)).withColumn("gap2", F.lead("gap").over(w)).where("gap2 = ' '").select("doc_id", F.lower(F.concat_ws(" ", "surface", "next")).alias("bigram")).distinct()
    c = corrections.where("category = 'spacing'").withColumn("bigram", F.lower(F.array_join(F.slice(F.split("corrected", " "), 1, 2), " "))).where("contains(bigram, ' ')")
    return c.join(pairs, ["doc_id", "bigram"], "left_anti").select("doc_id", "seq", "original", "corrected")


def demote_term_swap(pairs: DataFrame, lexicon: DataFrame, far: int = 2) -> DataFrame:
    """Pairs of two registered terms that share an affix of two characters and differ in ``far`` letters or more."""
    known = lexicon.select("word")
    p = pairs.select("original", "corrected").distinct().where("original <> corrected")
    both = p.join(known.select(F.col("word").alias("original")), "original", "left_semi").join(known.select(F.col("word").alias("corrected")), "corrected", "left_semi")
    affix = (F.left("original", F.lit(2)) == F.left("corrected", F.lit(2))) | (F.right("original", F.lit(2)) == F.right("corrected", F.lit(2)))
    return both.where(affix & (F.levenshtein("original", "corrected") >= far)).select("original", "corrected")


def drop_loan_paraphrase(pairs: DataFrame, lexicon: DataFrame, far: int = 3) -> DataFrame:
    """Pairs whose second word is registered, shares no two-letter piece with the first, and is ``far`` edits away."""
    grams = lambda col: F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1))), lambda i: F.substring(col, i, F.lit(2)))
    p = pairs.select("original", "corrected").distinct().join(lexicon.select(F.col("word").alias("corrected")), "corrected", "left_semi")
    return p.where(~F.arrays_overlap(grams("original"), grams("corrected")) & (F.levenshtein("original", "corrected") >= far)).select("original", "corrected")


def demote_boundary(corrections: DataFrame) -> DataFrame:
    """Low confidence where the sentence mark at the end changes."""
    mark = lambda col: F.regexp_extract(col, r"([.?!,]*)\s*\z", 1)
    changed = mark("original") != mark("corrected")
    return corrections.select("doc_id", "seq", changed.alias("changed"), F.when(changed, "low").otherwise(F.col("confidence")).alias("confidence"))


def demote_deletion(corrections: DataFrame) -> DataFrame:
    """Low confidence where words are only deleted: all words left are words of the original, and there are fewer."""
    o, c = _words("original"), _words("corrected")
    deleted = (F.size(c) < F.size(o)) & (F.size(F.array_except(c, o)) == 0)
    return corrections.select("doc_id", "seq", deleted.alias("deleted"), F.when(deleted, "low").otherwise(F.col("confidence")).alias("confidence"))


def demote_grammar(corrections: DataFrame) -> DataFrame:
    """Low confidence where the number of words changes and more than spaces differ."""
    squeeze = lambda col: F.regexp_replace(col, r"\s", "")
    hit = (F.size(_words("original")) != F.size(_words("corrected"))) & (squeeze("original") != squeeze("corrected"))
    return corrections.select("doc_id", "seq", hit.alias("hit"), F.when(hit, "low").otherwise(F.col("confidence")).alias("confidence"))


def _fixes(corrections: DataFrame) -> DataFrame:
    """Spacing and punctuation corrections with ``fixes``, those spelling fixes of their document that stand in the original."""
    fix = corrections.where("category = 'spelling' and confidence = 'high' and trim(corrected) <> '' and original <> '' and original <> corrected and not contains(corrected, '\n')").groupBy("doc_id", "original").agg(F.min("seq").alias("seq"), F.min_by("corrected", "seq").alias("corrected"))
    by = fix.groupBy("doc_id").agg(F.collect_list(F.struct("original", "corrected", "seq")).alias("fixes"))
    base = corrections.where("category in ('spacing', 'punctuation')").select("doc_id", "seq", "original", "corrected").join(by, "doc_id")
    return base.withColumn("fixes", F.filter("fixes", lambda f: F.coalesce(F.contains(F.col("original"), f["original"]), F.lit(False))))


def compose_spelling(corrections: DataFrame) -> DataFrame:
    """Spacing and punctuation corrections with the document's high-confidence spelling fixes: doc_id, seq, original, corrected.

    A fix counts if it stands in the original. In the corrected form each word is looked up once, as it stands or as
    its base form or without a particle, which it keeps; so no fix changes a part of another word, or what another wrote. Of
    fixes of one word the first is taken. Documents without fixes have no rows; null and empty words fix nothing.
    """
    base = _fixes(corrections)
    runs, gaps = F.regexp_extract_all("corrected", F.lit(r"\p{L}+"), F.lit(0)), F.split("corrected", r"\p{L}+", -1)
    known = F.map_from_entries(F.transform("fixes", lambda f: F.struct(f["original"], f["corrected"])))

    def word(run: Column) -> Column:
        stems = [run, base_form(run), base_form(run, KO_PARTICLES, 1)]
        return F.coalesce(*[F.concat(F.try_element_at(known, s), F.substring(run, F.length(s) + 1, F.length(run))) for s in stems], run)

    text = F.array_join(F.zip_with(gaps, F.transform(runs, word), lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")
    return base.select("doc_id", "seq", "original", F.when(F.size("fixes") > 0, text).otherwise(F.col("corrected")).alias("corrected"))


def compose_inside(corrections: DataFrame) -> DataFrame:
    """The same with fixes put in inside longer words too, as compounds need.

    A fix that stands in the original is put in wherever it stands in the corrected form as that was, the longest first where fixes overlap, so nothing that one fix writes is changed by another. Of fixes of one word the
    first is taken. Documents without fixes have no rows; null and empty words fix nothing.
    """
    base = _fixes(corrections).withColumn("_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.col("seq").cast("string"), F.lit("")), "original", "corrected"))
    texts = base.where(F.size("fixes") > 0).select(F.col("_id").alias("doc_id"), F.col("corrected").alias("text"), "fixes").dropDuplicates(["doc_id"])
    inner = texts.select("doc_id", F.explode("fixes").alias("f")).select("doc_id", "f.*", F.lit("accepted").alias("status"))
    done = apply_to_corpus(texts.select("doc_id", "text"), inner).select(F.col("doc_id").alias("_id"), "text")
    return base.join(done, "_id", "left").select("doc_id", "seq", "original", F.coalesce("text", "corrected").alias("corrected"))
