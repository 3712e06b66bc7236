"""Algebra of correction sets: merge, guard, confidence, occurrences, overlap, apply, errata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.text import base_form
from lexiloom.operators.matching import find_in_texts
from lexiloom.operators.propagation import overlap_resolve
from lexiloom.sources.shared import written


def correction_validity(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """Corrections with why they are rejected: blank, no-op, line break, or an original that is not in the text."""
    c = corrections.join(docs.select("doc_id", "text"), "doc_id", "left")
    reason = (
        F.when(F.trim("corrected") == "", "blank").when(F.col("original") == F.col("corrected"), "noop")
        .when(F.col("corrected").contains("\n"), "newline").when(~F.coalesce(F.contains("text", "original"), F.lit(False)), "ghost").otherwise("valid")
    )
    return c.select("doc_id", "seq", "original", reason.alias("reason"))


def merge_first_wins(lists: DataFrame, list_rank: Column) -> DataFrame:
    """One correction a document and original: that of the first list, then the first in order; no-ops are left out.

    An aggregation with map-side combine picks the first; no window over all rows is needed.
    """
    good = lists.where((F.trim("corrected") != "") & (F.col("original") != F.col("corrected")))
    first = F.min_by(F.struct("seq", "corrected", "source", "confidence"), F.struct(list_rank, F.col("seq")))
    return good.groupBy("doc_id", "original").agg(first.alias("r")).select("doc_id", "original", "r.*")


def canonical_per_base(corrections: DataFrame) -> DataFrame:
    """One correction a document and base form: high confidence first, then the first; polish rows are skipped."""
    c = corrections.where(F.col("source") != "ai_polish").withColumn("base", base_form(F.col("original"))).where(F.length("base") >= 2)
    first = F.min_by(F.struct("original", "corrected", "confidence"), F.struct(F.col("confidence") != "high", F.col("seq")))
    return c.groupBy("doc_id", "base").agg(first.alias("r")).select("doc_id", "base", "r.*")


def variant_confidence(corrections: DataFrame) -> DataFrame:
    """Within a base of two or more rows, low is raised to high if any row is high, unless its reason asks for review."""
    w = Window.partitionBy("doc_id", "base")
    c = corrections.withColumn("base", base_form(F.col("original")))
    raised = (F.count(F.lit(1)).over(w) >= 2) & F.bool_or(F.col("confidence") == "high").over(w) & ~F.col("reason").contains("context")
    return c.select("doc_id", "seq", "original", F.when(raised, "high").otherwise(F.col("confidence")).alias("confidence"))


def frequency_demote(corrections: DataFrame, docs: DataFrame, often: int = 3) -> DataFrame:
    """Dictionary corrections of a text that occurs ``often`` times in its document, substrings counted, become low."""
    c = corrections.where("source = 'dict'").join(docs.select("doc_id", "text"), "doc_id")
    n = ((F.length("text") - F.length(F.replace("text", "original", F.lit("")))) / F.length("original")).cast("long")
    return c.withColumn("n", n).select("doc_id", "seq", "original", "n", F.when(F.col("n") >= often, "low").otherwise(F.col("confidence")).alias("confidence"))


def _prefixes(c: DataFrame) -> DataFrame:
    """Rows by each proper prefix (two characters or more) of the original."""
    return c.where("length(original) > 2").select("doc_id", "original", "corrected", F.explode(F.expr("transform(sequence(2, length(original) - 1), n -> substring(original, 1, n))")).alias("prefix"))


def redundant_variant(corrections: DataFrame) -> DataFrame:
    """Corrections that a shorter one makes needless: both sides are the shorter one's plus the same ending."""
    c = corrections.where("source <> 'ai_polish'").select("doc_id", "original", "corrected").distinct()
    short = c.select("doc_id", F.col("original").alias("prefix"), F.col("corrected").alias("short_corrected"))
    both = _prefixes(c).join(short, ["doc_id", "prefix"])
    same = F.expr("substring(corrected, length(short_corrected) + 1) = substring(original, length(prefix) + 1)") & F.startswith("corrected", "short_corrected") & (F.length("corrected") > F.length("short_corrected"))
    return both.where(same).select("doc_id", "original", "corrected").distinct()


def subset_relation(corrections: DataFrame) -> DataFrame:
    """For each original, the first longer original of its document that contains it.

    Substrings of the longer one meet the shorter ones in an equi-join on document and text.
    """
    c = corrections.groupBy("doc_id", "original").agg(F.min("seq").alias("seq"))
    starts = c.select("doc_id", F.col("original").alias("longer"), "seq", F.explode(F.sequence(F.lit(1), F.length("original"))).alias("i"))
    subs = starts.select("doc_id", "longer", "seq", F.explode(F.expr("transform(sequence(i, length(longer)), j -> substring(longer, i, j - i + 1))")).alias("original"))
    met = subs.where("length(original) < length(longer)").distinct().join(c.select("doc_id", "original"), ["doc_id", "original"])
    return met.groupBy("doc_id", "original").agg(F.min_by("longer", F.struct("seq", "longer")).alias("longer"))


def reverse_correction(corrections: DataFrame) -> DataFrame:
    """The opposite of each correction, and whether the set has it already."""
    c = corrections.select("doc_id", "original", "corrected").where("original <> corrected and trim(corrected) <> ''").distinct()
    swapped = c.select("doc_id", F.col("corrected").alias("original"), F.col("original").alias("corrected"))
    return swapped.join(c.withColumn("present", F.lit(True)), ["doc_id", "original", "corrected"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def auto_accept(corrections: DataFrame) -> DataFrame:
    """Status without a reviewer: dictionary flags accepted, low confidence rejected, the rest accepted."""
    status = F.when(F.col("source") == "dict", "accepted").when(F.col("confidence") == "low", "rejected").otherwise("accepted")
    return corrections.select("doc_id", "seq", "original", status.alias("status"))


def corrections_export(corrections: DataFrame) -> DataFrame:
    """Numbered JSON records (id from 1 by document, status pending)."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    body = F.to_json(F.struct(number.alias("id"), "original", "corrected", "confidence", F.lit("pending").alias("status")))
    return corrections.select("doc_id", number.alias("id"), body.alias("record"))


def occurrence_index(corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """All non-overlapping occurrences of each original: pos (from 0), end, occ (from 0), total; one null row if none.

    All originals of a document are found in one pass over its text. Originals may hold any characters; null and empty
    ones occur nowhere.
    """
    c = corrections.groupBy("doc_id", "original").agg(F.min("seq").alias("seq"), F.min("status").alias("status"))
    found = find_in_texts(docs, c).select("doc_id", "seq", "original", "status", F.size("starts").cast("int").alias("total"), F.posexplode_outer("starts").alias("occ", "start"))
    pos = F.col("start").cast("long")
    return found.select("doc_id", "seq", "original", "status", "occ", pos.alias("pos"), (pos + F.length("original")).alias("end"), "total")


def interval_containment(occurrences: DataFrame, block: int = 64) -> DataFrame:
    """Occurrences that lie inside a longer one of their document, with the outermost (longest, then first).

    Both sides are put into position blocks, so only spans near one another are compared.
    """
    o = occurrences.where("pos is not null").select("doc_id", "pos", "end")
    spread = o.distinct().select("doc_id", F.col("pos").alias("o_pos"), F.col("end").alias("o_end"), F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(F.col("end") / block))).alias("block"))
    met = o.distinct().withColumn("block", F.floor(F.col("pos") / block)).join(spread, ["doc_id", "block"]).where("o_pos <= pos and end <= o_end and o_end - o_pos > end - pos")
    return met.groupBy("doc_id", "pos", "end").agg(F.max_by(F.struct("o_pos", "o_end"), F.struct(F.col("o_end") - F.col("o_pos"), -F.col("o_pos"))).alias("o")).select("doc_id", "pos", "end", "o.o_pos", "o.o_end")


def occurrence_skip(occurrences: DataFrame) -> DataFrame:
    """By correction: indices of occurrences to skip (not accepted), visible count, and whether any is accepted."""
    o = occurrences.where("pos is not null")
    skip = F.array_sort(F.collect_list(F.when(F.col("status") != "accepted", F.col("occ"))))
    return o.groupBy("doc_id", "original").agg(skip.alias("skip"), F.count(F.lit(1)).alias("visible"), F.bool_or(F.col("status") == "accepted").alias("any_accepted"))


def review_summary(corrections: DataFrame) -> DataFrame:
    """Totals by category, and of all, with accepted, rejected and pending."""
    return corrections.rollup("category").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(~F.col("status").isin("accepted", "rejected")).alias("pending"),
    )


def split_decisions(occurrences: DataFrame) -> DataFrame:
    """Corrections decided both ways, with both counts."""
    both = occurrences.groupBy("doc_id", "original").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return both.where("accepted > 0 and rejected > 0")


def _live(corrections: DataFrame) -> DataFrame:
    """The accepted corrections that change something, one a document and original: the first."""
    good = corrections.where("status = 'accepted' and trim(corrected) <> '' and original <> corrected and not contains(corrected, '\n')")
    return good.groupBy("doc_id", "original").agg(F.min("seq").alias("seq"), F.min_by("corrected", "seq").alias("corrected"), F.lit("accepted").alias("status"))


def live_spans(docs: DataFrame, corrections: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Where live corrections stand: doc_id, original, corrected, pos, end, shadowed (by a longer one, then an earlier one).

    Occurrences in ``rejected`` (doc_id, original, occ) are left out first, so they shadow nothing.
    """
    live = _live(corrections)
    places = occurrence_index(live, docs).where("pos is not null")
    if rejected is not None:
        places = places.join(rejected.select("doc_id", "original", "occ").distinct(), ["doc_id", "original", "occ"], "left_anti")
    places = places.select("doc_id", "original", "pos", "end")
    return places.join(overlap_resolve(places), ["doc_id", "pos", "end"]).join(live.select("doc_id", "original", "corrected"), ["doc_id", "original"])


def apply_to_corpus(docs: DataFrame, corrections: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Texts with all accepted corrections applied where they stand in the text as it was, substrings too.

    Single occurrences in ``rejected`` (doc_id, original, occ) stay as they are. Of overlapping places the longest, then the first, is taken. A text is cut at its places and put together again,
    so nothing that one correction writes is changed by another. Texts without a correction stay; null stays null.
    """
    spans = live_spans(docs, corrections, rejected).where("not shadowed").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "end", "corrected"))).alias("spans"))
    before = "cast(coalesce(get(spans, i - 1).end, 0) as int)"
    pieces = f"array_join(transform(spans, (x, i) -> concat(substring(text, {before} + 1, cast(x.pos as int) - {before}), x.corrected)), '')"
    text = F.expr(f"concat({pieces}, substring(text, cast(get(spans, size(spans) - 1).end as int) + 1))")
    return docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", F.coalesce(text, "text").alias("text"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_edits"))


def apply_detail(docs: DataFrame, corrections: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """By document and original: how often it was replaced, how often a longer one was there, and the outcome."""
    each = live_spans(docs, corrections, rejected).groupBy("doc_id", "original").agg(F.count_if(~F.col("shadowed")).alias("replaced"), F.count_if("shadowed").alias("shadowed"))
    live = _live(corrections).select("doc_id", "original", F.lit(True).alias("live"))
    asked = corrections.groupBy("doc_id", "original").agg(F.bool_or(F.col("status") == "accepted").alias("accepted"))
    both = asked.join(live, ["doc_id", "original"], "left").join(each, ["doc_id", "original"], "left")
    outcome = F.when(~F.col("accepted"), "not_accepted").when(F.col("live").isNull(), "void").when(F.col("replaced").isNull(), "not_found").when(F.col("replaced") == 0, "consumed").when(F.col("shadowed") > 0, "partial").otherwise("applied")
    return both.select("doc_id", "original", F.coalesce("replaced", F.lit(0)).alias("replaced"), F.coalesce("shadowed", F.lit(0)).alias("shadowed"), outcome.alias("outcome"))


def _outer_values(docs: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of live corrections with what each writes after its inner ones, and the inner places with their outermost.

    The inner corrections are applied in order of place, each to its first occurrence in the text written so far; one
    that does not occur there changes nothing. Both are read several times, so the places and the inner ones are written:
    the texts are searched once.
    """
    live = _live(corrections)
    places = occurrence_index(live, docs).where("pos is not null").select("doc_id", "original", "pos", "end").join(live.select("doc_id", "original", "corrected"), ["doc_id", "original"])
    places = written(places, "live-places")
    inner = written(interval_containment(places).join(places, ["doc_id", "pos", "end"]), "inner-places")
    inside = inner.groupBy("doc_id", F.col("o_pos").alias("pos"), F.col("o_end").alias("end")).agg(F.sort_array(F.collect_list(F.struct("pos", "end", "original", "corrected"))).alias("inside"))
    fold = "aggregate(inside, corrected, (t, x) -> if(locate(x.original, t) > 0, concat(left(t, locate(x.original, t) - 1), x.corrected, substring(t, locate(x.original, t) + length(x.original))), t))"
    return places.join(inside, ["doc_id", "pos", "end"], "left").withColumn("value", F.coalesce(F.expr(fold), "corrected")), inner


def _composed(outer: DataFrame) -> DataFrame:
    n = F.sum(F.coalesce(F.size("inside"), F.lit(0))).alias("absorbed")
    values = outer.groupBy("doc_id", "original", "corrected").agg(F.min("value").alias("composed"), F.max("value").alias("other"), n)
    return values.where("composed = other and composed <> corrected").drop("other")


def overlap_compose(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """Live corrections that others lie in: what they write with those applied, and how many places they absorb.

    Used only if all places of a correction come to the same text, and one that differs from its own. The widest
    correction around a place, then the first, absorbs it. Null texts and originals have no place.
    """
    return _composed(_outer_values(docs, corrections)[0])


def overlap_absorbed(docs: DataFrame, corrections: DataFrame) -> DataFrame:
    """The inner places that composed corrections absorb: doc_id, original, pos, absorbed_by."""
    outer, inner = _outer_values(docs, corrections)
    used = outer.select("doc_id", F.col("original").alias("absorbed_by"), F.col("pos").alias("o_pos"), F.col("end").alias("o_end"))
    whole = _composed(outer).select("doc_id", F.col("original").alias("absorbed_by"))
    return inner.join(used, ["doc_id", "o_pos", "o_end"]).join(whole, ["doc_id", "absorbed_by"], "left_semi").select("doc_id", "original", "pos", "absorbed_by")


def dictionary_revalidate(corrections: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Confidence low where a correction brings in a word that is not in the lexicon."""
    words = lambda col: F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), F.lit(0))
    new = corrections.select("doc_id", "seq", F.explode(F.array_except(words("corrected"), words("original"))).alias("word"))
    bad = new.join(lexicon.select("word"), "word", "left_anti").select("doc_id", "seq", F.lit(True).alias("bad")).distinct()
    return corrections.join(bad, ["doc_id", "seq"], "left").select("doc_id", "seq", "original", F.when(F.col("bad"), "low").otherwise(F.col("confidence")).alias("confidence"))


def glossary_terms(corrections: DataFrame, most: int = 50) -> DataFrame:
    """Distinct base pairs of high-confidence corrections by document, the first ``most`` in order."""
    c = corrections.where("confidence = 'high'").select("doc_id", "seq", base_form(F.col("original")).alias("original_base"), base_form(F.col("corrected")).alias("corrected_base"))
    single = lambda col: F.col(col).rlike(r"^[\p{L}0-9]{2,20}\z")
    pairs = c.where(single("original_base") & single("corrected_base") & (F.col("original_base") != F.col("corrected_base"))).groupBy("doc_id", "original_base", "corrected_base").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "original_base", "corrected_base", "rank")


def demote_by_reason(corrections: DataFrame) -> DataFrame:
    """Low confidence, and why, where the reason is hedged, or appeals to convention or context."""
    r = F.lower("reason")
    why = F.when(r.rlike("likely|perhaps|may be"), "hedged").when(r.contains("convention"), "convention").when(r.contains("context"), "context")
    return corrections.select("doc_id", "seq", why.alias("why"), F.when(why.isNotNull(), "low").otherwise(F.col("confidence")).alias("confidence"))


# -- guards: one ordered chain ----------------------------------------------------------------


# Korean digits and units, surnames of person names.
DIGITS, SMALL_UNITS, LARGE_UNITS = ("", "일", "이", "삼", "사", "오", "육", "칠", "팔", "구"), ("", "십", "백", "천"), ("", "만", "억", "조")
SURNAMES = ("김", "이", "박", "최", "정", "강", "조", "윤", "장", "임")


def _strip(col: str, pattern: str) -> Column:
    return F.regexp_replace(col, pattern, "")


def _spaces(col: str) -> Column:
    """After how many letters, spaces left out, each space stands."""
    return F.expr(f"transform(sequence(1, size(split({col}, ' '))), i -> length(array_join(slice(split({col}, ' '), 1, i), '')))")


def number_reading(digits: str) -> Column:
    """The Korean reading of a run of up to 16 digits: a digit and its unit at each place, and a large unit every four places."""
    array = lambda values: "array(" + ", ".join(f"'{v}'" for v in values) + ")"
    digit, place = f"cast(substring({digits}, i, 1) as int)", f"(length({digits}) - i)"
    four = f"cast(cast({digits} as bigint) / pow(10, 4 * ({place} div 4)) as bigint) % 10000"
    small = f"if({digit} = 0, '', concat(if({digit} = 1 and {place} % 4 > 0, '', {array(DIGITS)}[{digit}]), {array(SMALL_UNITS)}[{place} % 4]))"
    large = f"if({place} % 4 = 0 and {four} > 0, {array(LARGE_UNITS)}[{place} div 4], '')"
    return F.expr(f"regexp_replace(array_join(transform(sequence(1, length({digits})), i -> concat({small}, {large})), ''), '^일만', '만')")


def guards() -> dict[str, Column]:
    """The guards in order; each is true where the correction is to be dropped. They hold for words of any script.

    ``compound_join`` asks for joined words of 4 to 14 letters, without a noun test, which needs an analyser.
    """
    o, c = F.col("original"), F.col("corrected")
    typo = F.col("source") == "ai_typo"
    count = lambda col, ch: F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))
    unbalanced = lambda col: sum((F.abs(count(col, a) - count(col, b)) for a, b in ("()", "[]", "{}")), F.lit(0))
    differ = o != c
    same_without = lambda pattern: differ & (_strip("original", pattern) == _strip("corrected", pattern))
    letters = lambda col: F.array_sort(F.split(_strip(col, r"\s"), ""))
    middot = lambda marks: o.rlike(f"[{marks}]") & differ & (F.regexp_replace(_strip("original", r"\s"), f"[{marks}]", "·") == _strip("corrected", r"\s"))
    clause = lambda col: F.regexp_replace(col, "([0-9]),([0-9])", "$1$2")
    commas = lambda col: F.length(clause(col)) - F.length(F.replace(clause(col), F.lit(","), F.lit("")))
    of, cf = _spaces("original"), _spaces("corrected")
    only_spaces = differ & (F.replace(o, F.lit(" "), F.lit("")) == F.replace(c, F.lit(" "), F.lit("")))
    joined = F.expr("forall(array_except(split(corrected, ' '), split(original, ' ')), x -> x rlike '^\\\\p{L}{4,14}$')")
    kernel = lambda col: _strip(col, r"[\s,.()·;:]")
    run = r"^([^0-9]*)([0-9]{1,16})([^0-9]*)$"
    part = lambda n: F.regexp_extract(o, run, n)
    reading = F.when(o.rlike(run), F.concat(part(1), number_reading(f"regexp_extract(original, '{run}', 2)"), part(3)))
    changed = F.expr("filter(zip_with(split(original, ' '), split(corrected, ' '), (a, b) -> named_struct('a', a, 'b', b)), x -> x.a <> x.b)")
    shared = "size(filter(sequence(1, greatest(1, least(length(x.a), length(x.b)))), i -> left(x.a, i) = left(x.b, i)))"
    edits = F.expr(f"transform(filter(zip_with(split(original, ' '), split(corrected, ' '), (a, b) -> named_struct('a', a, 'b', b)), x -> x.a <> x.b), x -> concat(substring(x.a, {shared} + 1), '>', substring(x.b, {shared} + 1), '>', if({shared} >= 2, 'y', 'n')))")
    return {
        "nonkr_trim": typo & ~o.rlike(r"[가-힣]") & F.startswith(o, c) & (F.length(c) < F.length(o)) & (F.length(c) > 0),
        "bracket_change": typo & (unbalanced("original") > 0) & (unbalanced("original") != unbalanced("corrected")),
        "english_gloss": ~o.rlike("[A-Za-z]") & differ & (_strip("corrected", r"\s*[(（][^()（）]*[A-Za-z][^()（）]*[)）]") == o),
        "bulk_delete": typo & (F.length(o) - F.length(c) >= 10),
        "number_change": o.rlike("[0-9]") & same_without("[0-9]"),
        "latin_to_hangul": o.rlike(r"^[A-Za-z ]+$") & c.rlike(r"^[가-힣 ]+$"),
        "hyphen_space": same_without("[- ]") & ((count("original", "-") > 0) | (count("corrected", "-") > 0)),
        "dash_to_middot": middot("–—-"),
        "citation_reformat": o.rlike(r"^\(?[^()0-9]+[0-9]{4}[a-z]?\)?$") & differ & (kernel("original") == kernel("corrected")),
        "colon_to_middot": middot(":："),
        "compound_split": typo & only_spaces & (F.size(cf) > F.size(of)) & (F.size(F.array_except(of, cf)) == 0),
        "compound_join": only_spaces & (F.size(cf) < F.size(of)) & (F.size(F.array_except(cf, of)) == 0) & joined,
        "comma_edit": same_without(",") & (commas("original") != commas("corrected")),
        "numeral_to_hangul": F.coalesce(reading == c, F.lit(False)),
        "latin_case": differ & (F.lower(o) == F.lower(c)),
        "grammar_rewrite": (F.size(F.split(o, " ")) == F.size(F.split(c, " "))) & (F.size(changed) >= 2) & F.forall(edits, lambda e: e.endswith("y")) & (F.size(F.array_distinct(edits)) >= 2),
        "syllable_reorder": typo & differ & (F.length(o) == F.length(c)) & (letters("original") == letters("corrected")),
        "name_join": o.rlike(f"^({'|'.join(SURNAMES)})( [가-힣]){{1,3}}$") & (F.replace(o, F.lit(" "), F.lit("")) == c),
    }


MODEL = ("ai_typo", "ai_polish")


def _first_guard() -> Column:
    hit = F.when(F.lit(False), "")
    for name, condition in guards().items():
        hit = hit.when(condition, name)
    return hit


def guard_chain(corrections: DataFrame) -> DataFrame:
    """Model corrections (typo and polish) with the first guard that hits, or null."""
    return corrections.where(F.col("source").isin(*MODEL)).select("doc_id", "seq", "original", "corrected", _first_guard().alias("guard"))


def guard_counts(corrections: DataFrame) -> DataFrame:
    """Corrections dropped by each guard, and kept ones. Like corrections are counted first, and guarded once."""
    alike = corrections.where(F.col("source").isin(*MODEL)).groupBy("original", "corrected", "source").agg(F.count(F.lit(1)).alias("n"))
    return alike.select(F.coalesce(_first_guard(), F.lit("kept")).alias("guard"), "n").groupBy("guard").agg(F.sum("n").alias("n"))


def errata_rows(corrections: DataFrame) -> DataFrame:
    """One row a correction with its outcome and the label of its kind."""
    outcome = F.when(F.col("status") == "rejected", "rejected").when(F.col("status") == "pending", "review").when(F.trim("corrected") == "", "todo").when(F.col("original") == F.col("corrected"), "failed").otherwise("applied")
    label = F.when(F.col("category") != "", F.col("category")).otherwise(F.col("source"))
    return corrections.select("doc_id", "seq", "original", "corrected", label.alias("type"), outcome.alias("outcome"))


def apply_summary(errata: DataFrame) -> DataFrame:
    """By document: how many rows of each outcome, and up to five failures."""
    n = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    samples = F.slice(F.sort_array(F.collect_list(F.when(F.col("outcome") == "failed", F.col("original")))), 1, 5)
    return errata.groupBy("doc_id").agg(n("applied"), n("failed"), n("todo"), n("rejected"), n("review"), F.array_join(samples, ",").alias("failures"))
