"""Counting written forms and voting: tokens, variants, verdicts, families, candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.runs import Runs, Spots, chunks, holds, pieces, strings, unlike
from lexiloom.sources.shared import bit_table, sized, written
from lexiloom.sources.tables import neighbours


def tokenise_runs(tokens: DataFrame, least: int = 2) -> DataFrame:
    """Runs of at least ``least`` letters that touch no digit: surface and frequency."""
    after = F.lead("gap").over(Window.partitionBy("doc_id").orderBy("idx"))
    near = tokens.withColumn("_after", after).where(~F.col("gap").rlike(r"[0-9]\z") & ~F.coalesce(F.col("_after"), F.lit("")).rlike(r"^[0-9]"))
    return near.where(F.length("surface") >= least).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(tokens: DataFrame, often: int = 3) -> DataFrame:
    """By document: running terms, distinct terms, and distinct terms seen ``often`` times (taken as intended)."""
    counts = tokens.groupBy("doc_id", "surface").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("n") >= often).alias("n_intended"))


def _forms(parts: int) -> Column:
    """The written forms in ``text``: single runs, and 2 to ``parts`` runs with one space between, at every run."""
    runs = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    several = [F.regexp_extract_all("text", F.lit(rf"(?<!\p{{L}})(?=(\p{{L}}+(?: \p{{L}}+){{{k}}}))"), F.lit(1)) for k in range(1, parts)]
    return F.concat(runs, *several)


def _counted(docs: DataFrame, low: int, high: int, parts: int, several: bool) -> DataFrame:
    """doc_id, key, form, n of each row of ``docs``, without a shuffle; ``several``: only of keys with two forms or more.

    Forms are sorted behind their keys, so like ones stand together, and where they begin gives how many they are.
    """
    key = lambda form: F.replace(form, F.lit(" "), F.lit(""))
    # Lower case has no fewer letters, so what is too long already goes first.
    short = F.transform(F.filter(_forms(parts), lambda f: F.length(f) < high + parts), F.lower)
    named = F.transform(short, lambda f: F.struct(key(f).alias("key"), f.alias("form")))
    fits = F.filter(named, lambda x: F.length(x["key"]).between(low, high))
    row = docs.select("doc_id", F.sort_array(F.transform(fits, lambda x: F.concat_ws(" ", x["key"], x["form"]))).alias("a"))
    begins = F.when(F.size("a") > 0, F.filter(F.sequence(F.lit(1), F.size("a")), lambda i: (i == 1) | (F.get("a", i - 1) != F.get("a", i - 2))))
    row = row.select("doc_id", "a", begins.alias("b"))
    ends = F.concat(F.slice("b", F.lit(2), F.size("b")), F.array(F.size("a") + 1))
    counts = F.zip_with("b", ends, lambda i, e: F.struct(F.get("a", i - 1).alias("both"), (e - i).cast("long").alias("n")))
    if several:
        row, of = row.select("doc_id", counts.alias("c")), lambda x: F.substring_index(x["both"], " ", 1)
        counts = F.filter("c", lambda x, i: F.coalesce((i > 0) & (of(x) == of(F.get("c", i - 1))), F.lit(False)) | F.coalesce(of(x) == of(F.get("c", i + 1)), F.lit(False)))
    # No filter on the arrays, and none exploded by its name: Spark would put what they are made of into the lambdas.
    each = row.select("doc_id", F.explode(counts).alias("c")).select("doc_id", F.substring_index("c.both", " ", 1).alias("key"), "c.both", "c.n")
    return each.select("doc_id", "key", F.substring("both", F.length("key") + 2, F.length("both")).alias("form"), "n")


def repeated(docs: DataFrame) -> DataFrame:
    """(id): ids of several rows of ``docs``."""
    return sized(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(F.col("doc_id").alias("id")), "repeated-ids")


def spacing_variants(docs: DataFrame, low: int = 4, high: int = 14, parts: int = 4, by_document: bool = False, several: bool = False) -> DataFrame:
    """Written forms of each key: single runs, and 2 to ``parts`` runs with one space between, by frequency.

    The key is the form without spaces, lower-cased. Over all documents, forms are made within the rows of ``docs``
    (doc_id, text), so only their counts, added up before, are shuffled. In each, they are counted there as well, and only
    those of ids with several rows are added up by a shuffle; ``several`` leaves out keys that a document writes one way.
    """
    if not by_document:
        forms = docs.select(F.explode(_forms(parts)).alias("form")).where(F.length("form") < high + parts).select(F.lower("form").alias("form")).where(F.length(F.replace("form", F.lit(" "), F.lit(""))).between(low, high))
        return forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).select(F.replace("form", F.lit(" "), F.lit("")).alias("key"), "form", "n")
    again = repeated(docs)
    if again.isEmpty():
        return _counted(docs, low, high, parts, several)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    once = _counted(docs.join(again, same, "left_anti"), low, high, parts, several)
    more = _counted(docs.join(again, same, "left_semi"), low, high, parts, False).groupBy("doc_id", "key", "form").agg(F.sum("n").alias("n"))
    if several:
        ways = more.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select(F.col("doc_id").alias("id"), F.col("key").alias("word"))
        more = more.join(ways, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("word")), "left_semi")
    return once.unionByName(more)


def _counts(docs: DataFrame, schema: str, found: Callable[[list[str]], Iterator[pa.Table]], most: int = 1 << 20) -> DataFrame:
    """The rows that ``found`` makes of some texts at a time, like ones added up (column n) over the last ``most`` of a task."""
    rename = [f.split()[0] for f in schema.split(", ")]

    def added(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by(rename[:-1]).aggregate([("n", "sum")]).rename_columns(rename)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = [], 0
        for batch in batches:
            for texts in chunks(batch.column(0).to_pylist()):
                for table in found(texts):
                    tables.append(table)
                    rows += len(table)
                if rows > most:
                    tables = [added(tables)]
                    rows = len(tables[0])
                    if rows > most // 2:
                        yield from tables[0].to_batches(1 << 16)
                        tables, rows = [], 0
        if tables:
            yield from added(tables).to_batches(1 << 16)

    return docs.select("text").mapInArrow(run, schema)


def _one_run(docs: DataFrame, low: int, high: int) -> DataFrame:
    """key, n of single runs, counted within some texts."""

    def found(texts: list[str]) -> Iterator[pa.Table]:
        runs = Runs(texts)
        words = strings(*runs.lowered()).filter(pa.array((runs.n >= low) & (runs.n <= high)))
        counts = words.value_counts()
        yield pa.table({"key": counts.field("values").cast(pa.string()), "n": counts.field("counts")})

    return _counts(docs, "key string, n long", found)


def _two_runs(docs: DataFrame, low: int, high: int, known: Broadcast) -> DataFrame:
    """key, at, n of two runs with one space between after ``at`` letters, of keys that ``known`` holds, counted within some texts."""

    def found(texts: list[str]) -> Iterator[pa.Table]:
        runs = Runs(texts)
        data, at = runs.lowered()
        size = runs.n[:-1] + runs.n[1:]
        i = np.flatnonzero(runs.pair[:-1] & (size >= low) & (size <= high))
        i = i[holds(known.value, Spots(data).of(at[i], at[i + 2]))]
        for odd in (0, 1):
            # Every other pair: these keys stand one after the other in the letters.
            mine = i[i % 2 == odd]
            keep = np.zeros(max(0, len(at[odd::2]) - 1), bool)
            keep[mine // 2] = True
            keys = strings(data, at[odd::2]).filter(pa.array(keep)).cast(pa.string()) if len(keep) else pa.array([], pa.string())
            yield pa.table({"key": keys, "at": runs.n[mine].astype(np.int64), "n": np.ones(len(mine), np.int64)})

    return _counts(docs, "key string, at long, n long", found)


def compound_forms(docs: DataFrame, low: int = 4, high: int = 14, by_document: bool = False) -> DataFrame:
    """``spacing_variants`` of one and two parts: all that a majority reads. In each document, only of keys with several forms.

    Over all documents, first single runs are counted, then pairs of runs, only those with the letters of a single run
    that occurs: a bit table of these goes to the tasks, so that pairs of unrelated words, nearly all, are neither
    shuffled nor counted. Few others pass it; keys without a single run say nothing in a majority.
    """
    if by_document:
        return spacing_variants(docs, low, high, 2, True, True)
    rest = written(spacing_variants(docs.where(unlike("text")), low, high, 2), "other-forms")
    n = F.sum("n").alias("n")
    words = _one_run(docs, low, high).unionByName(rest.where("key = form").select("key", "n"))
    words = written(words.groupBy("key").agg(n), "single-runs")
    pairs = _two_runs(docs, low, high, bit_table(words.select("key"))).unionByName(rest.where("key <> form").select("key", (F.instr("form", " ") - 1).cast("long").alias("at"), "n"))
    at = F.col("at").cast("int")
    form = F.concat(F.substring("key", F.lit(1), at), F.lit(" "), F.substring("key", at + 1, F.length("key")))
    return words.select("key", F.col("key").alias("form"), "n").unionByName(pairs.groupBy("key", "at").agg(n).select("key", form.alias("form"), "n"))


def _per(variants: DataFrame) -> list[str]:
    return ["doc_id"] if "doc_id" in variants.columns else []


def variant_verdict(variants: DataFrame, margin: int = 2) -> DataFrame:
    """For keys with several forms: winner, top and second counts, and ``clear`` or ``weak``. Ties: the smaller form.

    Only an aggregation by key (and document, if ``variants`` are by document): the two best forms are the head of a
    sorted list of a key's few forms.
    """
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "form")))
    by_key = variants.groupBy(*_per(variants), "key").agg(best.alias("f"), F.count(F.lit(1)).alias("forms"), F.sum("n").alias("total")).where("forms > 1")
    top, second = -F.col("f")[0]["m"], -F.col("f")[1]["m"]
    return by_key.select(*_per(variants), "key", F.col("f")[0]["form"].alias("winner"), top.alias("top"), second.alias("second"), F.when(top - second >= margin, "clear").otherwise("weak").alias("verdict"))


def compound_majority(variants: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Joined forms against their best two-part form: minority and majority, over all documents or in each.

    A tie goes the way of most words with the same last part that are not tied, then to the joined form if it is
    registered, else to the spaced one. Of two-part forms of a key with equal counts the greater is taken.
    """
    per = _per(variants)
    # Of forms of one key, the greater has its space further on: count and place in one number, so that groups are hashed.
    at, step = F.instr("form", " "), 1 << 24
    two = F.when((at > 0) & (F.substring_index("form", " ", 2) == F.col("form")), F.col("n") * step + at)
    both = variants.groupBy(*per, "key").agg(F.max(F.when(F.col("form") == F.col("key"), F.col("n"))).alias("n_joined"), F.max(two).alias("best")).where("n_joined is not null and best is not null")
    both = both.withColumn("head", F.substring("key", (F.col("best") % step).cast("int"), F.length("key")))
    spaced = F.concat(F.substring("key", F.lit(1), F.length("key") - F.length("head")), F.lit(" "), F.col("head"))
    both = both.select(*per, "key", "n_joined", spaced.alias("spaced"), F.shiftright("best", 24).alias("n_spaced"), "head")
    both = written(both, "compounds")
    clear, tied = both.where("n_joined <> n_spaced"), both.where("n_joined = n_spaced")
    votes = clear.groupBy(*per, "head").agg(F.sum(F.signum(F.col("n_joined") - F.col("n_spaced"))).alias("lead"))
    known = lexicon.select(F.col("word").alias("key"), F.lit(True).alias("known")).distinct()
    lead = F.coalesce("lead", F.lit(0))
    way = tied.join(votes, [*per, "head"], "left").join(known, "key", "left").withColumn("joins", F.when(lead != 0, lead > 0).otherwise(F.col("known").isNotNull()))
    columns = [*per, "key", "n_joined", "spaced", "n_spaced", "joins"]
    decided = clear.withColumn("joins", F.col("n_joined") > F.col("n_spaced")).select(columns).unionByName(way.select(columns))
    return decided.select(
        *per, F.when(F.col("joins"), F.col("spaced")).otherwise(F.col("key")).alias("minority"), F.when(F.col("joins"), F.col("key")).otherwise(F.col("spaced")).alias("majority"),
        F.least("n_joined", "n_spaced").alias("n_min"), F.greatest("n_joined", "n_spaced").alias("n_maj"),
    )


def _holding(rows: DataFrame, forms: DataFrame, low: int, high: int) -> DataFrame:
    """``rows`` (text and others) with each of ``forms`` (form) inside their text: how often (n, without overlaps), and whether it is the whole text.

    Bit tables of the forms go to the tasks, so that few other pieces of a text meet the forms in the exact join.
    """
    heads, table = bit_table(forms.select(F.substring("form", 1, low))), bit_table(forms)
    others = [f for f in rows.schema.fields if f.name != "text"]
    kind = T.StructType([*others, T.StructField("form", T.StringType()), T.StructField("n", T.LongType()), T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in chunks(batch.column("text").to_pylist()):
                whose, found = pieces(texts, heads.value, table.value, low, high)
                both = [(texts[k], p) for k, p in zip(whose.tolist(), found.to_pylist(), strict=True)]
                of = pa.array(whose + done)
                columns = [batch.column(f.name).take(of) for f in others]
                yield pa.RecordBatch.from_arrays([*columns, found, pa.array([t.count(p) for t, p in both], pa.int64()), pa.array([t == p for t, p in both], pa.bool_())], names=kind.names)
                done += len(texts)

    return rows.select(*(f.name for f in others), "text").mapInArrow(run, kind).join(forms, "form", "left_semi")


def covered_forms(forms: DataFrame, corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``forms`` (form, lower-cased) that other corrections already take at every place of ``docs``: (form).

    A document's corrections (doc_id, original, source) take all places of a form if it is the original of one, or if
    the originals of those not by ``ai_polish`` have it, all together, as often as the text; places without overlaps,
    in any case of letters. A form is covered if this holds for each document that has it, inside words too; rows of one id, or of
    none, are one document.

    First the forms inside originals are found. Of these, those that more documents have than have such an original go, by
    counts that tasks add up; the texts are asked again for the few others only.
    """
    forms = sized(forms.select("form").where("form <> ''").distinct(), "card-forms")
    low, high = forms.agg(F.min(F.length("form")), F.max(F.length("form"))).first()
    if low is None:
        return forms
    own = corrections.where("original <> ''").select("doc_id", F.lower("original").alias("text"), F.coalesce(F.col("source") != "ai_polish", F.lit(True)).alias("counts"))
    held = _holding(own, forms, low, high).groupBy("doc_id", "form").agg(F.sum(F.when(F.col("counts"), F.col("n")).otherwise(0)).alias("n_own"), F.bool_or("whole").alias("same")).where("same or n_own > 0")
    held = written(held, "held-forms")
    asked = sized(held.groupBy("form").agg(F.count(F.lit(1)).alias("documents")), "asked-forms")
    texts = docs.select("doc_id", F.lower("text").alias("text"))
    heads, table = bit_table(asked.select(F.substring("form", 1, low))), bit_table(asked.select("form"))

    def found(part: list[str]) -> Iterator[pa.Table]:
        form = pieces(part, heads.value, table.value, low, high)[1]
        yield pa.table({"form": form, "n": np.ones(len(form), np.int64)})

    again, same = repeated(docs), F.col("doc_id").eqNullSafe(F.col("id"))
    if again.isEmpty():
        there = _counts(texts, "form string, n long", found)
    else:
        more = _holding(texts.join(again, same, "left_semi"), asked.select("form"), low, high).select("doc_id", "form").distinct()
        there = _counts(texts.join(again, same, "left_anti"), "form string, n long", found).unionByName(more.select("form", F.lit(1).cast("long").alias("n")))
    few = there.groupBy("form").agg(F.sum("n").alias("n")).join(asked, "form").where("n <= documents").select("form")
    few = sized(few, "likely-covered")
    there = _holding(texts, few, low, high).groupBy("doc_id", "form").agg(F.sum("n").alias("n"))
    held = held.join(few, "form", "left_semi").select(F.col("doc_id").alias("id"), F.col("form").alias("held"), "n_own", "same")
    there = there.join(held, (F.col("form") == F.col("held")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return there.groupBy("form").agg(F.bool_and(F.coalesce(F.col("same") | (F.col("n_own") >= F.col("n")), F.lit(False))).alias("all")).where("all").select("form")


def uncovered(proposals: DataFrame, corrections: DataFrame, docs: DataFrame) -> DataFrame:
    """``proposals`` without those whose minority form other corrections already take everywhere (``covered_forms``)."""
    covered = sized(covered_forms(proposals.select(F.col("minority").alias("form")), corrections, docs), "covered-forms")
    return proposals.join(covered, F.col("minority") == F.col("form"), "left_anti")


def compound_cards(proposals: DataFrame) -> DataFrame:
    """Proposals as corrections: low confidence when tied, or within one of each other with two or more of the lesser."""
    low = (F.col("n_min") == F.col("n_maj")) | ((F.col("n_maj") - F.col("n_min") <= 1) & (F.col("n_min") >= 2))
    spaced = F.when(F.col("minority").contains(" "), F.col("minority")).otherwise(F.col("majority"))
    joined_wins = ~F.col("majority").contains(" ")
    return proposals.select(
        F.col("minority").alias("original"), F.col("majority").alias("corrected"), F.when(low, "low").otherwise("high").alias("confidence"),
        F.substring_index(spaced, " ", -1).alias("head"), F.substring_index(spaced, " ", 1).alias("lead"),
        F.when(joined_wins, F.col("n_maj")).otherwise(F.col("n_min")).alias("n_joined"), F.when(joined_wins, F.col("n_min")).otherwise(F.col("n_maj")).alias("n_spaced"),
    )


def family_analysis(cards: DataFrame) -> DataFrame:
    """Words grouped by their last part (tail) and first part (lead): families of two or more with their majority."""
    each = cards.select(F.explode(F.array(F.struct(F.lit("tail").alias("axis"), F.col("head").alias("part")), F.struct(F.lit("lead").alias("axis"), F.col("lead").alias("part")))).alias("f"), "n_joined", "n_spaced", "confidence")
    spaced = F.col("n_spaced") > F.col("n_joined")
    grouped = each.groupBy("f.axis", "f.part").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(spaced).alias("to_spaced"), F.count_if(~spaced).alias("to_joined"),
        F.sum("n_joined").alias("n_joined"), F.sum("n_spaced").alias("n_spaced"), F.bool_or(F.col("confidence") == "high").alias("strong"),
    )
    split = (F.col("to_spaced") > 0) & (F.col("to_joined") > 0)
    proposal = F.when(F.col("to_spaced") > F.col("to_joined"), "spaced").when(F.col("to_spaced") < F.col("to_joined"), "joined").when(F.col("n_spaced") > F.col("n_joined"), "spaced").otherwise("joined")
    return grouped.where("members >= 2").select("axis", "part", "members", "to_spaced", "to_joined", split.alias("split"), proposal.alias("proposal"), "strong")


def contested_words(cards: DataFrame, families: DataFrame) -> DataFrame:
    """Words that their two families ask to be written in different ways."""
    f = families.select("axis", "part", "proposal")
    each = cards.select("original", F.explode(F.array(F.struct(F.lit("tail").alias("axis"), F.col("head").alias("part")), F.struct(F.lit("lead").alias("axis"), F.col("lead").alias("part")))).alias("k")).select("original", "k.axis", "k.part")
    asked = each.join(f, ["axis", "part"]).groupBy("original").agg(F.countDistinct("proposal").alias("n"), F.array_join(F.sort_array(F.collect_set("proposal")), ",").alias("asked"))
    return asked.where("n > 1").select("original", "asked")


def junction_recover(verdicts: DataFrame, variants: DataFrame) -> DataFrame:
    """Minority forms of keys whose verdict is clear and whose winner is spaced, each with the winner."""
    clear = verdicts.where((F.col("verdict") == "clear") & F.col("winner").contains(" "))
    return variants.join(clear, "key").where("form <> winner").select(F.col("form").alias("original"), F.col("winner").alias("corrected"), F.col("n").alias("n_original"), "top")


def realword_candidates(tokens: DataFrame, common: int = 5, least: int = 4) -> DataFrame:
    """Words seen once, and common words of the same length that differ in one letter.

    Words meet on keys with one letter masked: an equi-join, and no pair of unrelated words is formed.
    """
    return _one_letter_apart(tokens.groupBy(F.lower("surface").alias("word")).agg(F.count(F.lit(1)).alias("n")), common, least)


def _one_letter_apart(counts: DataFrame, common: int, least: int) -> DataFrame:
    counts = counts.where(F.length("word") >= least).where((F.col("n") == 1) | (F.col("n") >= common))
    masks = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("*"), F.substring("word", i + 1, F.length("word"))))
    keyed = counts.select("word", "n", F.explode(masks).alias("mask"))
    rare, often = keyed.where("n = 1").select(F.col("word").alias("rare"), "mask"), keyed.where(F.col("n") >= common).select(F.col("word").alias("common"), F.col("n").alias("n_common"), "mask")
    return rare.join(often, "mask").select("rare", "common", "n_common").distinct()


def topk_per_word(candidates: DataFrame, k: int = 2, cap: int = 60) -> DataFrame:
    """The ``k`` most frequent candidates of each word, and of those the ``cap`` best: a top-k report."""
    rank = F.row_number().over(Window.partitionBy("rare").orderBy(F.desc("n_common"), "common"))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= k).orderBy(F.desc("n_common"), "rare", "common").limit(cap)


def realword_scored(docs: DataFrame, least_gap: float = 12.0, alpha: float = 0.01, common: int = 5, least: int = 4) -> DataFrame:
    """Candidates whose common word fits the rare word's place better by ``least_gap``: rare, common, n_common, gap.

    The fit of a word between two neighbours is a smoothed bigram log-likelihood over the corpus, the rare word's own
    place left out: its counts are then 0. A neighbour that is missing counts as fitting both alike. Neighbours come from
    the rows of ``docs``; only places of rare words and pairs with a candidate's common word go on.
    """
    near = neighbours(docs, 1, 1).select(F.col("s0").alias("word"), F.col("b1").alias("left"), F.col("s1").alias("right"))
    counts = written(near.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    found = written(_one_letter_apart(counts, common, least), "candidates")
    rare, often = (sized(found.select(F.col(c).alias("word")).distinct(), f"{c}-words") for c in ("rare", "common"))
    places = near.join(rare, "word", "left_semi").select(F.col("word").alias("rare"), "left", "right")
    # Only pairs with a common word of some candidate are counted.
    beside = near.join(often, "word", "left_semi")
    pairs = beside.where("left is not null").groupBy("left", "word").agg(F.count(F.lit(1)).alias("n"))
    pairs_on = beside.where("right is not null").groupBy("word", "right").agg(F.count(F.lit(1)).alias("n"))
    before = pairs.select("left", F.col("word").alias("common"), F.col("n").alias("n_left"))
    after = pairs_on.select(F.col("word").alias("common"), "right", F.col("n").alias("n_right"))
    both = found.join(places, "rare").join(before, ["left", "common"], "left").join(after, ["common", "right"], "left")
    both = both.crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("n_words"))))
    seen = lambda name: F.coalesce(name, F.lit(0)) + F.lit(alpha)
    rest = alpha * F.col("n_words")
    left = F.when(F.col("left").isNotNull(), F.log(seen("n_left") / alpha)).otherwise(0.0)
    right = F.when(F.col("right").isNotNull(), F.log(seen("n_right") / (F.col("n_common") + rest)) - F.log(F.lit(alpha) / rest)).otherwise(0.0)
    return both.select("rare", "common", "n_common", F.round(left + right, 4).alias("gap")).where(F.col("gap") >= least_gap)


def topk_by_gap(scored: DataFrame, k: int = 2, cap: int = 60) -> DataFrame:
    """The ``k`` candidates of each word with the largest gap, and of those the ``cap`` best: a top-k report."""
    rank = F.row_number().over(Window.partitionBy("rare").orderBy(F.desc("gap"), "common"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).orderBy(F.desc("gap"), "rare", "common").limit(cap)


def _first_sentences(docs: DataFrame, low: int, high: int) -> DataFrame:
    """doc_id, word, at, sentence: the first sentence of each row that holds a word, without a shuffle."""
    sentences = F.filter(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+"), F.lit(0)), lambda s: F.length(s).between(low, high))
    row = docs.select("doc_id", sentences.alias("s"))
    words = F.flatten(F.transform("s", lambda s, i: F.transform(F.regexp_extract_all(s, F.lit(r"\p{L}+"), F.lit(0)), lambda w: F.struct(w.alias("word"), i.alias("at")))))
    row = row.select("doc_id", "s", F.sort_array(words).alias("w"))
    first = F.filter("w", lambda x, i: (i == 0) | (F.get("w", F.greatest(i - 1, F.lit(0)))["word"] != x["word"]))
    return row.select("doc_id", F.explode(F.transform(first, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), F.get("s", x["at"]).alias("sentence")))).alias("f")).select("doc_id", "f.*")


def first_context(docs: DataFrame, low: int = 6, high: int = 200) -> DataFrame:
    """The first sentence (``low`` to ``high`` characters) that holds each word of a document.

    Found within the rows of ``docs``; only ids of several rows are brought together by a shuffle.
    """
    again = repeated(docs)
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    once = docs if again.isEmpty() else docs.join(again, same, "left_anti")
    found = _first_sentences(once, low, high).drop("at")
    if once is docs:
        return found
    more = _first_sentences(docs.join(again, same, "left_semi"), low, high)
    return found.unionByName(more.groupBy("doc_id", "word").agg(F.min_by("sentence", "at").alias("sentence")))
