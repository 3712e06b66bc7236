"""Checks of corrections that put another name or word in a text instead of spelling the one that is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.runs import unlike
from lexiloom.functions.text import base_form, base_of, distance_of, letter_distance
from lexiloom.sources.shared import written

#: A word, and a bracket that opens right after it or after one space.
BRACKETED = r"\p{L}{2,}\s?\p{Ps}[^\p{Pe}]+\p{Pe}"


def _model() -> Column:
    return F.coalesce(F.col("source").isin("ai_typo", "ai_polish"), F.lit(False))


def drop_glossed_name(corrections: DataFrame, docs: DataFrame, far: int = 4) -> DataFrame:
    """Corrections without those by a model that change a word, ``far`` letters or more, which a gloss in brackets fixes.

    A gloss is a bracket with a Latin letter right after the word, anywhere in the document; the word counts as it
    stands in the correction or as its base form, in any case. A null text has no gloss.
    """
    word = F.lower("original")
    asked = corrections.where(_model() & ~F.col("original").contains(" ") & ~F.col("corrected").contains(" ") & (letter_distance(F.col("original"), F.col("corrected")) >= far))
    asked = asked.select("doc_id", "seq", F.explode(F.array_distinct(F.array(word, base_form(word)))).alias("word"))
    brackets = F.filter(F.regexp_extract_all("text", F.lit(BRACKETED), F.lit(0)), lambda x: F.regexp_extract(x, r"\p{Ps}.*", 0).rlike("[A-Za-z]"))
    fixed = docs.select("doc_id", F.explode(F.array_distinct(F.transform(brackets, lambda x: F.lower(F.regexp_extract(x, r"^\p{L}+", 0))))).alias("word"))
    bad = asked.join(fixed, ["doc_id", "word"], "left_semi").select("doc_id", "seq").distinct()
    return corrections.join(bad, ["doc_id", "seq"], "left_anti").select("doc_id", "seq", "original", "corrected")


def demote_org_name(corrections: DataFrame, endings: Sequence[str], claims: Sequence[str], far: int = 3, least: int = 4) -> DataFrame:
    """All corrections; low confidence where a model puts one name of a body for another.

    Both sides are one word, or one with the same rest from a space or opening bracket on; their base forms have
    ``least`` letters or more and differ in ``far`` or more. Then either both end in the same of ``endings`` (what
    bodies of a kind are called: ministries, courts, banks), or the reason meets all patterns of ``claims``, by which
    models say that a name is the right one. Both lists belong to a language and its texts and are left to the caller.
    """
    word = lambda col: F.regexp_extract(F.trim(col), r"^\p{L}{2,}(?=[\s\p{Ps}]|$)", 0)
    rest = lambda col: F.substring(F.trim(col), F.length(word(col)) + 1, F.length(col))
    name, other = base_form(word("original")), base_form(word("corrected"))
    kind = F.array(*[F.endswith(name, F.lit(e)) & F.endswith(other, F.lit(e)) for e in endings]) if endings else F.array(F.lit(False))
    claimed = reduce(lambda a, b: a & b, [F.col("reason").rlike(c) for c in claims], F.lit(bool(claims)))
    renamed = (rest("original") == rest("corrected")) & (F.length(name) >= least) & (F.length(other) >= least) & (letter_distance(name, other) >= far)
    low = _model() & renamed & (F.exists(kind, lambda x: x) | F.coalesce(claimed, F.lit(False)))
    return corrections.select("doc_id", "seq", "original", "corrected", F.when(low, "low").otherwise(F.col("confidence")).alias("confidence"))


def changed_words(corrections: DataFrame) -> DataFrame:
    """(doc_id, seq, o, c): words that stand at the same place of both sides, between what both begin and end with alike; a null has none."""
    both = corrections.where("original is not null and corrected is not null").select("doc_id", "seq", F.split("original", " ").alias("a"), F.split("corrected", " ").alias("b"))
    least = "least(size(a), size(b))"
    both = both.withColumn("p", F.expr(f"size(filter(sequence(1, {least}), i -> slice(a, 1, i) = slice(b, 1, i)))"))
    both = both.withColumn("q", F.expr(f"size(filter(sequence(1, {least}), i -> i <= {least} - p and slice(a, -i, i) = slice(b, -i, i)))"))
    each = F.expr(f"filter(transform(sequence(1, {least}), i -> struct(i, a[i - 1] as o, get(b, i - 1) as c)), x -> x.i > p and x.i <= {least} - q)")
    return both.select("doc_id", "seq", F.explode(each).alias("w")).select("doc_id", "seq", "w.o", "w.c")


def _edges(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """How many codes are equal from ``first_a`` and ``first_b`` on, ``size`` at most, forwards or backwards."""
    same = np.zeros(len(size), np.int64)
    on = np.flatnonzero(size > 0)
    while len(on):
        on = on[a[first_a[on] + step * same[on]] == b[first_b[on] + step * same[on]]]
        same[on] += 1
        on = on[same[on] < size[on]]
    return same


def swapped(o: str, c: str, far: int = 3) -> bool:
    """Whether one lower-cased word is quite another than the other: no part of it, no two letters shared, ``far`` letters away."""
    if not o or not c or o in c or c in o:
        return False
    grams = lambda w: {w[i : i + 2] for i in range(max(1, len(w) - 1))}
    ob, cb = base_of(o), base_of(c)
    if not grams(ob).isdisjoint(grams(cb)):
        return False
    # A letter that the other has not takes an edit each, if letters are characters.
    a, b = set(ob), set(cb)
    return ob.isascii() and cb.isascii() and (len(a - b) >= far or len(b - a) >= far) or distance_of(ob, cb) >= far


def _swaps(words: Broadcast, far: int) -> Callable:
    """Whether a correction puts one of ``words`` for quite another at some place. The last two texts are lower-cased ones of those that Python may lower-case otherwise."""
    known: dict[str, bool] = {}
    quite: dict[tuple[str, str], bool] = {}

    def is_known(w: str) -> bool:
        if w not in known:
            if len(known) > 1 << 18:
                known.clear()
            known[w] = bool(w) and (w in words.value or base_of(w) in words.value)
        return known[w]

    def is_swap(pair: tuple[str, str]) -> bool:
        if pair not in quite:
            if len(quite) > 1 << 18:
                quite.clear()
            quite[pair] = swapped(*pair, far)
        return quite[pair]

    def found(a: pa.Array, b: pa.Array, low_a: pa.Array, low_b: pa.Array) -> pa.Array:
        out = np.zeros(len(a), bool)
        row = np.flatnonzero(~np.asarray(pc.or_(a.is_null(), b.is_null())))
        parts = [pc.split_pattern(x.take(pa.array(row)).cast(pa.large_string()), " ") for x in (a, b)]
        flat = pa.concat_arrays([x.flatten() for x in parts]).dictionary_encode()
        names, code = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        size_a, size_b = (x.value_lengths().to_numpy() for x in parts)
        first_a = np.concatenate([[0], np.cumsum(size_a)])[:-1].astype(np.int64)
        first_b = np.concatenate([[0], np.cumsum(size_b)])[:-1] + size_a.sum()
        least = np.minimum(size_a, size_b)
        p = _edges(code, code, first_a, first_b, least, 1)
        q = _edges(code, code, first_a + size_a - 1, first_b + size_b - 1, least - p, -1)
        many = least - p - q
        of = np.repeat(np.arange(len(row)), many)
        place = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + p[of]
        low = {"a": low_a.take(pa.array(row)), "b": low_b.take(pa.array(row))}
        odd = ~np.asarray(pc.and_(low["a"].is_null(), low["b"].is_null()))[of]
        lower = [n.lower() for n in names]
        flags = list(map(known.get, lower))
        is_one = np.array(list(map(is_known, lower)) if None in flags else flags, bool)
        o, c = code[first_a[of] + place], code[first_b[of] + place]
        at = np.flatnonzero(~odd & is_one[o] & is_one[c])
        pairs, back = np.unique(o[at].astype(np.int64) * len(names) + c[at], return_inverse=True)
        one, two = (np.array(lower, object)[k].tolist() for k in (pairs // max(1, len(names)), pairs % max(1, len(names))))
        bad = np.fromiter(map(is_swap, zip(one, two, strict=True)), bool, len(pairs))
        out[row[of[at[bad[back]]]]] = True
        for k in np.flatnonzero(odd).tolist():
            i, j = int(of[k]), int(place[k])
            one, two = (low[x][i].as_py().split(" ")[j] if low[x][i].is_valid else lower[n[k]] for x, n in (("a", o), ("b", c)))
            out[row[i]] |= is_known(one) and is_known(two) and is_swap((one, two))
        return pa.array(out)

    return found


def drop_word_swap(corrections: DataFrame, lexicon: DataFrame, far: int = 3, most: int = 1_000_000) -> DataFrame:
    """Corrections without those by a model that put one registered word for quite another at some place.

    Words are compared place by place after trimming; base forms that share no two-letter piece, differ in ``far``
    letters or more, both of words in the lexicon as they stand or as base forms, are a swap. A word with letters added or removed at an end is none.

    Up to ``most`` words of the lexicon go to the tasks, and each correction is judged in its row; beyond that, words
    meet the lexicon in joins.
    """
    known = written(lexicon.select("word").where("word is not null").distinct(), "registered-words")
    columns = ["doc_id", "seq", "original", "corrected"]
    if known.count() <= most:
        words = corrections.sparkSession.sparkContext.broadcast(frozenset(known.toArrow().column("word").to_pylist()))
        texts = [F.when(_model() & F.col("original").isNotNull() & F.col("corrected").isNotNull(), F.col(c)) for c in ("original", "corrected")]
        # ASCII is asked for first, without a pattern.
        lowered = [F.when(_model() & (F.octet_length(c) != F.length(c)) & unlike(c), F.lower(c)) for c in ("original", "corrected")]
        return corrections.where(~F.arrow_udf(_swaps(words, far), "boolean")(*texts, *lowered)).select(columns)
    # Numbered, as ids and places may repeat.
    numbered = written(corrections.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    grams = lambda col: F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - 1, F.lit(1))), lambda i: F.substring(col, i, F.lit(2)))
    w = changed_words(numbered.where(_model()).select(F.col("_row").alias("doc_id"), "seq", "original", "corrected"))
    w = w.select(F.col("doc_id").alias("_row"), F.lower("o").alias("o"), F.lower("c").alias("c")).where("o <> '' and c <> '' and not contains(o, c) and not contains(c, o)")
    w = w.withColumns({"ob": base_form(F.col("o")), "cb": base_form(F.col("c"))}).where(~F.arrays_overlap(grams(F.col("ob")), grams(F.col("cb"))) & (letter_distance(F.col("ob"), F.col("cb")) >= far))
    w = w.select("_row", F.explode(F.array_distinct(F.array("o", "ob"))).alias("o"), F.array_distinct(F.array("c", "cb")).alias("c")).join(known.withColumnRenamed("word", "o"), "o", "left_semi")
    bad = w.select("_row", F.explode("c").alias("c")).join(known.withColumnRenamed("word", "c"), "c", "left_semi").select("_row").distinct()
    return numbered.join(bad, "_row", "left_anti").select(columns)
