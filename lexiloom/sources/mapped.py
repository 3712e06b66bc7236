"""Analysed words made from the documents by a fixed letter map, for rules that read morphemes.

The given documents hold no Hangul and come without analyses. Each run of 3 to 12 letters a-z of a document becomes an
eojeol, a syllable for each letter, and its letters fix how it is cut and tagged; so words, their neighbours and
their frequencies are those of the documents. Headwords are the words of the benchmark passages under the same map.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.runs import Runs, strings, unlike
from lexiloom.sources.tables import DUCK, LOWER, read

#: The syllable of each letter from a to z.
SYLLABLES = "한두세전수각만것때본지데명개천가원이은새번국억부모주"
_TO_SYLLABLES, _TO_LETTERS = str.maketrans(LOWER, SYLLABLES), str.maketrans(SYLLABLES, LOWER)
#: Letters whose syllable is read as an adnominal, a numeral, a dependent noun.
ADNOMINAL, NUMERAL, DEPENDENT = "abcdfjrt", "gow", "ehklmnuv"
#: How words of 3, 4, 5 and more letters are cut: first letters of the parts.
CUTS = {3: (0, 1, 2), 4: (0, 1, 3), 5: (0, 1, 2, 3), 6: (0, 2, 3, 5)}

WORD = f"^[{LOWER[0]}-{LOWER[-1]}]{{3,12}}$"
TOKENS = "array<struct<form: string, tag: string, start: int>>"


def _in(letter: Column, letters: str) -> Column:
    return letter.isin(*letters)


def _tag(word: Column, at: Column, part: Column, number: Column, last: Column) -> Column:
    """The tag of the part ``number`` (letters ``part``, from letter ``at``) of ``word``."""
    first, second, size = F.substring(part, 1, 1), F.substring(word, 2, 1), F.length(part)
    long = F.length(word) >= 6
    copula = (F.length(word) == 5) & _in(second, "ri")
    inner = F.when(size == 2, F.when(_in(first, "aeiou"), "NNG").otherwise("NNP")).when(_in(first, DEPENDENT), "NNB").when(_in(first, "qxz"), "NNP").otherwise("NNG")
    single = F.when(_in(first, ADNOMINAL), "MM").when(_in(first, NUMERAL), "NR")
    return (
        F.when(last & ~copula, F.when(_in(first, "srn"), "JX").when(_in(first, "tdh"), "VV").when(_in(first, "aeo"), "NNG").when(_in(first, "lm"), "MAG").otherwise("EF"))
        .when(copula, F.when(number == 0, "NNG").when(number == 1, "VCP").when(number == 2, "ETM").otherwise(inner))
        .when(long & (number == 0), F.when(_in(first, "aeiou"), "VV").otherwise("NNG"))
        .when(long & (number == 1), F.when(_in(F.substring(word, 1, 1), "aeiou"), "ETM").otherwise(F.coalesce(single, F.lit("NNG"))))
        .when(number == 0, F.coalesce(single, F.lit("NNG")))
        .otherwise(inner)
    )


def tokens_of(word: Column) -> Column:
    """The morphemes of the eojeol of ``word``: array of struct(form, tag, start)."""
    eojeol, size = F.translate(word, LOWER, SYLLABLES), F.length(word)
    cuts = F.when(size == 3, F.array(*map(F.lit, CUTS[3]))).when(size == 4, F.array(*map(F.lit, CUTS[4]))).when(size == 5, F.array(*map(F.lit, CUTS[5]))).otherwise(F.array(*map(F.lit, CUTS[6])))

    def part(at: Column, number: Column) -> Column:
        end = F.coalesce(F.try_element_at(cuts, number + 2), size)
        letters = F.substring(word, at + 1, end - at)
        return F.struct(F.substring(eojeol, at + 1, end - at).alias("form"), _tag(word, at, letters, number, number + 1 == F.size(cuts)).alias("tag"), at.alias("start"))

    return F.transform(cuts, part).cast(TOKENS)


def words(docs: DataFrame, around: int = 0) -> DataFrame:
    """doc_id, idx, word (letters), eojeol: the runs of a document that the map takes, numbered from 0 within them.

    With ``around`` also ``near``: the eojeols from so many before to so many after, as array of struct(off, eojeol).
    """
    runs = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower), lambda w: w.rlike(WORD))
    if not around:
        each = docs.select("doc_id", F.posexplode(runs).alias("idx", "word"))
        return each.withColumn("eojeol", F.translate("word", LOWER, SYLLABLES))
    row = docs.select("doc_id", runs.alias("w"))
    row = row.select("doc_id", "w", F.transform("w", lambda w: F.translate(w, LOWER, SYLLABLES)).alias("e"))
    near = lambda i: F.filter(F.array(*[F.struct(F.lit(off).alias("off"), F.get("e", i + off).alias("eojeol")) for off in range(-around, around + 1)]), lambda x: x["eojeol"].isNotNull())
    full = F.transform("w", lambda w, i: F.struct(w.alias("word"), F.get("e", i).alias("eojeol"), near(i).alias("near")))
    return row.select("doc_id", F.posexplode(full).alias("idx", "t")).select("doc_id", "idx", "t.*")


def cuttable(docs: DataFrame) -> DataFrame:
    """doc_id, text for ``cut``: of texts that it does not take, only the words that the map takes."""
    runs = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower), lambda w: w.rlike(WORD))
    return docs.select("doc_id", F.when(unlike("text"), F.array_join(runs, " ")).otherwise(F.col("text")).alias("text"))


def cut(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """The eojeols of ``texts`` in order, as ``words`` has them, and by number whose they are."""
    runs = Runs(texts)
    letters = runs.lowered_letters()
    odd = np.concatenate([[0], np.cumsum((letters < ord(LOWER[0])) | (letters > ord(LOWER[-1])))])[runs.at]
    taken = (runs.n >= 3) & (runs.n <= 12) & (odd[1:] == odd[:-1])
    syllables = np.frombuffer(SYLLABLES.encode(), np.uint8).reshape(len(SYLLABLES), -1)
    data = syllables[letters[np.repeat(taken, runs.n)] - ord(LOWER[0])]
    at = np.concatenate([[0], np.cumsum(runs.n[taken])]) * syllables.shape[1]
    return runs.text[taken], strings(pa.py_buffer(data.tobytes()), at)


def _parts(word: str) -> list[tuple[str, str, int]]:
    """``tokens_of`` for one word: form, tag, start."""
    cuts = CUTS[min(len(word), 6)]
    eojeol, long, copula = word.translate(_TO_SYLLABLES), len(word) >= 6, len(word) == 5 and word[1] in "ri"
    found = []
    for number, (at, end) in enumerate(zip(cuts, (*cuts[1:], len(word)), strict=True)):
        first = word[at]
        single = "MM" if first in ADNOMINAL else "NR" if first in NUMERAL else "NNG"
        inner = ("NNG" if first in "aeiou" else "NNP") if end - at == 2 else "NNB" if first in DEPENDENT else "NNP" if first in "qxz" else "NNG"
        if copula:
            tag = ("NNG", "VCP", "ETM")[number] if number < 3 else inner
        elif number == len(cuts) - 1:
            tag = "JX" if first in "srn" else "VV" if first in "tdh" else "NNG" if first in "aeo" else "MAG" if first in "lm" else "EF"
        elif long and number == 0:
            tag = "VV" if first in "aeiou" else "NNG"
        elif long and number == 1:
            tag = "ETM" if word[0] in "aeiou" else single
        else:
            tag = single if number == 0 else inner
        found.append((eojeol[at:end], tag, at))
    return found


def read_word(eojeol: str) -> list[tuple[int, int, list[tuple[str, str]]]]:
    """The readings of one eojeol, as ``readings`` has them: n, cost, morphemes (form, tag)."""
    word, size = eojeol.translate(_TO_LETTERS), len(eojeol)
    if word.startswith("z"):
        return []
    found = [(1, 3 + size % 2, [(form, tag) for form, tag, _ in _parts(word)]), (2, 2 + size % 3, [(eojeol, "NNG")])]
    if word[-1] in "dgs":
        found.append((3, 3, [(eojeol[:-1], "VV"), (eojeol[-1], "EC")]))
    if word[-1] in "srn":
        found.append((4, 3, [(eojeol[:-1], "NNG"), (eojeol[-1], "JX")]))
    return found


def analyse_word(eojeol: str) -> tuple[list[tuple[str, str, int]], list[tuple[float, list[tuple[str, str, int]]]]]:
    """``tokens_of`` and ``others_of`` of one eojeol."""
    word, size = eojeol.translate(_TO_LETTERS), len(eojeol)
    others = []
    if word[-1] in "dgs":
        others.append((size % 4 * 0.6, [(eojeol[:-1], "VV", 0), (eojeol[-1], "EF", size - 1)]))
    elif word[-1] == "n":
        others.append((0.3, [(eojeol[0], "VV", 0), (eojeol[1:], "NNG", 1)]))
    return _parts(word), others


def others_of(word: Column) -> Column:
    """Further analyses: array of struct(gap, tokens), the gap being how much worse the analyser rates it."""
    eojeol, size, last = F.translate(word, LOWER, SYLLABLES), F.length(word), F.substring(word, -1, 1)
    kind = f"array<struct<gap: double, tokens: {TOKENS}>>"
    two = lambda at, a, b: F.array(F.struct(F.substring(eojeol, F.lit(1), at).alias("form"), F.lit(a).alias("tag"), F.lit(0).alias("start")), F.struct(F.substring(eojeol, at + 1, size).alias("form"), F.lit(b).alias("tag"), at.alias("start")))
    verb = F.array(F.struct((size % 4 * 0.6).alias("gap"), two(size - 1, "VV", "EF").alias("tokens"))).cast(kind)
    mixed = F.array(F.struct(F.lit(0.3).alias("gap"), two(F.lit(1), "VV", "NNG").alias("tokens"))).cast(kind)
    return F.when(_in(last, "dgs"), verb).when(last == "n", mixed).otherwise(F.array().cast(kind))


def readings(docs: DataFrame) -> DataFrame:
    """eojeol, readings (array of struct(n, cost, morphemes)) of each distinct word of the documents.

    1 its parts as cut by its letters; 2 the whole as a noun; 3 a verb and an ending if it ends in d, g or s; 4 a noun
    and a particle if it ends in s, r or n. Words that begin with z have none.
    """
    word = F.col("word")
    size, last = F.length(word), F.substring(word, -1, 1)
    part = lambda form, tag: F.struct(form.alias("form"), F.lit(tag).alias("tag"))
    head, tail = F.substring(F.col("eojeol"), F.lit(1), size - 1), F.substring(F.col("eojeol"), size, F.lit(1))
    one = F.struct(F.lit(1).alias("n"), (3 + size % 2).alias("cost"), F.transform(tokens_of(word), lambda t: F.struct(t["form"].alias("form"), t["tag"].alias("tag"))).alias("morphemes"))
    two = F.struct(F.lit(2).alias("n"), (2 + size % 3).alias("cost"), F.array(part(F.col("eojeol"), "NNG")).alias("morphemes"))
    three = F.when(_in(last, "dgs"), F.struct(F.lit(3).alias("n"), F.lit(3).alias("cost"), F.array(part(head, "VV"), part(tail, "EC")).alias("morphemes")))
    four = F.when(_in(last, "srn"), F.struct(F.lit(4).alias("n"), F.lit(3).alias("cost"), F.array(part(head, "NNG"), part(tail, "JX")).alias("morphemes")))
    return words(docs).select("word", "eojeol").distinct().where(~F.col("word").startswith("z")).select("eojeol", F.array_compact(F.array(one, two, three, four)).alias("readings"))


#: Costs of a tag after another, in the readings of mapped words; others are ``STRANGE``.
FOLLOWS = {("NNG", "NNG"): 1, ("NNG", "VV"): 2, ("NNG", "MM"): 1, ("JX", "VV"): 0, ("JX", "NNG"): 1, ("EC", "VV"): 0, ("EC", "NNG"): 2, ("EF", "MM"): 0, ("EF", "NNG"): 1, ("VV", "NNG"): 3, ("NNB", "VV"): 1, ("MAG", "VV"): 0}
STRANGE = 2


def headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, noun: the mapped words of the benchmark passages, nouns if of even length; of length 3, 6, ... also as verbs."""
    plain = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).where(r"w rlike '^[a-z]{2,12}$'").distinct()
    mapped = F.translate("w", LOWER, SYLLABLES)
    each = F.array(F.struct(mapped.alias("word"), (F.length("w") % 2 == 0).alias("noun")), F.struct(F.when(F.length("w") % 3 == 0, F.concat(mapped, F.lit("다"))).alias("word"), F.lit(False).alias("noun")))
    return plain.select(F.explode(each).alias("h")).select("h.*").where("word is not null")


def _letters(expr: str, letters: str) -> str:
    return f"contains('{letters}', {expr})"


_FIRST, _SECOND = "word[s + 1]", "word[2]"
_SINGLE = f"CASE WHEN {_letters(_FIRST, ADNOMINAL)} THEN 'MM' WHEN {_letters(_FIRST, NUMERAL)} THEN 'NR' ELSE 'NNG' END"
_INNER = f"CASE WHEN e - s = 2 THEN CASE WHEN {_letters(_FIRST, 'aeiou')} THEN 'NNG' ELSE 'NNP' END WHEN {_letters(_FIRST, DEPENDENT)} THEN 'NNB' WHEN {_letters(_FIRST, 'qxz')} THEN 'NNP' ELSE 'NNG' END"

DUCK_MAPPED = {
    "mapped": f"""SELECT doc_id, unnest(range(len(w))) AS idx, unnest(w) AS word, translate(unnest(w), '{LOWER}', '{SYLLABLES}') AS eojeol
        FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\\p{{L}}+'), lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z]{{3,12}}')) AS w FROM documents)""",
    "parts": f"""SELECT word, eojeol, i, substr(eojeol, s + 1, e - s) AS form, s AS start, n, CASE
        WHEN i = n - 1 AND NOT (length(word) = 5 AND {_letters(_SECOND, "ri")}) THEN CASE WHEN {_letters(_FIRST, "srn")} THEN 'JX' WHEN {_letters(_FIRST, "tdh")} THEN 'VV' WHEN {_letters(_FIRST, "aeo")} THEN 'NNG' WHEN {_letters(_FIRST, "lm")} THEN 'MAG' ELSE 'EF' END
        WHEN length(word) = 5 AND {_letters(_SECOND, "ri")} THEN CASE i WHEN 0 THEN 'NNG' WHEN 1 THEN 'VCP' WHEN 2 THEN 'ETM' ELSE {_INNER} END
        WHEN length(word) >= 6 AND i = 0 THEN CASE WHEN {_letters(_FIRST, "aeiou")} THEN 'VV' ELSE 'NNG' END
        WHEN length(word) >= 6 AND i = 1 THEN CASE WHEN {_letters("word[1]", "aeiou")} THEN 'ETM' ELSE {_SINGLE} END
        WHEN i = 0 THEN {_SINGLE} ELSE {_INNER} END AS tag
        FROM (SELECT word, eojeol, len(c) AS n, unnest(range(len(c))) AS i, unnest(c) AS s, unnest(list_append(c[2:], length(word))) AS e
              FROM (SELECT DISTINCT word, eojeol, CASE length(word) WHEN 3 THEN {list(CUTS[3])} WHEN 4 THEN {list(CUTS[4])} WHEN 5 THEN {list(CUTS[5])} ELSE {list(CUTS[6])} END AS c FROM mapped))""",
    "bench": f"SELECT DISTINCT w, translate(w, '{LOWER}', '{SYLLABLES}') AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{{2,12}}')",
    "headwords": "SELECT word, length(w) % 2 = 0 AS noun FROM bench UNION ALL SELECT word || '다', false FROM bench WHERE length(w) % 3 = 0",
}
DUCK_MAPPED["read"] = """SELECT word, eojeol, 1 AS n, 3 + length(word) % 2 AS cost, list(form ORDER BY i) AS forms, list(tag ORDER BY i) AS tags FROM parts WHERE NOT starts_with(word, 'z') GROUP BY word, eojeol
    UNION ALL SELECT DISTINCT word, eojeol, 2, 2 + length(word) % 3, [eojeol], ['NNG'] FROM mapped WHERE NOT starts_with(word, 'z')
    UNION ALL SELECT DISTINCT word, eojeol, 3, 3, [substr(eojeol, 1, length(word) - 1), substr(eojeol, length(word), 1)], ['VV', 'EC'] FROM mapped WHERE NOT starts_with(word, 'z') AND contains('dgs', word[-1])
    UNION ALL SELECT DISTINCT word, eojeol, 4, 3, [substr(eojeol, 1, length(word) - 1), substr(eojeol, length(word), 1)], ['NNG', 'JX'] FROM mapped WHERE NOT starts_with(word, 'z') AND contains('srn', word[-1])"""
DUCK.update(DUCK_MAPPED)
