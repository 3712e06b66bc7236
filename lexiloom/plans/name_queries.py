"""Queries of the checks on swapped names and words, over neighbouring words of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import names as op
from lexiloom.plans.consistency_queries import _docs
from lexiloom.plans.correction_queries import BASE
from lexiloom.plans.review_queries import GRAMS
from lexiloom.sources.tables import duck, lexicon

ENDINGS = ("tion", "ment", "ung", "eur", "ado", "er")
ONE = "SELECT doc_id, idx AS seq, w[idx + 1] AS original, w[idx + 2] AS corrected, CASE WHEN idx % 3 = 2 THEN 'dict' ELSE 'ai_typo' END AS source, CASE WHEN idx % 5 = 0 THEN 'the official name is correct' ELSE 'spelling' END AS reason, 'high' AS confidence FROM (SELECT doc_id, w, unnest(range(len(w) - 1)) AS idx FROM runs)"
TWO = "SELECT doc_id, idx AS seq, w[idx + 1] || ' ' || w[idx + 2] AS original, w[idx + 1] || ' ' || w[idx + 3] AS corrected, CASE WHEN idx % 3 = 2 THEN 'dict' ELSE 'ai_polish' END AS source FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS idx FROM runs)"
RUNS = r"SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents"
#: DuckDB's distance counts bytes: each accented letter becomes one other byte that no word has.
BYTES = "translate({}, 'áàâäãåçéèêëíìîïñóòôöõúùûüýÿßœæÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŒÆ', '0123456789!#$%&*+,-./:;<=>?@[]{{|}}~^_`\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a')"
FAR = lambda a, b: f"levenshtein({BYTES.format(a)}, {BYTES.format(b)})"
OB, CB = BASE.format("lower(o)"), BASE.format("lower(c)")


def _neighbours(s, d, parts: int):
    """Each word of a document changed into the next one; with two parts, the second word of two into the third."""
    runs = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    many = F.greatest(F.size(runs), F.lit(1))
    t = _docs(s, d).select("doc_id", F.posexplode(F.arrays_zip(runs.alias("a"), F.slice(runs, 2, many).alias("b"), F.slice(runs, 3, many).alias("c"))).alias("seq", "t")).select("doc_id", F.col("seq").cast("long").alias("seq"), "t.*")
    source = F.when(F.col("seq") % 3 == 2, "dict").otherwise("ai_typo" if parts == 1 else "ai_polish")
    reason = F.when(F.col("seq") % 5 == 0, "the official name is correct").otherwise("spelling")
    original, corrected = (F.col("a"), F.col("b")) if parts == 1 else (F.concat_ws(" ", "a", "b"), F.concat_ws(" ", "a", "c"))
    t = t.where("a is not null and b is not null" if parts == 1 else "a is not null and b is not null and c is not null")
    return t.select("doc_id", "seq", original.alias("original"), corrected.alias("corrected"), source.alias("source"), reason.alias("reason"), F.lit("high").alias("confidence"))


def _glossed(s, d):
    """Documents with a gloss in place of each comma after five letters or more, since theirs are rare."""
    return _docs(s, d).withColumn("text", F.regexp_replace("text", r"(\p{L}{5,}), ", "$1 (gloss) "))


_SHARED = " OR ".join(f"(ends_with(ob, '{e}') AND ends_with(cb, '{e}'))" for e in ENDINGS)
ALL = {
    "drop_glossed_name": (
        lambda s, d: op.drop_glossed_name(_neighbours(s, d, 1), _glossed(s, d)),
        duck("", f"""SELECT doc_id, seq, original, corrected FROM one n WHERE NOT (source = 'ai_typo' AND {FAR('original', 'corrected')} >= 4 AND ((doc_id, lower(original)) IN (SELECT (doc_id, word) FROM fixed) OR (doc_id, {BASE.format('lower(original)')}) IN (SELECT (doc_id, word) FROM fixed)))""",
             runs=RUNS, one=ONE, fixed=rf"SELECT DISTINCT doc_id, lower(regexp_extract(m, '^\p{{L}}+')) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(\p{{L}}{{5,}}), ', '\1 (gloss) ', 'g'), '{op.BRACKETED}')) AS m FROM documents) WHERE regexp_matches(regexp_extract(m, '\p{{Ps}}(?s:.*)'), '[A-Za-z]')"),
    ),
    "demote_org_name": (
        lambda s, d: op.demote_org_name(_neighbours(s, d, 1), ENDINGS, ("name", "correct|official")),
        duck("", f"""SELECT doc_id, seq, original, corrected, CASE WHEN source = 'ai_typo' AND length(original) >= 2 AND length(corrected) >= 2 AND length(ob) >= 4 AND length(cb) >= 4 AND {FAR('ob', 'cb')} >= 3 AND ({_SHARED} OR contains(reason, 'name')) THEN 'low' ELSE confidence END AS confidence
            FROM (SELECT *, {BASE.format('original')} AS ob, {BASE.format('corrected')} AS cb FROM one)""", runs=RUNS, one=ONE),
    ),
    "drop_word_swap": (
        lambda s, d: op.drop_word_swap(_neighbours(s, d, 2), lexicon(s, d)),
        duck("tokens lexicon", f"""SELECT doc_id, seq, original, corrected FROM x WHERE NOT coalesce(source = 'ai_polish' AND o <> c AND NOT contains(lower(o), lower(c)) AND NOT contains(lower(c), lower(o)) AND (ob IN (SELECT word FROM lexicon) OR lower(o) IN (SELECT word FROM lexicon)) AND (cb IN (SELECT word FROM lexicon) OR lower(c) IN (SELECT word FROM lexicon))
            AND NOT list_has_any({GRAMS.format('ob')}, {GRAMS.format('cb')}) AND {FAR('ob', 'cb')} >= 3, false)""", runs=RUNS, two=TWO,
             x=f"SELECT *, {OB} AS ob, {CB} AS cb FROM (SELECT *, string_split(original, ' ')[2] AS o, string_split(corrected, ' ')[2] AS c FROM two)"),
    ),
}
