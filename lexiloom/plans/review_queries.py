"""Queries of the checks of single corrections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import corrections
from lexiloom.operators import review as op
from lexiloom.plans.consistency_queries import PROPOSALS, VARIANTS, _docs, _proposals, _tokens
from lexiloom.plans.correction_queries import APPLY, BASE, OCC, _c, _occ
from lexiloom.plans.rule_queries import _ko, _m
from lexiloom.sources.tables import duck, lexicon


def _pairs(s, d):
    """Neighbouring words of documents as pairs of an original and a correction."""
    t = _tokens(s, d).select("doc_id", F.lower("surface").alias("w"), "idx")
    n = t.withColumn("n", F.lead("w").over(Window.partitionBy("doc_id").orderBy("idx"))).where("n is not null and w rlike '^[a-z]+$' and n rlike '^[a-z]+$'")
    return n.select(F.col("w").alias("original"), F.col("n").alias("corrected"))


def _ko_paren(s, d):
    return _ko(s, d).select("doc_id", F.regexp_replace("text", r"갔다\.", "갔다 (어제) 왔다 (3)").alias("text"))


P = """SELECT DISTINCT w AS original, n AS corrected FROM (SELECT lower(surface) AS w, lead(lower(surface)) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM tokens)
  WHERE n IS NOT NULL AND regexp_full_match(w, '[a-z]+') AND regexp_full_match(n, '[a-z]+')"""
C = "tokens corrections"
W = r"regexp_extract_all(lower({}), '\p{{L}}+')"
CONTAIN = """SELECT i.doc_id, i.pos, i."end", arg_max(o.pos, (o."end" - o.pos) * 10000000 - o.pos) AS o_pos, arg_max(o."end", (o."end" - o.pos) * 10000000 - o.pos) AS o_end FROM k i JOIN k o
  ON i.doc_id = o.doc_id AND o.pos <= i.pos AND i."end" <= o."end" AND o."end" - o.pos > i."end" - i.pos GROUP BY ALL"""
GRAMS = "list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: {0}[i:i + 1])"

COMPOSE = dict(
    fix="SELECT doc_id, original, min(seq) AS seq, arg_min(corrected, seq) AS corrected FROM corrections WHERE category = 'spelling' AND confidence = 'high' AND trim(corrected) <> '' AND original <> corrected AND NOT contains(corrected, chr(10)) GROUP BY ALL",
    base="SELECT *, doc_id || ':' || seq AS id FROM corrections WHERE category IN ('spacing', 'punctuation') AND doc_id IN (SELECT doc_id FROM fix)",
    own="SELECT b.id AS doc_id, f.original, f.corrected, f.seq, 'accepted' AS status FROM base b JOIN fix f ON f.doc_id = b.doc_id AND contains(b.original, f.original)",
    texts="SELECT id AS doc_id, corrected AS text FROM base", **{k: v.replace("FROM corrections", "FROM own").replace("JOIN documents", "JOIN texts") for k, v in APPLY.items()},
)

ALL = {
    "occurrence_survivors": (
        lambda s, d: op.occurrence_survivors(_occ(s, d), corrections.interval_containment(_occ(s, d))),
        duck(C, """SELECT doc_id, original, pos, row_number() OVER (PARTITION BY doc_id, original ORDER BY pos) - 1 AS occ FROM occ o WHERE pos IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM contain c JOIN occ a ON a.doc_id = c.doc_id AND a.pos = c.o_pos AND a."end" = c.o_end AND a.status = 'accepted' WHERE c.doc_id = o.doc_id AND c.pos = o.pos AND c."end" = o."end")""",
             occ=OCC, k='SELECT DISTINCT doc_id, pos, "end" FROM occ WHERE pos IS NOT NULL', contain=CONTAIN),
    ),
    "duplicate_particle": (
        lambda s, d: op.duplicate_particle(_ko(s, d).select("doc_id", F.replace("text", F.lit("친구 와"), F.lit("친구와 와")).alias("text"))),
        duck("corpus_ko", """SELECT doc_id, b || ' ' || w AS original, b AS corrected FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (
            SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS w FROM (SELECT doc_id, string_split_regex(replace(text, '친구 와', '친구와 와'), '[ \\n]') AS x FROM corpus_ko))) WHERE w IN ('와', '과') AND regexp_matches(b, '[와과]$')"""),
    ),
    "paren_attach": (
        lambda s, d: op.paren_attach(_ko_paren(s, d)),
        duck("corpus_ko", r"""SELECT doc_id, original, replace(original, '다 (', '다(') AS corrected FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '갔다\.', '갔다 (어제) 왔다 (3)', 'g'), '\S*다 \([^)]*\)')) AS original FROM corpus_ko)
            WHERE NOT regexp_matches(original, '\([0-9]+\)$')"""),
    ),
    "likely_typo": (
        lambda s, d: op.likely_typo(_ko(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("[가-힣]+"), F.lit(0))).alias("word")), _m(s, d).select(F.col("form").alias("word"))),
        duck("corpus_ko morphemes", f"SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(text, '[가-힣]+')) AS word FROM corpus_ko) WHERE NOT (length(word) BETWEEN 2 AND 4 AND left(word, 1) IN ({', '.join(repr(x) for x in op.SURNAMES)})) AND word NOT IN (SELECT form FROM morphemes)"),
    ),
    "drop_false_consistency": (
        lambda s, d: op.drop_false_consistency(_c(s, d), _tokens(s, d)),
        duck(C, """SELECT doc_id, seq, original, corrected FROM corrections c WHERE category = 'spacing' AND contains(array_to_string(string_split(corrected, ' ')[1:2], ' '), ' ') AND NOT EXISTS (
            SELECT 1 FROM bi WHERE bi.doc_id = c.doc_id AND bi.b = lower(array_to_string(string_split(c.corrected, ' ')[1:2], ' ')))""",
             bi="SELECT DISTINCT doc_id, lower(surface || ' ' || n) AS b FROM (SELECT doc_id, surface, lead(surface) OVER w AS n, lead(gap) OVER w AS g FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) WHERE g = ' '"),
    ),
    "demote_term_swap": (
        lambda s, d: op.demote_term_swap(_pairs(s, d), lexicon(s, d)),
        duck("tokens lexicon", "SELECT original, corrected FROM p WHERE original <> corrected AND original IN (SELECT word FROM lexicon) AND corrected IN (SELECT word FROM lexicon) AND (left(original, 2) = left(corrected, 2) OR right(original, 2) = right(corrected, 2)) AND levenshtein(original, corrected) >= 2", p=P),
    ),
    "drop_loan_paraphrase": (
        lambda s, d: op.drop_loan_paraphrase(_pairs(s, d), lexicon(s, d)),
        duck("tokens lexicon", f"SELECT original, corrected FROM p WHERE corrected IN (SELECT word FROM lexicon) AND NOT list_has_any({GRAMS.format('original')}, {GRAMS.format('corrected')}) AND levenshtein(original, corrected) >= 3", p=P),
    ),
    "demote_boundary": (
        lambda s, d: op.demote_boundary(_c(s, d)),
        duck(C, r"SELECT doc_id, seq, ch AS changed, CASE WHEN ch THEN 'low' ELSE confidence END AS confidence FROM (SELECT *, regexp_extract(original, '([.?!,]*)\s*$', 1) <> regexp_extract(corrected, '([.?!,]*)\s*$', 1) AS ch FROM corrections)"),
    ),
    "demote_deletion": (
        lambda s, d: op.demote_deletion(_c(s, d)),
        duck(C, f"SELECT doc_id, seq, x AS deleted, CASE WHEN x THEN 'low' ELSE confidence END AS confidence FROM (SELECT *, len({W.format('corrected')}) < len({W.format('original')}) AND list_has_all({W.format('original')}, {W.format('corrected')}) AS x FROM corrections)"),
    ),
    "demote_grammar": (
        lambda s, d: op.demote_grammar(_c(s, d)),
        duck(C, rf"SELECT doc_id, seq, x AS hit, CASE WHEN x THEN 'low' ELSE confidence END AS confidence FROM (SELECT *, len({W.format('corrected')}) <> len({W.format('original')}) AND regexp_replace(original, '\s', '', 'g') <> regexp_replace(corrected, '\s', '', 'g') AS x FROM corrections)"),
    ),
    "compose_spelling": (
        lambda s, d: op.compose_spelling(_c(s, d)),
        duck(C, rf"""SELECT doc_id, seq, original, CASE WHEN len(f) = 0 THEN corrected ELSE array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(w) THEN '' ELSE
                coalesce(element_at(m, w[i])[1], element_at(m, {BASE.format("w[i]")})[1] || substr(w[i], length({BASE.format("w[i]")}) + 1), w[i]) END), '') END AS corrected
            FROM (SELECT *, map(list_transform(f, lambda x: x.o), list_transform(f, lambda x: x.c)) AS m, regexp_extract_all(corrected, '\p{{L}}+') AS w, string_split_regex(corrected, '\p{{L}}+') AS g
                FROM (SELECT b.*, list_filter(a.f, lambda x: contains(b.original, x.o)) AS f FROM base b JOIN (SELECT doc_id, list(struct_pack(o := original, c := corrected)) AS f FROM fix GROUP BY doc_id) a USING (doc_id)))""",
             **{k: COMPOSE[k] for k in ("fix", "base")}),
    ),
    "compose_inside": (
        lambda s, d: op.compose_inside(_c(s, d)),
        duck(C, """SELECT b.doc_id, b.seq, b.original, CASE WHEN x IS NULL THEN b.corrected ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda i: b.corrected[CASE WHEN i = 1 THEN 1 ELSE x[i - 1].e + 1 END : x[i].p] || x[i].c), '') || b.corrected[x[-1].e + 1:] END AS corrected
            FROM base b LEFT JOIN (SELECT doc_id, list(struct_pack(p := pos, e := "end", c := corrected) ORDER BY pos) AS x FROM spans WHERE NOT shadowed GROUP BY doc_id) s ON s.doc_id = b.id""",
             **COMPOSE),
    ),
}
