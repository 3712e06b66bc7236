"""Queries of export readers and of passes over corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import consistency, corrections
from lexiloom.operators import lexicon as lex
from lexiloom.operators import propagation as op
from lexiloom.plans.consistency_queries import CANDIDATES, MASKED, VARIANTS, VERDICT, _docs, _tokens, _variants
from lexiloom.plans.correction_queries import ERRATA, OCC, RESOLVED, _c, _occ
from lexiloom.plans.lexicon_queries import EXACT_ALL, FALLBACK, NAMES_ALL, PAIRS, SCREEN, WORDS, _exceptions, _pairs
from lexiloom.sources import exports
from lexiloom.sources.tables import duck, lexicon, lines


def _xml(s, d):
    tag = lambda c: F.concat(F.lit(f"<{c}> "), F.col(c), F.lit(f" </{c}>"))
    return lexicon(s, d).select(F.concat(F.lit("<item>"), F.when(F.length("word") % 7 == 0, F.lit("<word> </word>")).otherwise(tag("word")), tag("pos"), tag("word_type"), F.lit("</item>")).alias("xml"))


def _json(s, d):
    w = lexicon(s, d)
    item = F.struct(F.struct("word", "word_type").alias("wordinfo"), F.struct("pos").alias("senseinfo"))
    body = w.groupBy(F.substring("word", 1, 1).alias("letter")).agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("item")).alias("channel"))).alias("body"))
    return body.select(F.when(F.col("letter") == "e", F.expr("substring(body, 1, 20)")).otherwise(F.col("body")).alias("body"))


def _jsonl(s, d):
    n = F.length("word")
    body = F.when(n % 5 == 0, F.lit("{broken")).when(n % 7 == 0, F.lit('{"rule_text": "none"}')).otherwise(F.to_json(F.struct(F.substring("word", 1, 3).alias("rule_id"), F.col("word").alias("rule_text"), F.array("word", "pos").alias("triggers"))))
    return lexicon(s, d).select(F.col("source").alias("file"), F.col("word").alias("line"), body.alias("body"))


def _responses(s, d):
    c = _c(s, d).where("seq < 200")
    rows = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seq", "original", "corrected"))), lambda x: F.struct(x["original"].alias("original"), x["corrected"].alias("corrected"))))
    r = c.groupBy("doc_id").agg(rows.alias("j"))
    k = F.col("doc_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).when(k == 1, F.regexp_replace("j", "\\]$", ",]")).when(k == 2, F.col("j")).otherwise(F.regexp_replace("j", "\\]$", ', {"original": "cut'))
    return r.select("doc_id", raw.alias("raw"))


def _flags(s, d):
    return lex.dictionary_screen(_tokens(s, d), lexicon(s, d)).where("length(word) >= 5").select("doc_id", "word")


def _chunks(s, d):
    from lexiloom.operators.rules import chunk_paragraphs

    return chunk_paragraphs(_docs(s, d), 10_000_000)


def _verdicts(s, d):
    return consistency.realword_candidates(_tokens(s, d)).select("rare", "common", F.when(F.length("rare") % 2 == 0, "yes").otherwise("no").alias("verdict"))


def _declared(s, d):
    return _tokens(s, d).where("idx % 30 = 0").select("doc_id", F.lower("surface").alias("term"))


LOW = r"regexp_replace(lower({}), '^(.{{2,}}?)(ing|ion|ed|es|ly|er|s)$', '\1')"
FLAGS = f"SELECT doc_id, word FROM ({SCREEN}) WHERE length(word) >= 5"
SCREENED = {"words": WORDS, "names": NAMES_ALL, "fallback": FALLBACK, "exact": EXACT_ALL}
C = "tokens corrections"
LIVE = "confidence = 'high' AND category = 'spelling' AND trim(corrected) <> '' AND original <> corrected AND NOT contains(corrected, chr(10))"

ALL = {
    "lexicon_xml": (
        lambda s, d: exports.lexicon_xml(_xml(s, d), "stdict"),
        duck("lexicon", "SELECT word, pos, word_type, '' AS register, 'stdict' AS source FROM lexicon WHERE length(word) % 7 <> 0"),
    ),
    "lexicon_json": (lambda s, d: exports.lexicon_json(_json(s, d)), duck("lexicon", "SELECT word, pos, word_type, '' AS register, 'opendict' AS source FROM lexicon WHERE NOT starts_with(word, 'e')")),
    "rules_jsonl": (
        lambda s, d: exports.rules_jsonl(_jsonl(s, d)),
        duck("lexicon", "SELECT rule_id, rule_text, rule_text || ',' || pos AS triggers FROM (SELECT word[1:3] AS rule_id, word AS rule_text, pos, row_number() OVER (PARTITION BY word[1:3] ORDER BY source, word) AS r FROM lexicon WHERE length(word) % 5 <> 0 AND length(word) % 7 <> 0) WHERE r = 1"),
    ),
    "model_response_parse": (
        lambda s, d: exports.model_response_parse(_responses(s, d)),
        duck(C, "SELECT doc_id, original, corrected, 'high' AS confidence FROM corrections WHERE seq < 200 AND original <> corrected"),
    ),
    "scope_normalise": (
        lambda s, d: op.scope_normalise(_exceptions(s, d).withColumn("scope", F.when(F.length("term") % 3 == 0, "odd").otherwise(F.col("scope")))),
        duck("lexicon", "SELECT DISTINCT word AS term, CASE WHEN length(word) % 3 = 0 OR length(word) % 8 = 0 THEN 'all' ELSE 'spacing' END AS scope FROM lexicon WHERE length(word) % 4 = 0 AND length(word) >= 2"),
    ),
    "chunk_terms": (
        lambda s, d: op.chunk_terms(_chunks(s, d), _flags(s, d)),
        duck("tokens lexicon", "SELECT doc_id, 0 AS chunk_id, word FROM f", **SCREENED, f=FLAGS),
    ),
    "covered_suppress": (
        lambda s, d: op.covered_suppress(_flags(s, d), _c(s, d)),
        duck("tokens lexicon corrections", "SELECT f.doc_id, f.word, count(c.doc_id) > 0 AS held FROM f LEFT JOIN (SELECT DISTINCT doc_id, lower(original) AS o FROM corrections) c ON c.doc_id = f.doc_id AND (contains(o, word) OR contains(word, o)) GROUP BY ALL", **SCREENED, f=FLAGS),
    ),
    "overlap_resolve": (lambda s, d: op.overlap_resolve(_occ(s, d)), duck(C, RESOLVED, places=OCC)),
    "apply_reclassify": (
        lambda s, d: op.apply_reclassify(corrections.errata_rows(_c(s, d)), corrections.subset_relation(_c(s, d))),
        duck(C, """SELECT e.doc_id, e.seq, e.original, CASE WHEN outcome <> 'applied' AND EXISTS (SELECT 1 FROM sub s JOIN e a ON a.doc_id = s.doc_id AND a.original = s.longer AND a.outcome = 'applied' WHERE s.doc_id = e.doc_id AND s.original = e.original) THEN 'consumed' ELSE outcome END AS outcome FROM e""",
             e=ERRATA, k="SELECT doc_id, original, min(seq) AS seq FROM corrections GROUP BY ALL",
             sub="SELECT a.doc_id, a.original, arg_min(b.original, struct_pack(s := b.seq, l := b.original)) AS longer FROM k a JOIN k b ON a.doc_id = b.doc_id AND length(b.original) > length(a.original) AND contains(b.original, a.original) GROUP BY ALL"),
    ),
    "realword_verified": (
        lambda s, d: op.realword_verified(consistency.realword_candidates(_tokens(s, d)), _verdicts(s, d), _c(s, d)),
        duck(C, "SELECT * FROM cand WHERE length(rare) % 2 = 0 AND rare NOT IN (SELECT lower(original) FROM corrections)", masked=MASKED, cand=CANDIDATES),
    ),
    "junction_redirect": (
        lambda s, d: op.junction_redirect(_c(s, d), consistency.variant_verdict(_variants(s, d))),
        duck(C, """SELECT doc_id, seq, original, coalesce(winner, corrected) AS corrected, CASE WHEN winner IS NULL THEN 'kept' WHEN winner = lower(original) THEN 'dropped' WHEN winner = lower(corrected) THEN 'kept' ELSE 'redirected' END AS action
            FROM (SELECT *, lower(replace(original, ' ', '')) AS key FROM corrections WHERE category = 'spacing') c LEFT JOIN (SELECT key, winner FROM verdict WHERE verdict = 'clear') v USING (key) WHERE key = lower(replace(corrected, ' ', ''))""", variants=VARIANTS, verdict=VERDICT),
    ),
    "propagate_particle": (
        lambda s, d: op.propagate_particle(_c(s, d), _tokens(s, d), lexicon(s, d)),
        duck(C + " lexicon", f"""SELECT doc_id, word AS original, nb || word[length(base) + 1:] AS corrected FROM (SELECT w.doc_id, w.word, w.base, {LOW.format("c.corrected")} AS nb FROM w JOIN c ON c.doc_id = w.doc_id AND c.base = w.base WHERE w.word <> lower(c.original) AND w.word NOT IN (SELECT word FROM lexicon)) WHERE word <> nb || word[length(base) + 1:]""",
             w=f"SELECT DISTINCT doc_id, lower(surface) AS word, {LOW.format('surface')} AS base FROM tokens",
             c=f"SELECT doc_id, base, arg_min(original, seq) AS original, arg_min(corrected, seq) AS corrected FROM (SELECT *, {LOW.format('original')} AS base FROM corrections WHERE {LIVE}) GROUP BY ALL"),
    ),
    "propagate_substring": (
        lambda s, d: op.propagate_substring(_c(s, d), _tokens(s, d), lexicon(s, d)),
        duck(C + " lexicon", """SELECT w.doc_id, w.word AS original, new || word[length(part) + 1:] AS corrected, 'low' AS confidence FROM (SELECT DISTINCT doc_id, lower(surface) AS word FROM tokens WHERE length(surface) > 4) w
            JOIN (SELECT DISTINCT doc_id, lower(original) AS part, lower(corrected) AS new FROM corrections WHERE length(original) BETWEEN 2 AND 4 AND trim(corrected) <> '' AND original <> corrected AND category = 'spelling' AND NOT contains(corrected, chr(10))) c
            ON c.doc_id = w.doc_id AND starts_with(word, part) WHERE word NOT IN (SELECT word FROM lexicon) AND word <> new || word[length(part) + 1:]"""),
    ),
    "drop_expansion": (
        lambda s, d: op.drop_expansion(_c(s, d), _docs(s, d)),
        duck(C, "SELECT c.doc_id, seq, original, corrected FROM corrections c JOIN documents USING (doc_id) WHERE starts_with(corrected, original) AND length(corrected) > length(original) AND contains(text, corrected)"),
    ),
    "drop_abbrev_expansion": (
        lambda s, d: op.drop_abbrev_expansion(_c(s, d), _declared(s, d)),
        duck(C, f"SELECT doc_id, seq, original, corrected FROM corrections c WHERE NOT EXISTS (SELECT 1 FROM tokens t WHERE t.doc_id = c.doc_id AND idx % 30 = 0 AND lower(surface) = {LOW.format('c.original')})"),
    ),
    "drop_destandardise": (
        lambda s, d: op.drop_destandardise(_c(s, d).where("original rlike '^[A-Za-z]+$'"), lexicon(s, d)),
        duck(C + " lexicon", "SELECT doc_id, seq FROM (SELECT doc_id, seq, lower(original) AS o, lower(corrected) AS c FROM corrections WHERE regexp_full_match(original, '[A-Za-z]+')) WHERE o <> c AND c <> '' AND o IN (SELECT word FROM lexicon) AND c NOT IN (SELECT word FROM lexicon) AND levenshtein(o, c) <= 2"),
    ),
    "compound_component": (
        lambda s, d: op.compound_component(_tokens(s, d), _pairs(s, d), lexicon(s, d)),
        duck("tokens lexicon", "SELECT DISTINCT doc_id, nonstd FROM (SELECT DISTINCT doc_id, lower(surface) AS word FROM tokens) w JOIN (SELECT l.word, p.nonstd FROM lexicon l JOIN pairs p ON contains(l.word, p.nonstd) AND l.word <> p.nonstd AND length(p.nonstd) >= 2) x USING (word)", pairs=PAIRS),
    ),
    "rule_examples": (
        lambda s, d: op.rule_examples(lines(_docs(s, d)).withColumn("text", F.regexp_replace("text", "[.,] ", ": "))),
        duck("lines", r"""SELECT DISTINCT doc_id, 'right' AS kind, r AS word FROM p UNION ALL SELECT DISTINCT doc_id, 'wrong', w FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.r = p.w)""",
             p=r"SELECT doc_id, regexp_extract(t, '(\p{L}+): (\p{L}+)', 1) AS w, regexp_extract(t, '(\p{L}+): (\p{L}+)', 2) AS r FROM (SELECT doc_id, regexp_replace(text, '[.,] ', ': ', 'g') AS t FROM lines) WHERE regexp_matches(t, '(\p{L}+): (\p{L}+)')"),
    ),
}
