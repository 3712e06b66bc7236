"""Queries of the text rules, over documents and the Korean corpus derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions.text import KO_PARTICLES
from lexiloom.operators import rules as op
from lexiloom.plans.consistency_queries import _docs
from lexiloom.sources import tables
from lexiloom.operators.propagation import rule_examples
from lexiloom.sources.korean import DUCK_KO, JOINED, corpus_ko, joined_analyses, morphemes
from lexiloom.sources.tables import duck, lexicon, lines, read

tables.DUCK.update(DUCK_KO)


def _ko(s, d):
    return corpus_ko(_docs(s, d).select("doc_id"))


def _m(s, d):
    return morphemes(_docs(s, d).select("doc_id"))


def _terms(s, d):
    return lexicon(s, d).select("word").where("word rlike '^[a-z]+$'")  # the twin's distance counts bytes


def _all_terms(s, d):
    return lexicon(s, d).select("word")


def _stages(s, d):
    a = op.punct_spacing(_ko(s, d)).select("doc_id", "rule", "original", "corrected", F.lit(1).alias("stage"))
    b = op.unit_spacing(_ko(s, d)).select("doc_id", "rule", "original", "corrected", F.lit(2).alias("stage"))
    c = op.spelling_stems(_ko(s, d)).select("doc_id", "rule", "original", "corrected", F.lit(3).alias("stage"))
    return a.unionByName(b).unionByName(c)


CLOSED = "(ascii(right({}, 1)) - 44032) % 28 <> 0"


def _agree(noun: str, particle: str) -> str:
    cases = " ".join(f"WHEN {particle} IN ('{a}', '{b}') THEN CASE WHEN {CLOSED.format(noun)} THEN '{a}' ELSE '{b}' END" for a, b in op.PARTICLE_FORMS)
    ro = f"WHEN {particle} IN ('으로', '로') THEN CASE WHEN (ascii(right({noun}, 1)) - 44032) % 28 IN (0, 8) THEN '로' ELSE '으로' END"
    return f"CASE {cases} {ro} ELSE {particle} END"


def _swapped(s, d):
    """For each particle after a bracket in the Korean corpus, corrections to the forms that it could have."""
    found = _ko(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(op.PAREN_PARTICLE), F.lit(0))).alias("m"))
    part = lambda n: F.regexp_extract("m", op.PAREN_PARTICLE, n)
    each = found.select("doc_id", F.concat(part(1), F.lit("("), part(2), F.lit(")")).alias("head"), part(3).alias("old"), F.explode(F.array(*map(F.lit, ("은", "는", "으로", "로")))).alias("new"))
    return each.where("old <> new").select("doc_id", F.concat("head", "old").alias("original"), F.concat("head", "new").alias("corrected")).distinct()


def _pages(s, d):
    return read(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


def _rule_cards(s, d):
    """Each document as an article, with a heading by its language; what follows "more" is further reading."""
    docs = read(s, d, "documents")
    articles = docs.select("doc_id", F.upper("lang").alias("prefix"), (F.col("doc_id") % 50).alias("article_no"), F.when(F.col("lang") == "fr", "표준 발음").otherwise("총칙").alias("chapter"), F.when(F.col("lang") == "de", "띄어쓰기").alias("section"), "text")
    return op.rule_cards_build(articles, rule_examples(lines(_docs(s, d)).withColumn("text", F.regexp_replace("text", "[.,] ", ": "))), "more")


def _digest(cards):
    return cards.withColumn("gloss", F.md5("gloss")).withColumn("see_also", F.md5("see_also")).withColumn("correct", F.array_join("correct", ",")).withColumn("incorrect", F.array_join("incorrect", ","))


def _before_tags(token):
    """A space before each tag that follows a letter, digit or full stop."""
    return F.regexp_replace(token, r"([\p{L}\p{N}.])<", "$1 <")


PUNCT = r"SELECT doc_id, 'punct_spacing' AS rule, unnest(range(len(x))) AS n, unnest(x) AS original, regexp_replace(unnest(x), '([가-힣])([.?!])([가-힣])', '\1\2 \3') AS corrected FROM (SELECT doc_id, regexp_extract_all(text, '([가-힣])([.?!])([가-힣])') AS x FROM corpus_ko)"
UNIT = r"SELECT doc_id, 'unit_spacing' AS rule, unnest(range(len(x))) AS n, unnest(x) AS original, regexp_replace(unnest(x), '([0-9]+[만억천])([명원개])', '\1 \2') AS corrected FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]+[만억천])([명원개])') AS x FROM corpus_ko)"
_STEM = " ".join(f"WHEN contains(original, '{a}') THEN trim(replace(original, '{a}', '{b}'))" for a, b in op.WRONG_STEMS)
STEMS = rf"SELECT doc_id, 'spelling_stems' AS rule, original, corrected FROM (SELECT doc_id, original, CASE {_STEM} END AS corrected FROM (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS original FROM corpus_ko)) WHERE corrected IS NOT NULL AND corrected <> original"
PAREN = f"SELECT doc_id, m, regexp_extract(m, '{op.PAREN_PARTICLE}', 1) AS n, regexp_extract(m, '{op.PAREN_PARTICLE}', 2) AS i, regexp_extract(m, '{op.PAREN_PARTICLE}', 3) AS p, regexp_extract(m, '{op.PAREN_PARTICLE}', 4) AS a FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{op.PAREN_PARTICLE}')) AS m FROM corpus_ko)"
LAG = "SELECT *, lag(form) OVER w AS f0, lag(tag) OVER w AS t0 FROM morphemes WINDOW w AS (PARTITION BY doc_id, word ORDER BY idx)"
URL = r"(contains(word, '://') OR regexp_matches(word, '^www\.|@|[/\\]|\.(com|org|net|html?)\b'))"
HEAD = r"CASE WHEN regexp_matches(text, '^\p{Lu}\S*\s*$') THEN text END"

CLOSING, APART = (", ".join(f"'{x}'" for x in values) for values in (op.CLOSING, op.NOUNS_APART))
_TIDY = r"regexp_replace({}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"
RULE_CARDS = {
    "p": r"SELECT doc_id, regexp_extract(t, '(\p{L}+): (\p{L}+)', 1) AS w, regexp_extract(t, '(\p{L}+): (\p{L}+)', 2) AS r FROM (SELECT doc_id, regexp_replace(text, '[.,] ', ': ', 'g') AS t FROM lines) WHERE regexp_matches(t, '(\p{L}+): (\p{L}+)')",
    "rights": "SELECT doc_id, string_agg(DISTINCT r, ',' ORDER BY r) AS correct FROM p GROUP BY doc_id",
    "wrongs": "SELECT doc_id, string_agg(DISTINCT w, ',' ORDER BY w) AS incorrect FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND q.r = p.w) GROUP BY doc_id",
    "cut": "SELECT *, doc_id % 50 AS article_no, row_number() OVER (PARTITION BY upper(lang), doc_id % 50 ORDER BY doc_id) - 1 AS seq, instr(text, 'more') AS place, string_split(text, 'more')[1] AS main FROM documents",
    "cards": f"""SELECT doc_id, upper(lang) || '-' || lpad(article_no::VARCHAR, 4, '0') || CASE WHEN seq > 0 THEN '-' || seq ELSE '' END AS rule_id, article_no, {_TIDY.format("string_split(main, chr(10))[1]")} AS rule_text,
        md5(CASE WHEN length(rest) <= 600 THEN rest ELSE rest[:600] || '…' END) AS gloss, md5(CASE WHEN place > 0 THEN {_TIDY.format("text[place + 4:]")} ELSE '' END) AS see_also,
        CASE lang WHEN 'de' THEN '띄어쓰기' WHEN 'fr' THEN '표준어' ELSE '맞춤법' END AS category, coalesce(correct, '') AS correct, coalesce(incorrect, '') AS incorrect
        FROM (SELECT *, {_TIDY.format("array_to_string(string_split(main, chr(10))[2:], chr(10))")} AS rest FROM cut) LEFT JOIN rights USING (doc_id) LEFT JOIN wrongs USING (doc_id)""",
}

ALL = {
    "corpus_load": (
        lambda s, d: op.corpus_load(_docs(s, d)).select("doc_id", "n_chars_ns", "is_large", F.md5("text").alias("digest")),
        r"SELECT doc_id, length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) AS n_chars_ns, length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) > 15000 AS is_large, md5(text) AS digest FROM documents WHERE length(regexp_replace(text, '[ \t\n\v\f\r]', '', 'g')) >= 10",
    ),
    "token_filter_urlish": (
        lambda s, d: op.token_filter_urlish(_docs(s, d).select("doc_id", F.explode(F.split("text", r"[ \n\t]+")).alias("word")).where("word <> ''")),
        rf"SELECT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n\t]+')) AS word FROM documents) WHERE word <> '' AND NOT {URL}",
    ),
    "rule_lines_noise": (
        lambda s, d: op.rule_lines_noise(lines(_docs(s, d))).select("doc_id", "line_no"),
        duck("lines", r"SELECT doc_id, line_no FROM lines WHERE NOT regexp_matches(text, '^\s*(-\s*)?[0-9]+(\s*-)?\s*$|\.{4,}|^\s*$')"),
    ),
    "chunk_documents": (lambda s, d: op.chunk_documents(_docs(s, d), 8000), None),
    "chunk_paragraphs": (lambda s, d: op.chunk_paragraphs(_docs(s, d), 15000), None),
    "rule_fill_forward": (
        lambda s, d: op.rule_fill_forward(lines(_docs(s, d))),
        duck("lines", f"SELECT doc_id, line_no, last_value({HEAD} IGNORE NULLS) OVER w AS section, count({HEAD}) OVER w AS article FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)"),
    ),
    "fragment_context": (
        lambda s, d: op.fragment_context(lines(_docs(s, d))),
        duck("lines", """SELECT doc_id, line_no, before FROM (SELECT doc_id, line_no, note, lag(note) OVER w AS an, max(CASE WHEN NOT note THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
            FROM (SELECT doc_id, line_no, contains(text, '|') AS note FROM lines WHERE trim(text) <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)) WHERE NOT note AND an AND before IS NOT NULL"""),
    ),
    "author_abbreviations": (
        lambda s, d: op.author_abbreviations(_ko(s, d)),
        duck("corpus_ko", r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\(이하 ([^)]+)\)', 1)) AS term FROM corpus_ko"),
    ),
    "hanja_readings": (
        lambda s, d: op.hanja_readings(_ko(s, d)),
        duck("corpus_ko", r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '([가-힣]+)\([一-龥]+\)', 1)) AS term FROM corpus_ko"),
    ),
    "punct_spacing": (lambda s, d: op.punct_spacing(_ko(s, d)), duck("corpus_ko", PUNCT)),
    "unit_spacing": (lambda s, d: op.unit_spacing(_ko(s, d)), duck("corpus_ko", UNIT)),
    "spelling_stems": (lambda s, d: op.spelling_stems(_ko(s, d)), duck("corpus_ko", STEMS)),
    "finding_collect": (
        lambda s, d: op.finding_collect(_stages(s, d)),
        duck("corpus_ko", f"""SELECT doc_id, original, rule, corrected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, original ORDER BY stage, corrected) AS r FROM (
            SELECT doc_id, original, rule, corrected, 1 AS stage FROM ({PUNCT}) UNION ALL SELECT doc_id, original, rule, corrected, 2 FROM ({UNIT}) UNION ALL SELECT doc_id, original, rule, corrected, 3 FROM ({STEMS}))) WHERE r = 1"""),
    ),
    "paren_particle": (
        lambda s, d: op.paren_particle(_ko(s, d)),
        duck("corpus_ko", rf"""SELECT DISTINCT doc_id, 'paren_particle' AS rule, substr(m, 1, length(m) - length(a)) AS original, n || '(' || i || ')' || {_agree('n', 'p')} AS corrected
            FROM parts WHERE NOT regexp_matches(i, '{op.PAREN_LABEL}') AND p <> {_agree('n', 'p')}""", parts=PAREN),
    ),
    "fix_paren_agreement": (
        lambda s, d: op.fix_paren_agreement(_swapped(s, d), _ko(s, d)),
        duck("corpus_ko", rf"""SELECT doc_id, h || o AS original, h || f AS corrected FROM (SELECT doc_id, h, o, CASE WHEN regexp_matches(i, '{op.PAREN_LABEL}') THEN c ELSE {_agree('n', 'c')} END AS f
            FROM (SELECT DISTINCT doc_id, n, i, n || '(' || i || ')' AS h, p AS o, unnest(['은', '는', '으로', '로']) AS c FROM parts) WHERE o <> c) WHERE f <> o""", parts=PAREN),
    ),
    "anchor_narrow": (
        lambda s, d: op.anchor_narrow(_pages(s, d), _before_tags),
        duck("", r"""SELECT doc_id, original, arg_min(corrected, idx) AS corrected FROM (SELECT doc_id, idx, CASE WHEN a = t OR n = k THEN a ELSE t END AS original, CASE WHEN a = t OR n = k THEN af ELSE f END AS corrected
            FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a) AS k FROM narrowed) JOIN places USING (doc_id, a)) GROUP BY doc_id, original""",
             found=r"SELECT * FROM (SELECT doc_id, text, idx, t, regexp_replace(t, '([\p{L}\p{N}.])<', '\1 <', 'g') AS f FROM (SELECT page_id AS doc_id, html AS text, unnest(range(len(x))) AS idx, unnest(x) AS t FROM (SELECT *, regexp_extract_all(html, '[^ \t\n\v\f\r]+') AS x FROM pages))) WHERE f <> t",
             narrowed=rf"SELECT *, replace(af, ' ', '') AS a FROM (SELECT *, regexp_extract(f, '(?:[\p{{L}}\p{{N}}]{op.ANCHOR}*)?\S(?: \S+)* \S(?:{op.ANCHOR}*[\p{{L}}\p{{N}}])?') AS af FROM found)",
             places="SELECT doc_id, a, len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, length(a)) = a)) AS n FROM (SELECT DISTINCT doc_id, a, text FROM narrowed)"),
    ),
    "particle_agreement": (
        lambda s, d: op.particle_agreement(_m(s, d)),
        duck("morphemes", f"SELECT doc_id, word, f0 || form AS original, f0 || {_agree('f0', 'form')} AS corrected FROM ({LAG}) WHERE t0 = 'NNG' AND tag LIKE 'J%' AND f0 || form <> f0 || {_agree('f0', 'form')}"),
    ),
    "orphan_particle": (
        lambda s, d: op.orphan_particle(_ko(s, d)),
        duck("corpus_ko", f"""SELECT doc_id, b || ' ' || w AS original, b || {_agree('b', 'w')} AS corrected FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM (
            SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS w FROM (SELECT doc_id, string_split_regex(text, '[ \\n]') AS x FROM corpus_ko))) WHERE w IN ('은', '는', '을', '를', '와', '과') AND regexp_matches(b, '[가-힣]$')"""),
    ),
    "strip_particle_regex": (
        lambda s, d: op.strip_particle_regex(_ko(s, d)),
        duck("corpus_ko", f"SELECT word, regexp_replace(word, '^(.+?)({'|'.join(KO_PARTICLES)})$', '\\1') AS base FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[가-힣]+')) AS word FROM corpus_ko)"),
    ),
    "strip_particle_tags": (
        lambda s, d: op.strip_particle_tags(_m(s, d)),
        duck("morphemes", """SELECT doc_id, word, coalesce(string_agg(form, '' ORDER BY idx) FILTER (kept), '') AS base FROM (SELECT *, coalesce(idx <= max(CASE WHEN NOT starts_with(tag, 'J') THEN idx END) OVER (PARTITION BY doc_id, word), false) AS kept FROM morphemes) GROUP BY doc_id, word"""),
    ),
    "dependent_noun_spacing": (
        lambda s, d: op.dependent_noun_spacing(_m(s, d)),
        duck("morphemes", f"SELECT doc_id, word, f0 || form AS original, f0 || ' ' || form AS corrected FROM ({LAG}) WHERE tag = 'NNB' AND t0 = 'ETM' AND form IN ({', '.join(repr(x) for x in op.DEPENDENT_NOUNS)})"),
    ),
    "auxiliary_spacing": (
        lambda s, d: op.auxiliary_spacing(_m(s, d)),
        duck("morphemes", "SELECT doc_id, word, form, 'high' AS confidence FROM (SELECT *, lag(form) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM morphemes) WHERE tag = 'VX' AND b = '어야'"),
    ),
    "symbol_noun_spacing": (
        lambda s, d: op.symbol_noun_spacing(_m(s, d)),
        duck("morphemes", rf"""SELECT doc_id, word, string_agg(form, '' ORDER BY idx) AS original, string_agg(CASE WHEN cut THEN ' ' ELSE '' END || form, '' ORDER BY idx) AS corrected FROM (
            SELECT *, f0 IN ({CLOSING}) AND coalesce(c - length(form) - length(f0) - opened > 1, true) AND ((tag IN ('NNG', 'NNP', 'NR', 'NP') AND length(form) >= 2) OR (tag = 'NNB' AND form IN ({APART}))) AS cut FROM (
                SELECT *, max(CASE WHEN tag = 'SSO' THEN c END) OVER (PARTITION BY doc_id, word ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened
                FROM (SELECT *, lag(form) OVER w AS f0, sum(length(form)) OVER w AS c FROM morphemes WINDOW w AS (PARTITION BY doc_id, word ORDER BY idx)))) GROUP BY doc_id, word HAVING bool_or(cut)"""),
    ),
    "passive_join": (
        lambda s, d: op.passive_join(_ko(s, d), joined_analyses(s)),
        duck("corpus_ko", """SELECT doc_id, a || ' ' || b AS original, a || b AS corrected FROM pairs JOIN parts ON joined = a || b WHERE regexp_matches(a, '[아어여]$') AND regexp_matches(b, '^[지졌져질진]') GROUP BY doc_id, a, b
            HAVING NOT bool_or(tag IN ('NNG', 'NNP', 'NNB', 'NP', 'NR', 'SL', 'SH', 'SN') AND st >= length(a)) AND (bool_or(tag LIKE 'V%' AND st < length(a) AND en > length(a))
                OR (bool_or(tag LIKE 'E%' AND form IN ('아', '어', '여') AND st < length(a) AND en <= length(a)) AND bool_or(tag = 'VX' AND form = '지' AND st <= length(a) AND en > length(a))))""",
             pairs="SELECT DISTINCT doc_id, a, b FROM (SELECT doc_id, unnest(w) AS a, unnest(w[2:]) AS b FROM (SELECT doc_id, string_split(l, ' ') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM corpus_ko))) WHERE b IS NOT NULL",
             parts=f"SELECT * FROM (VALUES {', '.join(map(str, JOINED))}) v(joined, st, en, form, tag)"),
    ),
    "rule_cards_build": (lambda s, d: _digest(_rule_cards(s, d)), duck("lines", "SELECT * FROM cards", **RULE_CARDS)),
    "suspicious_cards": (
        lambda s, d: op.suspicious_cards(_rule_cards(s, d)).select("doc_id", "rule_id"),
        duck("lines", "SELECT doc_id, rule_id FROM cards WHERE length(rule_text) < 5 OR length(rule_text) > 200 OR (correct = '' AND incorrect = '')", **RULE_CARDS),
    ),
    "nominal_boundary": (
        lambda s, d: op.nominal_boundary(_m(s, d)),
        duck("morphemes", "SELECT doc_id, word, bool_and(tag LIKE 'N%' OR tag LIKE 'J%') AS nominal FROM morphemes GROUP BY doc_id, word"),
    ),
    "known_form": (
        lambda s, d: op.known_form(_m(s, d), _m(s, d).where("doc_id % 3 = 0").select(F.col("form").alias("word")).distinct()),
        duck("morphemes", "SELECT doc_id, word, bool_and(form IN (SELECT form FROM morphemes WHERE doc_id % 3 = 0)) AS known FROM morphemes WHERE (tag LIKE 'N%' AND length(form) >= 2) OR tag LIKE 'V%' GROUP BY doc_id, word"),
    ),
    "bracket_balance": (
        lambda s, d: op.bracket_balance(_docs(s, d).union(_ko(s, d).select("doc_id", "text"))).drop("depth"),
        duck("corpus_ko", """SELECT doc_id, kind, o AS opened, c AS closed, abs(o - c) AS imbalance FROM (SELECT doc_id, k.kind, length(text) - length(replace(text, k.a, '')) AS o, length(text) - length(replace(text, k.b, '')) AS c
            FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM corpus_ko), (VALUES ('round', '(', ')'), ('square', '[', ']'), ('curly', '{', '}')) k(kind, a, b)) WHERE o + c > 0"""),
    ),
    "term_similarity_all": (lambda s, d: op.term_similarity(_all_terms(s, d)), None),
    "term_similarity": (
        lambda s, d: op.term_similarity(_terms(s, d)),
        duck("lexicon", """SELECT *, distance AS letters FROM (SELECT a.word, b.word AS other, levenshtein(a.word, b.word) AS distance FROM t a JOIN t b ON a.word < b.word AND abs(length(a.word) - length(b.word)) <= 2) WHERE distance <= 2""",
             t="SELECT DISTINCT word FROM lexicon WHERE length(word) >= 5 AND regexp_full_match(word, '[a-z]+')"),
    ),
}
