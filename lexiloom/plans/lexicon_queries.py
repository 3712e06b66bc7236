"""Queries of the lexicon operators, over the lexicon derived from benchmark passages and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import lexicon as op
from lexiloom.plans.consistency_queries import _docs, _tokens
from lexiloom.sources.tables import duck, lexicon


def _words(s, d):
    return _tokens(s, d).select(F.lower("surface").alias("word"))


def _pairs(s, d):
    """Each lexicon word of five letters or more, written with its second letter doubled (or, every third, with 'x')."""
    w = lexicon(s, d).where("length(word) >= 5")
    n = F.length("word")
    nonstd = F.when(n % 2 == 0, F.expr("concat(substring(word, 1, 2), substring(word, 2))")).otherwise(F.expr("substring(word, 1, length(word) - 1)"))
    return w.select(nonstd.alias("nonstd"), F.when(n % 4 == 1, F.concat("word", F.lit("x"))).otherwise(F.col("word")).alias("norm"))


def _senses(s, d):
    n = F.length("word")
    w = lexicon(s, d)
    every = w.select("word", F.lit(1).alias("order"), F.when(n % 3 == 0, F.concat(F.lit("variant of "), F.reverse("word"))).otherwise("a thing").alias("definition"))
    return every.unionByName(w.where("length(word) % 6 = 0").select("word", F.lit(2).alias("order"), F.lit("a real sense").alias("definition")))


def _cards(s, d):
    w = lexicon(s, d)
    return w.select(
        F.concat(F.lit("R"), F.length("word"), F.substring("word", 1, 2)).alias("rule_id"), F.array("word", F.concat("word", F.lit(" (old)"))).alias("triggers"), F.array(F.concat("word", F.lit("s"))).alias("wrong"),
        (F.length("word") % 4).alias("priority"),
    )


def _rules(s, d):
    return _cards(s, d).groupBy("rule_id").agg(F.min("priority").alias("priority"))


def _exceptions(s, d):
    return lexicon(s, d).where("length(word) % 4 = 0").select(F.col("word").alias("term"), F.when(F.length("word") % 8 == 0, "all").otherwise("spacing").alias("scope"))


def _cache(s, d):
    return lexicon(s, d).select("word", (F.length("word") % 2).alias("found"))


def _findings(s, d):
    return op.dictionary_screen(_tokens(s, d), lexicon(s, d).where("length(word) % 4 <> 0")).select("doc_id", F.col("word").alias("term"), "n")


BASE = r"regexp_replace(word, '^(.{2,}?)(ing|ion|ed|es|ly|er|s)$', '\1')"
WORDS = "SELECT lower(surface) AS word FROM tokens"
PAIRS = """SELECT CASE WHEN length(word) % 2 = 0 THEN word[1:2] || word[2:] ELSE word[1:length(word) - 1] END AS nonstd, CASE WHEN length(word) % 4 = 1 THEN word || 'x' ELSE word END AS norm FROM lexicon WHERE length(word) >= 5"""
SENSES = """SELECT word, 1 AS ord, CASE WHEN length(word) % 3 = 0 THEN 'variant of ' || reverse(word) ELSE 'a thing' END AS definition FROM lexicon UNION ALL SELECT word, 2, 'a real sense' FROM lexicon WHERE length(word) % 6 = 0"""
EXACT = "SELECT w.word, m.word IS NOT NULL AS exists, m.source, m.register FROM (SELECT DISTINCT word FROM words) w LEFT JOIN (SELECT word, min(source) AS source, arg_min(register, struct_pack(s := source, r := register)) AS register FROM {lex} GROUP BY word) m ON w.word = m.word"
FALLBACK = f"""SELECT word, kind IS NOT NULL AS exists, coalesce(kind, 'none') AS match_kind FROM (
  SELECT w.word, CASE WHEN length(w.word) < 2 THEN 'short' WHEN a.plain THEN 'exact' WHEN a.k IS NOT NULL THEN 'homograph' WHEN b.k IS NOT NULL THEN 'base' END AS kind
  FROM (SELECT DISTINCT word, {BASE} AS base FROM words) w LEFT JOIN names a ON a.k = w.word LEFT JOIN names b ON b.k = w.base)"""
NAMES = "SELECT regexp_replace(word, '[0-9]{{2}}$', '') AS k, bool_or(NOT regexp_matches(word, '[0-9]{{2}}$')) AS plain FROM {lex} GROUP BY 1"
SCREEN = """SELECT t.doc_id, t.word, t.n, k.reason FROM (SELECT doc_id, lower(surface) AS word, count(*) AS n FROM tokens GROUP BY ALL) t
  JOIN (SELECT f.word, CASE WHEN NOT f.exists THEN 'unknown' WHEN e.source = 'opendict' AND e.register IN ('dialect', 'archaic', 'north', 'obsolete') THEN 'register' END AS reason FROM fallback f JOIN exact e USING (word)) k USING (word)
  WHERE length(t.word) >= 2 AND k.reason IS NOT NULL"""
GUARD = """SELECT nonstd, norm, reason = 'ok' AS ok, reason FROM (SELECT *, CASE WHEN nonstd IN (SELECT word FROM lexicon WHERE register NOT IN ('dialect', 'archaic', 'north', 'obsolete')) THEN 'nonstd_is_standard'
  WHEN norm NOT IN (SELECT word FROM lexicon) THEN 'norm_missing' ELSE 'ok' END AS reason FROM pairs)"""
LOOKUP = f"""SELECT word, n, norm || word[length(nonstd) + 1:] AS corrected FROM (
  SELECT word, n, arg_min(p.nonstd, struct_pack(r := rank, m := p.norm)) AS nonstd, arg_min(p.norm, struct_pack(r := rank, m := p.norm)) AS norm
  FROM (SELECT word, n, 0 AS rank, word AS key FROM c UNION ALL SELECT word, n, 1, {BASE} FROM c) k JOIN pairs p ON p.nonstd = k.key GROUP BY word, n)"""
COUNTS = "SELECT word, count(*) AS n FROM words GROUP BY word"
CARDS = "SELECT 'R' || length(word) || word[1:2] AS rule_id, [word, word || ' (old)'] AS triggers, [word || 's'] AS wrong, length(word) % 4 AS priority FROM lexicon"
TRIGGERS = r"""SELECT DISTINCT surface, rule_id FROM (SELECT rule_id, trim(string_split(s, '(')[1]) AS surface FROM (SELECT rule_id, unnest(list_concat(triggers, wrong)) AS s FROM cards))
  WHERE NOT regexp_matches(surface, '\s') AND length(surface) >= 2 AND regexp_matches(surface, '\p{L}')"""
NAMES_ALL, EXACT_ALL = NAMES.format(lex="lexicon"), EXACT.format(lex="lexicon")
PART = "SELECT * FROM lexicon WHERE length(word) % 4 <> 0"

ALL = {
    "headword_normalise": (
        lambda s, d: op.headword_normalise(_docs(s, d).select(F.explode(F.split("text", "\n")).alias("word")).distinct()),
        duck("lines", "SELECT trim(string_split(replace(replace(word, '-', ''), '^', ''), '(')[1]) AS word FROM (SELECT DISTINCT text AS word FROM lines) WHERE trim(string_split(replace(replace(word, '-', ''), '^', ''), '(')[1]) <> ''"),
    ),
    "single_token_filter": (
        lambda s, d: op.single_token_filter(_pairs(s, d)),
        duck("lexicon", r"SELECT * FROM pairs WHERE nonstd <> norm AND length(nonstd) >= 2 AND length(norm) >= 2 AND NOT regexp_matches(nonstd, '\s') AND NOT regexp_matches(norm, '\s')", pairs=PAIRS),
    ),
    "lexicon_exact": (lambda s, d: op.lexicon_exact(_words(s, d), lexicon(s, d)), duck("tokens lexicon", EXACT_ALL, words=WORDS)),
    "lexicon_fallback": (lambda s, d: op.lexicon_fallback(_words(s, d), lexicon(s, d)), duck("tokens lexicon", FALLBACK, words=WORDS, names=NAMES_ALL)),
    "noun_headword": (
        lambda s, d: op.noun_headword(_words(s, d), lexicon(s, d)),
        duck("tokens lexicon", "SELECT DISTINCT word FROM words WHERE word IN (SELECT word FROM lexicon WHERE pos IN ('noun', 'pronoun'))", words=WORDS),
    ),
    "register_filter": (
        lambda s, d: op.register_filter(op.lexicon_exact(_words(s, d), lexicon(s, d))),
        duck("tokens lexicon", "SELECT *, CASE WHEN source = 'opendict' AND register IN ('dialect', 'archaic', 'north', 'obsolete') THEN 'notable' ELSE 'plain' END AS register_class FROM exact", words=WORDS, exact=EXACT_ALL),
    ),
    "dictionary_screen": (lambda s, d: op.dictionary_screen(_tokens(s, d), lexicon(s, d)), duck("tokens lexicon", SCREEN, words=WORDS, names=NAMES_ALL, fallback=FALLBACK, exact=EXACT_ALL)),
    "norm_pair_lookup": (lambda s, d: op.norm_pair_lookup(_tokens(s, d), _pairs(s, d)), duck("tokens lexicon", LOOKUP, words=WORDS, pairs=PAIRS, c=COUNTS)),
    "norm_map_build": (
        lambda s, d: op.norm_map_build(_senses(s, d)),
        duck("lexicon", "SELECT word AS nonstd, min(definition[12:]) AS norm FROM senses WHERE starts_with(definition, 'variant of ') AND word NOT IN (SELECT word FROM senses WHERE NOT starts_with(definition, 'variant of ')) GROUP BY word", senses=SENSES),
    ),
    "pair_guard": (lambda s, d: op.pair_guard(_pairs(s, d), lexicon(s, d)), duck("lexicon", GUARD, pairs=PAIRS)),
    "pair_publish": (
        lambda s, d: op.pair_publish(op.pair_guard(_pairs(s, d), lexicon(s, d))),
        duck("lexicon", "SELECT nonstd, min(norm) AS norm, count(DISTINCT norm) - 1 AS conflicts FROM guarded WHERE ok GROUP BY nonstd", pairs=PAIRS, guarded=GUARD),
    ),
    "house_vs_standard": (
        lambda s, d: op.house_vs_standard(_pairs(s, d), op.norm_map_build(_senses(s, d)).unionByName(op.pair_publish(op.pair_guard(_pairs(s, d), lexicon(s, d))).select("nonstd", "norm"))),
        duck("lexicon", "SELECT p.nonstd, p.norm, s.norm AS standard_norm, coalesce(p.norm <> s.norm, false) AS conflict, coalesce(s.norm, p.norm) AS used FROM pairs p LEFT JOIN std s USING (nonstd)", pairs=PAIRS, guarded=GUARD, senses=SENSES,
             std="SELECT word AS nonstd, min(definition[12:]) AS norm FROM senses WHERE starts_with(definition, 'variant of ') AND word NOT IN (SELECT word FROM senses WHERE NOT starts_with(definition, 'variant of ')) GROUP BY word UNION ALL SELECT nonstd, min(norm) FROM guarded WHERE ok GROUP BY nonstd"),
    ),
    "component_of_pair": (
        lambda s, d: op.component_of_pair(_words(s, d), _pairs(s, d)),
        duck("tokens lexicon", """SELECT DISTINCT word FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM (SELECT DISTINCT word FROM words)) w, unnest(range(2, 15)) AS t(n)
            WHERE i + n - 1 <= length(word) AND word[i:i + n - 1] IN (SELECT nonstd FROM pairs)""", words=WORDS, pairs=PAIRS),
    ),
    "exception_suppress": (
        lambda s, d: op.exception_suppress(_findings(s, d), _exceptions(s, d), "spacing"),
        duck("tokens lexicon", f"""SELECT doc_id, word AS term, n FROM ({SCREEN}) WHERE word NOT IN (SELECT word FROM lexicon WHERE length(word) % 4 = 0)""", words=WORDS, part=PART, names=NAMES.format(lex="part"), fallback=FALLBACK, exact=EXACT.format(lex="part")),
    ),
    "lookup_cache": (
        lambda s, d: op.lookup_cache(_words(s, d), _cache(s, d)),
        duck("tokens lexicon", "SELECT w.word, length(l.word) % 2 AS found FROM (SELECT DISTINCT word FROM words) w LEFT JOIN lexicon l USING (word)", words=WORDS),
    ),
    "source_swap": (
        lambda s, d: op.source_swap(lexicon(s, d), lexicon(s, d).withColumn("register", F.lit("new")), "opendict"),
        duck("lexicon", "SELECT word, pos, word_type, CASE WHEN source = 'opendict' THEN 'new' ELSE register END AS register, source FROM lexicon"),
    ),
    "lexicon_union": (
        lambda s, d: lexicon(s, d).where("source = 'stdict'").unionByName(lexicon(s, d).where("source = 'opendict'")),
        duck("lexicon", "SELECT * FROM lexicon"),
    ),
    "lexicon_gap": (lambda s, d: op.lexicon_gap(_words(s, d), lexicon(s, d)), duck("tokens lexicon", "SELECT DISTINCT word FROM words WHERE word NOT IN (SELECT word FROM lexicon)", words=WORDS)),
    "source_counts": (
        lambda s, d: op.source_counts(lexicon(s, d), lexicon(s, d).where("length(word) > 4")),
        duck("lexicon", "SELECT source, register, count(*) AS n_before, count(*) FILTER (length(word) > 4) AS n_after FROM lexicon GROUP BY ALL"),
    ),
    "publish_gate": (
        lambda s, d: op.publish_gate(lexicon(s, d).where("length(word) > 4 or source = 'stdict'"), lexicon(s, d), 1000, "stdict"),
        duck("lexicon", """SELECT 'headwords' AS "check", count(*) AS actual, 1000 AS "limit", count(*) >= 1000 AS pass FROM c UNION ALL SELECT 'blank', 0, 0, true
            UNION ALL SELECT 'kept_source', a, b, a = b FROM (SELECT (SELECT count(*) FROM c WHERE source = 'stdict') AS a, (SELECT count(*) FROM lexicon WHERE source = 'stdict') AS b)
            UNION ALL SELECT 'sources', a, b, a = b FROM (SELECT (SELECT count(DISTINCT source) FROM c) AS a, (SELECT count(DISTINCT source) FROM lexicon) AS b)""", c="SELECT * FROM lexicon WHERE length(word) > 4 OR source = 'stdict'"),
    ),
    "lexicon_status": (lambda s, d: op.lexicon_status(lexicon(s, d)), duck("lexicon", "SELECT source, count(*) AS rows, count(DISTINCT word) AS words, count(*) FILTER (register <> '') AS with_register FROM lexicon GROUP BY source")),
    "latest_export": (
        lambda s, d: op.latest_export(lexicon(s, d).withColumn("version", F.concat(F.lit("2026-0"), F.length("word") % 3))),
        duck("lexicon", "SELECT *, '2026-0' || length(word) % 3 AS version FROM lexicon WHERE length(word) % 3 = (SELECT max(length(word) % 3) FROM lexicon)"),
    ),
    "table_publish": (
        lambda s, d: op.table_publish(_pairs(s, d), "nonstd", "norm", "last"),
        duck("lexicon", "SELECT nonstd, max(norm) AS norm FROM pairs GROUP BY nonstd", pairs=PAIRS),
    ),
    "headword_sample": (
        lambda s, d: op.headword_sample(lexicon(s, d), 300),
        duck("lexicon", "SELECT DISTINCT word FROM lexicon WHERE register NOT IN ('dialect', 'archaic', 'north', 'obsolete') AND length(word) >= 2 ORDER BY word LIMIT 300"),
    ),
    "trigger_explode": (lambda s, d: op.trigger_explode(_cards(s, d)), duck("lexicon", TRIGGERS, cards=CARDS)),
    "rule_retrieve": (
        lambda s, d: op.rule_retrieve(_tokens(s, d), op.trigger_explode(_cards(s, d)), _rules(s, d)),
        duck("tokens lexicon", """SELECT doc_id, rule_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority, hits DESC, rule_id) AS rank FROM (
            SELECT doc_id, t.rule_id, sum(n)::BIGINT AS hits, any_value(r.priority) AS priority FROM (SELECT doc_id, lower(surface) AS surface, count(*) AS n FROM tokens GROUP BY ALL) w JOIN trig t USING (surface)
            JOIN (SELECT rule_id, min(priority) AS priority FROM cards GROUP BY 1) r ON r.rule_id = t.rule_id GROUP BY doc_id, t.rule_id)) WHERE rank <= 12""", cards=CARDS, trig=TRIGGERS),
    ),
    "no_change_gate": (
        lambda s, d: op.no_change_gate(lexicon(s, d), _pairs(s, d)),
        duck("lexicon", f"SELECT word, corrected FROM ({LOOKUP}) WHERE corrected <> word", pairs=PAIRS, c="SELECT word, count(*) AS n FROM lexicon GROUP BY word"),
    ),
    "no_change_union": (
        lambda s, d: lexicon(s, d).select("word").union(_pairs(s, d).select("norm")).distinct(),
        duck("lexicon", "SELECT word FROM lexicon UNION SELECT norm FROM pairs", pairs=PAIRS),
    ),
}
