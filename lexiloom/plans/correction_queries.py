"""Queries of the correction operators, over the corrections derived from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import corrections as op
from lexiloom.operators.consistency import compound_forms, compound_majority
from lexiloom.plans.consistency_queries import _docs, _tokens
from lexiloom.sources.tables import corrections, duck, guarded, lexicon, variant_corrections


def _c(s, d):
    return corrections(_docs(s, d))


def _whole(s, d):
    return variant_corrections(_docs(s, d), compound_majority(compound_forms(_docs(s, d)), lexicon(s, d)))


def _guarded(s, d):
    return guarded(_docs(s, d))


def _occ(s, d):
    return op.occurrence_index(_c(s, d), _docs(s, d))


def _rejected(s, d):
    """A third of all occurrences, by number and document."""
    return _occ(s, d).where("(doc_id + occ) % 3 = 0").select("doc_id", "original", "occ")


BASE = r"regexp_replace({}, '^(.{{2,}}?)(ing|ion|ed|es|ly|er|s)$', '\1')"
OCC = """SELECT doc_id, seq, original, status, occ, pos, pos + length(original) AS "end", total FROM (
  SELECT *, (sum(gap) OVER (PARTITION BY doc_id, original ORDER BY occ) + length(original) * occ)::BIGINT AS pos FROM (
    SELECT doc_id, seq, original, status, len(p) - 1 AS total, unnest(CASE WHEN len(p) = 1 THEN [NULL] ELSE range(len(p) - 1) END) AS occ, unnest(CASE WHEN len(p) = 1 THEN [NULL] ELSE list_transform(p[1:len(p) - 1], lambda x: length(x)) END) AS gap
    FROM (SELECT c.*, string_split(text, original) AS p FROM (SELECT doc_id, original, min(seq) AS seq, min(status) AS status FROM corrections GROUP BY ALL) c JOIN documents USING (doc_id))))"""
LETTERS = "list_sort(string_split(regexp_replace({}, '\\s', '', 'g'), ''))"
UNB = "(abs(len(string_split({0}, '(')) - len(string_split({0}, ')'))) + abs(len(string_split({0}, '[')) - len(string_split({0}, ']'))) + abs(len(string_split({0}, '{{')) - len(string_split({0}, '}}'))))"
SPACES = "list_transform(range(1, len(string_split({0}, ' ')) + 1), lambda i: length(array_to_string(string_split({0}, ' ')[1:i], '')))"
SQUEEZED = "regexp_replace({}, '\\s', '', 'g')"
CLAUSE = "regexp_replace({}, '([0-9]),([0-9])', '\\1\\2', 'g')"
COMMAS = f"(length({CLAUSE}) - length(replace({CLAUSE}, ',', '')))"
KERNEL = "regexp_replace({}, '[\\s,.()·;:]', '', 'g')"
ONLY_SPACES = "o <> c AND replace(o, ' ', '') = replace(c, ' ', '')"
_RUN = "'^([^0-9]*)([0-9]{1,16})([^0-9]*)$'"
_NAMES = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
READING = f"""regexp_replace(array_to_string(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN d[i] = '0' THEN '' ELSE (CASE WHEN d[i] = '1' AND (length(d) - i) % 4 > 0 THEN '' ELSE {_NAMES(op.DIGITS)}[d[i]::INT + 1] END) || {_NAMES(op.SMALL_UNITS)}[(length(d) - i) % 4 + 1] END
    || CASE WHEN (length(d) - i) % 4 = 0 AND (d::BIGINT // (10 ** (4 * ((length(d) - i) // 4)))::BIGINT) % 10000 > 0 THEN {_NAMES(op.LARGE_UNITS)}[(length(d) - i) // 4 + 1] ELSE '' END), ''), '^일만', '만')"""
SHARED = "len(list_filter(range(1, greatest(1, least(length(x.a), length(x.b))) + 1), lambda i: left(x.a, i) = left(x.b, i)))"
GUARD = f"""SELECT doc_id, seq, original, corrected, CASE
  WHEN t AND NOT regexp_matches(o, '[가-힣]') AND starts_with(o, c) AND length(c) < length(o) AND length(c) > 0 THEN 'nonkr_trim'
  WHEN t AND {UNB.format("o")} > 0 AND {UNB.format("o")} <> {UNB.format("c")} THEN 'bracket_change'
  WHEN NOT regexp_matches(o, '[A-Za-z]') AND o <> c AND regexp_replace(c, '\\s*[(（][^()（）]*[A-Za-z][^()（）]*[)）]', '', 'g') = o THEN 'english_gloss'
  WHEN t AND length(o) - length(c) >= 10 THEN 'bulk_delete'
  WHEN regexp_matches(o, '[0-9]') AND o <> c AND regexp_replace(o, '[0-9]', '', 'g') = regexp_replace(c, '[0-9]', '', 'g') THEN 'number_change'
  WHEN regexp_full_match(o, '[A-Za-z ]+') AND regexp_full_match(c, '[가-힣 ]+') THEN 'latin_to_hangul'
  WHEN o <> c AND regexp_replace(o, '[- ]', '', 'g') = regexp_replace(c, '[- ]', '', 'g') AND (contains(o, '-') OR contains(c, '-')) THEN 'hyphen_space'
  WHEN regexp_matches(o, '[–—-]') AND o <> c AND regexp_replace({SQUEEZED.format("o")}, '[–—-]', '·', 'g') = {SQUEEZED.format("c")} THEN 'dash_to_middot'
  WHEN regexp_full_match(o, '\\(?[^()0-9]+[0-9]{{4}}[a-z]?\\)?') AND o <> c AND {KERNEL.format("o")} = {KERNEL.format("c")} THEN 'citation_reformat'
  WHEN regexp_matches(o, '[:：]') AND o <> c AND regexp_replace({SQUEEZED.format("o")}, '[:：]', '·', 'g') = {SQUEEZED.format("c")} THEN 'colon_to_middot'
  WHEN t AND {ONLY_SPACES} AND len(sc) > len(so) AND list_has_all(sc, so) THEN 'compound_split'
  WHEN {ONLY_SPACES} AND len(sc) < len(so) AND list_has_all(so, sc) AND len(list_filter(string_split(c, ' '), lambda x: NOT list_contains(string_split(o, ' '), x) AND NOT regexp_full_match(x, '\\p{{L}}{{4,14}}'))) = 0 THEN 'compound_join'
  WHEN o <> c AND replace(o, ',', '') = replace(c, ',', '') AND {COMMAS.format("o", "o")} <> {COMMAS.format("c", "c")} THEN 'comma_edit'
  WHEN coalesce(p1 || {READING} || p3 = c, false) THEN 'numeral_to_hangul'
  WHEN o <> c AND lower(o) = lower(c) THEN 'latin_case'
  WHEN len(string_split(o, ' ')) = len(string_split(c, ' ')) AND len(ch) >= 2 AND len(list_filter(ch, lambda x: {SHARED} < 2)) = 0
    AND len(list_distinct(list_transform(ch, lambda x: x.a[{SHARED} + 1:] || '>' || x.b[{SHARED} + 1:]))) >= 2 THEN 'grammar_rewrite'
  WHEN t AND o <> c AND length(o) = length(c) AND {LETTERS.format("o")} = {LETTERS.format("c")} THEN 'syllable_reorder'
  WHEN regexp_full_match(o, '({"|".join(op.SURNAMES)})( [가-힣]){{1,3}}') AND replace(o, ' ', '') = c THEN 'name_join' END AS guard
  FROM (SELECT *, original AS o, corrected AS c, source = 'ai_typo' AS t, {SPACES.format("original")} AS so, {SPACES.format("corrected")} AS sc,
    CASE WHEN regexp_matches(original, {_RUN}) THEN regexp_extract(original, {_RUN}, 1) END AS p1, CASE WHEN regexp_matches(original, {_RUN}) THEN regexp_extract(original, {_RUN}, 2) END AS d, CASE WHEN regexp_matches(original, {_RUN}) THEN regexp_extract(original, {_RUN}, 3) END AS p3,
    list_filter(list_transform(range(1, len(string_split(original, ' ')) + 1), lambda i: struct_pack(a := string_split(original, ' ')[i], b := coalesce(string_split(corrected, ' ')[i], ''))), lambda x: x.a <> x.b) AS ch
    FROM guarded WHERE source IN ('ai_typo', 'ai_polish'))"""
LIVE = "SELECT doc_id, original, min(seq) AS seq, arg_min(corrected, seq) AS corrected, 'accepted' AS status FROM corrections WHERE status = 'accepted' AND trim(corrected) <> '' AND original <> corrected AND NOT contains(corrected, chr(10)) GROUP BY doc_id, original"
PLACES = OCC.replace("SELECT doc_id, original, min(seq) AS seq, min(status) AS status FROM corrections GROUP BY ALL", "SELECT * FROM live")
#: Greedy choice: a document's spans, the longest first, folded into those kept.
RESOLVED = """SELECT doc_id, s.pos AS pos, s."end" AS "end", NOT list_contains(kept, s) AS shadowed FROM (SELECT doc_id, kept, unnest(spans) AS s FROM (
  SELECT doc_id, spans, list_reduce(list_transform(spans, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.pos < x[1]."end" AND x[1].pos < y."end")) > 0 THEN a ELSE list_concat(a, x) END) AS kept
  FROM (SELECT doc_id, list(struct_pack(n := pos - "end", pos := pos, "end" := "end") ORDER BY pos - "end", pos) AS spans FROM (SELECT DISTINCT doc_id, pos, "end" FROM places WHERE pos IS NOT NULL) GROUP BY doc_id)))"""
SPANS = """SELECT p.doc_id, p.original, l.corrected, p.pos, p."end", r.shadowed FROM places p JOIN resolved r ON r.doc_id = p.doc_id AND r.pos = p.pos AND r."end" = p."end" JOIN live l ON l.doc_id = p.doc_id AND l.original = p.original WHERE p.pos IS NOT NULL"""
APPLY = {"live": LIVE, "places": PLACES, "resolved": RESOLVED, "spans": SPANS}
ERRATA = """SELECT doc_id, seq, original, corrected, CASE WHEN category <> '' THEN category ELSE source END AS type,
  CASE WHEN status = 'rejected' THEN 'rejected' WHEN status = 'pending' THEN 'review' WHEN trim(corrected) = '' THEN 'todo' WHEN original = corrected THEN 'failed' ELSE 'applied' END AS outcome FROM corrections"""
WORDS = r"regexp_extract_all(lower({}), '\p{{L}}+')"
C, G = "tokens corrections", "tokens corrections guarded"

ALL = {
    "correction_validity": (
        lambda s, d: op.correction_validity(_c(s, d), _docs(s, d)),
        duck(C, """SELECT c.doc_id, seq, original, CASE WHEN trim(corrected) = '' THEN 'blank' WHEN original = corrected THEN 'noop' WHEN contains(corrected, chr(10)) THEN 'newline'
            WHEN NOT coalesce(contains(text, original), false) THEN 'ghost' ELSE 'valid' END AS reason FROM corrections c LEFT JOIN documents d USING (doc_id)"""),
    ),
    "merge_first_wins": (
        lambda s, d: op.merge_first_wins(_c(s, d), F.when(F.col("source") == "rule", 0).when(F.col("source") == "dict", 1).otherwise(2)),
        duck(C, """SELECT doc_id, original, seq, corrected, source, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, original ORDER BY CASE source WHEN 'rule' THEN 0 WHEN 'dict' THEN 1 ELSE 2 END, seq) AS r
            FROM corrections WHERE trim(corrected) <> '' AND original <> corrected) WHERE r = 1"""),
    ),
    "canonical_per_base": (
        lambda s, d: op.canonical_per_base(_c(s, d)),
        duck(C, f"""SELECT doc_id, base, original, corrected, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY confidence <> 'high', seq) AS r
            FROM (SELECT *, {BASE.format("original")} AS base FROM corrections WHERE source <> 'ai_polish') WHERE length(base) >= 2) WHERE r = 1"""),
    ),
    "variant_confidence": (
        lambda s, d: op.variant_confidence(_c(s, d)),
        duck(C, f"""SELECT doc_id, seq, original, CASE WHEN count(*) OVER w >= 2 AND bool_or(confidence = 'high') OVER w AND NOT contains(reason, 'context') THEN 'high' ELSE confidence END AS confidence
            FROM (SELECT *, {BASE.format("original")} AS base FROM corrections) WINDOW w AS (PARTITION BY doc_id, base)"""),
    ),
    "frequency_demote": (
        lambda s, d: op.frequency_demote(_c(s, d), _docs(s, d)),
        duck(C, "SELECT doc_id, seq, original, n, CASE WHEN n >= 3 THEN 'low' ELSE confidence END AS confidence FROM (SELECT c.*, (length(text) - length(replace(text, original, ''))) // length(original) AS n FROM corrections c JOIN documents USING (doc_id) WHERE c.source = 'dict')"),
    ),
    "redundant_variant": (
        lambda s, d: op.redundant_variant(_c(s, d)),
        duck(C, """SELECT DISTINCT v.doc_id, v.original, v.corrected FROM k v JOIN k b ON v.doc_id = b.doc_id AND starts_with(v.original, b.original) AND length(b.original) BETWEEN 2 AND length(v.original) - 1
            WHERE starts_with(v.corrected, b.corrected) AND length(v.corrected) > length(b.corrected) AND v.corrected[length(b.corrected) + 1:] = v.original[length(b.original) + 1:]""",
             k="SELECT DISTINCT doc_id, original, corrected FROM corrections WHERE source <> 'ai_polish'"),
    ),
    "subset_relation": (
        lambda s, d: op.subset_relation(_c(s, d)),
        duck(C, "SELECT a.doc_id, a.original, arg_min(b.original, struct_pack(s := b.seq, l := b.original)) AS longer FROM k a JOIN k b ON a.doc_id = b.doc_id AND length(b.original) > length(a.original) AND contains(b.original, a.original) GROUP BY ALL",
             k="SELECT doc_id, original, min(seq) AS seq FROM corrections GROUP BY ALL"),
    ),
    "reverse_correction": (
        lambda s, d: op.reverse_correction(_c(s, d)),
        duck(C, "SELECT a.doc_id, a.corrected AS original, a.original AS corrected, b.doc_id IS NOT NULL AS present FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND a.original = b.corrected AND a.corrected = b.original",
             k="SELECT DISTINCT doc_id, original, corrected FROM corrections WHERE original <> corrected AND trim(corrected) <> ''"),
    ),
    "auto_accept": (lambda s, d: op.auto_accept(_c(s, d)), duck(C, "SELECT doc_id, seq, original, CASE WHEN source = 'dict' THEN 'accepted' WHEN confidence = 'low' THEN 'rejected' ELSE 'accepted' END AS status FROM corrections")),
    "corrections_export": (
        lambda s, d: op.corrections_export(_c(s, d)),
        duck(C, "SELECT doc_id, id, to_json(struct_pack(id := id, original := original, corrected := corrected, confidence := confidence, status := 'pending'))::VARCHAR AS record FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS id FROM corrections)"),
    ),
    "occurrence_index": (_occ, duck(C, OCC)),
    "interval_containment": (
        lambda s, d: op.interval_containment(_occ(s, d)),
        duck(C, """SELECT i.doc_id, i.pos, i."end", arg_max(o.pos, (o."end" - o.pos) * 10000000 - o.pos) AS o_pos, arg_max(o."end", (o."end" - o.pos) * 10000000 - o.pos) AS o_end FROM k i JOIN k o
            ON i.doc_id = o.doc_id AND o.pos <= i.pos AND i."end" <= o."end" AND o."end" - o.pos > i."end" - i.pos GROUP BY ALL""", k=f'SELECT DISTINCT doc_id, pos, "end" FROM ({OCC}) WHERE pos IS NOT NULL'),
    ),
    "occurrence_skip": (
        lambda s, d: op.occurrence_skip(_occ(s, d).withColumn("status", F.when((F.col("occ") + F.col("seq")) % 3 == 0, "rejected").otherwise(F.col("status")))).withColumn("skip", F.array_join("skip", ",")),
        duck(C, """SELECT doc_id, original, coalesce(array_to_string(list_sort(list(occ) FILTER (st <> 'accepted')), ','), '') AS skip, count(*) AS visible, bool_or(st = 'accepted') AS any_accepted
            FROM (SELECT *, CASE WHEN (occ + seq) % 3 = 0 THEN 'rejected' ELSE status END AS st FROM o WHERE pos IS NOT NULL) GROUP BY doc_id, original""", o=OCC),
    ),
    "review_summary": (
        lambda s, d: op.review_summary(_c(s, d)),
        duck(C, "SELECT category, count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status NOT IN ('accepted', 'rejected')) AS pending FROM corrections GROUP BY ROLLUP (category)"),
    ),
    "split_decisions": (
        lambda s, d: op.split_decisions(_c(s, d)),
        duck(C, "SELECT doc_id, original, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected FROM corrections GROUP BY ALL HAVING accepted > 0 AND rejected > 0"),
    ),
    "apply_to_corpus": (
        lambda s, d: op.apply_to_corpus(_docs(s, d), _c(s, d)),
        duck(C, """SELECT d.doc_id, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda i: text[CASE WHEN i = 1 THEN 1 ELSE x[i - 1].e + 1 END : x[i].p] || x[i].c), '') || text[x[-1].e + 1:] END AS text, coalesce(len(x), 0)::INT AS n_edits
            FROM documents d LEFT JOIN (SELECT doc_id, list(struct_pack(p := pos, e := "end", c := corrected) ORDER BY pos) AS x FROM spans WHERE NOT shadowed GROUP BY doc_id) s ON s.doc_id = d.doc_id""", **APPLY),
    ),
    "apply_rejected": (
        lambda s, d: op.apply_to_corpus(_docs(s, d), _c(s, d), _rejected(s, d)),
        duck(C, """SELECT d.doc_id, CASE WHEN x IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(x) + 1), lambda i: text[CASE WHEN i = 1 THEN 1 ELSE x[i - 1].e + 1 END : x[i].p] || x[i].c), '') || text[x[-1].e + 1:] END AS text, coalesce(len(x), 0)::INT AS n_edits
            FROM documents d LEFT JOIN (SELECT doc_id, list(struct_pack(p := pos, e := "end", c := corrected) ORDER BY pos) AS x FROM spans WHERE NOT shadowed GROUP BY doc_id) s ON s.doc_id = d.doc_id""",
             **{**APPLY, "places": f"SELECT * FROM ({PLACES}) WHERE pos IS NOT NULL AND (doc_id + occ) % 3 <> 0"}),
    ),
    "apply_detail": (
        lambda s, d: op.apply_detail(_docs(s, d), _c(s, d)),
        duck(C, """SELECT a.doc_id, a.original, coalesce(n, 0)::BIGINT AS replaced, coalesce(m, 0)::BIGINT AS shadowed, CASE WHEN NOT ok THEN 'not_accepted' WHEN l.doc_id IS NULL THEN 'void' WHEN n IS NULL THEN 'not_found' WHEN n = 0 THEN 'consumed' WHEN m > 0 THEN 'partial' ELSE 'applied' END AS outcome
            FROM (SELECT doc_id, original, bool_or(status = 'accepted') AS ok FROM corrections GROUP BY ALL) a LEFT JOIN live l ON l.doc_id = a.doc_id AND l.original = a.original
            LEFT JOIN (SELECT doc_id, original, count(*) FILTER (NOT shadowed) AS n, count(*) FILTER (shadowed) AS m FROM spans GROUP BY ALL) s ON s.doc_id = a.doc_id AND s.original = a.original""", **APPLY),
    ),
    "dictionary_revalidate": (
        lambda s, d: op.dictionary_revalidate(_c(s, d), lexicon(s, d)),
        duck(C + " lexicon", f"""SELECT c.doc_id, c.seq, original, CASE WHEN b.seq IS NOT NULL THEN 'low' ELSE confidence END AS confidence FROM corrections c LEFT JOIN (
            SELECT DISTINCT doc_id, seq FROM (SELECT doc_id, seq, {WORDS.format("original")} AS o, unnest({WORDS.format("corrected")}) AS w FROM corrections) x LEFT JOIN lexicon l ON l.word = x.w
            WHERE NOT list_contains(o, w) AND l.word IS NULL) b ON b.doc_id = c.doc_id AND b.seq = c.seq"""),
    ),
    "glossary_terms": (
        lambda s, d: op.glossary_terms(_c(s, d)),
        duck(C, rf"""SELECT doc_id, ob AS original_base, cb AS corrected_base, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS rank FROM (
            SELECT doc_id, ob, cb, min(seq) AS seq FROM (SELECT doc_id, seq, {BASE.format("original")} AS ob, {BASE.format("corrected")} AS cb FROM corrections WHERE confidence = 'high')
            WHERE ob <> cb AND regexp_full_match(ob, '[\p{{L}}0-9]{{2,20}}') AND regexp_full_match(cb, '[\p{{L}}0-9]{{2,20}}') GROUP BY ALL)) WHERE rank <= 50"""),
    ),
    "demote_by_reason": (
        lambda s, d: op.demote_by_reason(_c(s, d)),
        duck(C, """SELECT doc_id, seq, why, CASE WHEN why IS NOT NULL THEN 'low' ELSE confidence END AS confidence FROM (SELECT *, CASE WHEN regexp_matches(lower(reason), 'likely|perhaps|may be') THEN 'hedged'
            WHEN contains(reason, 'convention') THEN 'convention' WHEN contains(reason, 'context') THEN 'context' END AS why FROM corrections)"""),
    ),
    "guard_chain": (lambda s, d: op.guard_chain(_guarded(s, d)), duck(G, GUARD)),
    "guard_counts": (lambda s, d: op.guard_counts(_guarded(s, d)), duck(G, f"SELECT coalesce(guard, 'kept') AS guard, count(*) AS n FROM ({GUARD}) GROUP BY 1")),
    "errata_rows": (lambda s, d: op.errata_rows(_c(s, d)), duck(C, ERRATA)),
    "apply_summary": (
        lambda s, d: op.apply_summary(op.errata_rows(_c(s, d))),
        duck(C, """SELECT doc_id, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'todo') AS todo, count(*) FILTER (outcome = 'rejected') AS rejected,
            count(*) FILTER (outcome = 'review') AS review, coalesce(array_to_string(list_sort(list(original) FILTER (outcome = 'failed'))[1:5], ','), '') AS failures FROM e GROUP BY doc_id""", e=ERRATA),
    ),
    "guard_chain_whole": (lambda s, d: op.guard_chain(_whole(s, d)), None),
    "guard_counts_whole": (lambda s, d: op.guard_counts(_whole(s, d)), None),
}
