"""Queries of the consistency operators."""

from __future__ import annotations

from lexiloom.operators import consistency as op
from lexiloom.sources.shared import written
from lexiloom.sources.tables import corrections, duck, lexicon, read, tokens


def _docs(s, d):
    return read(s, d, "documents").select("doc_id", "text")


def _tokens(s, d):
    return tokens(_docs(s, d))


def _variants(s, d):
    return op.spacing_variants(_docs(s, d))


def _proposals(s, d):
    return op.compound_majority(op.compound_forms(_docs(s, d)), lexicon(s, d))


def _cards(s, d):
    return op.compound_cards(_proposals(s, d))


def _open_cards(s, d):
    """Cards of what the corrections of the documents do not take already; families are of all cards."""
    docs = _docs(s, d)
    return op.compound_cards(op.uncovered(written(_proposals(s, d), "proposals"), corrections(docs), docs))


def _contested(s, d):
    cards = written(_cards(s, d), "cards")
    return op.contested_words(cards, op.family_analysis(cards))


VARIANTS = """SELECT key, form, count(*) AS n FROM (
  SELECT form, replace(form, ' ', '') AS key FROM (
    SELECT unnest([s0, CASE WHEN g1 = ' ' THEN s0 || ' ' || s1 END, CASE WHEN g1 = ' ' AND g2 = ' ' THEN s0 || ' ' || s1 || ' ' || s2 END,
                   CASE WHEN g1 = ' ' AND g2 = ' ' AND g3 = ' ' THEN s0 || ' ' || s1 || ' ' || s2 || ' ' || s3 END]) AS form
    FROM (SELECT lower(surface) AS s0, lead(lower(surface), 1) OVER w AS s1, lead(lower(surface), 2) OVER w AS s2, lead(lower(surface), 3) OVER w AS s3,
                 lead(gap, 1) OVER w AS g1, lead(gap, 2) OVER w AS g2, lead(gap, 3) OVER w AS g3 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY idx)))
  WHERE form IS NOT NULL) WHERE length(key) BETWEEN 4 AND 14 GROUP BY key, form"""
VERDICT = """SELECT key, f[1].form AS winner, -f[1].m AS top, -f[2].m AS second, CASE WHEN f[2].m - f[1].m >= 2 THEN 'clear' ELSE 'weak' END AS verdict
FROM (SELECT key, list(struct_pack(m := -n, form := form) ORDER BY n DESC, form) AS f FROM variants GROUP BY key HAVING count(*) > 1)"""
PROPOSALS = """WITH both_ AS (
    SELECT key, n_joined, best.f AS spaced, best.n AS n_spaced, string_split(best.f, ' ')[-1] AS head FROM (
      SELECT key, max(n) FILTER (form = key) AS n_joined, max(struct_pack(n := n, f := form)) FILTER (len(string_split(form, ' ')) = 2) AS best FROM variants GROUP BY key) WHERE n_joined IS NOT NULL AND best IS NOT NULL),
  votes AS (SELECT head, sum(CASE WHEN n_joined > n_spaced THEN 1 ELSE -1 END) AS lead FROM both_ WHERE n_joined <> n_spaced GROUP BY head)
SELECT CASE WHEN j THEN spaced ELSE key END AS minority, CASE WHEN j THEN key ELSE spaced END AS majority, least(n_joined, n_spaced) AS n_min, greatest(n_joined, n_spaced) AS n_maj
FROM (SELECT b.*, CASE WHEN n_joined <> n_spaced THEN n_joined > n_spaced WHEN coalesce(lead, 0) <> 0 THEN lead > 0 ELSE key IN (SELECT word FROM lexicon) END AS j FROM both_ b LEFT JOIN votes v ON v.head = b.head)"""
#: The same in each document.
VARIANTS_BY = VARIANTS.replace("SELECT key, form, count", "SELECT doc_id, key, form, count").replace("SELECT form, replace", "SELECT doc_id, form, replace").replace("SELECT unnest([s0", "SELECT doc_id, unnest([s0").replace("(SELECT lower(surface) AS s0", "(SELECT doc_id, lower(surface) AS s0").replace("GROUP BY key, form", "GROUP BY doc_id, key, form")
VERDICT_BY = VERDICT.replace("SELECT key, f[1]", "SELECT doc_id, key, f[1]").replace("(SELECT key, list", "(SELECT doc_id, key, list").replace("GROUP BY key", "GROUP BY doc_id, key")
PROPOSALS_BY = (
    PROPOSALS.replace("SELECT key, n_joined", "SELECT doc_id, key, n_joined").replace("SELECT key, max(n)", "SELECT doc_id, key, max(n)").replace("GROUP BY key)", "GROUP BY doc_id, key)").replace("SELECT head, sum", "SELECT doc_id, head, sum")
    .replace("GROUP BY head)", "GROUP BY doc_id, head)").replace("SELECT CASE WHEN j THEN spaced", "SELECT doc_id, CASE WHEN j THEN spaced").replace("ON v.head = b.head)", "ON v.head = b.head AND v.doc_id = b.doc_id)")
)
CARDS = """SELECT minority AS original, majority AS corrected, CASE WHEN n_min = n_maj OR (n_maj - n_min <= 1 AND n_min >= 2) THEN 'low' ELSE 'high' END AS confidence,
  string_split(spaced, ' ')[-1] AS head, string_split(spaced, ' ')[1] AS lead, CASE WHEN jw THEN n_maj ELSE n_min END AS n_joined, CASE WHEN jw THEN n_min ELSE n_maj END AS n_spaced
  FROM (SELECT *, CASE WHEN contains(minority, ' ') THEN minority ELSE majority END AS spaced, NOT contains(majority, ' ') AS jw FROM proposals)"""
#: Minority forms that other corrections take at every place: as an original of the document, or as often inside its originals as in its text.
_TIMES = "(length({0}) - length(replace({0}, minority, ''))) // length(minority)"
COVERED = {
    "own": "SELECT doc_id, lower(original) AS o, source IS DISTINCT FROM 'ai_polish' AS counts FROM corrections WHERE original <> ''",
    "held": f"SELECT minority, doc_id, coalesce(sum({_TIMES.format('o')}) FILTER (counts), 0) AS n_own, bool_or(o = minority) AS same FROM proposals JOIN own ON contains(o, minority) GROUP BY minority, doc_id",
    "there": f"SELECT minority, doc_id, sum({_TIMES.format('t')}) AS n FROM (SELECT DISTINCT minority FROM held) JOIN (SELECT doc_id, lower(text) AS t FROM documents) ON contains(t, minority) GROUP BY minority, doc_id",
    "covered": "SELECT t.minority FROM there t LEFT JOIN held h ON h.minority = t.minority AND h.doc_id IS NOT DISTINCT FROM t.doc_id GROUP BY t.minority HAVING bool_and(coalesce(same OR n_own >= n, false))",
}
EACH = "SELECT original, 'tail' AS axis, head AS part, n_joined, n_spaced, confidence FROM cards UNION ALL SELECT original, 'lead', lead, n_joined, n_spaced, confidence FROM cards"
FAMILIES = """SELECT axis, part, members, to_spaced, to_joined, to_spaced > 0 AND to_joined > 0 AS split,
  CASE WHEN to_spaced > to_joined THEN 'spaced' WHEN to_spaced < to_joined THEN 'joined' WHEN ns > nj THEN 'spaced' ELSE 'joined' END AS proposal, strong
  FROM (SELECT axis, part, count(*) AS members, count(*) FILTER (n_spaced > n_joined) AS to_spaced, count(*) FILTER (n_spaced <= n_joined) AS to_joined,
               sum(n_joined) AS nj, sum(n_spaced) AS ns, bool_or(confidence = 'high') AS strong FROM each GROUP BY axis, part) WHERE members >= 2"""
CANDIDATES = """SELECT DISTINCT r.word AS rare, c.word AS common, c.n AS n_common FROM masked r JOIN masked c ON r.mask = c.mask WHERE r.n = 1 AND c.n >= 5"""
MASKED = """SELECT word, n, unnest(list_transform(range(1, length(word) + 1), lambda i: word[1:i - 1] || '*' || word[i + 1:])) AS mask
  FROM (SELECT lower(surface) AS word, count(*) AS n FROM tokens GROUP BY 1) WHERE length(word) >= 4 AND (n = 1 OR n >= 5)"""

ALL = {
    "realword_scored": (lambda s, d: op.realword_scored(_docs(s, d)), None),
    "topk_by_gap": (lambda s, d: op.topk_by_gap(op.realword_scored(_docs(s, d))), None),
    "tokenise_runs": (
        lambda s, d: op.tokenise_runs(_tokens(s, d)),
        duck("tokens", r"""SELECT surface, count(*) AS n FROM (SELECT *, coalesce(lead(gap) OVER (PARTITION BY doc_id ORDER BY idx), '') AS after FROM tokens)
            WHERE length(surface) >= 2 AND NOT regexp_matches(gap, '[0-9]$') AND NOT regexp_matches(after, '^[0-9]') GROUP BY surface"""),
    ),
    "term_frequency": (
        lambda s, d: op.term_frequency(_tokens(s, d)),
        duck("tokens", "SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_terms, count(*) FILTER (n >= 3) AS n_intended FROM (SELECT doc_id, surface, count(*) AS n FROM tokens GROUP BY ALL) GROUP BY doc_id"),
    ),
    "spacing_variants": (_variants, duck("tokens", "SELECT * FROM variants", variants=VARIANTS)),
    "variant_verdict": (lambda s, d: op.variant_verdict(_variants(s, d)), duck("tokens", VERDICT, variants=VARIANTS)),
    "spacing_variants_by_document": (lambda s, d: op.spacing_variants(_docs(s, d), by_document=True), duck("tokens", "SELECT * FROM variants", variants=VARIANTS_BY)),
    "variant_verdict_by_document": (lambda s, d: op.variant_verdict(op.spacing_variants(_docs(s, d), by_document=True, several=True)), duck("tokens", VERDICT_BY, variants=VARIANTS_BY)),
    "compound_majority_by_document": (lambda s, d: op.compound_majority(op.compound_forms(_docs(s, d), by_document=True), lexicon(s, d)), duck("tokens lexicon", "SELECT * FROM proposals", variants=VARIANTS_BY, proposals=PROPOSALS_BY)),
    "compound_majority": (_proposals, duck("tokens lexicon", "SELECT * FROM proposals", variants=VARIANTS, proposals=PROPOSALS)),
    "compound_cards": (_open_cards, duck("tokens lexicon corrections", f"{CARDS} WHERE minority NOT IN (SELECT minority FROM covered)", variants=VARIANTS, proposals=PROPOSALS, **COVERED)),
    "family_analysis": (lambda s, d: op.family_analysis(_cards(s, d)), duck("tokens lexicon", FAMILIES, variants=VARIANTS, proposals=PROPOSALS, cards=CARDS, each=EACH)),
    "contested_words": (
        _contested,
        duck("tokens lexicon", """SELECT original, array_to_string(list_sort(list_distinct(list(proposal))), ',') AS asked FROM each JOIN families USING (axis, part)
            GROUP BY original HAVING count(DISTINCT proposal) > 1""", variants=VARIANTS, proposals=PROPOSALS, cards=CARDS, each=EACH, families=FAMILIES),
    ),
    "junction_recover": (
        lambda s, d: op.junction_recover(op.variant_verdict(_variants(s, d)), _variants(s, d)),
        duck("tokens", "SELECT form AS original, winner AS corrected, n AS n_original, top FROM variants JOIN verdict USING (key) WHERE verdict = 'clear' AND contains(winner, ' ') AND form <> winner", variants=VARIANTS, verdict=VERDICT),
    ),
    "realword_candidates": (lambda s, d: op.realword_candidates(_tokens(s, d)), duck("tokens", CANDIDATES, masked=MASKED)),
    "topk_per_word": (
        lambda s, d: op.topk_per_word(op.realword_candidates(_tokens(s, d))),
        duck("tokens", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY n_common DESC, common) AS rank FROM candidates) WHERE rank <= 2 ORDER BY n_common DESC, rare, common LIMIT 60", masked=MASKED, candidates=CANDIDATES),
    ),
    "first_context": (
        lambda s, d: op.first_context(_docs(s, d)),
        r"""SELECT doc_id, word, arg_min(sentence, i) AS sentence FROM (
            SELECT doc_id, i, sentence, unnest(list_distinct(regexp_extract_all(sentence, '\p{L}+'))) AS word FROM (
              SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]+') AS x FROM documents)) WHERE length(sentence) BETWEEN 6 AND 200)
            GROUP BY doc_id, word""",
    ),
}
