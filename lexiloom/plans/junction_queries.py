"""Queries of junctions over the spacing proposals of all documents, and of quotation marks over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import junctions as op
from lexiloom.operators import quotes
from lexiloom.operators.junctions import junction_conflicts
from lexiloom.operators.consistency import variant_verdict
from lexiloom.plans.consistency_queries import PROPOSALS, VARIANTS, VERDICT, _docs, _proposals, _variants
from lexiloom.sources.shared import written
from lexiloom.sources.tables import duck, lines, read


def _bases(s, d):
    """Conflicts, proposals and the support of their majority forms."""
    proposals = written(_proposals(s, d), "proposals")
    conflicts = written(junction_conflicts(proposals).distinct(), "conflicts")
    return conflicts, proposals, proposals.select(F.col("majority").alias("form"), F.col("n_maj").alias("n"))


def _harmonise(s, d):
    conflicts, _, support = _bases(s, d)
    return op.junction_harmonise(conflicts, support)


def _groups(s, d):
    return op.junction_groups(_bases(s, d)[0])


def _propagate(s, d):
    conflicts, proposals, support = _bases(s, d)
    cards = proposals.select(F.col("minority").alias("original"), F.col("majority").alias("corrected"))
    return op.junction_propagate(conflicts, op.junction_groups(conflicts), cards, support)


def _lines(s, d):
    """Lines of documents and of raw pages, whose attributes are full of straight marks; page ids are negative.

    By number, four of five page lines get shaped marks: all closing, turned round, after a full stop, or after a letter.
    """
    pages = lines(read(s, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text")))
    pair, k = r'="([^"]*)"', F.pmod(F.col("doc_id") + F.col("line_no"), F.lit(5))
    shaped = F.when(k == 1, F.translate("text", '"', "”")).when(k == 2, F.regexp_replace("text", pair, "=”$1“")).when(k == 3, F.regexp_replace("text", pair, ".“$1”")).when(k == 4, F.regexp_replace("text", pair, "x“$1”"))
    return lines(_docs(s, d)).unionByName(pages.withColumn("text", F.coalesce(shaped, "text")))


def _roles(s, d):
    return quotes.quote_roles(_lines(s, d))


SP = "list_transform(range(1, len(string_split({0}, ' '))), lambda i: length(array_to_string(string_split({0}, ' ')[1:i], '')))"
IN = f"list_transform(list_filter({SP}, lambda x: x > place AND x < place + {{1}}), lambda x: x - place)"
CONFLICTS = f"""SELECT short, longer, place FROM (SELECT a.key, a.form AS short, b.form AS longer, min(b.place)::INT AS place
    FROM keyed a JOIN (SELECT key, form, o AS place, substr(key, o + 1, k) AS part FROM keyed, unnest(range(0, length(key) - 3)) u(o), unnest(range(4, length(key) - o + 1)) v(k)) b ON b.part = a.key AND b.key <> a.key GROUP BY ALL)
  WHERE {SP.format("short")} <> {IN.format("longer", "length(key)")}"""
KEYED = "SELECT DISTINCT replace(majority, ' ', '') AS key, majority AS form FROM proposals"
SUPPORT = "SELECT majority AS form, max(n_maj) AS n FROM proposals GROUP BY 1"
_LETTERS = "replace({0}, ' ', '')"
CUTS = f"""CASE WHEN length({_LETTERS.format("{0}")}) > length({_LETTERS.format("{1}")}) THEN list_sort(list_concat(list_filter({SP.format("{0}")}, lambda x: x <= place OR x >= place + length({_LETTERS.format("{1}")})), list_transform({SP.format("{1}")}, lambda x: x + place)))
    ELSE list_transform(list_filter({SP.format("{1}")}, lambda x: x > place AND x < place + length({_LETTERS.format("{0}")})), lambda x: x - place) END"""
BUILT = "array_to_string(list_transform(range(1, len(cuts) + 2), lambda i: replace({0}, ' ', '')[CASE WHEN i = 1 THEN 1 ELSE cuts[i - 1] + 1 END : CASE WHEN i = len(cuts) + 1 THEN length({0}) ELSE cuts[i] END]), ' ')"
WEAK = """SELECT DISTINCT CASE WHEN s.n < l.n THEN short ELSE longer END AS weak, CASE WHEN s.n < l.n THEN longer ELSE short END AS strong, place FROM conflicts c JOIN support s ON s.form = c.short JOIN support l ON l.form = c.longer"""
GROUPS = """SELECT form, junction, count(*) OVER (PARTITION BY junction) AS members FROM (SELECT form, min(c) AS junction FROM reach GROUP BY form)"""
REACH = "SELECT form, form AS c FROM ends UNION SELECT r.form, e.b FROM reach r JOIN edges e ON r.c = e.a"
EDGES = "SELECT short AS a, longer AS b, place FROM conflicts UNION SELECT longer, short, place FROM conflicts"
BASE = {"variants": VARIANTS, "proposals": PROPOSALS, "keyed": KEYED, "conflicts": CONFLICTS}
DECIDED = "SELECT junction, arg_min(form, struct_pack(n := -n, f := form)) AS decided FROM groups JOIN support USING (form) GROUP BY junction"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _classes(s, d):
    proposals = written(_proposals(s, d), "proposals")
    cards = proposals.select(F.col("minority").alias("original"), F.col("majority").alias("corrected"))
    return op.junction_classes(junction_conflicts(proposals), cards, variant_verdict(_variants(s, d)))


CLASSES = """SELECT c.*, a.minority AS short_original, b.minority AS longer_original, CASE WHEN va.verdict = 'clear' AND vb.verdict = 'clear' THEN CASE WHEN
        CASE WHEN contains(a.minority, ' ') THEN contains(longer, a.minority) ELSE contains(' ' || longer || ' ', ' ' || a.minority || ' ') END OR CASE WHEN contains(b.minority, ' ') THEN contains(short, b.minority) ELSE contains(' ' || short || ' ', ' ' || b.minority || ' ') END THEN 'mutual' ELSE 'preserved' END
        WHEN va.verdict = 'clear' AND vb.verdict IS NULL THEN 'harmonise_long' WHEN vb.verdict = 'clear' AND va.verdict IS NULL THEN 'harmonise_short' ELSE 'group' END AS outcome
    FROM conflicts c JOIN proposals a ON a.majority = c.short JOIN proposals b ON b.majority = c.longer LEFT JOIN verdict va ON va.key = replace(short, ' ', '') LEFT JOIN verdict vb ON vb.key = replace(longer, ' ', '')"""

ALL = {
    "junction_conflicts": (lambda s, d: junction_conflicts(_proposals(s, d)), duck("tokens lexicon", "SELECT * FROM conflicts", **BASE)),
    "junction_classes": (_classes, duck("tokens lexicon", CLASSES, **BASE, verdict=VERDICT)),
    "junction_harmonise": (_harmonise, duck("tokens lexicon", f"SELECT weak, strong, {BUILT.format('weak')} AS corrected FROM (SELECT *, {CUTS.format('weak', 'strong')} AS cuts FROM weak) WHERE {BUILT.format('weak')} <> weak", **BASE, support=SUPPORT, weak=WEAK)),
    "junction_groups": (_groups, _recursive(duck("tokens lexicon", GROUPS, **BASE, edges=EDGES, ends="SELECT DISTINCT a AS form FROM edges", reach=REACH))),
    "junction_propagate": (
        _propagate,
        _recursive(duck("tokens lexicon", f"""SELECT original, form, decided, corrected, CASE WHEN corrected = original THEN 'rejected' WHEN length(replace(form, ' ', '')) <= length(replace(decided, ' ', '')) THEN 'accepted' ELSE 'changed' END AS action
            FROM (SELECT original, form, decided, {BUILT.format('form')} AS corrected FROM (SELECT DISTINCT p.minority AS original, g.form, d.decided, e.place, {CUTS.format('g.form', 'd.decided')} AS cuts FROM groups g JOIN decided d USING (junction)
              JOIN edges e ON e.a = g.form AND e.b = d.decided JOIN proposals p ON p.majority = g.form WHERE g.form <> d.decided))""",
            **BASE, support=SUPPORT, edges=EDGES, ends="SELECT DISTINCT a AS form FROM edges", reach=REACH, groups=GROUPS, decided=DECIDED)),
    ),
    "quote_roles": (_roles, None),
    "unpaired_quotes": (lambda s, d: quotes.unpaired_quotes(_roles(s, d), _lines(s, d)), None),
    "reversed_quotes": (lambda s, d: quotes.reversed_quotes(_roles(s, d), _lines(s, d)), None),
    "quote_punct_spacing": (lambda s, d: quotes.quote_punct_spacing(_roles(s, d)), None),
    "quote_spacing": (lambda s, d: quotes.quote_spacing_in(_lines(s, d)), None),
}
