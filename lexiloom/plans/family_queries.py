"""Queries of family plans, of corrections inside corrections, and of found places against expected ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators import consistency, families as op
from lexiloom.operators import corrections as co
from lexiloom.operators import measures as me
from lexiloom.plans.consistency_queries import CARDS, EACH, FAMILIES, PROPOSALS, VARIANTS, _cards, _docs
from lexiloom.plans.correction_queries import C, LIVE, PLACES
from lexiloom.plans.event_queries import MATCHES, _matches
from lexiloom.sources.shared import written
from lexiloom.sources.tables import corrections, duck


def _plan(s, d, then=lambda cards, families, decided, plan: plan, allow_break=False):
    """Strong split families are decided; words of a length divisible by 3 are chosen to be joined."""
    cards = written(_cards(s, d), "family-cards")
    families = written(consistency.family_analysis(cards), "families")
    decided = families.where("split and strong")
    choices = cards.where("length(original) % 3 = 0").select("original", F.lit("joined").alias("choice"))
    return then(cards, families, decided, op.family_plan(cards, families, decided, choices, allow_break))


def _align(s, d):
    """Families with the same number of words either way are weak: their proposal rests on counts of places alone."""
    cards = written(_cards(s, d), "family-cards")
    families = written(consistency.family_analysis(cards), "families").withColumn("strong", F.col("to_spaced") != F.col("to_joined"))
    return op.family_align(op.family_members(cards), families)


def _earlier(cards):
    return cards.where("length(original) % 5 = 0").select("original", "corrected", F.lit("rejected").alias("status"))


def _found(s, d):
    """What a search that misses a fifth of the places, and now and then names the next page, would give."""
    moved = F.col("page") + F.when((F.col("page") + F.col("y")) % 97 == 1, 1).otherwise(0)
    return _matches(s, d).where((F.col("page") + F.col("y")) % 5 != 0).select("term", moved.alias("page"), "x", "y")


def _inside(s, d):
    """Corrections, and for each a second one of its middle letters: those lie inside the first."""
    c = corrections(_docs(s, d))
    inner = c.where("length(original) >= 6").select("doc_id", "seq", F.expr("substring(original, 2, 3)").alias("original"), F.expr("concat(substring(original, 2, 3), 'e')").alias("corrected"), "status")
    return c.select(*inner.columns).unionByName(inner)


PLAN = {
    "variants": VARIANTS, "proposals": PROPOSALS, "cards": CARDS, "each": EACH, "families": FAMILIES, "decided": "SELECT * FROM families WHERE split AND strong",
    "wanted": """SELECT original, direction, CASE WHEN lo = hi THEN lo WHEN length(original) % 3 = 0 THEN 'joined' END AS want FROM (
        SELECT e.original, CASE WHEN contains(c.corrected, ' ') THEN 'spaced' ELSE 'joined' END AS direction, min(proposal) AS lo, max(proposal) AS hi FROM each e JOIN decided USING (axis, part) JOIN cards c ON c.original = e.original GROUP BY ALL)""",
    "alike": "SELECT e.axis, e.part, e.original, coalesce(w.want <> w.direction, false) AS moves FROM each e JOIN families f ON f.axis = e.axis AND f.part = e.part AND NOT f.split LEFT JOIN wanted w ON w.original = e.original",
    "broken": "SELECT DISTINCT original FROM alike WHERE moves AND (axis, part) IN (SELECT (axis, part) FROM alike GROUP BY axis, part HAVING bool_or(moves) AND NOT bool_and(moves))",
    "held": "SELECT original FROM broken UNION SELECT b.original FROM held h JOIN alike a ON a.original = h.original JOIN alike b ON a.axis = b.axis AND a.part = b.part WHERE b.moves",
    "plan": "SELECT original, direction, want, CASE WHEN want IS NULL THEN 'undecided' WHEN want = direction THEN 'kept' WHEN original IN (SELECT original FROM held) THEN 'blocked' ELSE 'job' END AS outcome, false AS breaks FROM wanted",
}


def _twin(body: str) -> str:
    return duck("tokens lexicon", body, **PLAN).replace("WITH ", "WITH RECURSIVE ", 1)


INSIDE = {
    "own": "SELECT doc_id, seq, original, corrected, status FROM corrections UNION ALL SELECT doc_id, seq, original[2:4], original[2:4] || 'e', status FROM corrections WHERE length(original) >= 6",
    "live": LIVE.replace("FROM corrections", "FROM own"), "places": PLACES, "p": 'SELECT doc_id, original, corrected, pos, "end" FROM places JOIN live USING (doc_id, original) WHERE pos IS NOT NULL',
    "inner_of": """SELECT i.doc_id, i.original, i.corrected, i.pos, i."end", arg_max(o.pos, (o."end" - o.pos) * 10000000 - o.pos) AS o_pos, arg_max(o."end", (o."end" - o.pos) * 10000000 - o.pos) AS o_end FROM p i JOIN p o
        ON i.doc_id = o.doc_id AND o.pos <= i.pos AND i."end" <= o."end" AND o."end" - o.pos > i."end" - i.pos GROUP BY ALL""",
    "outer_of": """SELECT p.doc_id, p.original, p.corrected, p.pos, len(s) AS inside, CASE WHEN s IS NULL THEN p.corrected ELSE list_reduce(list_prepend(struct_pack(a := 0::BIGINT, b := 0::BIGINT, o := '', c := p.corrected), s),
        lambda t, x: struct_pack(a := 0::BIGINT, b := 0::BIGINT, o := '', c := CASE WHEN instr(t.c, x.o) > 0 THEN t.c[:instr(t.c, x.o) - 1] || x.c || t.c[instr(t.c, x.o) + length(x.o):] ELSE t.c END)).c END AS value
        FROM p LEFT JOIN (SELECT doc_id, o_pos, o_end, list(struct_pack(a := pos, b := "end", o := original, c := corrected) ORDER BY pos, "end") AS s FROM inner_of GROUP BY ALL) g ON g.doc_id = p.doc_id AND g.o_pos = p.pos AND g.o_end = p."end" """,
    "composed": "SELECT doc_id, original, corrected, min(value) AS composed, coalesce(sum(inside), 0)::BIGINT AS absorbed FROM outer_of GROUP BY doc_id, original, corrected HAVING count(DISTINCT value) = 1 AND min(value) <> corrected",
}

def _align_sql() -> str:
    """Eight half-rounds, each with all costs counted anew from the members."""
    cost = lambda form, k: f"""(SELECT count(*) FROM pairs p JOIN s{k} g ON g.axis = p.axis2 AND g.part = p.part2 WHERE p.axis = s.axis AND p.part = s.part AND g.proposal <> '{form}')
        + (SELECT count(*) FROM would w WHERE w.axis = s.axis AND w.part = s.part AND w.form <> '{form}')"""  # noqa: E731
    steps = {
        "weak": "SELECT axis, part, to_spaced <> to_joined AS strong, proposal FROM families WHERE split",
        "m": "SELECT e.axis, e.part, e.original, CASE WHEN contains(c.corrected, ' ') THEN 'spaced' ELSE 'joined' END AS form, f.split FROM each e JOIN cards c USING (original) JOIN families f ON f.axis = e.axis AND f.part = e.part",
        "pairs": "SELECT a.axis, a.part, b.axis AS axis2, b.part AS part2 FROM m a JOIN m b ON a.original = b.original AND a.axis <> b.axis WHERE a.split AND b.split",
        "would": "SELECT DISTINCT a.axis, a.part, b.axis AS axis2, b.part AS part2, b.form FROM m a JOIN m b ON a.original = b.original WHERE a.split AND NOT b.split",
        "s0": "SELECT axis, part, strong, proposal AS was, proposal, 0 AS flips FROM weak",
    }
    for k in range(8):
        axis = ("lead", "tail")[k % 2]
        flip = f"NOT strong AND axis = '{axis}' AND CASE WHEN proposal = 'joined' THEN to_spaced < to_joined ELSE to_joined < to_spaced END"
        steps[f"s{k + 1}"] = f"""SELECT axis, part, strong, was, CASE WHEN {flip} THEN CASE proposal WHEN 'joined' THEN 'spaced' ELSE 'joined' END ELSE proposal END AS proposal, flips + CASE WHEN {flip} THEN 1 ELSE 0 END AS flips
            FROM (SELECT *, {cost("joined", k)} AS to_joined, {cost("spaced", k)} AS to_spaced FROM s{k} s)"""
    return duck("tokens lexicon", "SELECT axis, part, was, proposal, flips FROM s8", variants=VARIANTS, proposals=PROPOSALS, cards=CARDS, each=EACH, families=FAMILIES, **steps)


ALL = {
    "family_align": (_align, _align_sql()),
    "family_plan": (_plan, _twin("SELECT * FROM plan")),
    "family_plan_breaks": (
        lambda s, d: _plan(s, d, allow_break=True),
        _twin("SELECT original, direction, want, CASE WHEN want IS NULL THEN 'undecided' WHEN want = direction THEN 'kept' ELSE 'job' END AS outcome, original IN (SELECT original FROM broken) AS breaks FROM wanted"),
    ),
    "family_apply": (
        lambda s, d: _plan(s, d, lambda cards, families, decided, plan: op.family_apply(cards, plan, _earlier(cards))),
        _twin("""SELECT c.original, c.corrected, CASE WHEN outcome = 'job' THEN 'rejected' WHEN outcome = 'kept' THEN 'accepted' WHEN length(c.original) % 5 = 0 THEN 'rejected' ELSE 'pending' END AS status FROM cards c LEFT JOIN plan p ON p.original = c.original
            UNION ALL SELECT c.corrected, c.original, 'accepted' FROM cards c JOIN plan p ON p.original = c.original WHERE outcome = 'job'"""),
    ),
    "family_open": (
        lambda s, d: _plan(s, d, lambda cards, families, decided, plan: op.family_open(families, decided, plan)),
        _twin("SELECT f AS families, u AS undecided, b AS blocked, f + u + b AS total FROM (SELECT (SELECT count(*) FROM families WHERE split AND NOT strong) AS f, count(*) FILTER (outcome = 'undecided') AS u, count(*) FILTER (outcome = 'blocked') AS b FROM plan)"),
    ),
    "overlap_compose": (lambda s, d: co.overlap_compose(_docs(s, d), _inside(s, d)), duck(C, "SELECT * FROM composed", **INSIDE)),
    "overlap_absorbed": (
        lambda s, d: co.overlap_absorbed(_docs(s, d), _inside(s, d)),
        duck(C, """SELECT i.doc_id, i.original, i.pos, o.original AS absorbed_by FROM inner_of i JOIN p o ON o.doc_id = i.doc_id AND o.pos = i.o_pos AND o."end" = i.o_end JOIN composed c ON c.doc_id = i.doc_id AND c.original = o.original""", **INSIDE),
    ),
    "page_realign": (
        lambda s, d: me.page_realign(_matches(s, d), _found(s, d)),
        duck("lines", """SELECT e.term, e.page, e.y, e.x, f.y AS found_y, f.x AS found_x, f.y IS NULL AS unfound FROM (SELECT *, row_number() OVER (PARTITION BY term, page ORDER BY y, x) AS n FROM matches) e
            JOIN good USING (term) LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY term, page ORDER BY y, x) AS n FROM found) f ON f.term = e.term AND f.page = e.page AND f.n = e.n""",
             matches=MATCHES, found="SELECT term, page + CASE WHEN (page + y) % 97 = 1 THEN 1 ELSE 0 END AS page, x, y FROM matches WHERE (page + y) % 5 <> 0",
             counts="SELECT term, page, sum(e)::BIGINT AS e, sum(f)::BIGINT AS f FROM (SELECT term, page, 1 AS e, 0 AS f FROM matches UNION ALL SELECT term, page, 0, 1 FROM found) GROUP BY ALL",
             good="SELECT term FROM counts GROUP BY term HAVING sum(f) > 0 AND sum(e) > sum(f) AND bool_and(f <= e)"),
    ),
}
