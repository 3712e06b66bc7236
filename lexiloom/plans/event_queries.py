"""Queries of the decision-event and measurement operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiloom.operators import events as op
from lexiloom.operators import measures as me
from lexiloom.plans.consistency_queries import _docs, _tokens
from lexiloom.plans.correction_queries import GUARD as GUARD_OF_CASES
from lexiloom.plans.correction_queries import _c
from lexiloom.plans.lexicon_queries import PAIRS, _pairs
from lexiloom.sources.shared import shared_folder
from lexiloom.sources.tables import duck, lines, read, votes

GUARD = GUARD_OF_CASES.replace("FROM guarded WHERE", "FROM corrections WHERE")


def _votes(s, d):
    return votes(read(s, d, "events"))


def _old(s, d):
    """An earlier candidate table: every third term was decided by a curator."""
    k = F.regexp_extract("original", "[0-9]+", 0).cast("int")
    return _votes(s, d).select("original", "corrected").distinct().select("original", "corrected", F.when(k % 3 == 0, "active").when(k % 3 == 1, "rejected").otherwise("pending").alias("status"))


def _snapshots(s, d):
    """Snapshots by day: the terms voted on that day."""
    day = F.dayofmonth("ts")
    pairs = F.sort_array(F.collect_set(F.struct(F.col("original").alias("nonstd"), F.col("corrected").alias("norm"))))
    return _votes(s, d).withColumn("ver", day).groupBy("ver").agg(pairs.alias("pairs")).select("ver", F.to_json(F.struct(F.col("ver").alias("version"), "pairs")).alias("payload"))


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _ingest_stream(s, d):
    from lexiloom.streaming import events as st

    at, events = _folder(s), read(s, d, "events")
    events.unionByName(events.where("event_id % 10 = 0")).write.parquet(f"{at}/in")
    st.event_ingest_stream(st.read_events(s, f"{at}/in", events.schema), f"{at}/out", f"{at}/state", "60 days").awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _consensus_stream(s, d):
    from lexiloom.streaming import events as st

    at, v = _folder(s), _votes(s, d)
    v.repartition(3, "event_id").write.parquet(f"{at}/in")
    st.consensus_stream(st.read_events(s, f"{at}/in", v.schema), f"{at}/votes", f"{at}/out", f"{at}/state").awaitTermination()
    return st.current_candidates(s, f"{at}/out")


def _findings(s, d):
    return _c(s, d).withColumn("rule", F.col("category"))


def _decisions(s, d):
    from lexiloom.operators.corrections import guard_chain

    return guard_chain(_c(s, d)).select("doc_id", "seq", F.col("guard").isNotNull().alias("decided"), (F.col("seq") % 60 == 0).alias("gold"))


def _cases(s, d):
    t = _tokens(s, d).where("idx % 10 = 0").groupBy("doc_id", F.col("surface").alias("original")).agg(F.min("idx").alias("idx"))
    return t.select("doc_id", "original", F.when(F.col("idx") % 40 == 0, "expect").otherwise("forbid").alias("kind"))


def _matches(s, d):
    t = lines(_docs(s, d)).where("text <> ''")
    return t.select(F.lower("text").alias("term"), F.col("doc_id").alias("page"), (F.col("line_no") % 5 + 0.2).cast("double").alias("x"), F.col("line_no").cast("double").alias("y"), F.col("text").rlike("^[A-Z]").alias("exact"))


def _expected(s, d):
    return _matches(s, d).groupBy("term").agg(F.count_if("exact").alias("expected"))


def _groups(s, d):
    t = _tokens(s, d).where("length(surface) >= 5").select(F.lower(F.substring("surface", 1, 5)).alias("grp"), F.lower("surface").alias("surface"), F.col("doc_id").alias("sentence"))
    total = t.groupBy("grp").agg(F.countDistinct("sentence").alias("total"))
    return t.join(total, "grp")


CONSENSUS = """SELECT original, corrected, distinct_users, a::BIGINT AS accept_n, r::BIGINT AS reject_n, round(a / (a + r), 4) AS agreement, CASE WHEN status = 'exception' THEN 'exception' ELSE 'pair' END AS kind, CASE WHEN spacing THEN 'spacing' ELSE 'all' END AS scope, status
FROM (SELECT *, CASE WHEN a >= 3 AND a / (a + r) >= 0.8 THEN 'pending' WHEN a >= 3 AND a / (a + r) >= 0.5 THEN 'context_dependent' WHEN r >= 3 AND a / (a + r) < 0.5 THEN 'exception' END AS status FROM (
  SELECT original, corrected, count(DISTINCT user_id) AS distinct_users, count(DISTINCT user_id) FILTER (action <> 'reject') AS a, count(DISTINCT user_id) FILTER (action = 'reject') AS r, bool_or(spacing) AS spacing FROM votes GROUP BY ALL)) WHERE status IS NOT NULL"""
OLD = "SELECT original, corrected, CASE CAST(original[5:] AS INT) % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM (SELECT DISTINCT original, corrected FROM votes)"
MERGE = """SELECT coalesce(n.original, o.original) AS original, coalesce(n.corrected, o.corrected) AS corrected, CASE WHEN o.status IN ('active', 'rejected') THEN o.status ELSE n.status END AS status, agreement
  FROM consensus n FULL OUTER JOIN old o ON n.original = o.original AND n.corrected = o.corrected WHERE n.status IS NOT NULL OR o.status IN ('active', 'rejected')"""
SNAP = "SELECT ver, list(struct_pack(nonstd := original, norm := corrected) ORDER BY original, corrected) AS pairs FROM (SELECT DISTINCT day(ts)::INT AS ver, original, corrected FROM votes) GROUP BY ver"
DECIDED = "SELECT doc_id, seq, guard IS NOT NULL AS decided, seq % 60 = 0 AS gold FROM guards"
MATCHES = "SELECT lower(text) AS term, doc_id AS page, (line_no % 5 + 0.2)::DOUBLE AS x, line_no::DOUBLE AS y, regexp_matches(text, '^[A-Z]') AS exact FROM lines WHERE text <> ''"
EXPECTED = "SELECT term, count(*) FILTER (exact) AS expected FROM matches GROUP BY term"
CASES = "SELECT doc_id, surface AS original, CASE WHEN min(idx) % 40 = 0 THEN 'expect' ELSE 'forbid' END AS kind FROM tokens WHERE idx % 10 = 0 GROUP BY doc_id, surface"
RESULTS = """SELECT doc_id, count(*) FILTER (made AND kind = 'forbid') AS violations, count(*) FILTER (made AND kind = 'expect') AS hits, count(*) FILTER (kind = 'expect') AS expected
  FROM (SELECT k.*, c.doc_id IS NOT NULL AS made FROM cases k LEFT JOIN (SELECT DISTINCT doc_id, original FROM corrections) c ON c.doc_id = k.doc_id AND c.original = k.original) GROUP BY doc_id"""

ALL = {
    "decision_events": (
        lambda s, d: op.decision_events(_c(s, d)),
        duck("tokens corrections", r"""SELECT md5(doc_id || '|' || seq || '|' || status) AS event_id, CASE WHEN sh THEN regexp_replace(original, '^(.{2,}?)(ing|ion|ed|es|ly|er|s)$', '\1') ELSE original END AS original,
            CASE WHEN sh THEN regexp_replace(corrected, '^(.{2,}?)(ing|ion|ed|es|ly|er|s)$', '\1') ELSE corrected END AS corrected, CASE status WHEN 'accepted' THEN 'accept' ELSE 'reject' END AS action,
            CASE source WHEN 'ai_typo' THEN 'model' ELSE 'rule' END AS suggest_src
            FROM (SELECT *, tail <> '' AND ends_with(corrected, tail) AS sh FROM (SELECT *, regexp_extract(original, '(ing|ion|ed|es|ly|er|s)$', 1) AS tail FROM corrections))
            WHERE status IN ('accepted', 'rejected') AND source NOT IN ('dict', 'ai_polish') AND category <> 'punctuation' AND original <> corrected"""),
    ),
    "edit_vote_split": (
        lambda s, d: op.edit_vote_split(_votes(s, d), "design").select("event_id", "user_id", "original", "corrected", "action"),
        duck("votes", "SELECT event_id, user_id, original, CASE WHEN action = 'edit_accept' THEN corrected || '*' ELSE corrected END AS corrected, CASE WHEN action = 'edit_accept' THEN 'accept' ELSE action END AS action FROM votes UNION ALL SELECT event_id, user_id, original, corrected, 'reject' FROM votes WHERE action = 'edit_accept'"),
    ),
    "consensus": (lambda s, d: op.consensus(_votes(s, d)), duck("votes", CONSENSUS)),
    "candidate_merge": (lambda s, d: op.candidate_merge(op.consensus(_votes(s, d)), _old(s, d)), duck("votes", MERGE, consensus=CONSENSUS, old=OLD)),
    "snapshot_build": (
        lambda s, d: op.snapshot_build(op.candidate_merge(op.consensus(_votes(s, d)), _old(s, d)), 7),
        duck("votes", """SELECT 7 AS ver, payload, sha256(payload) AS sha256 FROM (SELECT to_json(struct_pack(version := 7, pairs := list(struct_pack(nonstd := original, norm := corrected) ORDER BY original, corrected)))::VARCHAR AS payload FROM merged WHERE status = 'active')""",
             consensus=CONSENSUS, old=OLD, merged=MERGE),
    ),
    "snapshot_payload": (lambda s, d: op.snapshot_payload(_snapshots(s, d)), duck("votes", "SELECT ver AS version, p.nonstd, p.norm FROM (SELECT ver, unnest(pairs) AS p FROM snap)", snap=SNAP)),
    "latest_snapshot": (
        lambda s, d: op.latest_snapshot(_snapshots(s, d), 3),
        duck("votes", "SELECT ver, to_json(struct_pack(version := ver, pairs := pairs))::VARCHAR AS payload FROM snap WHERE ver = (SELECT max(ver) FROM snap) AND ver > 3", snap=SNAP),
    ),
    "candidate_queue": (lambda s, d: op.candidate_queue(op.consensus(_votes(s, d)), 40), duck("votes", "SELECT * FROM consensus ORDER BY kind, distinct_users DESC, original, corrected LIMIT 40", consensus=CONSENSUS)),
    "pending_batch": (
        lambda s, d: op.pending_batch(_votes(s, d).withColumn("synced", (F.col("event_id") % 3).cast("int"))).select("event_id", "original", "action"),
        duck("votes", "SELECT event_id, original, action FROM votes WHERE event_id % 3 = 0 ORDER BY ts, event_id LIMIT 500"),
    ),
    "event_ingest": (
        lambda s, d: op.event_ingest(_votes(s, d).union(_votes(s, d).where("event_id % 5 = 0")), _votes(s, d).where("event_id % 7 = 0")).select("event_id", "original", "action"),
        duck("votes", "SELECT event_id, original, action FROM votes WHERE event_id % 7 <> 0"),
    ),
    "event_ingest_stream": (_ingest_stream, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
    "consensus_stream": (_consensus_stream, duck("votes", CONSENSUS)),
    "finder_firing": (
        lambda s, d: me.finder_firing(_findings(s, d), lines(_docs(s, d))),
        duck("tokens corrections lines", "SELECT category AS rule, count(*) AS n, round(count(*) / (SELECT count(DISTINCT text) FROM lines), 4) AS rate FROM corrections GROUP BY category"),
    ),
    "firing_delta": (
        lambda s, d: me.firing_delta(_findings(s, d).groupBy("rule").agg(F.count(F.lit(1)).alias("n")), _findings(s, d).where("confidence = 'high' or category = 'spacing'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))),
        duck("tokens corrections", """SELECT category AS rule, count(*) AS now, count(*) FILTER (confidence = 'high' OR category = 'spacing') AS was, CASE WHEN now > was THEN 'fail' WHEN now < was THEN 'improved' ELSE 'same' END AS verdict FROM corrections GROUP BY category"""),
    ),
    "guard_confusion": (
        lambda s, d: me.guard_confusion(_decisions(s, d)),
        duck("tokens corrections", "SELECT tp, fp, tn, fn, round(tp / (tp + fn), 4) AS recall, round((tp + tn) / (tp + fp + tn + fn), 4) AS agreement FROM (SELECT count(*) FILTER (decided AND gold) AS tp, count(*) FILTER (decided AND NOT gold) AS fp, count(*) FILTER (NOT decided AND NOT gold) AS tn, count(*) FILTER (NOT decided AND gold) AS fn FROM x)", guards=GUARD, x=DECIDED),
    ),
    "precision_recall": (
        lambda s, d: me.precision_recall(_decisions(s, d), "doc_id"),
        duck("tokens corrections", """SELECT doc_id, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) END, 4) AS f05 FROM (
            SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fn) END AS r FROM (
            SELECT doc_id, count(*) FILTER (decided AND gold) AS tp, count(*) FILTER (decided AND NOT gold) AS fp, count(*) FILTER (NOT decided AND gold) AS fn FROM x GROUP BY doc_id))""", guards=GUARD, x=DECIDED),
    ),
    "case_expectations": (lambda s, d: me.case_expectations(_cases(s, d), _c(s, d)), duck("tokens corrections", RESULTS, cases=CASES)),
    "case_totals": (
        lambda s, d: me.case_totals(me.case_expectations(_cases(s, d), _c(s, d)).withColumn("version", F.concat(F.lit("v"), F.col("doc_id") % 3))),
        duck("tokens corrections", "SELECT 'v' || doc_id % 3 AS version, sum(violations)::BIGINT AS violations, sum(hits)::BIGINT AS hits, sum(expected)::BIGINT AS expected FROM results GROUP BY ROLLUP ('v' || doc_id % 3)", cases=CASES, results=RESULTS),
    ),
    "repeated_position_drop": (
        lambda s, d: me.repeated_position_drop(_matches(s, d)),
        duck("lines", "SELECT m.* FROM m LEFT JOIN (SELECT term, round(x) AS rx, round(y) AS ry FROM m GROUP BY ALL HAVING count(DISTINCT page) >= 3) h ON h.term = m.term AND rx = round(x) AND ry = round(y) WHERE h.term IS NULL", m=MATCHES),
    ),
    "ambiguous_match_drop": (
        lambda s, d: me.ambiguous_match_drop(_matches(s, d), _expected(s, d)),
        duck("lines", "SELECT * FROM matches WHERE exact OR term NOT IN (SELECT term FROM (SELECT term, count(*) AS found, count(*) FILTER (exact) AS e FROM matches GROUP BY term) WHERE found > e)", matches=MATCHES),
    ),
    "match_alignment": (
        lambda s, d: me.match_alignment(_matches(s, d), _expected(s, d)),
        duck("lines", """SELECT term, page, x, y, CASE WHEN found = expected THEN occ END AS occ, found <> expected AS warn FROM (SELECT m.*, expected, count(*) OVER (PARTITION BY m.term) AS found,
            row_number() OVER (PARTITION BY m.term ORDER BY page, y, x) - 1 AS occ FROM matches m JOIN expected e USING (term))""", matches=MATCHES, expected=EXPECTED),
    ),
    "rule_collision": (
        lambda s, d: me.rule_collision(_tokens(s, d).select(F.lower("surface").alias("surface"), (F.length("gap") % 3).alias("reading")), _pairs(s, d)),
        duck("tokens lexicon", "SELECT lower(surface) AS surface, count(DISTINCT length(gap) % 3) AS readings FROM tokens WHERE lower(surface) IN (SELECT nonstd FROM pairs) GROUP BY 1 HAVING readings >= 2", pairs=PAIRS),
    ),
    "shared_surface": (
        lambda s, d: me.shared_surface(_groups(s, d)),
        duck("tokens", """SELECT grp, CASE WHEN count(*) = 1 THEN min(surface) END AS surface, d FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY d) AS r FROM (
            SELECT grp, surface, length(surface) - length(grp) AS d FROM (SELECT grp, surface, count(DISTINCT doc_id) AS n FROM g GROUP BY ALL) JOIN (SELECT grp, count(DISTINCT doc_id) AS total FROM g GROUP BY grp) USING (grp) WHERE n = total AND total >= 2)) WHERE r = 1 GROUP BY grp, d""",
             g="SELECT lower(surface[1:5]) AS grp, lower(surface) AS surface, doc_id FROM tokens WHERE length(surface) >= 5"),
    ),
}
