"""Reviewer decisions: term events, votes, consensus, curated candidates, published snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import LATIN_ENDINGS, base_form


def decision_events(corrections: DataFrame) -> DataFrame:
    """Term-level events of decided corrections, without document text.

    Flags of the dictionary, polish, punctuation, pending rows and no-ops are skipped; an ending shared by both sides is
    stripped from both. The id is a hash of what was decided, so a second delivery is recognised.
    """
    c = corrections.where(F.col("status").isin("accepted", "rejected") & ~F.col("source").isin("dict", "ai_polish") & (F.col("category") != "punctuation") & (F.col("original") != F.col("corrected")))
    tail = F.regexp_extract("original", f"({'|'.join(LATIN_ENDINGS)})\\z", 1)
    shared = (tail != "") & F.endswith("corrected", tail)
    strip = lambda col: F.when(shared, base_form(F.col(col))).otherwise(F.col(col))
    action = F.when(F.col("status") == "accepted", "accept").otherwise("reject")
    return c.select(
        F.md5(F.concat_ws("|", "doc_id", "seq", "status")).alias("event_id"), strip("original").alias("original"), strip("corrected").alias("corrected"),
        action.alias("action"), F.when(F.col("source") == "ai_typo", "model").otherwise("rule").alias("suggest_src"),
    )


def edit_vote_split(votes: DataFrame, mode: str = "implemented") -> DataFrame:
    """Edited acceptances as votes: ``implemented`` counts an accept; ``design`` adds a reject of the suggestion."""
    edited = F.col("action") == "edit_accept"
    accept = F.struct(F.when(edited, "accept").otherwise(F.col("action")).alias("action"), F.when(edited, F.concat("corrected", F.lit("*"))).otherwise(F.col("corrected")).alias("corrected"))
    if mode == "implemented":
        return votes.select("event_id", "user_id", "original", "spacing", "ts", accept.alias("v")).select("event_id", "user_id", "original", "spacing", "ts", "v.*")
    both = F.when(edited, F.array(accept, F.struct(F.lit("reject").alias("action"), F.col("corrected")))).otherwise(F.array(accept))
    return votes.select("event_id", "user_id", "original", "spacing", "ts", F.explode(both).alias("v")).select("event_id", "user_id", "original", "spacing", "ts", "v.*")


def consensus(votes: DataFrame, k: int = 3, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """Term pairs by distinct accepting and rejecting users: pending, context_dependent, or an exception.

    A user's repeated votes are collapsed first, with map-side combine; a hot pair then has at most one row a user.
    """
    accept = F.col("action").isin("accept", "edit_accept")
    users = votes.groupBy("original", "corrected", "user_id").agg(F.max(F.when(accept, 1).otherwise(0)).alias("a"), F.max(F.when(~accept, 1).otherwise(0)).alias("r"), F.bool_or("spacing").alias("spacing"))
    n = users.groupBy("original", "corrected").agg(F.sum("a").alias("accept_n"), F.sum("r").alias("reject_n"), F.count(F.lit(1)).alias("distinct_users"), F.bool_or("spacing").alias("spacing"))
    agreement = F.col("accept_n") / (F.col("accept_n") + F.col("reject_n"))
    enough = F.col("accept_n") >= k
    status = F.when(enough & (agreement >= high), "pending").when(enough & (agreement >= low), "context_dependent").when((F.col("reject_n") >= k) & (agreement < low), "exception")
    kind = F.when(status == "exception", "exception").otherwise("pair")
    out = n.select("original", "corrected", "distinct_users", "accept_n", "reject_n", F.round(agreement, 4).alias("agreement"), kind.alias("kind"), F.when(F.col("spacing"), "spacing").otherwise("all").alias("scope"), status.alias("status"))
    return out.where("status is not null")


def candidate_merge(new: DataFrame, old: DataFrame) -> DataFrame:
    """New candidates over the old table; what a curator made active or rejected keeps its status."""
    o = old.select("original", "corrected", F.col("status").alias("old_status"))
    both = new.join(o, ["original", "corrected"], "full_outer")
    kept = F.col("old_status").isin("active", "rejected")
    return both.where("status is not null or old_status in ('active', 'rejected')").select("original", "corrected", F.when(kept, F.col("old_status")).otherwise(F.col("status")).alias("status"), "agreement")


def snapshot_build(candidates: DataFrame, version: int) -> DataFrame:
    """One row: version, payload (JSON of all active pairs in order) and its SHA-256. A published list is small."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("original").alias("nonstd"), F.col("corrected").alias("norm"))))
    body = candidates.where("status = 'active'").agg(F.to_json(F.struct(F.lit(version).alias("version"), pairs.alias("pairs"))).alias("payload"))
    return body.select(F.lit(version).alias("ver"), "payload", F.sha2("payload", 256).alias("sha256"))


def snapshot_payload(snapshots: DataFrame) -> DataFrame:
    """The pairs in snapshot payloads; a missing list is empty."""
    schema = "struct<version:int,pairs:array<struct<nonstd:string,norm:string>>>"
    return snapshots.select(F.from_json("payload", schema).alias("s")).select("s.version", F.explode(F.coalesce("s.pairs", F.array().cast("array<struct<nonstd:string,norm:string>>"))).alias("p")).select("version", "p.*")


def latest_snapshot(snapshots: DataFrame, local: int) -> DataFrame:
    """The newest snapshot, if it is newer than the local one."""
    return snapshots.groupBy().agg(F.max_by(F.struct(*snapshots.columns), "ver").alias("s")).select("s.*").where(F.col("ver") > local)


def candidate_queue(candidates: DataFrame, n: int) -> DataFrame:
    """The first ``n`` candidates by kind, then most users: a report."""
    return candidates.orderBy("kind", F.desc("distinct_users"), "original", "corrected").limit(n)


def pending_batch(events: DataFrame, n: int = 500) -> DataFrame:
    """The oldest ``n`` events not sent yet."""
    return events.where("synced = 0").orderBy("ts", "event_id").limit(n)


def event_ingest(new: DataFrame, have: DataFrame) -> DataFrame:
    """Events of ``new`` whose id is neither in ``have`` nor repeated in ``new``."""
    return new.dropDuplicates(["event_id"]).join(have.select("event_id"), "event_id", "left_anti")
