"""Regression measurement: firing rates, deltas, confusion, gold cases, repeated and ambiguous matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def finder_firing(findings: DataFrame, sentences: DataFrame) -> DataFrame:
    """Firings by rule, and their rate by distinct sentence."""
    total = sentences.agg(F.countDistinct("text").alias("sentences"))
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("rule", "n", F.round(F.col("n") / F.col("sentences"), 4).alias("rate"))


def firing_delta(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Firing counts against a baseline: any increase fails, a decrease improves."""
    both = now.select("rule", F.col("n").alias("now")).join(baseline.select("rule", F.col("n").alias("was")), "rule", "full_outer").select("rule", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("was", F.lit(0)).alias("was"))
    return both.withColumn("verdict", F.when(F.col("now") > F.col("was"), "fail").when(F.col("now") < F.col("was"), "improved").otherwise("same"))


def guard_confusion(decisions: DataFrame) -> DataFrame:
    """Confusion counts of ``decided`` against ``gold``, recall and agreement."""
    d, g = F.col("decided"), F.col("gold")
    n = decisions.agg(F.count_if(d & g).alias("tp"), F.count_if(d & ~g).alias("fp"), F.count_if(~d & ~g).alias("tn"), F.count_if(~d & g).alias("fn"))
    return n.withColumns({"recall": F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4), "agreement": F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 4)})


def precision_recall(decisions: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F0.5 by group; with nothing decided or nothing wanted they are 1."""
    d, g = F.col("decided"), F.col("gold")
    n = decisions.groupBy(by).agg(F.count_if(d & g).alias("tp"), F.count_if(d & ~g).alias("fp"), F.count_if(~d & g).alias("fn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) == 0, 1.0).otherwise(F.col(a) / (F.col(a) + F.col(b)))
    out = n.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    p, r = F.col("precision"), F.col("recall")
    f = F.when(p + r == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return out.select(by, "tp", "fp", "fn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f, 4).alias("f05"))


def case_expectations(cases: DataFrame, corrections: DataFrame) -> DataFrame:
    """By case: violations (forbidden originals changed) and expected originals hit."""
    c = corrections.select("doc_id", "original").distinct().withColumn("made", F.lit(True))
    each = cases.join(c, ["doc_id", "original"], "left")
    made = F.col("made").isNotNull()
    return each.groupBy("doc_id").agg(F.count_if(made & (F.col("kind") == "forbid")).alias("violations"), F.count_if(made & (F.col("kind") == "expect")).alias("hits"), F.count_if(F.col("kind") == "expect").alias("expected"))


def case_totals(results: DataFrame, version: str = "version") -> DataFrame:
    """Violations, hits and expectations by version and, with a null version, of all."""
    return results.rollup(version).agg(F.sum("violations").alias("violations"), F.sum("hits").alias("hits"), F.sum("expected").alias("expected"))


def repeated_position_drop(matches: DataFrame, pages: int = 3) -> DataFrame:
    """Matches without those whose rounded place repeats for a term on ``pages`` pages (running heads)."""
    keys = ["term", "rx", "ry"]
    m = matches.withColumns({"rx": F.round("x", 0), "ry": F.round("y", 0)})
    heads = m.groupBy(*keys).agg(F.countDistinct("page").alias("pages")).where(F.col("pages") >= pages)
    return m.join(heads, keys, "left_anti").drop("rx", "ry")


def ambiguous_match_drop(matches: DataFrame, expected: DataFrame) -> DataFrame:
    """Where a term has more matches than expected and its exact ones are as many as expected, only those stay."""
    n = matches.groupBy("term").agg(F.count(F.lit(1)).alias("found"), F.count_if("exact").alias("exact_n")).join(expected, "term")
    strict = n.where("found > expected and exact_n = expected").select("term", F.lit(True).alias("strict"))
    return matches.join(strict, "term", "left").where("strict is null or exact").drop("strict")


def match_alignment(matches: DataFrame, expected: DataFrame) -> DataFrame:
    """Occurrence numbers of matches in order of place; a warning where their number is not the expected one."""
    w = Window.partitionBy("term")
    m = matches.join(expected, "term", "left").withColumn("found", F.count(F.lit(1)).over(w))
    occ = F.row_number().over(w.orderBy("page", "y", "x")) - 1
    fits = F.col("found") == F.col("expected")
    return m.select("term", "page", "x", "y", F.when(fits, occ).alias("occ"), F.coalesce(~fits, F.lit(True)).alias("warn"))


def rule_collision(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """Surfaces with two or more readings that are pair keys."""
    return readings.groupBy("surface").agg(F.countDistinct("reading").alias("readings")).where("readings >= 2").join(pairs.select(F.col("nonstd").alias("surface")), "surface", "left_semi")


def shared_surface(tokens: DataFrame, sentences: int = 2) -> DataFrame:
    """Tokens present in every sentence of a group, with the one nearest to the group's name; a tie gives null."""
    per = tokens.groupBy("grp", "surface").agg(F.countDistinct("sentence").alias("n"), F.first("total").alias("total")).where((F.col("n") == F.col("total")) & (F.col("total") >= sentences))
    near = per.withColumn("d", F.levenshtein("grp", "surface"))
    best = near.groupBy("grp").agg(F.min("d").alias("d"))
    hit = near.join(best, ["grp", "d"]).groupBy("grp", "d").agg(F.count(F.lit(1)).alias("n"), F.min("surface").alias("s"))
    return hit.select("grp", F.when(F.col("n") == 1, F.col("s")).alias("surface"), "d")


def page_realign(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected places (term, page, y, x) of terms of which fewer were found, each with the one found on its page.

    On a page the first expected ones are met, in order of place; the others are unfound. A term is realigned only if
    that explains its whole gap: it was found at all, and on no page more often than expected. Terms with a null page
    are not realigned. Places meet on (term, page) and their number there, so no term is gathered in one task.
    """
    sides = expected.select("term", "page", F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select("term", "page", F.lit(0).alias("e"), F.lit(1).alias("f")))
    pages = sides.groupBy("term", "page").agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    good = pages.groupBy("term").agg(F.sum("e").alias("e"), F.sum("f").alias("f"), F.bool_and(F.col("page").isNotNull() & (F.col("f") <= F.col("e"))).alias("fits")).where("fits and f > 0 and e > f").select("term")
    number = F.row_number().over(Window.partitionBy("term", "page").orderBy("y", "x"))
    met = found.select("term", "page", F.col("y").alias("found_y"), F.col("x").alias("found_x"), number.alias("n"), F.lit(True).alias("met"))
    e = expected.select("term", "page", "y", "x", number.alias("n")).join(good, "term", "left_semi")
    return e.join(met, ["term", "page", "n"], "left").select("term", "page", "y", "x", "found_y", "found_x", F.col("met").isNull().alias("unfound"))
