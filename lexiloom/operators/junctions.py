"""Spacing decisions that bind words of which one holds the other: conflicts, harmonise, group, propagate.

A form is a key (letters) with spaces; a conflict is a pair of forms where the shorter key stands in the longer one, from
letter ``place`` on (its first place), and the spaces within the shared letters differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.shared import written


def _key(form: str | Column) -> Column:
    return F.replace(form, F.lit(" "), F.lit(""))


def spaces_of(form: str | Column) -> Column:
    """After how many letters each space of ``form`` stands."""
    parts = F.split(form, " ")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, F.lit(1), i), "")))
    return F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<int>"))


def spaced(key: Column, spaces: Column) -> Column:
    """``key`` with spaces after so many letters, ascending."""
    return F.array_join(F.zip_with(F.concat(F.array(F.lit(0)), spaces), F.concat(spaces, F.array(F.length(key))), lambda a, b: F.substring(key, a + 1, b - a)), " ")


def _inside(spaces: Column, at: Column, size: Column) -> Column:
    """Those of ``spaces`` within ``size`` letters from ``at`` on, counted from there."""
    return F.transform(F.filter(spaces, lambda x: (x > at) & (x < at + size)), lambda x: (x - at).cast("int"))


def respaced(word: str, model: str, place: Column | None = None) -> Column:
    """``word`` with the spaces of ``model`` in the letters that they share and its own elsewhere, the shorter from letter ``place`` (the first) of the longer on."""
    key, other, at = _key(word), _key(model), F.lit(0) if place is None else place
    size = F.length(other)
    longer = F.array_sort(F.concat(F.filter(spaces_of(word), lambda x: (x <= at) | (x >= at + size)), F.transform(spaces_of(model), lambda x: (x + at).cast("int"))))
    return F.when(F.length(key) > size, spaced(key, longer)).otherwise(spaced(key, _inside(spaces_of(model), at, F.length(key))))


def junction_conflicts(cards: DataFrame, least: int = 4) -> DataFrame:
    """Pairs of forms (column ``majority``) with different spaces in shared letters: short, longer, place.

    Keys of ``least`` letters or more meet the substrings of longer keys in an equi-join: as many as the square of a
    word's length, whatever the number of words. Keys of equal letters are no pair. Nulls are left out.
    """
    c = cards.select(_key("majority").alias("key"), F.col("majority").alias("form")).where("length(key) >= 1").distinct()
    n = F.length("key")
    starts = F.when(n > least, F.sequence(F.lit(1), n - least + 1))
    subs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(least), n - i + 1), lambda k: F.struct((i - 1).alias("place"), F.substring("key", i, k).alias("part")))))
    longer = c.select(F.col("key").alias("long_key"), F.col("form").alias("longer"), F.explode(subs).alias("s")).select("long_key", "longer", F.col("s.place").alias("place"), F.col("s.part").alias("key")).where("key <> long_key")
    met = longer.join(c, "key").groupBy("key", "longer", F.col("form").alias("short")).agg(F.min("place").alias("place"))
    return met.where(spaces_of("short") != _inside(spaces_of("longer"), F.col("place"), n)).select("short", "longer", "place")


def junction_classes(conflicts: DataFrame, cards: DataFrame, verdicts: DataFrame) -> DataFrame:
    """What becomes of the cards of each conflict: short, longer, place, short_original, longer_original, outcome.

    ``cards``: original, corrected; ``verdicts``: key, verdict (``clear`` or ``weak``; a key without one was written one
    way only). ``preserved``: both are clear and neither would undo the other. ``mutual``: both are clear, but the original of
    one stands in the corrected form of the other, with spaces anywhere, without as a word. ``harmonise_long``,
    ``harmonise_short``: one is clear, and the other, named, has no verdict and is to follow. ``group``: for a reviewer.
    """
    c = cards.select("original", "corrected", _key("corrected").alias("key")).distinct().join(verdicts.select("key", "verdict"), "key", "left").withColumn("verdict", F.coalesce("verdict", F.lit("none")))
    side = lambda name: c.select(F.col("corrected").alias(name), F.col("original").alias(f"{name}_original"), F.col("verdict").alias(f"{name}_verdict"))
    both = conflicts.join(side("short"), "short").join(side("longer"), "longer")
    padded = lambda col: F.concat(F.lit(" "), F.col(col), F.lit(" "))
    undoes = lambda original, corrected: F.when(F.contains(original, F.lit(" ")), F.contains(corrected, F.col(original))).otherwise(F.contains(padded(corrected), padded(original)))
    a, b = F.col("short_verdict"), F.col("longer_verdict")
    undone = undoes("short_original", "longer") | undoes("longer_original", "short")
    outcome = F.when((a == "clear") & (b == "clear"), F.when(undone, "mutual").otherwise("preserved")).when((a == "clear") & (b == "none"), "harmonise_long").when((b == "clear") & (a == "none"), "harmonise_short").otherwise("group")
    return both.select("short", "longer", "place", "short_original", "longer_original", outcome.alias("outcome"))


def _placed(conflicts: DataFrame) -> DataFrame:
    """``conflicts`` with ``place``; without that column the shorter begins the longer."""
    return conflicts if "place" in conflicts.columns else conflicts.withColumn("place", F.lit(0))


def junction_harmonise(conflicts: DataFrame, support: DataFrame) -> DataFrame:
    """The form of each conflict with less support, respaced after the other: weak, strong, corrected. Ties: the longer is weak.

    ``support`` has a form and its count n. What is not changed by this is left out.
    """
    n = lambda name: support.groupBy(F.col("form").alias(name)).agg(F.max("n").alias(f"n_{name}"))
    both = _placed(conflicts).join(n("short"), "short").join(n("longer"), "longer")
    short_weak = F.col("n_short") < F.col("n_longer")
    named = both.select(F.when(short_weak, F.col("short")).otherwise(F.col("longer")).alias("weak"), F.when(short_weak, F.col("longer")).otherwise(F.col("short")).alias("strong"), "place").distinct()
    return named.withColumn("corrected", respaced("weak", "strong", F.col("place"))).where("corrected <> weak").drop("place")


def junction_groups(conflicts: DataFrame) -> DataFrame:
    """Forms tied by conflicts: form, junction (its first form in order), members. Their corrections are to be reviewed.

    The least form travels along conflicts, two steps a round, until nothing changes; rounds are written to the shared folder.
    """
    edges = conflicts.select(F.col("short").alias("a"), F.col("longer").alias("b"))
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "junction-edges")
    now = written(edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("label")), "junction-labels")
    while True:
        near = edges.join(now.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, "a").select("a", "label", F.least("label", "near").alias("least"))
        jump = step.join(now.select(F.col("a").alias("least"), F.col("label").alias("far")), "least", "left")
        after = written(jump.select("a", F.col("label").alias("was"), F.least("least", F.coalesce("far", "least")).alias("label")), "junction-labels")
        if after.where("was <> label").isEmpty():
            break
        now = after.select("a", "label")
    size = now.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    return now.join(size, "label").select(F.col("a").alias("form"), F.col("label").alias("junction"), "members")


def junction_propagate(conflicts: DataFrame, groups: DataFrame, cards: DataFrame, support: DataFrame) -> DataFrame:
    """The best supported form of each junction carried to the others in conflict with it.

    By card (original, corrected) whose corrected form is bound: the form respaced, and what becomes of the card:
    ``rejected`` if the original is left, ``accepted`` if the decided form governs all of its letters, else ``changed``.
    """
    n = support.groupBy("form").agg(F.max("n").alias("n"))
    decided = groups.join(n, "form").groupBy("junction").agg(F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("decided"))
    conflicts = _placed(conflicts)
    both = conflicts.select(F.col("short").alias("form"), F.col("longer").alias("other"), "place").unionByName(conflicts.select(F.col("longer").alias("form"), F.col("short").alias("other"), "place"))
    bound = groups.join(decided, "junction").join(both, "form").where("other = decided and form <> decided").select("form", "decided", "place").distinct()
    carried = cards.select("original", F.col("corrected").alias("form")).distinct().join(bound, "form").withColumn("corrected", respaced("form", "decided", F.col("place")))
    governed = F.length(_key("form")) <= F.length(_key("decided"))
    action = F.when(F.col("corrected") == F.col("original"), "rejected").when(governed, "accepted").otherwise("changed")
    return carried.select("original", "form", "decided", "corrected", action.alias("action"))
