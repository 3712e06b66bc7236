"""Plans that write the words of families alike, without breaking families that are alike already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.sources.shared import written


def family_members(cards: DataFrame) -> DataFrame:
    """(axis, part, original, direction): each word in its tail family and its lead family."""
    direction = F.when(F.col("corrected").contains(" "), "spaced").otherwise("joined")
    keys = F.array(F.struct(F.lit("tail").alias("axis"), F.col("head").alias("part")), F.struct(F.lit("lead").alias("axis"), F.col("lead").alias("part")))
    return cards.select("original", direction.alias("direction"), F.explode(keys).alias("k")).select("k.axis", "k.part", "original", "direction")


def family_plan(cards: DataFrame, families: DataFrame, decided: DataFrame, choices: DataFrame, allow_break: bool = False) -> DataFrame:
    """What decided families (axis, part, proposal) ask of their words: original, direction, want, outcome, breaks.

    ``undecided``: its two families ask for different forms and ``choices`` (original, choice) has none for it; ``want``
    is null. ``kept``: it is written so already. ``blocked``: its move would leave one of its families, alike so far,
    with two forms. ``job``: it moves. A word that cannot move holds back the moving words of its families that are
    alike; those hold back others, so blocking spreads over shared families until no new word is met, one join a round.
    With ``allow_break`` nothing is blocked and ``breaks`` marks the moves that break a family. Words of no decided
    family, and null words, are left out; an empty table gives none.
    """
    each = family_members(cards)
    asked = each.join(decided.select("axis", "part", "proposal"), ["axis", "part"]).groupBy("original", "direction").agg(F.min("proposal").alias("low"), F.max("proposal").alias("high"))
    want = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("choice"))
    plan = written(asked.join(choices.select("original", "choice"), "original", "left").select("original", "direction", want.alias("want")), "family-want")

    moving = plan.where("want <> direction").select("original", F.lit(True).alias("moves"))
    alike = each.join(families.where(~F.col("split")).select("axis", "part"), ["axis", "part"], "left_semi").join(moving, "original", "left")
    alike = written(alike.select("axis", "part", "original", F.coalesce("moves", F.lit(False)).alias("moves")), "family-alike")
    broken = alike.groupBy("axis", "part").agg(F.bool_or("moves").alias("some"), F.bool_and("moves").alias("every")).where("some and not every")
    held = written(alike.where("moves").join(broken, ["axis", "part"], "left_semi").select("original").distinct(), "family-held")
    new = held
    while not allow_break and new.limit(1).count():
        met = alike.join(new, "original", "left_semi").select("axis", "part").distinct()
        new = written(alike.where("moves").join(met, ["axis", "part"], "left_semi").select("original").distinct().join(held, "original", "left_anti"), "family-held")
        held = held.unionByName(new)

    outcome = F.when(F.col("want").isNull(), "undecided").when(F.col("want") == F.col("direction"), "kept").when(F.col("held") & F.lit(not allow_break), "blocked").otherwise("job")
    marked = plan.join(held.withColumn("held", F.lit(True)), "original", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    return marked.select("original", "direction", "want", outcome.alias("outcome"), (F.col("held") & F.lit(allow_break)).alias("breaks"))


def _shared(members: DataFrame, split: DataFrame) -> DataFrame:
    """(axis, part, other_axis, other_part, words): split families that share words; on one axis they share none."""
    mine = members.join(split.select("axis", "part"), ["axis", "part"], "left_semi").select("axis", "part", "original").distinct()
    other = mine.select(F.col("axis").alias("other_axis"), F.col("part").alias("other_part"), "original")
    return mine.join(other, "original").where("axis <> other_axis").groupBy("axis", "part", "other_axis", "other_part").agg(F.count(F.lit(1)).alias("words"))


def _would_break(members: DataFrame, families: DataFrame) -> DataFrame:
    """(axis, part, break_joined, break_spaced): families alike so far that a split family breaks if it takes a form.

    A family alike so far has the form of all its words, so the word that it shares with the split family moves, and
    breaks it, if the split family takes the other form. Each is counted once, however many words it shares.
    """
    flagged = members.join(families.select("axis", "part", "split"), ["axis", "part"])
    split = flagged.where("split").select("axis", "part", "original")
    alike = flagged.where(~F.col("split")).select(F.col("axis").alias("axis_"), F.col("part").alias("part_"), "original", "direction")
    met = split.join(alike, "original").select("axis", "part", "axis_", "part_", "direction").distinct()
    return met.groupBy("axis", "part").agg(F.count_if(F.col("direction") == "spaced").alias("break_joined"), F.count_if(F.col("direction") == "joined").alias("break_spaced"))


def family_align(members: DataFrame, families: DataFrame, rounds: int = 4) -> DataFrame:
    """Split families with their proposals aligned: axis, part, was, proposal, flips.

    ``members``: axis, part, original, direction (``joined`` or ``spaced``); ``families``: axis, part, split, strong,
    proposal. In order of (axis, part), a family that is split and not strong takes the other form if that lowers its
    cost: its words in families that propose otherwise, and the families alike so far that it would break. This is
    repeated until nothing changes, ``rounds`` times at most.

    A word has one part an axis, so families of one axis share no words and their flips do not depend on each other:
    the order is kept by an axis at a time, all its families at once. Each family carries the count of its words whose other
    families propose a form; a flip is added to its neighbours' counts as a delta, in a join of the flipped families
    only. What a family would break does not change and is counted once. Null parts and words are left out; a family
    that shares no words keeps its proposal. Empty tables give an empty result.
    """
    split = families.where("split")
    shared = written(_shared(members, split), "family-shared")
    against = lambda form: F.sum(F.when(F.col("proposal") == form, F.col("words")).otherwise(0))
    proposed = split.select(F.col("axis").alias("other_axis"), F.col("part").alias("other_part"), "proposal")
    counts = shared.join(proposed, ["other_axis", "other_part"]).groupBy("axis", "part").agg(against("joined").alias("near_joined"), against("spaced").alias("near_spaced"))
    state = split.select("axis", "part", F.coalesce("strong", F.lit(False)).alias("strong"), F.col("proposal").alias("was"), "proposal", F.lit(0).alias("flips"))
    state = state.join(counts, ["axis", "part"], "left").join(_would_break(members, families), ["axis", "part"], "left")
    state = written(state.na.fill(0, ["near_joined", "near_spaced", "break_joined", "break_spaced"]), "family-state")
    axes = [r[0] for r in state.select("axis").distinct().orderBy("axis").collect()]  # two: tail and lead

    to_joined, to_spaced = F.col("near_spaced") + F.col("break_joined"), F.col("near_joined") + F.col("break_spaced")
    flips = ~F.col("strong") & F.when(F.col("proposal") == "joined", to_spaced < to_joined).otherwise(to_joined < to_spaced)
    other = F.when(F.col("proposal") == "joined", "spaced").otherwise("joined")
    for _ in range(rounds):
        changed = False
        for axis in axes:
            turned = written(state.where((F.col("axis") == axis) & flips).select("axis", "part", other.alias("proposal")), "family-turned")
            if turned.isEmpty():
                continue
            changed = True
            sign = F.when(F.col("proposal") == "joined", F.col("words")).otherwise(-F.col("words"))
            delta = turned.join(shared, ["axis", "part"]).groupBy(F.col("other_axis").alias("axis"), F.col("other_part").alias("part")).agg(F.sum(sign).alias("delta"))
            now = turned.select("axis", "part", F.lit(True).alias("turned"))
            moved = state.join(delta, ["axis", "part"], "left").join(now, ["axis", "part"], "left")
            step = F.coalesce("delta", F.lit(0))
            state = written(
                moved.select(
                    "axis", "part", "strong", "was", F.when(F.col("turned"), other).otherwise(F.col("proposal")).alias("proposal"), (F.col("flips") + F.coalesce(F.col("turned").cast("int"), F.lit(0))).alias("flips"),
                    (F.col("near_joined") + step).alias("near_joined"), (F.col("near_spaced") - step).alias("near_spaced"), "break_joined", "break_spaced",
                ),
                "family-state",
            )
        if not changed:
            break
    return state.select("axis", "part", "was", "proposal", "flips")


def family_apply(cards: DataFrame, plan: DataFrame, earlier: DataFrame) -> DataFrame:
    """Decisions on cards: original, corrected, status.

    A job rejects its card and accepts the reverse; a word that the plan keeps has its card accepted. Other cards keep
    the ``earlier`` decision on (original, corrected), or are pending.
    """
    c = cards.select("original", "corrected").join(plan.select("original", "outcome"), "original", "left").join(earlier.select("original", "corrected", F.col("status").alias("was")), ["original", "corrected"], "left")
    status = F.when(F.col("outcome") == "job", "rejected").when(F.col("outcome") == "kept", "accepted").otherwise(F.coalesce("was", F.lit("pending")))
    own, back = F.struct("original", "corrected", status.alias("status")), F.struct(F.col("corrected").alias("original"), F.col("original").alias("corrected"), F.lit("accepted").alias("status"))
    return c.select(F.explode(F.when(F.col("outcome") == "job", F.array(own, back)).otherwise(F.array(own))).alias("d")).select("d.*")


def family_open(families: DataFrame, decided: DataFrame, plan: DataFrame) -> DataFrame:
    """One row of what is still open: split families without a decision, words asked for both ways, blocked words."""
    left = families.where("split").join(decided.select("axis", "part"), ["axis", "part"], "left_anti").select(F.lit("families").alias("what"))
    words = plan.where("outcome in ('undecided', 'blocked')").select(F.col("outcome").alias("what"))
    n = lambda what: F.count_if(F.col("what") == what)
    return left.unionByName(words).agg(n("families").alias("families"), n("undecided").alias("undecided"), n("blocked").alias("blocked"), F.count(F.lit(1)).alias("total"))
