"""Family plans, corrections inside corrections and found places, on small cases."""

import random

from pyspark.sql import functions as F

from lexiloom.operators import corrections, families, measures

CARD = "original string, corrected string, head string, lead string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan_by_hand(cards, split, asked, choices):
    """Words one by one, families in any order, until nothing changes."""
    direction = {c[0]: "spaced" if " " in c[1] else "joined" for c in cards}
    members = {}
    for original, _, head, lead in cards:
        members.setdefault(("tail", head), set()).add(original)
        members.setdefault(("lead", lead), set()).add(original)
    asks = {}
    for key, proposal in asked.items():
        for word in members[key]:
            asks.setdefault(word, set()).add(proposal)
    want = {w: next(iter(a)) if len(a) == 1 else choices.get(w) for w, a in asks.items()}
    blocked, again = set(), True
    while again:
        again = False
        for key, words in members.items():
            moving = {w for w in words if want.get(w) not in (None, direction[w]) and w not in blocked}
            if key not in split and moving and moving != words:
                blocked |= moving
                again = True
    return sorted((w, direction[w], x, "undecided" if x is None else "kept" if x == direction[w] else "blocked" if w in blocked else "job", False) for w, x in want.items())


def test_family_plan_against_one_word_at_a_time(spark):
    seen = set()
    for seed in range(4):
        draw = random.Random(seed)
        cards = []
        for lead in "abcdefgh":
            for head in draw.sample("stuvwxyz", 4):
                joined, spaced = lead + head, f"{lead} {head}"
                cards.append((joined, spaced, head, lead) if draw.random() < 0.25 else (spaced, joined, head, lead))
        ways = {}
        for original, corrected, head, lead in cards:
            for key in (("tail", head), ("lead", lead)):
                ways.setdefault(key, []).append("spaced" if " " in corrected else "joined")
        split = {k for k, v in ways.items() if len(set(v)) > 1}
        asked = {k: draw.choice(["spaced", "joined"]) for k in sorted(split)[:3]}
        choices = {c[0]: "joined" for c in cards[::3]}
        c = spark.createDataFrame(cards, CARD)
        f = spark.createDataFrame([(a, p, (a, p) in split) for a, p in ways], "axis string, part string, split boolean")
        d = spark.createDataFrame([(a, p, way) for (a, p), way in asked.items()], "axis string, part string, proposal string")
        ch = spark.createDataFrame(list(choices.items()), "original string, choice string")
        plan = families.family_plan(c, f, d, ch)
        assert sorted(map(tuple, plan.collect()), key=str) == sorted(plan_by_hand(cards, split, asked, choices), key=str)
        free = families.family_plan(c, f, d, ch, allow_break=True)
        assert free.where("outcome = 'blocked'").count() == 0
        seen |= {r.outcome for r in plan.collect()}
    assert {"kept", "job", "blocked"} <= seen


def test_blocking_spreads_over_shared_families(spark):
    cards = spark.createDataFrame([("ax", "a x", "x", "a"), ("bx", "b x", "x", "b"), ("by", "b y", "y", "b"), ("cy", "c y", "y", "c"), (None, None, None, None)], CARD)
    kinds = spark.createDataFrame([("tail", "x", False), ("lead", "b", False), ("tail", "y", True), ("lead", "a", True)], "axis string, part string, split boolean")
    decided = spark.createDataFrame([("tail", "y", "joined"), ("lead", "b", "joined")], "axis string, part string, proposal string")
    none = spark.createDataFrame([], "original string, choice string")
    plan = families.family_plan(cards, kinds, decided, none)
    assert rows(plan.select("original", "outcome")) == [("bx", "blocked"), ("by", "blocked"), ("cy", "job")]  # ax does not move, so bx stays, so by stays
    earlier = spark.createDataFrame([("ax", "a x", "rejected"), ("cy", "c y", "accepted")], "original string, corrected string, status string")
    got = rows(families.family_apply(cards.where("original is not null"), plan, earlier))
    assert got == [("ax", "a x", "rejected"), ("bx", "b x", "pending"), ("by", "b y", "pending"), ("c y", "cy", "accepted"), ("cy", "c y", "rejected")]
    assert rows(families.family_open(kinds, decided, plan)) == [(1, 0, 2, 3)]
    assert rows(families.family_plan(cards.limit(0), kinds, decided, none)) == []


def test_overlap_compose(spark):
    docs = spark.createDataFrame([(1, "a data base, the data base and data"), (2, None), (3, "xx data base xx")], "doc_id long, text string")
    each = [(1, 1, "data base", "data bases", "accepted"), (1, 2, "data", "datum", "accepted"), (1, 3, "base", "basis", "rejected"), (2, 1, "data", "datum", "accepted"), (3, 1, "data base", "database", "accepted"), (3, 2, "xx data", "yy", "accepted")]
    c = spark.createDataFrame(each, "doc_id long, seq long, original string, corrected string, status string")
    assert rows(corrections.overlap_compose(docs, c)) == [(1, "data base", "data bases", "datum bases", 2)]
    assert rows(corrections.overlap_absorbed(docs, c)) == [(1, "data", 2, "data base"), (1, "data", 17, "data base")]
    assert rows(corrections.overlap_compose(docs, c.limit(0))) == []


def test_absorbed_places_are_searched_once(spark):
    docs = spark.createDataFrame([(1, "a data base and data")], "doc_id long, text string")
    c = spark.createDataFrame([(1, 1, "data base", "data bases", "accepted"), (1, 2, "data", "datum", "accepted")], "doc_id long, seq long, original string, corrected string, status string")
    absorbed = corrections.overlap_absorbed(docs, c)
    # Before, every use of the places searched the texts again.
    assert "MapInArrow" not in absorbed._jdf.queryExecution().toString() and rows(absorbed) == [(1, "data", 2, "data base")]


def test_compose_needs_one_value_for_all_places(spark):
    docs = spark.createDataFrame([(1, "one data base; data base data base")], "doc_id long, text string")
    each = [(1, 1, "data base", "data bases", "accepted"), (1, 2, "data", "datum", "accepted"), (1, 3, "base data base", "base data bases", "accepted")]
    c = spark.createDataFrame(each, "doc_id long, seq long, original string, corrected string, status string")
    # The last "data base" lies in the wider one, which takes its "data": it would stay "data bases" there, so none is composed.
    assert rows(corrections.overlap_compose(docs, c).select("original", "composed")) == [("base data base", "base datum bases")]


def test_page_realign(spark):
    schema = "term string, page long, y double, x double"
    expected = spark.createDataFrame([("t", 1, 1.0, 0.0), ("t", 1, 2.0, 0.0), ("t", 2, 1.0, 0.0), ("u", 1, 1.0, 0.0), ("u", 2, 1.0, 0.0), ("v", 1, 1.0, 0.0), ("w", None, 1.0, 0.0), ("w", 1, 1.0, 0.0)], schema)
    found = spark.createDataFrame([("t", 1, 5.0, 3.0), ("t", 2, 5.0, 3.0), ("u", 3, 1.0, 0.0), ("v", 1, 1.0, 0.0), ("w", 1, 1.0, 0.0)], schema)
    got = rows(measures.page_realign(expected, found).select("term", "page", "y", F.coalesce("found_y", F.lit(-1.0)), "unfound"))
    assert got == [("t", 1, 1.0, 5.0, False), ("t", 1, 2.0, -1.0, True), ("t", 2, 1.0, 5.0, False)]
    assert rows(measures.page_realign(expected.limit(0), found)) == []


def align_by_hand(members, fams, rounds=4):
    """One family at a time in key order, each cost counted anew from the words."""
    proposal = {k: f["proposal"] for k, f in fams.items() if f["split"]}
    words = {k: {w for a, p, w, _ in members if (a, p) == k} for k in fams}
    form = {w: d for _, _, w, d in members}

    def cost(key, want):
        near = sum(proposal[k] != want for w in words[key] for k in proposal if k != key and w in words[k])
        return near + sum(any(w in words[key] and form[w] != want for w in words[k]) for k, f in fams.items() if not f["split"] and form[min(words[k])] != want)

    flips = dict.fromkeys(proposal, 0)
    for _ in range(rounds):
        before = dict(flips)
        for key in sorted(proposal):
            other = "spaced" if proposal[key] == "joined" else "joined"
            if not fams[key]["strong"] and cost(key, other) < cost(key, proposal[key]):
                proposal[key], flips[key] = other, flips[key] + 1
        if flips == before:
            break
    return {k: (fams[k]["proposal"], proposal[k], flips[k]) for k in proposal}


def test_family_align_equals_one_family_at_a_time(spark):
    rng, members, fams, want = random.Random(11), [], {}, {}
    for graph in range(200):
        own = set()
        for n in range(rng.randint(2, 30)):
            word, form = f"{graph}w{n}", rng.choice(["joined", "spaced"])
            own |= {("tail", f"{graph}t{rng.randint(0, 5)}", word, form), ("lead", f"{graph}l{rng.randint(0, 5)}", word, form)}
        keys = {}
        for axis, part, _, form in own:
            keys.setdefault((axis, part), []).append(form)
        mine = {k: {"split": len(set(v)) > 1, "strong": rng.random() < 0.2, "proposal": rng.choice(["joined", "spaced"])} for k, v in keys.items()}
        members += own
        fams |= mine
        want |= align_by_hand(own, mine)
    m = spark.createDataFrame(members + [("tail", None, "x", "joined"), ("tail", "0t0", None, "joined")], "axis string, part string, original string, direction string").withColumn("words", F.lit("clash"))
    f = spark.createDataFrame([(*k, x["split"], x["strong"], x["proposal"]) for k, x in fams.items()], "axis string, part string, split boolean, strong boolean, proposal string")
    got = {(r.axis, r.part): (r.was, r.proposal, r.flips) for r in families.family_align(m, f).collect()}
    assert got == want and sum(n for *_, n in got.values()) > 200 and max(n for *_, n in got.values()) > 1
    assert families.family_align(m.limit(0), f.limit(0)).count() == 0
