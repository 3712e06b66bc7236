"""Conflicts anywhere inside words against plain Python, and each outcome of a pair of cards."""

import random

from pyspark.sql import functions as F

from lexiloom.operators import junctions


def spaces(form):
    found, n = set(), 0
    for ch in form:
        if ch == " ":
            found.add(n)
        else:
            n += 1
    return found


def put(key, cuts):
    return "".join((" " if i in cuts else "") + ch for i, ch in enumerate(key))


def conflicts_by_hand(forms):
    out = {}
    for a in forms:
        for b in forms:
            p, q = a.replace(" ", ""), b.replace(" ", "")
            at = q.find(p)
            if 4 <= len(p) < len(q) and at >= 0 and spaces(a) != {x - at for x in spaces(b) if at < x < at + len(p)}:
                out[a, b] = at
    return out


def test_conflicts_inside_words(spark):
    rng, forms = random.Random(4), set()
    for _ in range(400):
        key = "".join(rng.choice("ab") for _ in range(rng.randint(3, 12)))
        forms.add(put(key, {i for i in range(1, len(key)) if rng.random() < 0.2}))
    df = spark.createDataFrame([(f,) for f in [*forms, "abab", None, ""]], "majority string").withColumn("key", F.lit("clash")).withColumn("place", F.lit("clash"))
    found = junctions.junction_conflicts(df).collect()
    want = conflicts_by_hand(forms | {"abab"})
    assert {(r.short, r.longer): r.place for r in found} == want and len(found) == len(want) and any(want.values())
    pairs = spark.createDataFrame(found)
    done = pairs.select("short", "longer", "place", junctions.respaced("longer", "short", F.col("place")).alias("l"), junctions.respaced("short", "longer", F.col("place")).alias("s")).collect()
    for r in done:
        key, size = r.longer.replace(" ", ""), len(r.short.replace(" ", ""))
        own = {x for x in spaces(r.longer) if x <= r.place or x >= r.place + size}
        assert r.l == put(key, own | {x + r.place for x in spaces(r.short)})
        assert r.s == put(r.short.replace(" ", ""), {x - r.place for x in spaces(r.longer) if r.place < x < r.place + size})
    assert junctions.junction_conflicts(df.limit(0)).count() == 0


def test_outcomes(spark):
    cards = [("codeword", "code word"), ("code word list", "codeword list"), ("pass code", "passcode"), ("passcodebook", "pass code book"), ("data file", "datafile"), ("mydatafile", "my data file"), ("lone text", "lonetext"), ("alonetextx", "alone textx"), ("soft ware", "software"), ("softwares", "soft wares")]
    verdicts = [("codeword", "clear"), ("codewordlist", "clear"), ("passcode", "clear"), ("passcodebook", "clear"), ("datafile", "clear"), ("alonetextx", "clear"), ("software", "weak"), ("softwares", "clear")]
    c, v = spark.createDataFrame(cards, "original string, corrected string"), spark.createDataFrame(verdicts, "key string, verdict string")
    got = {(r.short, r.longer): r.outcome for r in junctions.junction_classes(junctions.junction_conflicts(c.select(F.col("corrected").alias("majority"))), c, v).collect()}
    assert got == {
        ("code word", "codeword list"): "mutual",  # codeword stands as a word in the longer one
        ("passcode", "pass code book"): "mutual",  # "pass code" stands in the longer one
        ("datafile", "my data file"): "harmonise_long", ("lonetext", "alone textx"): "harmonise_short", ("software", "soft wares"): "group",
    }
    other = spark.createDataFrame([("keyboard", "key board"), ("key boardsets", "keyboardsets")], "original string, corrected string")
    clear = spark.createDataFrame([("keyboard", "clear"), ("keyboardsets", "clear")], "key string, verdict string")
    pairs = junctions.junction_conflicts(other.select(F.col("corrected").alias("majority")))
    assert [r.outcome for r in junctions.junction_classes(pairs, other, clear).collect()] == ["preserved"]
    assert junctions.junction_classes(pairs.limit(0), other, clear).count() == 0
