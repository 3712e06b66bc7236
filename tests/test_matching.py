"""Occurrences of any strings against a plain search, rejected ones, and fixes put in at their places."""

import random

from pyspark.sql import functions as F

from lexiloom.operators import corrections, matching, review, rules

KIND = "doc_id long, seq long, original string, corrected string, category string, confidence string, status string"


def plain(text, string):
    at, found = 0, []
    while string and (at := text.find(string, at)) >= 0:
        found.append(at)
        at += len(string)
    return found


def test_starts_equal_a_plain_search():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab\\E") for _ in range(rng.randint(0, 40)))
        strings = ["".join(rng.choice("ab\\E") for _ in range(rng.randint(0, 4))) for _ in range(8)]
        assert matching.starts_of(text, strings) == [plain(text, s) for s in strings]


def test_occurrences_of_any_characters(spark):
    texts = {1: "a\\Eb \\Qx\\E a\\Eb (.*) $1 aaaa 😀é😀", 2: None, 3: "", 4: "aaa"}
    originals = ["a\\Eb", "\\E", "\\Q", "(.*)", "$1", "aa", "aaa", "é😀", "", None, "absent"]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("starts", F.lit("clash"))
    c = spark.createDataFrame([(d, k, o, "x", "spelling", "high", "accepted") for d in texts for k, o in enumerate(originals)] + [(9, 1, "a", "b", "", "", "")], KIND)
    got = {}
    for r in corrections.occurrence_index(c, docs).collect():
        got.setdefault((r.doc_id, r.original), []).append((r.occ, r.pos, r.end, r.total))
    want = {}
    for d, t in texts.items():
        for o in originals:
            places = plain(t or "", o or "")
            want[d, o] = [(i, p, p + len(o), len(places)) for i, p in enumerate(places)] or [(None, None, None, 0)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert corrections.occurrence_index(c.limit(0), docs).count() == 0


def test_rejected_occurrences_stay(spark):
    docs = spark.createDataFrame([(1, "ab ab abc \\E")], "doc_id long, text string")
    c = spark.createDataFrame([(1, 1, "ab", "X", "", "", "accepted"), (1, 2, "abc", "Y", "", "", "accepted"), (1, 3, "\\E", "$1\\", "", "", "accepted")], KIND)
    gone = spark.createDataFrame([(1, "ab", 1), (1, "abc", 0), (1, "nowhere", 0), (None, "ab", 0)], "doc_id long, original string, occ int")
    text = lambda rejected: corrections.apply_to_corpus(docs, c, rejected).first().text
    assert text(None) == "X X Y $1\\" and text(gone) == "X ab Xc $1\\" and text(gone.limit(0)) == "X X Y $1\\"


def test_fixes_are_put_in_at_their_places(spark):
    rows = [
        (1, 1, "data", "datum", "spelling", "high", ""), (1, 2, "datum", "dates", "spelling", "high", ""), (1, 3, "database , x", "database, x", "punctuation", "high", ""), (1, 4, "datum , data", "datum, data", "punctuation", "high", ""),
        (1, 5, "base", "basis", "spelling", "low", ""), (1, 6, "other , x", "other, x", "punctuation", "high", ""), (2, 1, "data , x", "data, x", "punctuation", "high", ""), (1, 7, "data", "later", "spelling", "high", ""),
        (1, 8, None, "x", "spacing", "high", ""), (1, 9, "", "none", "spelling", "high", ""), (1, 3, "database , x", "database, x", "punctuation", "high", ""),
        (3, 1, "leflet", "leaflet", "spelling", "high", ""), (3, 2, "leflets등", "leflets 등", "spacing", "high", ""), (3, 3, "leflet을x", "leflet을 x", "spacing", "high", ""),
    ]
    texts = lambda compose: sorted((r.doc_id, r.seq, r.corrected) for r in compose(spark.createDataFrame(rows, KIND)).collect())
    assert texts(review.compose_spelling) == [(1, 3, "database, x"), (1, 3, "database, x"), (1, 4, "dates, datum"), (1, 6, "other, x"), (1, 8, "x"), (3, 2, "leaflets 등"), (3, 3, "leaflet을 x")]
    assert texts(review.compose_inside) == [(1, 3, "datumbase, x"), (1, 3, "datumbase, x"), (1, 4, "dates, datum"), (1, 6, "other, x"), (1, 8, "x"), (3, 2, "leaflets 등"), (3, 3, "leaflet을 x")]
    for compose in (review.compose_spelling, review.compose_inside):
        assert compose(spark.createDataFrame([], KIND)).count() == 0


def test_anchors_of_any_characters(spark):
    docs = spark.createDataFrame([(1, "x\\E.y and \\Q.z"), (2, None)], "doc_id long, text string")
    got = sorted((r.original, r.corrected) for r in rules.anchor_narrow(docs, lambda t: F.replace(t, F.lit("."), F.lit(". "))).collect())
    assert got and all(c.replace(" ", "") == o for o, c in got)


def test_counts_hold_overlapping_places_and_repeats():
    assert matching.counts_of("aaa b", ["aa", "a", "", "aa", "x"]) == [2, 3, 0, 2, 0]
