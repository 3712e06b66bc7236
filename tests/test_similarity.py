"""Similar terms against all pairs, and distances in letters."""

import random

from pyspark.sql import functions as F

from lexiloom.functions.text import letter_distance, letters_of
from lexiloom.operators import rules


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_similar_terms_are_all_pairs(spark):
    rng, words = random.Random(3), {"abcdefgh", "xbcdefgy", "abcdehgf", "abcdefgx", "가나다라마바", "각나다라마바"}
    for size in (3, 5, 6, 8, 11, 12, 13, 14, 15, 16, 20, 31):
        for _ in range(6):
            word = "".join(rng.choice("abcdé") for _ in range(size))
            words.add(word)
            for _ in range(8):
                w = list(word)
                for _ in range(rng.randint(1, 3)):
                    at = rng.randint(0, len(w) - 1)
                    w[at : at + rng.randint(0, 1)] = rng.choice(["", "x", rng.choice("abcdé")])
                words.add("".join(w))
    df = spark.createDataFrame([(w,) for w in [*words, "abcdefgh", None, ""]], "word string").withColumn("n", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {(r.word, r.other): r.distance for r in rules.term_similarity(df).collect()}
    kept = sorted(w for w in words if len(w) >= 5)
    want = {(a, b): d for a in kept for b in kept if a < b and abs(len(a) - len(b)) <= 2 and (d := edits(a, b)) <= 2}
    assert got == want and sum(len(a) > 12 and len(b) > 12 for a, b in want) > 50 and sum(len(a) <= 12 < len(b) for a, b in want) > 5
    assert rules.term_similarity(df.limit(0)).count() == 0


def test_letters(spark):
    df = spark.createDataFrame([("한글", "한굴"), ("값", "갑"), ("abc", "abd"), ("가a힣", "가a힢"), (None, "가")], "a string, b string")
    got = df.select(letters_of(F.col("a")).alias("l"), letter_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [1, 1, 1, 1, None]
    assert got[0].l == "한글" and got[2].l == "abc" and got[3].l == "가a힣"
