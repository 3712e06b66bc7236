"""Checks on swapped names and words, in both directions, with nulls, empty tables and long edits."""

import random

from pyspark.sql import functions as F

from lexiloom.functions import text
from lexiloom.operators import names
from lexiloom.plans import registry
from lexiloom.plans.name_queries import _neighbours

SCHEMA = "doc_id long, seq long, original string, corrected string, source string, reason string, confidence string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, *cases):
    return spark.createDataFrame([(1, n, *c) for n, c in enumerate(cases)], SCHEMA)


def test_drop_glossed_name(spark):
    docs = spark.createDataFrame([(1, "The Harbours (port authority) and Mill（no） and Quay (12)."), (2, None)], "doc_id long, text string")
    c = table(spark, ("harbours", "station", "ai_typo", "", "high"), ("harbours", "harbour", "ai_typo", "", "high"), ("harbours", "station", "dict", "", "high"), ("mill", "building", "ai_polish", "", "high"),
              ("quay", "building", "ai_typo", "", "high"), ("harbours and", "station", "ai_typo", "", "high"), (None, "station", None, None, None))
    assert [r[1] for r in rows(names.drop_glossed_name(c, docs).select("doc_id", "seq"))] == [1, 2, 4, 5, 6]
    assert rows(names.drop_glossed_name(c.limit(0), docs)) == []


def test_demote_org_name(spark):
    cases = [("해양개발청", "국토항만청", "ai_typo", "", "high"), ("국토항만칭", "국토항만청", "ai_typo", "", "high"), ("해양개발청(연안 담당)", "국토항만청(연안 담당)", "ai_typo", "", "high"), ("해양개발청(1990)", "국토항만청(1991)", "ai_typo", "", "high"),
             ("해양개발청", "국토항만청", "dict", "", "high"), ("푸른물류회관", "동부전시장", "ai_polish", "이 이름이 바른 것", "high"), ("푸른물류회관", "동부전시장", "ai_polish", "맞춤법", "high"), (None, "x", None, None, "high")]
    got = {r.seq: r.confidence for r in names.demote_org_name(table(spark, *cases), ("은행", "청"), ("이름", "바른|옳은")).collect()}
    assert got == {0: "low", 1: "high", 2: "low", 3: "high", 4: "high", 5: "low", 6: "high", 7: "high"}
    assert names.demote_org_name(table(spark, *cases), (), ()).where("confidence = 'low'").count() == 0


def test_changed_words_are_those_between_equal_ends(spark):
    c = table(spark, ("a b c d", "a x c d", "", "", ""), ("a b", "a", "", "", ""), ("a b c", "a x y z c", "", "", ""), ("a a", "a a a", "", "", ""), ("p q", "r s", "", "", ""), (None, "a", "", "", ""))
    assert rows(names.changed_words(c).select("seq", "o", "c")) == [(0, "b", "x"), (2, "b", "x"), (4, "p", "r"), (4, "q", "s")]


def test_drop_word_swap(spark):
    lexicon = spark.createDataFrame([("risk",), ("danger",), ("role",), ("roll",), (None,)], "word string")
    c = table(spark, ("the risk is", "the danger is", "ai_polish", "", ""), ("the risq is", "the danger is", "ai_polish", "", ""), ("the roll is", "the role is", "ai_typo", "", ""), ("the risk is", "the danger is", "rule", "", ""), ("risk", "risks", "ai_typo", "", ""))
    assert [r[1] for r in rows(names.drop_word_swap(c, lexicon).select("doc_id", "seq"))] == [1, 2, 3, 4]
    assert rows(names.drop_word_swap(c.limit(0), lexicon)) == []


def test_each_check_fires_on_the_documents(spark, sf):
    for name, parts in (("drop_glossed_name", 1), ("drop_word_swap", 2)):
        assert 0 < registry.QUERIES[name](spark, sf).count() < _neighbours(spark, sf, parts).count()
    assert 0 < registry.QUERIES["demote_org_name"](spark, sf).where("confidence = 'low'").count()


def test_swaps_are_judged_row_by_row(spark, sf):
    lexicon = spark.createDataFrame([("risk",), ("danger",), ("role",)], "word string")
    pair = [("the risk is", "the danger is"), ("the role is", "the rule is"), ("a role", "a danger"), (None, "danger")]
    rows_ = [(d, 1, a, b, "ai_polish", "", "") for d in (1, None) for a, b in pair]
    for most in (1_000_000, 0):
        kept = names.drop_word_swap(spark.createDataFrame(rows_, SCHEMA), lexicon, most=most).collect()
        assert sorted((r.doc_id or 0, r.original or "") for r in kept) == [(0, ""), (0, "the role is"), (1, ""), (1, "the role is")]
    plan = registry.QUERIES["drop_word_swap"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_swaps_in_rows_equal_those_of_joins(spark):
    rng = random.Random(3)
    pool = ["risk", "Risks", "danger", "dangers", "role", "rolling", "", "\u0130stanbul", "i\u0307stanbul", "\u039F\u0394\u039F\u03A3", "\u03BF\u03B4\u03BF\u03C2", "\u212Aelvin", "kelvin", "\uAC1C\uBC1C\uCCAD", "\uD56D\uB9CC\uCCAD", "\U0001D41A", "a\nb", "xy\ning", "a", "b"]
    text_ = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))
    rows_ = [(1, n, text_(), text_(), rng.choice(["ai_typo", "ai_polish", "dict", None]), "", "") for n in range(1500)] + [(1, -1, None, "a", "ai_typo", "", "")]
    c, lexicon = spark.createDataFrame(rows_, SCHEMA), spark.createDataFrame([(w.lower(),) for w in pool if w != "dangers"] + [(None,)], "word string")
    one, other = (rows(names.drop_word_swap(c, lexicon, most=m).select("seq")) for m in (1_000_000, 0))
    assert one == other and 400 < len(one) < 1400


def test_python_forms_equal_column_functions(spark):
    words = ["risks", "ing", "aing", "abing", "a\ning", "ab\u2028ing", "abings", "flies", "\uAC1C\uBC1C", "\uAC1D\uBC1C", "kitten", "sitting", "", "\U0001D41Aed"]
    got = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").select("a", "b", text.base_form(F.col("a")).alias("base"), text.letter_distance(F.col("a"), F.col("b")).alias("far")).collect()
    assert all(text.base_of(r.a) == r.base and text.distance_of(r.a, r.b) == r.far for r in got)
