"""Cards leave out words that other corrections take everywhere, against plain Python."""

import random

from lexiloom.operators import consistency
from lexiloom.plans import registry
from lexiloom.plans.consistency_queries import _cards

TEXTS, OWN = "doc_id long, text string", "doc_id long, original string, source string"


def covered(spark, docs, own, forms):
    df = spark.createDataFrame([(f,) for f in forms], "form string")
    return {r.form for r in consistency.covered_forms(df, spark.createDataFrame(own, OWN), spark.createDataFrame(docs, TEXTS)).collect()}


def test_each_way_to_be_covered(spark):
    docs = [(1, "An Overview, overviews; over view"), (2, "anan ananan"), (3, "data base x data base y"), (4, "lone word"), (5, "once here"), (6, "once here"), (7, "twice twice")]
    forms = ["overview", "over view", "anan", "data base", "lone", "word", "once", "here", "twice", "absent"]
    own = [(1, "Overview", "ai_polish"), (2, "anan", "dict"), (3, "data base x data base", "rule"), (4, "lone word", "ai_polish"), (4, "", "rule"), (4, None, "rule"),
           (5, "once", "dict"), (5, "here", "dict"), (6, "So once", None), (7, "one twice", "dict"), (9, "over view", "dict")]
    # The original of one, of any source; twice inside one original; in each of two documents, once inside another word's.
    assert covered(spark, docs, own, forms) == {"overview", "anan", "data base", "once"}
    assert covered(spark, docs, [*own, (7, "twice!", "dict")], forms) == {"overview", "anan", "data base", "once", "twice"}
    # Rows of one id are one document, and so are those without.
    assert covered(spark, [(1, "form"), (1, "a form")], [(1, "a form", "dict")], ["form"]) == set()
    assert covered(spark, [(1, "form"), (1, "a form")], [(1, "a form", "dict"), (1, "form.", "dict")], ["form"]) == {"form"}
    assert covered(spark, [(None, "form"), (2, None)], [(None, "form", "dict")], ["form", None, ""]) == {"form"}
    assert covered(spark, docs, [], forms) == set() and covered(spark, docs, own, []) == set() and covered(spark, [], own, forms) == set()


def test_covered_forms_equal_plain_counts(spark):
    rng = random.Random(2)
    words = ["Aba", "ababa", "bab", "éa b", "a", " ", "b é", "말말", "\U0001D41A", "말 ab", "xyz"]
    text = lambda n: "".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = [(rng.choice([*range(25), None]), rng.choice([None, text(5), text(3), text(1)])) for _ in range(45)]
    by_id = {}
    for d, t in docs:
        by_id.setdefault(d, []).append((t or "").lower())
    own = [(d, o, rng.choice(["dict", "ai_polish", None])) for d, ts in by_id.items() for t in ts for o in (t, t[1:], t[:3]) if rng.random() < 0.8]
    forms = sorted({t[i : i + n] for ts in by_id.values() for t in ts for n in (2, 3, 4, 5) for i in range(len(t) - n + 1)})

    def taken(f):
        for d, ts in by_id.items():
            n = sum(t.count(f) for t in ts)
            mine = [(o.lower(), s) for i, o, s in own if i == d and o]
            if n and not any(o == f for o, _ in mine) and sum(o.count(f) for o, s in mine if s != "ai_polish") < n:
                return False
        return any(f in t for ts in by_id.values() for t in ts)

    want = {f for f in forms if taken(f)}
    assert covered(spark, docs, own, forms) == want and 20 < len(want) < len(forms) - 20


def test_cards_of_the_documents_leave_out_what_is_covered(spark, sf):
    every = {tuple(r) for r in _cards(spark, sf).collect()}
    left = {tuple(r) for r in registry.QUERIES["compound_cards"](spark, sf).collect()}
    assert left < every
