"""Readings on the best path against all paths, and both holds of keys, each with a like word that is not held."""

import itertools
import random

from pyspark.sql import functions as F

from lexiloom.operators import readings
from lexiloom.plans import registry
from lexiloom.sources import mapped, tables
from lexiloom.sources.mapped import readings as mapped_readings
from lexiloom.sources.mapped import words

KIND = f"eojeol string, readings array<{readings.READING}>"
WORDS = "doc_id long, idx int, eojeol string"
FOLLOWS = {("NNG", "VV"): 0, ("MAG", "VV"): 0, ("JX", "VV"): 0, ("VV", "NNG"): 4, ("ETM", "NNG"): 0, ("EC", "VV"): 0, ("MM", "NNG"): 0}


def read(n, cost, packed):
    return n, cost, [tuple(x.split("/")) for x in packed.split()]


def test_best_path_equals_all_paths(spark):
    rng = random.Random(5)
    tags = ["A", "B", "C"]
    follows = {(a, b): rng.randint(0, 5) for a in tags for b in tags if rng.random() < 0.7}
    table = {f"w{k}": [read(n + 1, rng.randint(0, 6), f"x/{rng.choice(tags)} y/{rng.choice(tags)}") for n in range(rng.randint(0, 3))] for k in range(12)}
    docs = [(d, i, f"w{rng.randint(0, 11)}") for d in range(60) for i in range(rng.randint(1, 7))]
    text = {}
    for d, i, w in docs:
        text.setdefault(d, []).append(w)

    def brute(d, i):
        lo, hi = max(0, i - 2), min(len(text[d]), i + 3)
        options = [table[w] or [None] for w in text[d][lo:hi]]
        found = []
        for path in itertools.product(*options):
            cost = sum(r[1] for r in path if r) + sum(follows.get((a[2][-1][1], b[2][0][1]), 3) for a, b in itertools.pairwise(path) if a and b)
            center = path[i - lo]
            found.append((cost, center[0] if center else 99))
        return min(found)[1]

    words = spark.createDataFrame(docs, WORDS)
    places = readings.key_places(words, words.select(F.col("eojeol").alias("key")), most=2)
    got = readings.best_readings(places, words, spark.createDataFrame([(w, r) for w, r in table.items() if r], KIND), follows, 3)
    seen, want = {}, {}
    for d, i, w in docs:
        seen[d, w] = seen.get((d, w), 0) + 1
        if seen[d, w] <= 2:
            want[d, w, seen[d, w]] = brute(d, i)
    assert {(r.doc_id, r.key, r.occ): r.reading.n if r.reading else 99 for r in got.collect()} == want


def test_each_hold_both_ways(spark):
    table = [
        ("나올", [read(1, 1, "나올/NNG"), read(2, 2, "나오/VV ᆯ/ETM")]), ("수", [read(1, 1, "수/NNG")]), ("빨리", [read(1, 1, "빨리/MAG")]), ("실을", [read(1, 1, "실을/NNG")]),
        ("치뤄", [read(1, 1, "치루/VV 어/EC")]), ("말이", [read(1, 2, "말이/NNG"), read(2, 1, "말/NNG 이/JKS")]), ("곰이", [read(1, 1, "곰/NNG 이/JKS")]), ("과잘", [read(1, 1, "과자/NNG ᆯ/JKO")]), ("짚고", [read(1, 1, "짚/VV 고/EC")]), ("된", [read(1, 1, "되/VV ᆫ/ETM")]),
    ]
    docs = ["빨리 나올 수", "나올", "치뤄", "말이 수", "곰이", "과잘", "짚고", "나올나올", "동기와 빨리", "구굴", "말이 말이 말이 말이 나올"]
    rows = [(d, i, w) for d, t in enumerate(docs) for i, w in enumerate(t.split())] + [(99, 0, None), (None, 0, "나올")]
    keys = [(k,) for k in ("나올", "치뤄", "치루다", "말이", "곰이", "과잘", "짚고", "동기와", "구굴", None)]
    heads = [(w,) for w in ("말", "동기", "과자", "나오다", None)]
    args = spark.createDataFrame(rows, WORDS), spark.createDataFrame(keys, "key string"), spark.createDataFrame(table, KIND), spark.createDataFrame(heads, "word string")
    got = {(r.doc_id, r.key): r.hold for r in readings.homograph_in_context(*args, FOLLOWS, 2, ("구굴",)).collect() if r.doc_id is not None}
    assert got == {
        (0, "나올"): "verb",  # after an adverb and before a noun the path goes by the verb
        (1, "나올"): None,  # alone, the noun is cheaper
        (2, "치뤄"): None,  # its verb is a key itself
        (3, "말이"): "noun", (10, "말이"): "noun", (10, "나올"): None,
        (4, "곰이"): None,  # the noun is no headword
        (5, "과잘"): None,  # the parts do not add up to the word
        (6, "짚고"): "verb", (8, "동기와"): "particle", (9, "구굴"): "listed",
    }
    none = [a.limit(0) for a in args]
    assert readings.homograph_in_context(*none, FOLLOWS, 2).count() == 0 and readings.homograph_in_context(*args[:2], none[2], none[3], {}, 2).where("hold is not null").count() == 0


def test_all_holds_occur_in_the_documents(spark, sf):
    found = {r.hold for r in registry.QUERIES["homograph_in_context"](spark, sf).select("hold").distinct().collect()}
    assert {None, "verb", "noun"} <= found


def test_words_around_come_along_with_places(spark):
    docs = spark.createDataFrame([(1, "the Data base 12 of x data then there data"), (2, "data"), (3, None)], "doc_id long, text string")
    keys = words(docs).where("word = 'data'").select(F.col("eojeol").alias("key"))
    plain, along = readings.key_places(words(docs), keys), readings.key_places(words(docs, 2), keys)
    assert sorted(map(tuple, along.drop("near").collect())) == sorted(map(tuple, plain.collect()))
    table = mapped_readings(docs)
    lattice = lambda places, w: sorted((r.doc_id, r.occ, r.reading.n) for r in readings.best_readings(places, w, table, FOLLOWS, 2).collect())
    assert lattice(along, None) == lattice(plain, words(docs)) and len(lattice(plain, words(docs))) == 4


def test_words_and_readings_made_in_tasks_are_those_of_the_tables(spark, sf):
    odd = [(1, "The \u212Aelvin data\u0130x 12 data, ab abcdefghijklm DATA"), (2, None), (3, ""), (4, "r\u00E9sum\u00E9 zebra quartz"), (5, "\U0001D41Ax data \u1C89 base")]
    docs = tables.read(spark, sf, "documents").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = [r.text or "" for r in mapped.cuttable(docs).sort("doc_id", "text").collect()]
    whose, got = mapped.cut(texts)
    want = [r.e for r in docs.sort("doc_id", "text").select(F.transform(F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lower), lambda w: w.rlike(mapped.WORD)), lambda w: F.translate(w, mapped.LOWER, mapped.SYLLABLES)).alias("e")).collect()]
    assert [[w for k, w in zip(whose, got.to_pylist(), strict=True) if k == i] for i in range(len(texts))] == [e or [] for e in want]
    read = {r.eojeol: [(x.n, x.cost, [tuple(m) for m in x.morphemes]) for x in r.readings] for r in mapped_readings(docs).collect()}
    assert len(read) > 500 and all(mapped.read_word(w) == read.get(w, []) for w in got.to_pylist())


def test_holds_found_in_texts_equal_those_of_tables(spark):
    texts = ["the data base of data then there data data data zebra", None, "", "data \u212Aeys zoo data", "many seven data keys verbs"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "some other words of all and data with keys"), (None, "data keys"), (None, "keys verbs data")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda *w: spark.createDataFrame([(x.translate(str.maketrans(mapped.LOWER, mapped.SYLLABLES)),) for x in w] + [(None,)], "key string")
    keys, heads = of("data", "keys", "verbs", "zoo", "there", "missing", "zebra"), of("dat", "key", "verb", "all").select(F.col("key").alias("word"))
    for most, strange in ((4, 2), (1, 0), (2, 5)):
        want = readings.homograph_in_context(words(docs, 2), keys, mapped_readings(docs), heads, mapped.FOLLOWS, strange, (), 2, most).collect()
        got = readings.homograph_in_texts(mapped.cuttable(docs), mapped.cut, keys, mapped.read_word, heads, mapped.FOLLOWS, strange, (), 2, most).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 10
    empty = readings.homograph_in_texts(docs.limit(0), mapped.cut, keys.limit(0), mapped.read_word, heads.limit(0), {}, 2)
    assert empty.count() == 0


def test_lattices_equal_best_readings(spark):
    rng = random.Random(7)
    follows = {(a, b): rng.randint(0, 5) for a in "ABC" for b in "ABC" if rng.random() < 0.7}
    table = {f"w{k}": [read(n + 1, rng.randint(0, 4), f"x/{rng.choice('ABCD')} y/{rng.choice('ABCD')}") for n in range(rng.randint(0, 3))] for k in range(12)}
    for w in ("w1", "w2"):
        table[w].reverse()
    docs = [(d, i, f"w{rng.randint(0, 11)}") for d in range(80) for i in range(5)]
    words = spark.createDataFrame(docs, WORDS)
    places = words.where("idx = 2").select("doc_id", F.col("eojeol").alias("key"), F.lit(1).alias("occ"), "idx")
    want = {r.doc_id: r.reading.n if r.reading else None for r in readings.best_readings(places, words, spark.createDataFrame([(w, r) for w, r in table.items() if r], KIND), follows, 3).collect()}
    lattices = readings.Lattices(table.__getitem__, follows, 3)
    shapes = lattices.shapes_for([w for *_, w in docs]).reshape(80, 5)
    got = lattices.best(shapes, 2)
    assert {d: table[docs[5 * d + 2][2]][r][0] if r >= 0 else None for d, r in enumerate(got.tolist())} == want


def test_no_word_of_the_documents_is_shuffled(spark, sf):
    plan = registry.QUERIES["homograph_in_context"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan and "Exchange hashpartitioning" not in plan
