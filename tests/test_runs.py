"""Letter runs of many texts at once against Spark's own, and counts of forms by a bit table against all forms."""

from pyspark.sql import functions as F

from lexiloom.functions.runs import PLAIN, RANGES, Runs, _tables
from lexiloom.operators import consistency, corrections
from lexiloom.sources import tables
from lexiloom.sources.shared import bit_table
from lexiloom.sources.tables import tokens

TEXTS = ["Data base, data base; DATABASE data  base", None, "", "ab", "İstanbul İs tanbul is tanbul istanbul", "ΟΔΟΣ ΟΔ ΟΣ οδ ος", "code1base code base. codebase", "Ünter ünter Ünterünter", "𐐀𐐁𐐂 𐐃𐐄 𐐀𐐁𐐂𐐃𐐄", "가나 다라 가나다라", "x" * 300 + " yy", " note book notebook ", "data", "base"]


def test_characters_are_classed_and_lowered_as_in_spark(spark):
    chars = spark.range(0x20000).where(" or ".join(f"id between {a} and {b}" for a, b in RANGES)).select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, F.lit("0"))), "utf-32").alias("c"))
    letter, lower, _ = _tables()
    each = chars.select("id", F.col("c").rlike(PLAIN).alias("plain"), F.col("c").rlike(r"^\p{L}\z").alias("letter"), F.lower("c").alias("low"), F.lower("c").rlike(r"^\p{L}\z").alias("still")).collect()
    assert len(each) > 39000 and all(r.plain and r.letter == r.still == letter[r.id] and (not r.letter or r.low == chr(lower[r.id])) for r in each)


def test_runs_are_those_of_spark(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    want = {(r.doc_id, r.idx): (r.surface, r.gap) for r in tokens(docs.where(F.col("text").rlike(PLAIN))).collect()}
    runs = Runs([t or "" for t in TEXTS])
    points = [chr(p) for p in runs.letters]
    assert {(d, i): "".join(points[a:b]) for d, i, a, b in zip(runs.text, runs.place, runs.at, runs.at[1:], strict=False)} == {k: s for k, (s, _) in want.items()}
    assert {(d, i) for d, i, p in zip(runs.text, runs.place, runs.pair, strict=True) if p} == {(d, i - 1) for (d, i), (_, gap) in want.items() if i and gap == " "}


def test_forms_of_keys_written_both_ways_are_counted_as_among_all_forms(spark, sf):
    known = spark.createDataFrame([("notebook",)], "word string")
    own = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for docs in (own, own.limit(0), spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")):
        forms = consistency.compound_forms(docs)
        every = consistency.spacing_variants(docs, parts=2)
        both = every.groupBy("key").agg(F.bool_or(F.col("form") == F.col("key")).alias("one")).where("one").select("key")
        assert sorted(map(tuple, forms.join(both, "key", "left_semi").collect())) == sorted(map(tuple, every.join(both, "key", "left_semi").collect()))
        assert sorted(map(tuple, consistency.compound_majority(forms, known).collect())) == sorted(map(tuple, consistency.compound_majority(every, known).collect()))
    spaced = consistency.compound_forms(own).where("key <> form").count()
    # Before, every two-part form was counted: those without a single run of their letters too.
    assert 0 < spaced < consistency.spacing_variants(own, parts=2).where("key <> form").count()


def test_a_bit_table_holds_all_its_strings(spark):
    from lexiloom.functions.runs import Spots, holds, strings

    runs = Runs(["ab cd abcd abcde über berü"])
    data, at = runs.lowered()
    table = bit_table(spark.createDataFrame([("abcd",), ("über",), (None,), ("",)], "s string")).value
    assert list(holds(table, Spots(data).of(at[:-1], at[1:]))) == [False, False, True, False, True, False]
    assert list(holds(table, Spots(data).of(at[:-2], at[2:]))) == [True, False, False, False, False] and strings(data, at)[2].as_py() == "abcd"
    assert not bit_table(spark.createDataFrame([], "s string")).value.any()


def test_only_likely_forms_meet_the_minority_forms(spark):
    texts = [*TEXTS, "Data base x DATABASE, note\nbook Über ber", "İs tanbul istanbul x", "ΟΔ ΟΣ x", "𐐀𐐁𐐂𐐃𐐄 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = [("data base", "database"), ("istanbul", "is tanbul"), ("οδ ος", "οδος"), ("𐐨𐐩𐐪𐐫𐐬", "𐐨𐐩𐐪 𐐫𐐬"), ("note book", "notebook"), ("über ber", "überber"), ("codebase", "code base")]
    minority = spark.createDataFrame(forms, "minority string, majority string")
    same = lambda df: sorted(map(tuple, df.withColumn("minority", F.lower("original")).join(minority, "minority").select("doc_id", "seq", "original").collect()))
    every, likely = tables._all_forms(docs), tables._likely_forms(docs, minority.select("minority"))
    assert same(likely) == same(every) and len(same(every)) >= len(forms)
    c = tables.variant_corrections(docs, minority)
    assert sorted(map(tuple, c.where("seq >= 0").select("doc_id", "seq", "original").collect())) == same(every)
    # Before, every form was sent to meet them.
    plain, asked = docs.where(F.col("text").rlike(PLAIN)), minority.select("minority")
    assert tables._likely_forms(plain, asked).count() < tables._all_forms(plain).count() / 2
    assert tables._likely_forms(docs.limit(0), asked).count() == 0 and same(tables._likely_forms(plain, asked.limit(0))) == []


def test_like_corrections_are_guarded_once_and_counted_all(spark):
    each = [(k, 1, o, c, s) for k in range(3) for o, c, s in [*tables.GUARD_CASES, ("x", "y", "dict"), (None, None, "ai_typo")]]
    c = spark.createDataFrame(each, "doc_id long, seq long, original string, corrected string, source string")
    one_by_one = corrections.guard_chain(c).groupBy(F.coalesce("guard", F.lit("kept")).alias("guard")).count()
    assert sorted(map(tuple, corrections.guard_counts(c).collect())) == sorted(map(tuple, one_by_one.collect()))
