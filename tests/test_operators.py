"""Small literal cases of the operators, in both directions, and their behaviour on empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import consistency, corrections, events, lexicon, propagation, rules
from lexiloom.plans import registry
from lexiloom.sources import tables
from lexiloom.sources.tables import GUARD_CASES, tokens, variant_corrections


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "data base data base data base database"), (2, "note book 12 notebook notebook"), (3, ""), (4, None)], "doc_id long, text string")


def test_tokens(docs):
    got = rows(tokens(docs).where("doc_id = 2").select("idx", "gap", "surface"))
    assert got == [(0, "", "note"), (1, " ", "book"), (2, " 12 ", "notebook"), (3, " ", "notebook")]


def test_runs_that_touch_a_digit_go(spark):
    d = spark.createDataFrame([(1, "ab1 cd 2ef gh")], "doc_id long, text string")
    assert rows(consistency.tokenise_runs(tokens(d)))[0][0] == "cd" and len(rows(consistency.tokenise_runs(tokens(d)))) == 2


def test_a_digit_before_a_line_end_touches_no_run(spark):
    d = spark.createDataFrame([(1, "ab 12\ncd 3 ef"), (2, "gh\n4\n\nij5\nkl")], "doc_id long, text string")
    assert rows(consistency.tokenise_runs(tokens(d))) == [("ab", 1), ("cd", 1), ("ef", 1), ("gh", 1), ("kl", 1)]  # ij stands before a digit


def test_variant_verdict(docs):
    got = {r["key"]: (r["winner"], r["top"], r["second"], r["verdict"]) for r in consistency.variant_verdict(consistency.spacing_variants(docs)).collect()}
    assert got["database"] == ("data base", 3, 1, "clear")
    assert got["notebook"] == ("notebook", 2, 1, "weak")


def test_verdicts_and_majorities_by_document(spark):
    d = spark.createDataFrame([(1, "data base. data base. data base. database. note book. notebook"), (2, "database. database"), (3, "Database. database"), (4, "data base. database. code base. codebase. codebase. text base. textbase"), (5, None), (6, "")], "doc_id long, text string")
    forms = consistency.spacing_variants(d, by_document=True)
    got = {(r.doc_id, r["key"]): (r.winner, r.top, r.second, r.verdict) for r in consistency.variant_verdict(forms).collect()}
    assert got[1, "database"] == ("data base", 3, 1, "clear") and (2, "database") not in got and got[4, "codebase"] == ("codebase", 2, 1, "weak")
    known = spark.createDataFrame([("notebook",), (None,)], "word string")
    pairs = {(r.doc_id, r.minority): (r.majority, r.n_min, r.n_maj) for r in consistency.compound_majority(forms, known).collect()}
    assert pairs[1, "database"] == ("data base", 1, 3) and pairs[1, "note book"] == ("notebook", 1, 1)  # registered
    assert pairs[4, "data base"] == ("database", 1, 1) and pairs[4, "text base"] == ("textbase", 1, 1)  # as most words in base
    pooled = {r.minority: r.majority for r in consistency.compound_majority(consistency.spacing_variants(d), known.limit(0)).collect()}
    assert pooled["data base"] == "database" and pooled["notebook"] == "note book" and pooled["text base"] == "textbase"


def test_variants_of_documents_are_counted_in_their_rows(spark):
    texts = [(1, "Data base, data base; DATABASE 𐐀𐐁 x"), (2, "aa bb"), (2, "aabb. aa bb"), (None, "cc dd"), (None, "ccdd"), (3, None), (4, "1 2")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    forms = consistency.spacing_variants(d, by_document=True)
    got = Counter({(r.doc_id, r.form): r.n for r in forms.collect() if r.doc_id != 1})
    assert got == {(2, "aa bb"): 2, (2, "aabb"): 1, (None, "cc dd"): 1, (None, "ccdd"): 1}
    assert {r.form: r.n for r in consistency.spacing_variants(d.where("doc_id = 1"), by_document=True, several=True).collect()} == {"data base": 2, "database": 1}
    several = consistency.spacing_variants(d, by_document=True, several=True)
    assert sorted(r.form for r in several.collect()) == ["aa bb", "aabb", "cc dd", "ccdd", "data base", "database"]
    plan = consistency.spacing_variants(d.where("doc_id = 1"), by_document=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_first_sentences_are_found_in_their_rows(spark):
    d = spark.createDataFrame([(1, "No. First words here. Words first again!\nfirst alone now"), (2, None), (3, ""), (4, "one two three."), (4, "no. one four five.")], "doc_id long, text string")
    got = {(r.doc_id, r.word): r.sentence for r in consistency.first_context(d).collect()}
    assert got[1, "First"] == " First words here" and got[1, "words"] == " First words here" and got[1, "first"] == " Words first again" and got[1, "alone"] == "first alone now"
    assert got[4, "one"] in ("one two three", " one four five") and got[4, "five"] == " one four five" and (1, "No") not in got and len(got) == 13
    assert "Exchange" not in consistency.first_context(d.where("doc_id = 1"))._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows(consistency.variant_verdict(consistency.spacing_variants(none))) == []
    assert rows(consistency.realword_candidates(tokens(none))) == []
    assert rows(rules.chunk_documents(none, 10)) == []


def test_realword_pairs_differ_in_one_letter(spark):
    d = spark.createDataFrame([(1, "their " * 5 + "theip horse")], "doc_id long, text string")
    assert rows(consistency.realword_candidates(tokens(d))) == [("theip", "their", 5)]


def test_realword_scored_keeps_and_ranks_by_gap(spark):
    import math

    d = spark.createDataFrame([(1, "in their house " * 5), (2, "in theip house"), (3, "go theer now"), (4, "theep " * 50)], "doc_id long, text string")
    assert {(r.rare, r.common) for r in consistency.realword_candidates(tokens(d)).collect()} == {("theip", "their"), ("theip", "theep"), ("theer", "their"), ("theer", "theep")}
    scored = consistency.realword_scored(d, least_gap=5.0)
    n_words, a = 8, 0.01
    gap = math.log((5 + a) / a) + math.log((5 + a) / (5 + a * n_words)) - math.log(1 / n_words)
    assert rows(scored) == [("theip", "their", 5, round(gap, 4))]
    assert rows(consistency.realword_scored(d, least_gap=12.0)) == []
    every = consistency.realword_scored(d, least_gap=-1e9)
    assert every.count() == 4 and [r.common for r in consistency.topk_by_gap(every, cap=1).collect()] == ["their"]
    assert [r.common for r in consistency.topk_per_word(consistency.realword_candidates(tokens(d)), cap=1).collect()] == ["theep"]
    assert consistency.realword_scored(d.limit(0)).count() == 0


def test_chunks_join_to_the_text(spark):
    text = "One two. Three four five! Six?\nSeven eight nine ten eleven."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.text for r in rules.chunk_documents(d, 20).orderBy("chunk_id").collect()]
    assert "".join(got) == text and all(len(g) <= 20 or g.count(".") <= 1 for g in got)


def test_guard_chain_both_ways(spark):
    c = spark.createDataFrame(
        [(1, 1, "IBM", "ibm", "ai_typo"), (1, 2, "data base", "database", "ai_typo"), (1, 3, "teh", "the", "ai_typo"), (1, 4, "colour", "color", "ai_polish"), (1, 5, "in 1999", "in 1998", "ai_typo"), (1, 6, "x", "y", "dict")],
        "doc_id long, seq long, original string, corrected string, source string",
    )
    got = {r.seq: r.guard for r in corrections.guard_chain(c).collect()}
    assert got == {1: "latin_case", 2: "compound_join", 3: "syllable_reorder", 4: None, 5: "number_change"}


def test_whole_corrections_take_every_place_and_fire_every_guard(spark, docs):
    proposals = consistency.compound_majority(consistency.spacing_variants(docs), spark.createDataFrame([], "word string"))
    c = variant_corrections(docs, proposals)
    assert rows(c.where("seq >= 0").select("doc_id", "seq", "original", "corrected")) == [(1, 12, "database", "data base"), (2, 1, "note book", "notebook")]
    assert c.where("seq < 0").groupBy("doc_id").count().where(f"count = {len(GUARD_CASES)}").count() == 4
    assert {r.guard for r in corrections.guard_counts(c).collect()} == {*corrections.guards(), "kept"}


def test_whole_corrections_keep_letters_as_written(spark):
    d = spark.createDataFrame([(5, "Data base x DATABASE"), (6, "data base. data  base"), (6, "Database")], "doc_id long, text string")
    c = variant_corrections(d, spark.createDataFrame([("database", "data base")], "minority string, majority string"))
    assert rows(c.where("seq >= 0").select("doc_id", "seq", "original", "corrected")) == [(5, 6, "DATABASE", "DATA BASE"), (6, 0, "Database", "Data base")]


def test_occurrences(spark):
    d = spark.createDataFrame([(1, "aXa (b) aXaXa")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "aXa", "q", 1, "accepted"), (1, "(b)", "r", 2, "accepted"), (1, "zz", "y", 3, "accepted")], "doc_id long, original string, corrected string, seq long, status string")
    got = rows(corrections.occurrence_index(c, d).where("pos is not null").select("original", "occ", "pos", "end", "total"))
    assert got == [("(b)", 0, 4, 7, 1), ("aXa", 0, 0, 3, 2), ("aXa", 1, 8, 11, 2)]
    assert corrections.occurrence_index(c, d).where("original = 'zz'").first().pos is None


def test_apply_longest_first(spark):
    d = spark.createDataFrame([(1, "data base and data"), (2, "none")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "data", "datum", 1, "accepted"), (1, "data base", "database", 2, "accepted"), (2, "none", "x", 1, "rejected")], "doc_id long, original string, corrected string, seq long, status string")
    got = {r.doc_id: r.text for r in corrections.apply_to_corpus(d, c).collect()}
    assert got == {1: "database and datum", 2: "none"}


def test_apply_writes_nothing_over_its_own_output(spark):
    d = spark.createDataFrame([(1, "ab bc ab"), (2, None), (3, "xyz xy"), (4, "")], "doc_id long, text string")
    c = spark.createDataFrame([(1, "ab", "bc", 1, "accepted"), (1, "bc", "ab", 2, "accepted"), (3, "xyz", "xy", 1, "accepted"), (3, "xy", "q", 2, "accepted"), (3, "none", "x", 3, "accepted"), (3, "z", "w", 4, "pending"), (3, "yz", "u", 5, "accepted"), (2, "a", "b", 1, "accepted")], "doc_id long, original string, corrected string, seq long, status string")
    assert {r.doc_id: (r.text, r.n_edits) for r in corrections.apply_to_corpus(d, c).collect()} == {1: ("bc ab bc", 3), 2: (None, 0), 3: ("xy q", 2), 4: ("", 0)}
    got = {(r.doc_id, r.original): (r.replaced, r.shadowed, r.outcome) for r in corrections.apply_detail(d, c).collect()}
    assert got[3, "xy"] == (1, 1, "partial") and got[3, "yz"] == (0, 1, "consumed") and got[3, "none"] == (0, 0, "not_found") and got[3, "z"] == (0, 0, "not_accepted") and got[1, "ab"] == (2, 0, "applied")


@pytest.mark.parametrize("seed", range(3))
def test_overlap_resolve_is_greedy_by_length(spark, seed):
    import random

    rng = random.Random(seed)
    spans = {(doc, a, a + rng.randint(1, 9)) for doc in range(4) for a in [rng.randint(0, 60) for _ in range(30)]}
    got = {(r.doc_id, r.pos, r["end"]): r.shadowed for r in propagation.overlap_resolve(spark.createDataFrame(sorted(spans), "doc_id long, pos long, end long")).collect()}
    kept = set()
    for doc, a, b in sorted(spans, key=lambda s: (s[0], s[1] - s[2], s[1])):
        if not any(doc == x and a < z and y < b for x, y, z in kept):
            kept.add((doc, a, b))
    assert got == {s: s not in kept for s in spans}


@pytest.mark.parametrize("number, reading", [("0", ""), ("1", "일"), ("10", "십"), ("11", "십일"), ("105", "백오"), ("10000", "만"), ("30500", "삼만오백"), ("100000000", "일억"), ("123456789", "일억이천삼백사십오만육천칠백팔십구"), ("1000000000000", "일조")])
def test_number_reading(spark, number, reading):
    assert spark.createDataFrame([(number,)], "d string").select(corrections.number_reading("d")).first()[0] == reading


def test_guards_leave_other_edits_alone(spark):
    pairs = [("1,000", "1000", "ai_polish"), ("a b", "ab", "ai_polish"), ("12개", "십삼개", "ai_polish"), ("walked home", "walking home", "ai_polish"), ("물 관 길", "물관길", "ai_polish"), ("x-y", "x·z", "ai_polish"), ("(Kim, 1999)", "(Lee, 1999)", "ai_polish"), ("한글", "한글(12)", "ai_polish"), ("note book s", "no tebooks", "ai_polish")]
    c = spark.createDataFrame([(1, n, *p) for n, p in enumerate(pairs)], "doc_id long, seq long, original string, corrected string, source string")
    assert {r.seq: r.guard for r in corrections.guard_chain(c).collect()} == dict.fromkeys(range(len(pairs)))


@pytest.mark.parametrize("accepts, rejects, status", [(3, 0, "pending"), (3, 1, "context_dependent"), (2, 0, None), (0, 3, "exception")])
def test_consensus(spark, accepts, rejects, status):
    rows_ = [(u, "accept") for u in range(accepts)] + [(100 + u, "reject") for u in range(rejects)] + [(0, "accept")] * min(accepts, 1)
    v = spark.createDataFrame(rows_, "user_id long, action string").withColumns({"original": F.lit("a"), "corrected": F.lit("b"), "spacing": F.lit(False)})
    got = [r.status for r in events.consensus(v).collect()]
    assert got == ([status] if status else []) or (accepts, rejects) == (3, 1) and got == ["context_dependent"]


def test_lexicon_fallback(spark):
    lex = spark.createDataFrame([("run",), ("bank01",), ("walk",)], "word string")
    words = spark.createDataFrame([("run",), ("bank",), ("walking",), ("zzz",), ("a",)], "word string")
    assert {r.word: r.match_kind for r in lexicon.lexicon_fallback(words, lex).collect()} == {"run": "exact", "bank": "homograph", "walking": "base", "zzz": "none", "a": "short"}


def test_component_of_pair_takes_long_keys(spark):
    words = spark.createDataFrame([("internationalisations",), ("internat",), ("a",), ("xabx",)], "word string")
    pairs = spark.createDataFrame([("internationalisation",), ("ab",), ("a",)], "nonstd string")
    assert rows(lexicon.component_of_pair(words, pairs)) == [("internationalisations",), ("xabx",)]
    assert rows(lexicon.component_of_pair(words, pairs.where("nonstd = 'a'"))) == [] == rows(lexicon.component_of_pair(words, pairs.limit(0)))


def test_all_terms_are_compared_by_letters(spark, sf):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    words = [r.word for r in tables.lexicon(spark, sf).where("length(word) >= 5").select("word").collect()]
    counted = [(w, Counter(w)) for w in sorted(set(words))]
    close = ((a, b) for k, (a, p) in enumerate(counted) for b, q in counted[k + 1 :] if abs(len(a) - len(b)) <= 2 and (p - q).total() <= 2 and (q - p).total() <= 2)
    want = sorted((a, b, d, d) for a, b in close if (d := distance(a, b)) <= 2)
    got = rows(registry.QUERIES["term_similarity_all"](spark, sf))
    assert got == want and any(not (a + b).isascii() for a, b, *_ in got)


def test_normalise_text(spark):
    from lexiloom.functions.text import normalise_text

    d = spark.createDataFrame([("é​x",), (None,), ("한",)], "t string")
    assert [r[0] for r in d.select(normalise_text(F.col("t"))).collect()] == ["éx", None, "한"]


def test_every_query_has_a_plan(spark, sf):
    for name, query in registry.QUERIES.items():
        if "stream" not in name:
            assert query(spark, sf).columns, name


def test_particles_after_brackets(spark):
    d = spark.createDataFrame([(1, "바나나(banana)은 달다"), (2, "길(road)으로 가고 식 (4)와 방식 (way)로"), (3, "사과(apple)는 책(book)을"), (4, None), (5, "")], "doc_id long, text string")
    got = rows(rules.paren_particle(d).select("doc_id", "original", "corrected"))
    assert got == [(1, "바나나(banana)은", "바나나(banana)는"), (2, "길(road)으로", "길(road)로"), (2, "방식 (way)로", "방식(way)으로")]
    c = spark.createDataFrame(
        [(1, "바나나(banana)은", "바나나(banana)을"), (1, "nana)은", "nana)는"), (2, "길(road)으로", "길(road)로"), (2, "식 (4)와", "식 (4)과"), (2, "방식 (way)로", "방식 (way)로서"), (3, "책(book)을", "책(book)를"), (3, None, "x"), (3, "책(book)을", "책(paper)을")],
        "doc_id long, original string, corrected string",
    )
    got = [tuple(r) for r in rules.fix_paren_agreement(c, d).collect()]
    want = [(1, "바나나(banana)은", "바나나(banana)를"), (1, "nana)은", "nana)는"), (2, "길(road)으로", "길(road)로"), (2, "식 (4)와", "식 (4)과"), (2, "방식 (way)로", "방식 (way)로서"), (3, None, "x"), (3, "책(book)을", "책(paper)을")]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert rules.fix_paren_agreement(c.limit(0), d).count() == 0


def test_stems(spark):
    d = spark.createDataFrame([(1, "아니였으며, 됬다 괜찮다"), (2, None)], "doc_id long, text string")
    assert rows(rules.spelling_stems(d).select("original", "corrected")) == [("됬다", "됐다"), ("아니였으며,", "아니었으며,")]


def test_anchors(spark):
    d = spark.createDataFrame([(1, '"(5km),x 5km.'), (2, "“3cm” 3cm!"), (3, "3cm 13cm"), (4, None), (5, "a.b(c)d")], "doc_id long, text string")
    got = rows(rules.anchor_narrow(d, lambda t: F.regexp_replace(t, "([0-9])([a-z]m)", "$1 $2")))
    assert got == [(1, "5km", "5 km"), (2, "3cm", "3 cm"), (3, "13cm", "13 cm"), (3, "3cm", "3 cm")]
    some = rows(rules.anchor_narrow(d, lambda t: F.when(t.startswith('"'), F.regexp_replace(t, "([0-9])([a-z]m)", "$1 $2")).otherwise(t)))
    assert some == [(1, '"(5km),x', '"(5 km),x')]


def test_symbols_passives_and_cards(spark):
    from lexiloom.sources.korean import corpus_ko, joined_analyses, morphemes

    ids = spark.createDataFrame([(12,), (13,)], "doc_id long")
    assert rows(rules.symbol_noun_spacing(morphemes(ids)).select("original", "corrected")) == [("(센터)운영은", "(센터) 운영은"), ("(회의)때", "(회의) 때")]
    assert rows(rules.passive_join(corpus_ko(ids), joined_analyses(spark))) == [(13, "이루어 졌다", "이루어졌다"), (13, "작아 진다", "작아진다")]
    articles = spark.createDataFrame(
        [(1, "HM", 3, "띄어쓰기", None, "규칙 하나이다\n 해설 " + "가" * 700), (2, "HM", 3, None, None, "둘\n해설\n더 알아보기 끝"), (3, "SW", 3, "발음", "", None)],
        "doc_id long, prefix string, article_no int, chapter string, section string, text string",
    )
    examples = spark.createDataFrame([(1, "right", "b"), (1, "right", "a"), (1, "wrong", "c")], "doc_id long, kind string, word string")
    cards = rules.rule_cards_build(articles, examples)
    got = {r.doc_id: r for r in cards.collect()}
    assert [got[k].rule_id for k in (1, 2, 3)] == ["HM-0003", "HM-0003-1", "SW-0003"] and [got[k].category for k in (1, 2, 3)] == ["띄어쓰기", "맞춤법", "표준어"]
    assert got[1].correct == ["a", "b"] and got[1].incorrect == ["c"] and len(got[1].gloss) == 601 and got[1].gloss.startswith("해설 가")
    assert (got[2].rule_text, got[2].gloss, got[2].see_also) == ("둘", "해설", "끝") and (got[3].rule_text, got[3].gloss, got[3].correct) == ("", "", [])
    assert rows(rules.suspicious_cards(cards).select("doc_id")) == [(2,), (3,)]
