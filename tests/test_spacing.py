"""Spaces after adnominals: each exception holds a border back, and a like word without its cause is cut."""

import numpy as np
import pyarrow as pa

from lexiloom.operators import spacing
from lexiloom.plans import registry
from lexiloom.sources import mapped, tables

KIND = "doc_id long, eojeol string, tokens array<struct<form: string, tag: string, start: int>>, others array<struct<gap: double, tokens: array<struct<form: string, tag: string, start: int>>>>"
HEADWORDS = [("이중", True), ("지난주", True), ("한부모가족", True), ("갈수", True), ("만명", True), ("세우다", False), ("두개", True), ("전부", False)]


def tagged(packed):
    """ "form/tag/start ..." as tokens."""
    return [(f, t, int(at)) for f, t, at in (x.split("/") for x in packed.split())]


CASES = [
    # word, tokens, other analyses, what it becomes
    ("갈수있다", "가/VV/0 ᆯ/ETM/0 수/NNB/1 있/VA/2 다/EF/3", [], "갈 수 있다"),  # the first two are a noun, the whole is not
    ("할때", "하/VV/0 ᆯ/ETM/0 때/NNG/1", [], "할 때"),
    ("전세계", "전/MM/0 세계/NNG/1", [], "전 세계"),
    ("전부", "전/MM/0 부/NNB/1", [], "전 부"),  # registered, but not as a noun
    ("한규진", "한/MM/0 규/NNG/1 진/NNG/2", [], None),  # a surname and one syllable
    ("각규진", "각/MM/0 규/NNG/1 진/NNG/2", [], "각 규진"),
    ("이중과제", "이/MM/0 중/NNB/1 과제/NNG/2", [], None),  # a registered noun
    ("각중과제", "각/MM/0 중/NNB/1 과제/NNG/2", [], "각 중 과제"),
    ("두개", "두/MM/0 개/NNB/1", [], "두 개"),  # registered, but a native numeral with a unit
    ("10만명", "10/SN/0 만/NR/2 명/NNB/3", [], "10만 명"),  # registered, but a number goes before
    ("만명", "만/NR/0 명/NNB/1", [], None),
    ("10만명천", "10/SN/0 만/NR/2 명/NNB/3 천/NR/4", [], None),  # the number goes on
    ("한부모가족지원", "한/MM/0 부모/NNG/1 가족/NNG/3 지원/NNG/5", [], None),  # a longer headword over the border
    ("한부모가구", "한/MM/0 부모/NNG/1 가구/NNG/3", [], None),  # and so elsewhere in the document
    ("한나라가구", "한/MM/0 나라/NNG/1 가구/NNG/3", [], "한 나라가구"),
    ("지난주에", "지나/VV/0 ᆫ/ETM/1 주/NNB/2 에/JKB/3", [], None),  # the whole is a noun, particle aside
    ("지난날에", "지나/VV/0 ᆫ/ETM/1 날/NNB/2 에/JKB/3", [], "지난 날에"),
    ("없는지", "없/VA/0 는/ETM/1 지/NNB/2", [], None),  # an ending that looks like a noun
    ("떠난지", "떠나/VV/0 ᆫ/ETM/1 지/NNB/2", [], "떠난 지"),
    ("국인자격", "국/NNG/0 이/VCP/1 ᆫ/ETM/1 자격/NNG/2", [], None),  # a copula after one syllable
    ("학생인경우", "학생/NNG/0 이/VCP/2 ᆫ/ETM/2 경우/NNG/3", [], "학생인 경우"),
    ("세울", "세/MM/0 울/NNG/1", [(0.6, "세우/VV/0 ᆯ/ETM/1")], None),  # an inflected verb
    ("세운", "세/MM/0 운/NNG/1", [(2.5, "세우/VV/0 ᆫ/ETM/1")], "세 운"),  # too far from the best
    ("본가구", "본/MM/0 가구/NNG/1", [(0.6, "보/VV/0 ᆫ/ETM/0 가구/NNG/1")], "본 가구"),  # a noun is left over
    ("가구정책", "가구/NNG/0 정책/NNG/2", [], None),  # two nouns
    ("www.전세계", "전/MM/4 세계/NNG/5", [], None),
]


def test_each_exception_both_ways(spark):
    analyses = [(w, tagged(t), [(g, tagged(o)) for g, o in others]) for w, t, others, _ in CASES]
    rows = [(1, *a) for a in analyses] + [(1, *analyses[0]), (2, *analyses[13]), (2, None, None, None), (3, "", [], []), (4, "latin", tagged("latin/SL/0"), [])]
    words, heads = spark.createDataFrame(rows, KIND), spark.createDataFrame([*HEADWORDS, ("전부", False), (None, True)], "word string, noun boolean")
    got = sorted((r.doc_id, r.original, r.corrected) for r in spacing.adnominal_spacing(words, heads).collect())
    assert got == sorted([(1, w, want) for w, *_, want in CASES if want] + [(2, "한부모가구", "한 부모가구")])
    assert spacing.adnominal_spacing(words.limit(0), heads).count() == 0
    assert spacing.adnominal_spacing(words, heads.limit(0)).where("original = '이중과제'").first().corrected == "이 중 과제"


def test_mapped_words_are_those_of_the_documents(spark, sf):
    docs = tables.read(spark, sf, "documents")
    words = mapped.words(docs)
    first = words.withColumn("tokens", mapped.tokens_of(words["word"])).limit(500).collect()
    for r in first:
        assert len(r.word) == len(r.eojeol) and "".join(t.form for t in r.tokens) == r.eojeol and [t.start for t in r.tokens] == list(mapped.CUTS[min(len(r.word), 6)])
    assert words.count() > docs.count() and len(set(mapped.SYLLABLES)) == 26


def by_spaces(texts):
    words = [t.split() for t in texts]
    return np.repeat(np.arange(len(texts)), [len(w) for w in words]), pa.array([x for w in words for x in w], pa.large_string())


def test_each_exception_in_texts(spark):
    table = {w: (tagged(t), [(g, tagged(o)) for g, o in others]) for w, t, others, _ in CASES} | {"latin": (tagged("latin/SL/0"), [])}
    heads = spark.createDataFrame([*HEADWORDS, ("전부", False), (None, True)], "word string, noun boolean")
    rows = [(1, " ".join(w for w, *_ in CASES) + " 갈수있다"), (2, CASES[13][0]), (3, None), (4, "latin"), (None, "한부모가족지원 한부모가구")]
    want = sorted([(1, w, want) for w, *_, want in CASES if want] + [(2, "한부모가구", "한 부모가구")])
    for more in ([], [(2, "한부모가족지원")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        # The second row of document 2 holds the word back in the first; without an id no word does.
        expected = sorted([w for w in want if w[0] != 2 or not more] + [(-1, "한부모가구", "한 부모가구")])
        for most in (1_000_000, 0):
            got = spacing.adnominal_in_texts(docs, by_spaces, table.__getitem__, heads, most=most).collect()
            assert sorted((-1 if r.doc_id is None else r.doc_id, r.original, r.corrected) for r in got) == expected
    assert spacing.adnominal_in_texts(docs.limit(0), by_spaces, table.__getitem__, heads.limit(0)).count() == 0


def test_words_judged_in_texts_equal_those_of_tables(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text").limit(150)
    words, heads = mapped.words(docs), mapped.headwords(spark, sf)
    analysed = words.select("doc_id", "eojeol", mapped.tokens_of(words["word"]).alias("tokens"), mapped.others_of(words["word"]).alias("others"))
    want = sorted(map(tuple, spacing.adnominal_spacing(analysed, heads).collect()))
    assert sorted(map(tuple, spacing.adnominal_in_texts(mapped.cuttable(docs), mapped.cut, mapped.analyse_word, heads).collect())) == want and len(want) > 1000
    plan = registry.QUERIES["adnominal_spacing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
