"""The Korean corpus: one written sentence for each document, with its analysed morphemes.

The given documents hold no Hangul, so rules on Korean text run over a table that gives each document one of the
sentences below, by its id. It grows with the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sentences (texts) and their morphemes as word position, form and tag.
SENTENCES = (
    "나는 학교에 갔다.그는 집에 있다.",
    "먹을것이 없어서 할수 없다",
    "책 을 읽고 친구 와 놀았다",
    "그는 \"빨리 가자\"라고 말했다",
    "국립국어원(이하 국어원)은 규범을 정한다",
    "고종(高宗)이 1897년에 황제로 즉위했다",
    "3만원짜리 표를 5천명이 샀다",
    "https://example.org/a 를 보라",
    "사과(apple)는 맛있다 바나나(banana)은 달다",
    "그럴듯한 말은 그만해야 한다",
    "이것은 아니였고 왠만하면 곰곰히 생각했다",
    "방식 (way)로 바꾸고 식 (4)와 길(road)으로 간다",
    "(센터)운영은 (주)경성 [붙임]에서 (회의)때 한다",
    "뜻이 이루어 졌다 고려하여 질적 방이 작아 진다",
)
MORPHEMES = (
    "0 나 NP;0 는 JX;1 학교 NNG;1 에 JKB;2 가 VV;2 았다 EF;3 그 NP;3 는 JX;4 집 NNG;4 에 JKB;5 있 VV;5 다 EF",
    "0 먹 VV;0 을 ETM;0 것 NNB;0 이 JKS;1 없 VA;1 어서 EC;2 하 VV;2 ㄹ ETM;2 수 NNB;3 없 VA;3 다 EF",
    "0 책 NNG;1 을 JKO;2 읽 VV;2 고 EC;3 친구 NNG;4 와 JC;5 놀 VV;5 았다 EF",
    "0 그 NP;0 는 JX;1 빨리 MAG;2 가 VV;2 자 EF;2 라고 JKQ;3 말하 VV;3 였다 EF",
    "0 국립국어원 NNP;1 국어원 NNP;1 은 JX;2 규범 NNG;2 을 JKO;3 정하 VV;3 ㄴ다 EF",
    "0 고종 NNP;0 이 JKS;1 1897 SN;1 년 NNB;1 에 JKB;2 황제 NNG;2 로 JKB;3 즉위하 VV;3 였다 EF",
    "0 3 SN;0 만 NR;0 원 NNB;0 짜리 XSN;1 표 NNG;1 를 JKO;2 5 SN;2 천 NR;2 명 NNB;2 이 JKS;3 사 VV;3 았다 EF",
    "1 를 JKO;2 보 VV;2 라 EF",
    "0 사과 NNG;0 는 JX;1 맛있 VA;1 다 EF;2 바나나 NNG;2 은 JX;3 달 VA;3 다 EF",
    "0 그럴듯하 VA;0 ㄴ ETM;1 말 NNG;1 은 JX;2 그만하 VV;2 어야 EC;3 하 VX;3 ㄴ다 EF",
    "0 이것 NP;0 은 JX;1 아니 VCN;1 였 EP;1 고 EC;2 왠만하 VA;2 면 EC;3 곰곰히 MAG;4 생각하 VV;4 였다 EF",
    "0 방식 NNG;1 로 JKB;2 바꾸 VV;2 고 EC;3 식 NNG;4 와 JC;5 길 NNG;5 으로 JKB;6 가 VV;6 ㄴ다 EF",
    "0 ( SSO;0 센터 NNG;0 ) SSC;0 운영 NNG;0 은 JX;1 ( SSO;1 주 NNG;1 ) SSC;1 경성 NNP;2 [ SSO;2 붙임 NNG;2 ] SSC;2 에서 JKB;3 ( SSO;3 회의 NNG;3 ) SSC;3 때 NNB;4 하 VV;4 ㄴ다 EF",
    "0 뜻 NNG;0 이 JKS;1 이루 VV;1 어 EC;2 지 VX;2 었다 EF;3 고려하 VV;3 여 EC;4 질적 NNG;5 방 NNG;5 이 JKS;6 작 VA;6 아 EC;7 지 VX;7 ㄴ다 EF",
)
#: Parts of joined forms: joined, start, end, form, tag.
JOINED = (
    ("이루어졌다", 0, 4, "이루어지", "VV"), ("이루어졌다", 3, 4, "었", "EP"), ("이루어졌다", 4, 5, "다", "EF"),
    ("고려하여질적", 0, 3, "고려하", "VV"), ("고려하여질적", 3, 4, "여", "EC"), ("고려하여질적", 4, 5, "지", "VX"), ("고려하여질적", 4, 5, "ㄹ", "ETM"), ("고려하여질적", 5, 6, "적", "NNB"),
    ("작아진다", 0, 1, "작", "VA"), ("작아진다", 1, 2, "아", "EC"), ("작아진다", 2, 3, "지", "VX"), ("작아진다", 2, 4, "ㄴ다", "EF"),
)


def corpus_ko(docs: DataFrame) -> DataFrame:
    """doc_id, sid, text: the sentence of each document, twice if its id is even."""
    sid = F.col("doc_id") % len(SENTENCES)
    one = F.element_at(F.array(*map(F.lit, SENTENCES)), (sid + 1).cast("int"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(one, F.lit("\n"), one)).otherwise(one)
    return docs.select("doc_id", sid.alias("sid"), text.alias("text"))


def morphemes(docs: DataFrame) -> DataFrame:
    """doc_id, word, idx, form, tag of the sentence of each document."""
    packed = F.element_at(F.array(*map(F.lit, MORPHEMES)), (F.col("doc_id") % len(MORPHEMES) + 1).cast("int"))
    each = docs.select("doc_id", F.posexplode(F.split(packed, ";")).alias("idx", "m")).withColumn("p", F.split("m", " "))
    return each.select("doc_id", F.col("p")[0].cast("int").alias("word"), "idx", F.col("p")[1].alias("form"), F.col("p")[2].alias("tag"))


def joined_analyses(spark: SparkSession) -> DataFrame:
    """joined, start, end, form, tag."""
    return spark.createDataFrame(JOINED, "joined string, start int, end int, form string, tag string")


def _array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DUCK_KO = {
    "corpus_ko": f"SELECT doc_id, doc_id % {len(SENTENCES)} AS sid, CASE WHEN doc_id % 2 = 0 THEN s || chr(10) || s ELSE s END AS text FROM (SELECT doc_id, {_array(SENTENCES)}[doc_id % {len(SENTENCES)} + 1] AS s FROM documents)",
    "morphemes": f"""SELECT doc_id, CAST(p[1] AS INT) AS word, idx, p[2] AS form, p[3] AS tag FROM (SELECT doc_id, idx, string_split(m, ' ') AS p FROM (
  SELECT doc_id, unnest(range(len(a))) AS idx, unnest(a) AS m FROM (SELECT doc_id, string_split({_array(MORPHEMES)}[doc_id % {len(MORPHEMES)} + 1], ';') AS a FROM documents)))""",
}
