"""Tables derived from the given ones, in Spark and, for the SQL twins, as DuckDB common table expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.runs import Runs, Spots, chunks, holds, unlike
from lexiloom.sources.shared import bit_table, sized

LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(docs: DataFrame) -> DataFrame:
    """Letter runs: doc_id, idx (from 0), gap (text since the run before), surface. One scan, no shuffle."""
    runs = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))
    gaps = F.slice(F.split("text", r"\p{L}+", -1), 1, F.greatest(F.size(runs), F.lit(1)))
    return docs.select("doc_id", F.posexplode(F.arrays_zip(runs.alias("surface"), gaps.alias("gap"))).alias("idx", "t")).select("doc_id", "idx", "t.gap", "t.surface").where("surface is not null")


def neighbours(docs: DataFrame, after: int = 3, before: int = 0) -> DataFrame:
    """Lower-cased letter runs with those around them: doc_id, idx (from 0), s0, s1 ..., the gaps g1 ... before them, and b1 ... back.

    The arrays of a row are shifted against each other, so no token is shuffled.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    gaps = F.split("text", r"\p{L}+", -1)
    many = F.greatest(F.size(words), F.lit(1))
    ahead = lambda array, k: F.slice(array, k + 1, many)
    none = F.lit(None).cast("string")
    shifted = [words.alias("s0"), *[ahead(words, k).alias(f"s{k}") for k in range(1, after + 1)], *[ahead(gaps, k).alias(f"g{k}") for k in range(1, after + 1)], *[F.concat(F.array_repeat(none, k), words).alias(f"b{k}") for k in range(1, before + 1)]]
    each = docs.select("doc_id", F.posexplode(F.arrays_zip(*shifted)).alias("idx", "t"))
    return each.select("doc_id", "idx", "t.*").where("s0 is not null")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), text."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, pos, word_type, register, source: the words of the benchmark passages and of part names."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    names = read(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    n = F.length("word")
    return words.union(names).distinct().select(
        "word",
        F.when(n % 3 == 0, "noun").when(n % 3 == 1, "verb").otherwise("pronoun").alias("pos"),
        F.lit("word").alias("word_type"),
        F.when(n % 5 == 0, "dialect").otherwise("").alias("register"),
        F.when(n % 2 == 0, "stdict").otherwise("opendict").alias("source"),
    )


def corrections(docs: DataFrame) -> DataFrame:
    """A correction for every 20th run of at least four letters, its kind fixed by place and document.

    doc_id, seq, original, corrected, reason, source, category, confidence, status.
    """
    t = tokens(docs).where("idx % 20 = 0 and length(surface) >= 4")
    k = (F.col("doc_id") + F.col("idx") / 20).cast("long") % 9
    s, cut = F.col("surface"), F.expr("concat(substring(surface, 1, 2), ' ', substring(surface, 3))")
    corrected = (
        F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("s"))).when(k == 2, cut).when(k == 3, F.translate(s, LOWER, LOWER.upper())).when(k == 4, F.expr("substring(surface, 1, length(surface) - 1)"))
        .when(k == 5, F.concat(s, F.lit("\n"))).when(k == 6, F.reverse(s)).when(k == 7, F.lit("")).otherwise(F.concat(s, F.lit(", "), s))
    )
    m = F.col("idx") / 20 % 4
    return t.select(
        "doc_id",
        F.col("idx").cast("long").alias("seq"),
        F.col("surface").alias("original"),
        corrected.alias("corrected"),
        F.when(k == 3, "likely a convention").when(k == 6, "depends on context").otherwise("spelling").alias("reason"),
        F.when(m == 0, "ai_typo").when(m == 1, "ai_polish").when(m == 2, "dict").otherwise("rule").alias("source"),
        F.when(k == 2, "spacing").when(k == 8, "punctuation").otherwise("spelling").alias("category"),
        F.when((F.col("doc_id") + F.col("idx")) % 3 == 0, "low").otherwise("high").alias("confidence"),
        F.when(F.col("idx") % 7 == 0, "rejected").when(F.col("idx") % 7 < 4, "accepted").otherwise("pending").alias("status"),
    )


#: original, corrected, source: a correction for each guard, and others that none drops.
GUARD_CASES = [
    ("reading room", "reading", "ai_typo"), ("left (open", "left (open)", "ai_typo"), ("한글", "한글(hangul)", "ai_typo"), ("a sentence that goes", "none", "ai_typo"), ("page 12", "page 13", "ai_polish"),
    ("seoul", "서울", "ai_polish"), ("well-known", "well known", "ai_polish"), ("2001–2002", "2001·2002", "ai_polish"), ("ratio 3:4", "ratio 3·4", "ai_polish"), ("notebook", "note book", "ai_typo"),
    ("note book", "notebook", "ai_polish"), ("red, green", "red green", "ai_polish"), ("nato", "NATO", "ai_polish"), ("form", "from", "ai_typo"), ("recieve", "receive it", "ai_typo"), ("colour", "color", "ai_polish"),
    ("(Kim, 1999)", "(Kim 1999)", "ai_polish"), ("12개", "십이개", "ai_polish"), ("30500원", "삼만오백원", "ai_polish"), ("walked and talked", "walking and talks", "ai_typo"), ("김 철 수", "김철수", "ai_typo"), ("1,000", "1000", "ai_polish"), ("a b", "ab", "ai_polish"),
]


def guarded(docs: DataFrame) -> DataFrame:
    """``corrections``, and ``GUARD_CASES`` for each document with ``seq`` below 0: every guard has something to drop."""
    cases = docs.sparkSession.createDataFrame([(-1 - n, *case) for n, case in enumerate(GUARD_CASES)], "seq long, original string, corrected string, source string")
    return corrections(docs).select("doc_id", "seq", "original", "corrected", "source").unionByName(docs.select("doc_id").crossJoin(F.broadcast(cases)))


def _all_forms(docs: DataFrame) -> DataFrame:
    """doc_id, seq, original: every run and every two runs with one space between."""
    runs, gaps = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.split("text", r"\p{L}+", -1)
    many = F.greatest(F.size(runs), F.lit(1))
    each = F.arrays_zip(runs.alias("surface"), F.slice(runs, 2, many).alias("next"), F.slice(gaps, 2, many).alias("between"))
    pair = docs.select("doc_id", F.posexplode(each).alias("idx", "t")).select("doc_id", "idx", "t.*").where("surface is not null")
    one, two = F.struct(F.lit(0).alias("k"), F.col("surface").alias("o")), F.struct(F.lit(1).alias("k"), F.when(F.col("between") == " ", F.concat_ws(" ", "surface", "next")).alias("o"))
    return pair.select("doc_id", "idx", F.explode(F.array(one, two)).alias("f")).where("f.o is not null").select("doc_id", (2 * F.col("idx") + F.col("f.k")).cast("long").alias("seq"), F.col("f.o").alias("original"))


def _likely_forms(docs: DataFrame, minority: DataFrame) -> DataFrame:
    """``_all_forms`` that may be in ``minority``, all of these and few others: what a bit table of single words and one of pairs let pass."""
    single, pair = (bit_table(minority.where(F.contains("minority", F.lit(" ")) == spaced).select(F.replace("minority", F.lit(" "), F.lit("")))) for spaced in (False, True))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("seq", T.LongType()), T.StructField("original", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in chunks(batch.column("text").to_pylist()):
                runs = Runs(texts)
                data, at = runs.lowered()
                spots = Spots(data)
                one = np.flatnonzero(holds(single.value, spots.of(at[:-1], at[1:])))
                two = np.flatnonzero(runs.pair)
                two = two[holds(pair.value, spots.of(at[two], at[two + 2]))]
                forms = [*runs.as_written(one), *(f"{a} {b}" for a, b in zip(runs.as_written(two), runs.as_written(two + 1), strict=True))]
                i = np.concatenate([one, two])
                seq = 2 * runs.place[i] + np.repeat([0, 1], [len(one), len(two)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(runs.text[i] + done)), pa.array(seq, pa.int64()), pa.array(forms, pa.string())], names=schema.names)
                done += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, schema).unionByName(_all_forms(docs.where(unlike("text"))))


def variant_corrections(docs: DataFrame, proposals: DataFrame) -> DataFrame:
    """A correction for every place of every document that has a minority form of ``proposals``, and ``GUARD_CASES`` for each document.

    Columns as of ``corrections``; the corrected form keeps the letters as written. ``seq`` is 2 * idx, one more for
    two runs, and below 0 for the cases. Only forms that may be minority forms meet ``proposals``, however many these are.
    """
    spark = docs.sparkSession
    minority = sized(proposals.select("minority", "majority"), "minority-forms")
    forms = _likely_forms(docs, minority.select("minority"))
    met = forms.withColumn("minority", F.lower("original")).join(minority, "minority")
    at = F.instr("majority", " ")
    spaced = F.concat(F.substring("original", F.lit(1), at - 1), F.lit(" "), F.substring("original", at, F.length("original")))
    as_written = F.when(F.length("minority") != F.length("original"), F.col("majority")).when(at > 0, spaced).otherwise(F.replace("original", F.lit(" "), F.lit("")))
    k = F.floor(F.col("seq") / 2)
    source = F.when(k % 4 == 0, "ai_typo").when(k % 4 == 1, "ai_polish").when(k % 4 == 2, "dict").otherwise("rule")
    variants = met.select("doc_id", "seq", "original", as_written.alias("corrected"), source.alias("source"), F.lit("spacing").alias("category"))
    cases = spark.createDataFrame([(-1 - n, *case) for n, case in enumerate(GUARD_CASES)], "seq long, original string, corrected string, source string")
    fixed = docs.select("doc_id").crossJoin(F.broadcast(cases)).withColumn("category", F.lit("spelling"))
    seven = F.pmod("seq", F.lit(7))
    return variants.unionByName(fixed).select(
        "doc_id", "seq", "original", "corrected", F.lit("spelling").alias("reason"), "source", "category",
        F.when(F.pmod(F.col("doc_id") + F.col("seq"), F.lit(3)) == 0, "low").otherwise("high").alias("confidence"),
        F.when(seven == 0, "rejected").when(seven < 4, "accepted").otherwise("pending").alias("status"),
    )


def votes(events: DataFrame) -> DataFrame:
    """Reviewer decisions on terms: event_id, user_id, original, corrected, action, ts."""
    k = F.get_json_object("props", "$.k").cast("int")
    action = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "edit_accept").otherwise("accept")
    return events.select("event_id", "user_id", F.concat(F.lit("term"), k).alias("original"), F.concat(F.lit("Term"), k).alias("corrected"), action.alias("action"), "ts", (k % 4 == 0).alias("spacing"))


_RUNS = r"(SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w, string_split_regex(text, '\p{L}+') AS g FROM documents)"

DUCK = {
    "tokens": f"SELECT doc_id, unnest(range(len(w))) AS idx, unnest(g[1:len(w)]) AS gap, unnest(w) AS surface FROM {_RUNS}",
    "lines": "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "lexicon": r"""SELECT word, CASE length(word) % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'pronoun' END AS pos, 'word' AS word_type,
  CASE WHEN length(word) % 5 = 0 THEN 'dialect' ELSE '' END AS register, CASE WHEN length(word) % 2 = 0 THEN 'stdict' ELSE 'opendict' END AS source
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(t), '\p{L}+')) AS word FROM (SELECT text AS t FROM benchmark UNION ALL SELECT p_name FROM part))""",
    "corrections": r"""SELECT doc_id, idx AS seq, surface AS original,
  CASE k WHEN 0 THEN surface WHEN 1 THEN surface || 's' WHEN 2 THEN surface[1:2] || ' ' || surface[3:] WHEN 3 THEN translate(surface, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 4 THEN surface[1:length(surface) - 1]
         WHEN 5 THEN surface || chr(10) WHEN 6 THEN reverse(surface) WHEN 7 THEN '' ELSE surface || ', ' || surface END AS corrected,
  CASE k WHEN 3 THEN 'likely a convention' WHEN 6 THEN 'depends on context' ELSE 'spelling' END AS reason,
  ['ai_typo', 'ai_polish', 'dict', 'rule'][(idx // 20) % 4 + 1] AS source,
  CASE k WHEN 2 THEN 'spacing' WHEN 8 THEN 'punctuation' ELSE 'spelling' END AS category,
  CASE WHEN (doc_id + idx) % 3 = 0 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN idx % 7 = 0 THEN 'rejected' WHEN idx % 7 < 4 THEN 'accepted' ELSE 'pending' END AS status
  FROM (SELECT *, (doc_id + idx // 20) % 9 AS k FROM tokens WHERE idx % 20 = 0 AND length(surface) >= 4)""",
    "votes": """SELECT event_id, user_id, 'term' || k AS original, 'Term' || k AS corrected,
  CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'edit_accept' ELSE 'accept' END AS action, ts, k % 4 = 0 AS spacing
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
}
_TEXT = lambda v: "'" + v.replace("'", "''") + "'"
_CASES = ", ".join(f"({-1 - n}, {_TEXT(o)}, {_TEXT(c)}, '{source}')" for n, (o, c, source) in enumerate(GUARD_CASES))
DUCK["guarded"] = f"SELECT doc_id, seq, original, corrected, source FROM corrections UNION ALL SELECT doc_id, v.seq, v.original, v.corrected, v.source FROM documents, (VALUES {_CASES}) v(seq, original, corrected, source)"
NEEDS = {"corrections": ("tokens",), "guarded": ("tokens", "corrections")}


def duck(names: str, body: str, /, **more: str) -> str:
    """A DuckDB query with the named derived tables, then ``more``, as common table expressions before ``body``."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*NEEDS.get(name, ()), name) if n not in wanted]
    parts = [f"{n} AS MATERIALIZED ({DUCK[n]})" for n in wanted] + [f"{n} AS MATERIALIZED ({sql})" for n, sql in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
