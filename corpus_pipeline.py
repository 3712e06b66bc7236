"""A corpus pipeline made of the operators of ``lexiloom.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what it decides takes effect. All
but the last return the columns of documents. ``run`` writes each stage's result to the shared folder as Parquet and
reads it again, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import exact_dedup, jaccard_join, language_id, sentence_pieces, source_mix
from lexiloom.llm.common import forget, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those without a letter or with a rejected score go."""
    return language_id.identify(docs.select(COLUMNS), language_id.learn(docs)).where("accepted").select(COLUMNS)


def _key() -> Column:
    """A key of a row's content, the same in every scan: ids may be null or repeat, equal rows share it."""
    return F.xxhash64(*COLUMNS)


def _without(docs: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows of ``gone``, and of the ``repeated`` ones one row each; both have ``key`` as _key, and _id."""
    d = docs.select(*COLUMNS).withColumn("_key", key)
    same = lambda x: (d["_key"] == x["_key"]) & d["doc_id"].eqNullSafe(x["_id"])
    out = gone.unionByName(repeated)
    once = d.join(repeated, same(repeated), "left_semi").dropDuplicates(["_key", "doc_id"])
    return d.join(out, same(out), "left_anti").unionByName(once).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, of several with that id one of them.

    A null text counts as empty. A row with a null id stays only if no other row has its text.
    """
    marks = exact_dedup.exact_dedup(docs.select("doc_id", "text")).select(F.col("text_sha256").alias("_key"), F.col("doc_id").alias("_id"), "kept")
    marks = written(marks, "exact-marks")
    gone, again = marks.where(~F.col("kept")), marks.where("kept").groupBy("_key", "_id").count().where("count > 1")
    gone, again = written(gone.select("_key", "_id").distinct(), "exact-gone"), written(again.select("_key", "_id"), "exact-again")
    return _without(docs, F.sha2(F.coalesce("text", F.lit("")), 256), gone, again)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of documents linked by shingle similarity the one with the smallest id stays; a null id counts as the largest.

    Rows without words stay, each for itself; equal rows are one document.
    """
    d = docs.select("doc_id", _key().alias("_key"), "text")
    groups = jaccard_join.jaccard_groups(d, "_key").select("_key", "component_id").distinct()
    marks = written(d.select("_key", F.col("doc_id").alias("_id")).groupBy("_key", "_id").count().join(groups, "_key"), "near-marks")
    stays = marks.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_key")).alias("s"), F.count(F.lit(1)).alias("n"))
    stays = written(stays.where("n > 1").select("component_id", F.col("s._key").alias("stays_key"), F.col("s._id").alias("stays_id")), "near-stays")
    gone = marks.join(stays, "component_id").where(~(F.col("_key").eqNullSafe(F.col("stays_key")) & F.col("_id").eqNullSafe(F.col("stays_id"))))
    gone = written(gone.select("_key", "_id"), "near-gone")
    again = written(marks.where("count > 1").select("_key", "_id").join(gone, ["_key"], "left_anti"), "near-again")
    return _without(docs, _key(), gone, again)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each whole copy of a document, and one for a part of it with that part's text.

    Documents of which nothing is taken go, those without words among them. A part keeps the separators between its
    words. Equal rows are separate documents.
    """
    d = docs.select(*COLUMNS).withColumn("_key", _key())
    mixed = source_mix.mix_sources(d, "_key").where("taken > 0").select("_key", "copies", "parts")
    taken = d.dropDuplicates(["_key"]).join(mixed, "_key")
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last")), F.col("copies"))
    each = taken.select(*COLUMNS, F.explode(F.concat(whole, "parts")).alias("part"))
    words = F.regexp_extract_all("text", F.lit(source_mix.WORD), F.lit(0))
    gaps = F.slice(F.split("text", source_mix.WORD, -1), 2, F.greatest(F.size(words), F.lit(1)))
    count = (F.col("part.last") - F.col("part.first")).cast("int")
    piece = F.array_join(F.transform(F.slice(F.arrays_zip(words.alias("w"), gaps.alias("g")), (F.col("part.first") + 1).cast("int"), count), lambda x: F.concat(x["w"], x["g"])), "")
    text = F.when(F.col("part.last").isNull(), F.col("text")).otherwise(piece)
    return each.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether decoding gives the text back."""
    import public_tokenizers

    model = sentence_pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    coded = sentence_pieces.digest_documents(docs.withColumn("_sha", sha), model)
    return coded.withColumn("round_trip", F.col("_sha") == F.col("decoded_sha256")).drop("_sha")


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pieces", pieces)]

#: Language identification, the mix of what it keeps and tokenizing are not SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages; a stage's result is deleted when its successor is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
