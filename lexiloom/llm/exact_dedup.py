"""Exact deduplication with an extendible-hash index kept in shared files.

Only DataFrame functions are used, and nothing but the directory's depth reaches the driver. The steps:

1. **Directory.** Each text has a 64-bit hash. Distinct hashes are counted by their low bits, for every number of bits
   (depth). A bucket over ``capacity`` is split by one more bit, so a bucket is where a count is within ``capacity``
   and that of one bit less is not. The directory, in the shared folder, has a slot for each value of the low bits at
   the largest depth; a bucket of a lesser depth has several slots. Bits are added until no bucket is overfull.
   Copies share a hash, so a large group of copies never makes a bucket overfull.
2. **Index.** Texts find their bucket by slot and are grouped by (bucket, hash, text): the aggregation compares the
   bytes of texts that share a hash, and combines copies before the shuffle. Owner tasks take ranges of buckets, number
   the entries that collide on a hash (the chain), and write the index, without texts, to the shared folder.
3. **Probe.** Each row goes by its slot to a bucket and finds its entry there by hash and, in a chain, by SHA-256. A
   hot group is a skewed join key with many small rows on one side and one on the other, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import table, written


def low_bits(number: Column, bits: Column | int) -> Column:
    ones = F.shiftleft(F.lit(1).cast("long"), bits) if isinstance(bits, int) else F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return number.bitwiseAND(ones - 1)


def make_directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory (_slot, bucket) of the distinct ``hashes`` (column _hash), and its depth.

    A bucket of depth d with low bits b has the number 2**d + b. Slots that no hash has are left out.
    """
    top = (hashes.count() // capacity).bit_length() + 4
    while True:
        top = min(top, 62)
        slots = hashes.groupBy(low_bits(F.col("_hash"), top).alias("low")).agg(F.count(F.lit(1)).alias("n"))
        each = slots.select("low", "n", F.explode(F.sequence(F.lit(0), F.lit(top))).alias("depth"))
        loads = written(each.groupBy("depth", low_bits(F.col("low"), F.col("depth")).alias("low")).agg(F.sum("n").alias("n")), "directory-loads")
        if top == 62 or loads.where((F.col("depth") == top) & (F.col("n") > capacity)).isEmpty():
            break
        top += 4
    over = loads.where((F.col("n") > capacity) & (F.col("depth") < top))
    halves = over.select(F.explode(F.array(F.struct((F.col("depth") + 1).alias("depth"), "low"), F.struct((F.col("depth") + 1).alias("depth"), (F.col("low") + F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))).alias("low")))).alias("h")).select("h.*")
    first = loads.where("depth = 0").select("depth", "low")
    leaves = loads.join(halves.unionByName(first), ["depth", "low"]).where((F.col("n") <= capacity) | (F.col("depth") == top))
    depth = leaves.agg(F.max("depth")).first()[0] or 0
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth"))
    slots = F.sequence(F.col("low"), F.lit((1 << depth) - 1).cast("long"), step)
    return written(leaves.select(F.explode(slots).alias("_slot"), (step + F.col("low")).alias("bucket")), "directory"), depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, capacity: int = 1024) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    ``text`` is the (normalised) text to compare, by default the column ``text``; null counts as empty. Of equal texts
    the largest id stays. A null id stays only in a group without any other id; rows that repeat an id with equal text
    are all marked alike. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    hashes = written(keyed.select("_hash").distinct(), "text-hashes")
    directory, depth = make_directory(hashes, capacity)
    slot = low_bits(F.col("_hash"), depth)

    entries = (
        keyed.withColumn("_slot", slot)
        .join(directory, "_slot")
        .groupBy("bucket", "_hash", "_text")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "_hash", F.sha2("_text", 256).alias("_sha"), "keep_id", "group_size")
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "_hash").orderBy("_sha")) - 1
    index = written(entries.repartitionByRange("bucket").withColumn("chain", chain), "extendible-index")

    rows = keyed.select("_id", "_hash", F.sha2("_text", 256).alias("_sha"), slot.alias("_slot"))
    found = rows.join(directory, "_slot").join(index, ["bucket", "_hash", "_sha"])
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"), "bucket", "chain")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
