"""Helpers shared by the operators of this subpackage: tables, the shared folder, hashing, components."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the shared folder ------------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and Spark runs in one JVM."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and no executor holds the only copy."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexiloom_path = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete tables made by ``written`` that no later plan reads."""
    for df in dfs:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._lexiloom_path)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_sample_cut(keyed: DataFrame, key: str, rows: int):
    """The largest ``key`` of the ``rows`` smallest: a cut that keeps at most ``rows`` rows (more only on ties)."""
    return keyed.select(key).orderBy(key).limit(rows).agg(F.max(key)).first()[0]


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Number the rows of ``df`` from 0 in ``order`` without a single-task window.

    The rows are range-partitioned, sorted and written; each partition numbers its own rows and adds the count of
    the partitions before it (one number a partition reaches the driver).
    """
    from pyspark.sql import Window

    ordered = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    counts = sorted((r[0], r[1]) for r in ordered.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in counts:
        before.append((part, total))
        total += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    out = ordered.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + within).cast("long")).drop("_part", "_at", "_before")
    out._lexiloom_path = ordered._lexiloom_path  # for ``forget``
    return out


# -- hashing in numpy -------------------------------------------------------------------------

_rng = np.random.RandomState(20240229)
#: A random 64-bit value for each byte value.
BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + _rng.randint(0, 2, 256).astype(np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, base in enumerate((BASE, BASE_INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences give the hash of any byte range; see ``range_hash``."""
    up, _ = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up, out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end): equal for equal byte strings wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def chunks_of(texts, limit: int = 1 << 21):
    """Cut a list of byte strings into (first, last) runs of about ``limit`` bytes: bounds what numpy holds at once."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


#: Longer words are hashed by BLAKE2: sums of powers modulo 2**64 collide, whatever the base, on strings of 1,024 bytes.
LONG_WORD = 128


def words_of(texts: list[bytes], lower: bool = True):
    """Word hashes of several texts at once: (data, starts, ends, document index, hash) of all words."""
    joined = b"\n".join(texts) + b"\n"
    if lower:
        joined = joined.lower()  # bytes.lower() changes A-Z only
    data = np.frombuffer(joined, np.uint8)
    inside = ~IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(bounds, starts, side="right")
    hashes = range_hash(prefix_hash(data), starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[k] = int.from_bytes(hashlib.blake2b(joined[starts[k] : ends[k]], digest_size=8, key=b"word").digest(), "little")
    return data, starts, ends, doc, hashes


# -- connected components ---------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b), component being the smallest id reachable.

    Alternating large-star and small-star rounds on DataFrames: each is an aggregation with map-side combine and an
    equi-join that adaptive execution can split on a hot id. A round's result is written to the shared folder. The
    loop ends when every id has one edge and no root has a parent. Loops and null ends are ignored; empty edges give
    an empty result.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        after = written(small, "edges")
        forget(now)
        now = after
        parents = now.groupBy("a").count()
        open_ = parents.where("count > 1").limit(1).count() or now.join(parents.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not open_:
            break
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


# -- per-text work in Arrow batches -----------------------------------------------------------


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers stay, idle, beside the stages that follow."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_texts(df: DataFrame, fn, new: str, text_col: str = "text", limit: int = 1 << 22) -> DataFrame:
    """``df`` without ``text_col`` and with the columns of the schema string ``new``, made by ``fn``.

    ``fn`` takes a list of UTF-8 byte strings (null is empty) of about ``limit`` bytes in all, or one longer text, and
    returns a dict of sequences, or Arrow arrays, of the same length. The other columns pass through as they are, nulls
    included.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    added = T._parse_datatype_string(new)
    kept = [f for f in df.schema.fields if f.name != text_col and f.name not in added.names]
    schema = T.StructType([*kept, *added.fields])

    def run(batches):
        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        rows = max(512, limit >> 11)  # of a batch, Python objects at a time
        for batch in (b.slice(first, rows) for b in batches for first in range(0, b.num_rows, rows)):
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            for first, last in chunks_of(texts, limit):
                got = fn(texts[first:last])
                arrays = [batch.column(f.name).slice(first, last - first) for f in kept]
                arrays += [got[f.name].cast(k) if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=k) for f, k in zip(added.fields, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        give_back()

    return df.mapInArrow(run, schema)


# -- labelled samples and calibration ---------------------------------------------------------


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(rows: DataFrame, label: str, id_col: str, per_label: int | dict) -> DataFrame:
    """About ``per_label`` rows of each label (never over twice that many), drawn by a hash of the id.

    ``per_label`` is a number, or one for each label. Rows with a null label are left out. Only the number of rows of
    each label reaches the driver.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 40))
    rate, most = F.lit(0), 1
    for value, n in counts:
        wanted = per_label.get(value, 0) if isinstance(per_label, dict) else per_label
        rate, most = F.when(F.col(label) == F.lit(value), F.lit(int((1 << 40) * min(1.0, wanted / n)))).otherwise(rate), most + 2 * wanted
    return rows.where(F.col(label).isNotNull() & (draw < rate)).limit(most)


def calibrate(margins: np.ndarray, positive: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve over margins (Newton's method, smoothed targets)."""
    good, bad = int(positive.sum()), int((~positive).sum())
    if not good or not bad:
        return 0.0, 4.0 if good else -4.0
    target = np.where(positive, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.abs(margins).max()), 1e-9)
    x = np.stack([margins / scale, np.ones(len(margins))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(hessian, x @ (p - target) + 1e-3 * w * [1, 0])
    return float(w[0] / scale), float(w[1])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
