"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.runs import BITS, blocks_of


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
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, most: int = 16 << 20) -> DataFrame:
    """``df`` written, and marked for a broadcast if its rows take no more than ``most`` bytes; else joins shuffle."""
    out = written(df, name)
    width = F.lit(16 * len(out.columns))
    for field in out.schema.fields:
        if field.dataType.simpleString() == "string":
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    size = out.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(out) if size <= most else out


def bit_table(df: DataFrame) -> Broadcast:
    """Bits of the strings in the only column of ``df``, sent to all tasks: 8 MB, whatever the number of rows.

    It says of every string of ``df`` that it is one, and of a part of the others too, so an exact join has to follow;
    what it leaves out need not be shuffled. With ten million strings a seventh of the others pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, bits = blocks_of(batch.column(0).drop_null())
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(bits)], names=["block", "bits"])

    found = df.mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.uint64)
    table[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return df.sparkSession.sparkContext.broadcast(table)
