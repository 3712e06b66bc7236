"""Places of many strings in one text at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def starts_of(text: str, strings: list[str]) -> list[list[int]]:
    """For each of ``strings`` where it starts in ``text``, from the left and without overlap of its own places.

    One pass of an Aho-Corasick automaton over the text. Empty strings start nowhere.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, s in enumerate(strings):
        if s:
            automaton.add_word(s, (*automaton.get(s, ()), k))
    found: list[list[int]] = [[] for _ in strings]
    free = [0] * len(strings)
    if len(automaton):
        automaton.make_automaton()
        for last, places in automaton.iter(text):
            for k in places:
                start = last + 1 - len(strings[k])
                if start >= free[k]:
                    found[k].append(start)
                    free[k] = last + 1
    return found


def counts_of(text: str, strings: list[str]) -> list[int]:
    """For each of ``strings`` at how many places it starts in ``text``, overlapping ones too. Empty strings start nowhere."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    n = dict.fromkeys(strings, 0)
    for s in n:
        if s:
            automaton.add_word(s, s)
    if len(automaton):
        automaton.make_automaton()
        for _, s in automaton.iter(text):
            n[s] += 1
    return [n[s] for s in strings]


def _counts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, asked in batches:
        yield pd.Series([counts_of(t or "", [] if a is None else list(a)) for t, a in zip(texts, asked, strict=True)], dtype=object)


def counts_in_text(text: Column, strings: Column) -> Column:
    """``counts_of`` for the array ``strings`` of each row."""
    return F.pandas_udf(_counts, "array<int>")(text, strings)


def find_in_texts(docs: DataFrame, strings: DataFrame, string_col: str = "original") -> DataFrame:
    """``strings`` (doc_id, a string, other columns) with ``starts``: where each starts in the text of its document.

    ``docs``: doc_id, text. The strings of a document are gathered first, so a text is sent and read once, however many
    are looked for. Strings whose document is not in ``docs`` are left out; a null or empty one, and any in a null
    text, starts nowhere. Places count code points from 0.
    """
    import pyarrow as pa

    rest = [f for f in strings.schema.fields if f.name != "doc_id"]
    grouped = strings.groupBy("doc_id").agg(F.collect_list(F.struct(*[f.name for f in rest])).alias("asked"))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("asked", grouped.schema["asked"].dataType), T.StructField("starts", T.ArrayType(T.ArrayType(T.IntegerType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            starts = []
            for text, asked in zip(batch.column("text"), lists, strict=True):
                starts.append(starts_of(text.as_py() or "", [s or "" for s in asked.values.field(string_col).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(starts, pa.list_(pa.list_(pa.int32())))], names=schema.names)

    found = docs.select("doc_id", "text").join(grouped, "doc_id").mapInArrow(run, schema)
    each = found.select("doc_id", F.explode(F.arrays_zip("asked", "starts")).alias("x"))
    return each.select("doc_id", *[F.col(f"x.asked.{f.name}").alias(f.name) for f in rest], F.col("x.starts").alias("starts"))
