"""Ranked lexical search: exact inner products over documents as sparse vectors, pruned by ball trees.

A document's score for an item is the sum, over the item's terms, of a weight of the term times an integer that grows
with its occurrences in the document and falls with the document's length: an inner product of two sparse vectors.

1. **Vectors.** One scan counts each document's terms and keeps those that some item asks for. What is shipped to tasks
   is the vocabulary of a block of at most ``items_at_once`` items; more items are answered block by block. The counts
   go to the shared folder, so the text is read once a block. Document counts of the vocabulary, and two sums over
   all documents, reach the driver.
2. **Shards.** Documents are range-partitioned by their heaviest term, so that documents alike meet, and each slice of
   ``rows`` of them becomes a ball tree: nodes have a centroid and a radius, and halve along the line between two far
   points. With q and x the vectors scaled by the square roots of the weights, no document of a node scores over
   q·c + |q'| r, where q' is q on the terms that the node's documents hold. Both parts are rounded up by more than
   floating-point sums can be off.
3. **Search.** An item descends best-first, from the node with the highest bound on, and stops when that is below its
   ``k``-th score so far; equal bounds go on, as a tie may win by its id. At leaves scores are summed in 64-bit
   integers. Scores so far carry over from slice to slice of a task.
4. **Ranks.** Each task returns at most ``k`` rows an item; a window with a limit pushed below the shuffle ranks them.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import forget, give_back, map_texts, ranked, table, written

#: Maximal runs of ASCII letters, digits and code points from 128 on, in UTF-8 bytes.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Longer texts are cut between terms, so that a task never holds all terms of a very long text.
LONG, BETWEEN = 1 << 22, re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # bytes.lower() changes A-Z only


def count_terms(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """The number of terms, and the occurrences of those in ``vocabulary`` by number."""
    total, held, at = 0, Counter(), 0
    while True:
        cut = BETWEEN.search(text, at + LONG) if len(text) - at > 2 * LONG else None
        terms = terms_of(text[at : cut.start()] if cut else text[at:])
        total += len(terms)
        held.update(filter(vocabulary.__contains__, terms))
        if not cut:
            return total, {vocabulary[t]: n for t, n in held.items()}
        at = cut.start()


class BallTree:
    """A ball tree over sparse rows: row i has ``values[ptr[i]:ptr[i + 1]]`` at the columns ``cols`` (of ``width``).

    ``weights`` are integers by column. Rows are kept in the order of the leaves; ``order`` is their number before.
    """

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, values: np.ndarray, weights: np.ndarray, leaf: int = 32):
        self.weights, self.root_weights, width = weights, np.sqrt(weights.astype(float)), len(weights)
        self.ptr, self.cols, self.values = ptr, cols, values
        x = values * self.root_weights[cols]
        square = np.add.reduceat(x * x, ptr[:-1])
        centres, supports, radii, spans, children, order = [], [], [], [], [], []

        def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = ptr[rows + 1] - ptr[rows]
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            return np.repeat(ptr[rows] - first, size) + np.arange(size.sum()), first

        def add(rows: np.ndarray) -> int:
            at, first = flat(rows)
            held, found = cols[at], x[at]
            centre = np.bincount(held, found, width) / len(rows)
            norm = float(centre @ centre)
            away = square[rows] - 2 * np.add.reduceat(found * centre[held], first) + norm
            node = len(radii)
            centres.append(centre)
            supports.append(np.bincount(held, minlength=width) > 0)
            radii.append(math.sqrt(max(float((np.maximum(away, 0) + 1e-9 * (square[rows] + norm)).max()), 0.0)))
            spans.append((len(order), len(order) + len(rows)))
            children.append(())
            if len(rows) <= leaf:
                order.extend(rows.tolist())
                return node
            far = np.zeros(width)
            one = rows[int(away.argmax())]
            far[cols[ptr[one] : ptr[one + 1]]] = x[ptr[one] : ptr[one + 1]]
            toward = np.add.reduceat(found * far[held], first)
            other = rows[int((square[rows] - 2 * toward).argmax())]
            far[cols[ptr[other] : ptr[other + 1]]] -= x[ptr[other] : ptr[other + 1]]
            along = np.argsort(np.add.reduceat(found * far[held], first), kind="stable")
            children[node] = (add(rows[along[: len(rows) // 2]]), add(rows[along[len(rows) // 2 :]]))
            return node

        add(np.arange(len(ptr) - 1))
        self.order, self.children, self.spans = np.array(order), children, spans
        self.centres, self.supports, self.radii = np.array(centres).T.copy(), np.array(supports).T.copy(), np.array(radii)
        at, _ = flat(self.order)
        self.starts = np.concatenate([[0], np.cumsum(ptr[self.order + 1] - ptr[self.order])])
        self.cols, self.values = cols[at], values[at]
        self.scored = 0  # rows scored so far

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """For each node, a number that no row of it scores over for the columns ``asked``."""
        q = self.root_weights[asked]
        reach = np.sqrt((q * q) @ self.supports[asked]) * self.radii
        return (q @ self.centres[asked] + reach) * (1 + 1e-9) + 1e-6

    def search(self, asked: np.ndarray, ids: list, k: int, best: list) -> list:
        """``best`` (sorted tuples of (-score, id is null, id), at most ``k``) with the rows of this tree."""
        bounds = self.bounds(asked)
        weight = np.zeros(len(self.weights), np.int64)
        weight[asked] = self.weights[asked]
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            least = -best[-1][0] if len(best) == k else 1
            if -bound < least:
                break
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (max(bound, -bounds[child]), child))
                continue
            a, b = self.spans[node]
            first, last = self.starts[a], self.starts[b]
            scores = np.add.reduceat(self.values[first:last] * weight[self.cols[first:last]], self.starts[a:b] - first)
            self.scored += b - a
            good = np.flatnonzero(scores >= least)
            if len(good):
                found = [(-int(scores[i]), ids[j] is None, ids[j]) for i in good for j in [self.order[a + i]]]
                best = heapq.nsmallest(k, [*best, *found], key=lambda r: (r[0], r[1], r[2] or 0))
        return best


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search_block(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, k: int, rows: int, leaf: int) -> DataFrame:
    """Rows (_item: place in ``items``, id, score), at most ``k`` an item from each task; ``items`` has (id, terms)."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    asked = [np.array(sorted(vocabulary[t] for t in set(terms)), int) for _, terms in items]

    def count(texts: list[bytes]) -> dict:
        got = [count_terms(t, vocabulary) for t in texts]
        return {"n": [n for n, _ in got], "terms": [list(h) for _, h in got], "times": [list(h.values()) for _, h in got]}

    plain = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = written(map_texts(plain, count, "n long, terms array<int>, times array<int>", "_text"), "term-counts")
    documents, length = counted.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, holding in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[term] = term_weight(documents, holding)

    kind = counted.schema["_id"].dataType
    vectors = F.arrays_zip("terms", "times")
    if documents:
        m = 10 + F.expr(f"(90 * n * {documents}) div {length}")
        heavy = F.array_max(F.transform("terms", lambda t: F.struct(F.element_at(F.lit(weights.tolist()), t + 1).alias("w"), t.alias("t"))))["t"]
        # One shuffle of compact vectors; a heavy term that many documents share is spread by their ids.
        counted_ = counted.where(F.size("terms") > 0).select("_id", m.cast("long").alias("m"), vectors.alias("v"), heavy.alias("_heavy"))
        counted_ = counted_.repartitionByRange("_heavy", "_id").sortWithinPartitions("_heavy")
    else:
        counted_ = counted.where(F.lit(False)).select("_id", F.col("n").alias("m"), vectors.alias("v"), F.lit(0).alias("_heavy"))

    def search(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        best = [[] for _ in asked]
        for batch in (b.slice(first, rows) for b in batches for first in range(0, b.num_rows, rows)):
            lists = batch.column("v")
            lists = lists.take(pa.array(np.arange(len(lists))))  # offsets from 0
            size = np.diff(lists.offsets.to_numpy())
            terms, times = (lists.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            m = np.repeat(batch.column("m").to_numpy(), size)
            values = 1_000_000_000 * times // (1000 * times + 8 * m)
            good = (weights[terms] > 0) & (values > 0)
            row = np.repeat(np.arange(len(size)), size)[good]
            if not len(row):
                continue
            held, cols = np.unique(terms[good], return_inverse=True)
            present, size = np.unique(row, return_counts=True)
            tree = BallTree(np.concatenate([[0], np.cumsum(size)]), cols, values[good], weights[held], leaf)
            ids = batch.column("_id").take(pa.array(present)).to_pylist()
            local = np.full(len(weights), -1)
            local[held] = np.arange(len(held))
            for i, wanted in enumerate(asked):
                columns = local[wanted]
                columns = columns[columns >= 0]
                if len(columns):
                    best[i] = tree.search(columns, ids, k, best[i])
        found = [(i, r[2], -r[0]) for i, b in enumerate(best) for r in b]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), to_arrow_type(kind), pa.int64()), strict=True)], names=["_item", "_id", "score"])
        give_back()

    out = counted_.select("_id", "m", "v").mapInArrow(search, f"_item int, _id {kind.simpleString()}, score long")
    done = written(out, "search-candidates")
    forget(counted)
    return done


def lexical_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", k: int = 10, items_at_once: int = 1024, rows: int = 4096, leaf: int = 32) -> DataFrame:
    """The ``k`` documents with the highest scores above 0 for each item: item id, rank (from 1), id, score.

    Equal scores are ranked by ascending id, null last. Null text, of documents or items, has no terms. Each row of
    ``docs`` is a document, rows that repeat an id included; rows of ``items`` with the same id, or with null, are
    one item that asks for the terms of all. Items or documents without terms, and empty tables, give no rows. Other
    columns of both tables are ignored.
    """
    ids = ranked(items.select(F.col(item_col).alias("_key")).distinct(), "_key", name="_n")
    number = ids.count()
    texts = items.select(F.col(item_col).alias("_key"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("_text"))
    numbered = texts.join(ids, texts["_key"].eqNullSafe(ids["_key"])).select(ids["_key"], "_n", "_text")
    out = None
    for first in range(0, max(number, 1), items_at_once):
        asked: dict[int, list] = {}
        for key, n, text in numbered.where(F.col("_n").between(first, first + items_at_once - 1)).toLocalIterator():
            asked.setdefault(n, [key, set()])[1].update(terms_of(bytes(text)))
        block = [tuple(v) for _, v in sorted(asked.items())]
        found = search_block(docs, block, id_col, text_col, k, rows, leaf)
        keys = docs.sparkSession.createDataFrame([(i, key) for i, (key, _) in enumerate(block)], f"_item int, _key {ids.schema['_key'].dataType.simpleString()}")
        best = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        part = top.join(F.broadcast(keys), "_item").select(F.col("_key").alias(item_col), "rank", F.col("_id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT doc_id, r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM low),
total AS (SELECT count(*) FILTER (len(words) > 0) AS docs, sum(len(words))::BIGINT AS words FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(words) AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total t GROUP BY term, t.docs),
s AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * t.docs) // t.words))))::BIGINT AS score
  FROM tf JOIN w USING (term) JOIN q USING (term), total t GROUP BY item_id, r, doc_id)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) QUALIFY row_number() OVER o <= 10
"""
