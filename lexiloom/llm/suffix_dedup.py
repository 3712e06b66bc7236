"""Removal of repeated byte strings with suffix arrays and longest-previous-factor arrays.

A suffix array of the whole corpus fits no task, so the text is first cut into small contexts that can match at all:

1. **Anchors.** Every string of ``size`` bytes has an anchor: its 48-byte substring with the smallest hash (the
   leftmost of equals). Equal strings have equal anchors at equal places. Consecutive strings with the same anchor
   are one run, about one for 75 bytes; its context is the bytes its strings cover. A run is kept as anchor hash,
   context hash and place, in packed arrays dealt by anchor.
2. **Grouping.** Runs whose anchor occurs once cannot repeat. Runs with equal anchors and contexts (two 64-bit hashes)
   repeat as a whole. Of anchors with different contexts, one of each kind is compared. A task sends one run of each
   kind it has, so a passage in very many documents is a few runs a task.
3. **Suffix arrays.** The contexts to compare are cut from the texts and dealt by anchor. A task builds the suffix
   array of a batch of groups by prefix doubling, the common prefixes of neighbours, and from them, with the previous
   and next smaller position in suffix order, the longest previous factor of each place (and, mirrored, the longest
   following one). A place whose factor has ``size`` bytes starts a repeated string.
   Of anchors with very many different contexts, all strings are counted instead by their hash and their anchor's,
   dealt by the former; a task sends each string once. Both ways find the same places.
4. **Cutting.** The repeated places of a document are gathered, the bytes they cover removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import chunks_of, forget, prefix_hash, range_hash, table, written

ANCHOR = 48
#: Most keys of documents that are broadcast.
MOST_KEYS = 1_000_000
#: Bytes of contexts in one suffix array, about.
BATCH = 1 << 17


# -- anchors ----------------------------------------------------------------------------------


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(texts: list[bytes], size: int) -> dict[str, np.ndarray]:
    """Runs of strings of ``size`` bytes with one anchor: doc (index), start, count, anchor, context."""
    none = np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < size:
        return {"doc": none, "start": none, "count": none, "anchor": none.astype(np.uint64), "context": none.astype(np.uint64)}
    length = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    sums = prefix_hash(data)
    at = np.arange(len(data) - ANCHOR + 1)
    h = range_hash(sums, at, at + ANCHOR)
    key = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    place = (sliding_least(key, size - ANCHOR + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    whole = doc[: len(place)] == doc[size - 1 :]
    head = whole.copy()
    head[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])
    tail = whole.copy()
    tail[:-1] &= head[1:] | ~whole[1:]
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    return {"doc": doc[a], "start": a - first[doc[a]], "count": b - a + 1, "anchor": h[place[a]], "context": range_hash(sums, a, b + size)}


# -- suffix arrays ----------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and the common prefix of each suffix with the one before it in suffix order.

    Prefix doubling; the ranks of every round are kept, and common prefixes are added up from the longest round down.
    With ``depth``, doubling ends when so many symbols are compared; longer common prefixes are given as ``depth`` or more.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int32)
    rounds, step = [], 1
    while True:
        rounds.append((step, rank))
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable").astype(np.int32)
        sorted_ = key[order]
        new = np.empty(n, np.int32)
        new[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank, step = new, 2 * step
        if rank.max() == n - 1 or step >= n or (depth and step > depth):
            break
    common = np.zeros(n, np.int32)
    a, b = order[:-1].copy(), order[1:].copy()
    for step, ranks in reversed(rounds):
        inside = (a + step <= n) & (b + step <= n)
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        common[1:] += np.int32(step) * same
        a, b = np.where(same, a + step, a), np.where(same, b + step, b)
        a, b = np.minimum(a, n), np.minimum(b, n)
    return order, common


def previous_factors(order: np.ndarray, common: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each place the longest match with a place of smaller ``before``: the longest-previous-factor array.

    The nearest entry before (after) in suffix order with a smaller value is found by jumping over pointers; the least
    common prefix on the way is the length of the match.
    """
    n = len(order)
    value = before[order]
    best = np.zeros(n, np.int32)
    for way in (1, -1):
        x = value if way == 1 else value[::-1]
        low = common.copy() if way == 1 else np.concatenate([[0], common[:0:-1]])
        pointer = np.arange(n) - 1
        todo = np.arange(1, n)
        while len(todo):
            todo = todo[(pointer[todo] >= 0) & (x[np.maximum(pointer[todo], 0)] > x[todo])]
            over = pointer[todo]
            low[todo], pointer[todo] = np.minimum(low[todo], low[over]), pointer[over]
        found = np.where(pointer >= 0, low, 0)
        best = np.maximum(best, found if way == 1 else found[::-1])
    out = np.empty(n, np.int32)
    out[order] = best
    return out


def repeated_places(contexts: list[bytes], size: int, keep_first: bool) -> np.ndarray:
    """Places, in the joined contexts, whose string of ``size`` bytes starts at another place too.

    With ``keep_first`` only at an earlier one. Matches never cross contexts: each ends with a symbol of its own.
    """
    length = np.array([len(c) for c in contexts])
    symbols = np.zeros(length.sum() + len(contexts), np.int32)
    ends = np.cumsum(length + 1) - 1
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(contexts), np.uint8)
    symbols[ends] = 256 + np.arange(len(contexts))
    order, common = suffix_order(symbols, size)
    factor = previous_factors(order, common, np.arange(len(symbols)))
    if not keep_first:
        factor = np.maximum(factor, previous_factors(order, common, -np.arange(len(symbols))))
    return np.flatnonzero(factor[inside] >= size)


# -- the distributed job ----------------------------------------------------------------------


def _row(frame, **columns) -> dict:
    return {k: v.tobytes() for k, v in columns.items()} | frame


def _by_bucket(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray]):
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        own = order[cut[b] : cut[b + 1]]
        yield _row({"bucket": int(b)}, **{k: v[own] for k, v in columns.items()})


def _joined(series, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype) for x in series])


def _arrow(df: DataFrame, fn, schema: str, limit: int = 1 << 22) -> DataFrame:
    """``fn`` takes a slice of a batch (with its texts) and yields rows."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for first, last in chunks_of(texts, limit):
                rows = list(fn(batch.slice(first, last - first), texts[first:last]))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def _stretches(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings (key, start, count) with those that follow one another put together."""
    order = np.lexsort((start, key))
    key, start, count = key[order], start[order].astype(np.int64), count[order].astype(np.int64)
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > (start + count)[:-1])]) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    last = np.maximum.reduceat(start + count, at) if len(at) else start
    return key[at], start[at], last - start[at]


def _repeats(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of arrays sorted by ``keys`` (the last decides first): the first entry of each kind, and each kind's size."""
    head = np.zeros(len(keys[0]), bool)
    head[:1] = True
    for k in keys:
        head[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(head)
    return head, np.diff(np.append(at, len(head)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 200, keep_first: bool = False, most_contexts: int = 2000, most_alike: int = 32, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    Bytes covered by a string of ``size`` bytes that also starts elsewhere are removed, in all places or, with
    ``keep_first``, in all but the first in order of an internal key. Null text counts as empty; texts shorter than
    ``size`` keep all bytes. Rows that repeat an id and a text are copies of one another, or one with ``keep_first``. A null id is kept as it is; an empty table gives
    an empty result. Other columns of ``docs`` are ignored. What is kept need not be valid UTF-8.

    Anchors with over ``most_contexts`` different contexts, or over ``most_alike`` in a task, go by string hashes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("text")).withColumn("key", F.xxhash64("_id", "text"))
    own = rows.select("key", "text").dropDuplicates(["key"]) if keep_first else rows.select("key", "text")
    total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (8 << 20))

    def passed(key, kind, start, count, anchor):
        """A row whose runs need no other task."""
        kind = np.full(len(key), kind, np.int32)
        return {"bucket": buckets + int(key[0] % buckets), "anchors": anchor.tobytes(), "contexts": kind.tobytes(), "keys": key.tobytes(), "starts": start.astype(np.int32).tobytes(), "counts": count.astype(np.int32).tobytes()}

    def anchors(batch, texts):
        r = runs_of(texts, size)
        order = np.lexsort((r["start"], batch.column("key").to_numpy()[r["doc"]], r["context"], r["anchor"]))
        a, c, start, count, key = r["anchor"][order], r["context"][order], r["start"][order].astype(np.int32), r["count"][order].astype(np.int32), batch.column("key").to_numpy()[r["doc"]][order]
        if not len(a):
            return
        new_a, of_a = _repeats(a)
        new_c, of_c = _repeats(a, c)
        copies = np.repeat(of_c, of_c)
        alike = np.repeat(np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_a)), of_a) > most_alike
        whole = ~alike & (~new_c if keep_first else copies > 1)
        if whole.any():
            k, s, n = _stretches(key[whole], start[whole], count[whole])
            yield passed(k, 0, s, n, np.zeros(len(k), np.uint64))
        if alike.any():
            yield passed(key[alike], 2, start[alike], count[alike], a[alike])
        # to others: of each kind one run, negative if it is known to repeat; 0 marks an anchor that goes by strings
        send = np.where(alike, new_a, new_c)
        told = np.where(alike, 0, np.where(whole, -count, count)).astype(np.int32)
        columns = {"anchors": a[send], "contexts": c[send], "keys": key[send], "starts": start[send], "counts": told[send]}
        yield from _by_bucket((a[send] >> np.uint64(16)).astype(np.int64) % buckets, buckets, columns)

    def group(pdf):
        import pandas as pd

        a, key, start, count = (_joined(pdf[n], kind) for n, kind in (("anchors", np.uint64), ("keys", np.int64), ("starts", np.int32), ("counts", np.int32)))
        if pdf["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"key": key, "kind": _joined(pdf["contexts"], np.int32), "start": start, "count": count, "anchor": a.view(np.int64)})
        c = _joined(pdf["contexts"], np.uint64)
        strings = np.isin(a, a[count == 0])
        real = count != 0
        strings, a, c, key, start, count = (x[real] for x in (strings, a, c, key, start, count))
        order = np.lexsort((start, key, c, a))
        strings, a, c, key, start, count = (x[order] for x in (strings, a, c, key, start, count))
        new_a, of_a = _repeats(a)
        new_c, of_c = _repeats(a, c)
        kinds = np.repeat(np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_a)), of_a) if len(a) else of_a
        known = count < 0
        many = np.repeat(of_c, of_c) > 1
        if len(a):
            many |= np.repeat(np.logical_or.reduceat(known, np.flatnonzero(new_c)), of_c)
        whole = ~new_c if keep_first else many & ~known
        strings |= kinds > most_contexts
        ask = new_c & ((kinds > 1) | strings)
        count = np.abs(count)
        out = []
        for rows_, kind in ((whole, 0), (ask & ~strings, 1), (ask & strings, 2)):
            out.append(pd.DataFrame({"key": key[rows_], "kind": np.int32(kind), "start": start[rows_], "count": count[rows_], "anchor": a[rows_].view(np.int64)}))
        return pd.concat(out)

    packed = _arrow(own, anchors, "bucket int, anchors binary, contexts binary, keys binary, starts binary, counts binary")
    places = "key long, kind int, start int, count int, anchor long"
    found = written(packed.groupBy("bucket").applyInPandas(group, places), "runs")

    asked = found.where("kind > 0").groupBy("key").agg(F.collect_list(F.struct("kind", "start", "count", "anchor")).alias("asked"))
    asked = written(asked, "asked")
    texts = own
    if asked.count() <= MOST_KEYS:
        texts = texts.join(F.broadcast(asked.select("key")), "key", "left_semi")
    texts = texts.join(asked, "key")

    def cut(batch, texts_):
        string: list[tuple] = []
        for key, text_, asks in zip(batch.column("key").to_pylist(), texts_, batch.column("asked").to_pylist(), strict=True):
            sums = prefix_hash(np.frombuffer(text_, np.uint8)) if any(x["kind"] == 2 for x in asks) else None
            by: dict[int, list] = {}
            for x in asks:
                if x["kind"] == 1:
                    by.setdefault((x["anchor"] >> 16) % buckets, []).append(x)
                else:
                    at = np.arange(x["start"], x["start"] + x["count"])
                    string.append((range_hash(sums, at, at + size), np.full(len(at), key), at.astype(np.int32), np.full(len(at), x["anchor"])))
            for b, own in by.items():
                pieces = [text_[x["start"] : x["start"] + x["count"] - 1 + size] for x in own]
                yield {"bucket": b, "key": key, "starts": np.array([x["start"] for x in own], np.int32).tobytes(), "numbers": np.array([x["anchor"] for x in own], np.int64).tobytes(), "counts": np.array([x["count"] for x in own], np.int32).tobytes(), "bytes": b"".join(pieces)}
        if not string:
            return
        h, key, at, anchor = (np.concatenate(x) for x in zip(*string, strict=True))
        order = np.lexsort((at, key, anchor, h))
        h, key, at, anchor = h[order], key[order], at[order], anchor[order]
        new, of = _repeats(h, anchor)
        gone = ~new if keep_first else np.repeat(of, of) > 1
        if gone.any():
            k, s, n = _stretches(key[gone], at[gone], np.ones(int(gone.sum()), np.int64))
            yield {"bucket": 2 * buckets + int(k[0] % buckets), "key": 0, "starts": s.astype(np.int32).tobytes(), "numbers": k.tobytes(), "counts": n.astype(np.int32).tobytes(), "bytes": b""}
        h, key, at, anchor, gone = h[new], key[new], at[new], anchor[new], gone[new]
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        for row in _by_bucket(bucket, buckets, {"starts": at, "numbers": h, "counts": gone.astype(np.int32), "bytes": np.stack([key, anchor], 1)}):
            yield row | {"bucket": buckets + row["bucket"], "key": 0}

    def compare(pdf):
        import pandas as pd

        def result(key, start, count):
            key, start, count = _stretches(key, start, count)
            return pd.DataFrame({"key": key, "start": start.astype(np.int32), "count": count.astype(np.int32)})

        kind = int(pdf["bucket"].iloc[0]) // buckets
        sizes = [len(x) // 4 for x in pdf["starts"]]
        start, number, count = (_joined(pdf[n], t) for n, t in (("starts", np.int32), ("numbers", np.int64), ("counts", np.int32)))
        if kind == 2:  # known to repeat
            return result(number, start, count)
        if kind == 1:  # strings by their hash and their anchor's
            key, anchor = _joined(pdf["bytes"], np.int64).reshape(-1, 2).T
            order = np.lexsort((start, key, anchor, number))
            key, anchor, start, number, known = key[order], anchor[order], start[order], number[order], count[order] > 0
            new, of = _repeats(number, anchor)
            many = (np.repeat(of, of) > 1) | np.repeat(np.logical_or.reduceat(known, np.flatnonzero(new)), of)
            good = ~new if keep_first else many
            return result(key[good], start[good], np.ones(int(good.sum()), np.int64))
        key = np.repeat(pdf["key"].to_numpy(np.int64), sizes)
        length = count.astype(np.int64) - 1 + size
        blob = np.frombuffer(b"".join(pdf["bytes"]), np.uint8)
        base = np.concatenate([[0], np.cumsum(length)])
        order = np.lexsort((start, key, number))
        edges = np.append(np.flatnonzero(np.diff(number[order])) + 1, len(order))
        out, first, held, at = [], 0, 0, 0
        for edge in edges:
            held += int(length[order[at:edge]].sum())
            at = edge
            if held < BATCH and edge < len(order):
                continue
            batch = order[first:edge]
            place = repeated_places([blob[base[i] : base[i + 1]].tobytes() for i in batch], size, keep_first)
            begin = np.concatenate([[0], np.cumsum(length[batch])])
            own = np.searchsorted(begin, place, side="right") - 1
            out.append(result(key[batch[own]], start[batch[own]] + place - begin[own], np.ones(len(place), np.int64)))
            first, held = edge, 0
        return pd.concat(out)

    contexts = _arrow(texts, cut, "bucket int, key long, starts binary, numbers binary, counts binary, bytes binary")
    compared = contexts.groupBy("bucket").applyInPandas(compare, "key long, start int, count int")

    both = found.where("kind = 0").select("key", "start", "count").unionByName(compared)
    spans = written(both.groupBy("key").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "spans")

    out = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    kind = dict(rows.dtypes)["_id"]

    def trim(batch, texts_):
        have = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * len(texts_)
        for id_, text_, own in zip(batch.column("_id").to_pylist(), texts_, have, strict=True):
            n = len(text_)
            edge = np.zeros(n + 1, np.int32)
            for x in own or ():
                edge[x["start"]] += 1
                edge[x["start"] + x["count"] - 1 + size] -= 1
            gone = np.cumsum(edge[:n]) > 0
            kept = np.frombuffer(text_, np.uint8)[~gone].tobytes()
            heads = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            yield {"_id": id_, "n_bytes": n, "n_removed": n - len(kept), "n_spans": heads, "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if with_text else {})

    columns = ["_id", "text", "key"]
    if spans.count() <= MOST_KEYS:
        names = F.broadcast(spans.select("key"))
        with_spans = rows.select(columns).join(names, "key", "left_semi").join(spans, "key")
        without = rows.select(columns).join(names, "key", "left_anti")
        done = _arrow(with_spans, trim, f"_id {kind}, {out}").unionByName(_arrow(without, trim, f"_id {kind}, {out}"))
    else:
        done = _arrow(rows.select(columns).join(spans, "key", "left"), trim, f"_id {kind}, {out}")
    forget(found, asked)
    return done.withColumnRenamed("_id", id_col)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
