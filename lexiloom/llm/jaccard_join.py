"""Self-join of documents by the Jaccard similarity of their word 5-gram sets, by token-combination prefixes.

Tokens are hashed shingles, in order of their hash. Let c be the tokens that two linked sets of n and m tokens have in
common, so that c >= 0.8 max(n, m), and e = n + m - 2c the others.

* **Extended prefixes.** The first n - ceil(0.8 n) + 1 + x tokens of both sets share x + 1 tokens, x being the lesser
  of both extensions (a tenth of a set's size). They are indexed as single tokens. A token of at most ``rare`` prefixes
  is rare, and all its pairs are candidates. So a linked pair that no rare token gives shares x + 1 frequent tokens,
  and only *hot* sets, with that many frequent tokens in the prefix, can be in such a pair.
* **Frequent tokens.** The prefix of a hot set is extended to the whole set, and the tokens of hot sets are indexed
  again. Two hot sets without a common rare token have at most the lesser count of frequent tokens in common: where
  this is less than 0.8 of the set, it has no such link.
* **Combinations.** Of the others, combinations of k = 3 tokens that follow each other are indexed. The e other tokens
  cut the common ones into at most e + 1 runs, so linked sets have at least c - (k - 1)(e + 1) >= 0.4 n - 2
  combinations in common, and the 0.6 n with the smallest hashes suffice. The bound is 1 or more but for sets of 5 and
  4 tokens; sets of at most 5 have their combinations of 2 tokens as well.

Frequency classes are decided where a token's prefixes meet, so no table of frequent tokens exists. A task that sees
more than ``rare`` prefixes with a token sends one mark for it, so a hot token is a few numbers a task.

Candidates are verified by whole sets, in rounds, so that no group is expanded into pairs of its members:

1. Each set is compared with its best partner: of rare tokens the one with most of them, of combinations the one of
   its lists' centres that is in most of them (a list's centre is the set with the largest share of frequent tokens).
   Candidates of rare tokens that cannot reach the overlap by their counts go before.
2. Components of these links leave few lists with several components. Sets linked with a centre are a star; there
   only centres of stars are compared, if their frequent tokens can be enough, and other candidates of rare tokens if
   their components differ.
3. Jaccard distance is a metric. Two stars whose centres are further apart than 0.2 and both radii have no link. For
   the others the members in reach are compared with the other centre, and what both distances leave with each other.

Sets that are equal are one node, by an aggregation of two 64-bit sums and the size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import BASE, components, forget, give_back, map_texts, mix, table, words_of, written

WORDS = 5
#: Similarity of a link, and by how much a prefix is extended, in hundredths.
LEAST, EXTRA = 80, 10
#: Neighbouring tokens of a combination.
K = 3
#: Nodes whose texts are looked up by a broadcast; more are looked up by a shuffle.
MOST_IDS = 250_000
#: A node has a count for each bucket with frequent tokens of its own. With this many their number is near its limit,
#: those tokens, at small sizes too, and then grows with the nodes alone.
LEAST_BUCKETS = 96
#: Tokens that a task sorts at once.
TOKENS = 1 << 20


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with 1 to 4 words the whole sequence is one shingle."""
    _, starts, _, doc, word = words_of(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    if len(word) >= WORDS:
        h = word[: len(word) - WORDS + 1].copy()
        for k in range(1, WORDS):
            h = h * BASE + word[k : len(word) - WORDS + 1 + k]
        h = mix(h + np.uint64(WORDS))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 1]))
        elif b > a:
            x = word[a : a + 1].copy()
            for k in range(a + 1, b):
                x = x * BASE + word[k]
            out.append(mix(x + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    return min(n, n - -(-LEAST * n // 100) + 1 + EXTRA * n // 100)


def combinations(tokens: np.ndarray) -> np.ndarray:
    """Index keys of a hot set (sorted by hash)."""
    n, out = len(tokens), []
    for k in (K, 2) if n <= 5 else (K,):
        if n >= k:
            h = tokens[: n - k + 1].copy()
            for i in range(1, k):
                h = h * BASE + tokens[i : n - k + 1 + i]
            h = np.sort(mix(h + np.uint64(k)))
            out.append(h[: len(h) - max(1, -(-4 * n // 10) - 2) + 1] if n > 5 else h)
    return np.concatenate(out) if out else tokens


def _prints(sets: list[np.ndarray]) -> dict:
    return {
        "n_shingles": [len(s) for s in sets],
        "print_a": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
        "print_b": np.array([np.bitwise_xor.reduce(mix(s * BASE)) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
    }


def _marks(texts: list[bytes]) -> dict:
    sets = shingle_sets(texts)
    return _prints(sets) | {"prefix": [s[: prefix_size(len(s))].tobytes() for s in sets]}


def _whole(texts: list[bytes]) -> dict:
    sets = shingle_sets(texts)
    return _prints(sets) | {"tokens": [s.tobytes() for s in sets]}


def _same_list(head: np.ndarray) -> np.ndarray:
    """Length of its list for every entry; ``head`` marks the first of each list."""
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(head)))
    return np.repeat(length, length)


def _heads(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)


def single_tokens(nodes: DataFrame, buckets: int, rare: int) -> DataFrame:
    """(a, b, votes, n_a, n_b): pairs of nodes with a rare token in both prefixes, and with null b frequent tokens of a."""

    def emit(batches):
        import pyarrow as pa

        def rows(node, size, prefix):
            token = np.concatenate([np.frombuffer(p, np.uint64) for p in prefix])
            at = np.repeat(np.arange(len(node)), [len(p) // 8 for p in prefix])
            order = np.argsort(token, kind="stable")
            token, at = token[order], at[order]
            head = _heads(token)
            often = _same_list(head) > rare
            count = np.bincount(at[often], minlength=len(node))
            own = np.flatnonzero(count)
            if len(own):
                yield {"bucket": buckets + int(node[own[0]] % buckets), "tokens": count[own].astype(np.uint64).tobytes(), "nodes": node[own].tobytes(), "sizes": size[own].tobytes()}
            send = ~often | head
            who = np.where(often, -1, node[at])[send]
            token, sizes = token[send], size[at][send]
            cut = np.searchsorted(token >> np.uint64(32), (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets))
            for k in np.flatnonzero(np.diff(cut)):
                x = slice(cut[k], cut[k + 1])
                yield {"bucket": int(k), "tokens": token[x].tobytes(), "nodes": who[x].tobytes(), "sizes": sizes[x].tobytes()}

        schema = pa.schema([("bucket", pa.int32()), ("tokens", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
        node, size, prefix, held = [], [], [], 0
        for batch in (b.slice(first, 512) for b in batches for first in range(0, b.num_rows, 512)):
            for i, n, p in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("prefix").to_pylist(), strict=True):
                node.append(i)
                size.append(n)
                prefix.append(p)
                held += len(p) // 8
                if held >= TOKENS:
                    yield pa.RecordBatch.from_pylist(list(rows(np.array(node, np.int64), np.array(size, np.int32), prefix)), schema=schema)
                    node, size, prefix, held = [], [], [], 0
        if node:
            yield pa.RecordBatch.from_pylist(list(rows(np.array(node, np.int64), np.array(size, np.int32), prefix)), schema=schema)
        give_back()

    def meet(pdf):
        import pandas as pd

        token, node, size = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("tokens", np.uint64), ("nodes", np.int64), ("sizes", np.int32)))
        if pdf["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"a": node, "b": pd.array([None] * len(node), "Int64"), "votes": token.astype(np.int64), "n_a": size, "n_b": 0})
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        head = _heads(token)
        length = _same_list(head)
        often = np.repeat(node[head] == -1, length[head]) | (length > rare)
        who, first, count = np.unique(node[often], return_index=True, return_counts=True)
        counts = pd.DataFrame({"a": who, "b": pd.array([None] * len(who), "Int64"), "votes": count, "n_a": size[often][first], "n_b": 0})[who != -1]
        token, node, size = token[~often], node[~often], size[~often]
        pairs = [np.zeros((0, 4), np.int64)]
        for step in range(1, rare):
            i = np.flatnonzero(token[step:] == token[:-step])
            j = i + step
            near = 100 * np.minimum(size[i], size[j]).astype(np.int64) >= LEAST * np.maximum(size[i], size[j]).astype(np.int64)
            pairs.append(np.stack([node[i], node[j], size[i], size[j]], 1)[near])
        pairs = pd.DataFrame(np.concatenate(pairs), columns=["a", "b", "n_a", "n_b"]).groupby(["a", "b", "n_a", "n_b"], as_index=False).size().rename(columns={"size": "votes"})
        give_back()
        return pd.concat([counts, pairs.astype({"b": "Int64"})[["a", "b", "votes", "n_a", "n_b"]]])

    packed = nodes.select("node", F.col("n_shingles").alias("n"), "prefix").mapInArrow(emit, "bucket int, tokens binary, nodes binary, sizes binary")
    return packed.groupBy("bucket").applyInPandas(meet, "a long, b long, votes long, n_a long, n_b long")


def combination_index(sets: DataFrame) -> DataFrame:
    """(key, node, n, often) for every indexed combination of ``sets`` (node, n, often, tokens)."""

    def emit(batches):
        import pyarrow as pa

        for batch in (b.slice(first, 256) for b in batches for first in range(0, b.num_rows, 256)):
            keys = [combinations(np.frombuffer(t, np.uint64)) for t in batch.column("tokens").to_pylist()]
            counts = [len(k) for k in keys]
            each = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("node", "n", "often")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, each)], names=["key", "node", "n", "often"])

    return sets.select("node", "n", "often", "tokens").mapInArrow(emit, "key long, node long, n long, often long")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their distance and whether they are linked, by the whole sets of both."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            linked, distance = [], []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):  # no copy of the sets
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                linked.append(100 * common >= LEAST * (len(p) + len(q) - common))
                distance.append(1 - common / (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(distance, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "distance", "linked"])
        give_back()

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("set_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("set_a")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, distance double, linked boolean")


def _near(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= LEAST * F.greatest(a, b)


def _prefix(n: str) -> Column:
    return F.expr(f"least({n}, {n} - ceil({LEAST} * {n} / 100) + 1 + {EXTRA} * {n} div 100)")


def _named(comps: DataFrame, node: str, name: str) -> DataFrame:
    return comps.select(F.col("id").alias(node), F.col("component").alias(name))


def _within(a: str, b: str) -> Column:
    """Two sets without a common rare token: what both have of frequent tokens is enough for their sizes, by ``reach``."""
    return (F.col(f"{a}low") <= F.col(f"{b}reach")) & (F.col(f"{b}low") <= F.col(f"{a}reach"))


def rare_pairs(found: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
    """Frequent tokens of each node, and the pairs (a, b, votes) whose common tokens can be enough.

    ``found`` is of ``single_tokens``, made from whole sets or from prefixes; of prefixes all later tokens may be common.
    """
    often = written(found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("votes").alias("often"), F.max("n_a").alias("n")), "frequent-counts")
    pairs = found.where("b is not null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("votes").alias("votes"))
    ends = [often.select(F.col("node").alias(c), F.col("often").alias(f"often_{c}")) for c in ("a", "b")]
    most = F.col("votes") + F.least(F.coalesce("often_a", F.lit(0)), F.coalesce("often_b", F.lit(0)))
    if not whole:
        most += F.greatest(F.col("n_a") - _prefix("n_a"), F.col("n_b") - _prefix("n_b"))
    pairs = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").where(100 * most >= LEAST * (F.col("n_a") + F.col("n_b") - most))
    return often, written(pairs.select("a", "b", "votes"), "rare-pairs")


def node_links(sets: DataFrame, pairs: DataFrame, often: DataFrame) -> DataFrame:
    """Links (a, b) that give the components of ``sets`` (node, n, tokens).

    ``pairs`` are the candidates of rare tokens, ``often`` (node, n, often) the sets whose frequent tokens alone can be
    enough for a link.
    """
    ends = F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")

    index = written(combination_index(sets.drop("n").join(often, "node")), "combinations")
    lists = index.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct(F.expr("1000 * often div n"), "node", "n")).alias("top")).where("m > 1")
    lists = written(lists.select("key", F.col("top.node").alias("centre"), F.col("top.n").alias("n_centre")), "lists")
    met = index.join(lists, "key").where((F.col("node") != F.col("centre")) & _near("n", "n_centre"))
    votes = met.groupBy("node", "centre").count()
    stars = written(votes.groupBy("node").agg(F.max(F.struct("count", "centre")).alias("top")).select("node", F.col("top.centre").alias("centre")), "stars")

    best = pairs.groupBy("b").agg(F.max(F.struct("votes", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    first = written(verify(best.unionByName(stars.select(*ends)).distinct(), sets), "first-checks")
    comps = written(components(first.where("linked").select("a", "b")), "components")

    # stars: the centre (or the node itself), the distance to it, and the component
    in_star = stars.select("node", "centre", *ends).join(first.where("linked"), ["a", "b"]).select("node", "centre", "distance").dropDuplicates(["node"])
    member = often.join(in_star, "node", "left").join(_named(comps, "node", "component"), "node", "left")
    reach = F.expr(f"floor({100 + LEAST} * often / {LEAST}) - n").alias("reach")
    member = member.select("node", F.col("n").alias("low"), reach, F.coalesce("centre", "node").alias("centre"), F.coalesce("distance", F.lit(0.0)).alias("distance"), F.coalesce("component", "centre", "node").alias("component"))
    member = written(member, "members")
    extent = F.max("distance").alias("radius"), F.min("low").alias("low"), F.max("reach").alias("reach"), F.first("component").alias("component")
    star = written(member.groupBy("centre").agg(*extent), "star-extents")

    heads = index.join(lists.select("key"), "key", "left_semi").select("key", "node").join(member.select("node", "centre", "component"), "node").groupBy("key", "centre", "component").agg(F.lit(1).alias("one"))
    heads = written(heads.select("key", "centre", "component"), "heads")
    mixed = heads.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.xxhash64("centre").cast("decimal(20)")).alias("name"), F.count(F.lit(1)).alias("m"))
    mixed = written(mixed.where("low <> high").groupBy("name", "m").agg(F.min("key").alias("key")).select("key"), "mixed")
    few = heads.join(mixed, "key", "left_semi").select("key", "centre").join(star, "centre")
    x, y = (few.select("key", *[F.col(c).alias(f"{k}_{c}") for c in ("centre", "component", "low", "reach")]) for k in ("a", "b"))
    apart = (F.col("a_centre") < F.col("b_centre")) & (F.col("a_component") != F.col("b_component"))
    across = x.join(y, "key").where(apart & _within("a_", "b_")).select(F.col("a_centre").alias("a"), F.col("b_centre").alias("b")).distinct()
    across = written(across, "centre-pairs")
    rest = pairs.select("a", "b").join(_named(comps, "a", "p"), "a", "left").join(_named(comps, "b", "q"), "b", "left").where("coalesce(p, a) <> coalesce(q, b)").select("a", "b")
    todo = written(rest.unionByName(across).distinct().join(first.select("a", "b"), ["a", "b"], "left_anti"), "second-pairs")
    second = written(verify(todo, sets), "second-checks")
    links = comps.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second.where("linked").select("a", "b"))

    apart_by = f"distance - {1 - LEAST / 100}"
    radii = [star.select(F.col("centre").alias(c), F.col("radius").alias(f"r_{c}"), F.col("low").alias(f"low_{c}"), F.col("reach").alias(f"reach_{c}")) for c in ("a", "b")]
    known = first.select("a", "b", "distance", "linked").unionByName(second).join(across, ["a", "b"], "left_semi").dropDuplicates(["a", "b"])
    open_ = written(known.where("not linked").join(radii[0], "a").join(radii[1], "b").where(f"r_a + r_b > 0 and r_a + r_b + 1e-9 >= {apart_by}").drop("linked"), "open-pairs")
    if not open_.isEmpty():
        links = links.unionByName(_members_in_reach(open_, member, sets, apart_by))
    links = written(links.distinct(), "all-links")
    forget(index, lists, stars, first, member, star, heads, mixed, across, todo, open_, second, comps)
    return links


def _members_in_reach(open_: DataFrame, member: DataFrame, sets: DataFrame, apart_by: str) -> DataFrame:
    """Links between members of stars whose centres are not far enough apart.

    Members that the triangle inequality leaves are compared with the other centre; what the distances to both centres
    leave is compared with each other.
    """
    own = member.select("node", "centre", F.col("distance").alias("d"), "low", "reach", "component")
    kept = "a", "b", "node", "d", "low", "reach", "component", "distance"
    left = open_.join(own.withColumnRenamed("centre", "a"), "a").where(f"d + r_b + 1e-9 >= {apart_by} and low <= reach_b and low_b <= reach").select(*kept, F.lit(True).alias("of_a"))
    right = open_.join(own.withColumnRenamed("centre", "b"), "b").where(f"d + r_a + 1e-9 >= {apart_by} and low <= reach_a and low_a <= reach").select(*kept, F.lit(False).alias("of_a"))
    near = written(left.unionByName(right), "in-reach")
    asked = near.select(F.col("node").alias("x"), F.when(F.col("of_a"), F.col("b")).otherwise(F.col("a")).alias("y"))
    checked = written(verify(asked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct(), sets), "reach-checks")
    sides = []
    for of_a, other in ((True, "b"), (False, "a")):
        own = near.where(F.col("of_a") if of_a else ~F.col("of_a")).withColumns({"x": F.least("node", other), "y": F.greatest("node", other)})
        sides.append(own.join(checked.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("distance").alias("o")), ["x", "y"]).select("a", "b", "node", "d", "o", "low", "reach", "component"))
    p, q = (s.select("a", "b", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "d", "o", "component")], F.col("low").alias(f"{k}_low"), F.col("reach").alias(f"{k}_reach")) for s, k in zip(sides, ("p", "q"), strict=True))
    far = 1 - LEAST / 100 + 1e-9
    both = p.join(q, ["a", "b"]).where(_within("p_", "q_") & (F.abs(F.col("d_p") - F.col("o_q")) <= far) & (F.abs(F.col("o_p") - F.col("d_q")) <= far) & (F.col("component_p") != F.col("component_q")))
    pairs = written(both.select(F.least("node_p", "node_q").alias("a"), F.greatest("node_p", "node_q").alias("b")).distinct(), "last-pairs")
    return checked.where("linked").select("a", "b").unionByName(verify(pairs, sets).where("linked").select("a", "b"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Null or empty texts have an empty set and are their own component. Rows that repeat an id are one document, linked
    by any of their texts that has words. A row with a null id is linked with nothing and has a null component. An empty table gives
    an empty result; other columns of ``docs`` are ignored. ``rare`` is the most prefixes of a rare token.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = ["n_shingles", "print_a", "print_b"]
    keyed = docs.withColumn("row", F.monotonically_increasing_id())
    marks = written(map_texts(keyed, _marks, "n_shingles long, print_a long, print_b long, prefix binary", limit=1 << 19), "shingle-prefixes")
    full = marks.where("n_shingles > 0 and doc_id is not null")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), LEAST_BUCKETS, marks.count() // 2500)

    nodes = full.groupBy(*prints).agg(F.min("row").alias("node"), F.any_value("prefix").alias("prefix"))
    found = written(single_tokens(nodes, buckets, rare), "single-tokens")
    often, pairs = rare_pairs(found, False)
    hot = often.where(f"often >= {EXTRA} * cast(ceil({LEAST} * n / 100) as long) div 100 + 1").select("node", "often")

    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(hot, "node", "full")
    asked = marks.select(F.col("row").alias("node"), "doc_id", *[F.col(c).alias(f"is_{c}") for c in prints]).join(named, "node")
    asked = written(asked, "asked")
    texts = docs.join(F.broadcast(asked) if asked.count() <= MOST_IDS else asked, "doc_id")
    sets = map_texts(texts, _whole, "n_shingles long, print_a long, print_b long, tokens binary", limit=1 << 19)
    sets = written(sets.where(" and ".join(f"{c} = is_{c}" for c in prints)).select("node", F.col("n_shingles").alias("n"), "tokens", F.col("often").isNotNull().alias("hot")), "shingle-sets")

    again = written(single_tokens(sets.where("hot").select("node", F.col("n").alias("n_shingles"), F.col("tokens").alias("prefix")), buckets, rare), "single-tokens")
    whole, more = rare_pairs(again, True)
    both = written(pairs.unionByName(more).groupBy("a", "b").agg(F.max("votes").alias("votes")), "all-pairs")
    links = node_links(sets, both, whole.where(f"100 * often >= {LEAST} * n"))
    same = written(full.groupBy(*prints).agg(F.min("row").alias("node"), F.min("doc_id").alias("first_id")), "equal-sets")
    of_node = written(marks.select("doc_id", *prints).join(same, prints, "left").select("doc_id", "n_shingles", "node", "first_id"), "nodes")
    several = of_node.where("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("doc_id", "low")
    repeats = of_node.join(several, "doc_id").select(F.col("node").alias("a"), F.col("low").alias("b"))
    comps = written(components(links.unionByName(repeats)), "components")
    names = of_node.where("doc_id is not null").select("node", "doc_id").join(_named(comps, "node", "component"), "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = comps.join(names, "component").select(F.col("id").alias("node"), "component_id")
    forget(marks, found, often, pairs, asked, sets, again, whole, more, both, links, same)
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "first_id", "doc_id"))
    return of_node.join(named, "node", "left").select(F.col("doc_id").alias(id_col), "n_shingles", own.alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM t),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM t UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""
