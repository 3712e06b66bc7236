"""Near-duplicate embeddings: one navigable small-world graph hierarchy per shard, every shard queried.

1. Equal vectors of a label are one node with a weight (an aggregation with map-side combine).
2. A label's nodes are dealt by a hash of their id to shards of about ``shard_rows``; a task builds the hierarchy of
   one shard in numpy and writes it as one row of bounded size. Points enter a layer in batches: each is searched in
   the graph so far and compared with its batch, and keeps neighbours that are nearer to it than to one another.
3. Every pair of shards of a label is searched: the vectors of each shard are queries against the graph of the other.
   A task takes all pairs between two blocks of shards, so a graph is sent once for each block, not for each shard.
   Beams start at ``beam`` and are widened until an audit, a brute-force search for some queries, finds no link
   missing, and for each query until its beam holds something below the threshold. See ``audit_links`` for its figures.
4. Cosines are computed again in double precision. A task returns its weighted link counts and a spanning forest of
   its links, not the pairs; components are then computed over all tasks' forests. What is linked stands in one
   boolean matrix of two shards, whose size does not depend on how dense they are.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import components, mix, table, written

NEIGHBOURS, BASE_NEIGHBOURS, BUILD_BEAM, BATCH = 12, 24, 48, 256


def _choose(to_point: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """For each row, places of up to ``most`` candidates: first those nearer to the point than to one chosen before.

    ``to_point`` (rows, c) is sorted downwards (-2 marks no candidate), ``among`` (rows, c, c) holds the similarities
    of candidates. Places left free take the best of the others. -1 fills up.
    """
    rows, c = to_point.shape
    closest = np.full((rows, c), -2.0, np.float32)
    taken = np.zeros((rows, c), bool)
    for j in range(c):
        good = (to_point[:, j] > -2) & (to_point[:, j] > closest[:, j]) & (taken.sum(1) < most)
        taken[:, j] = good
        closest = np.where(good[:, None], np.maximum(closest, among[:, j]), closest)
    rank = np.where(taken, 0, c) + np.where(to_point > -2, np.arange(c), 3 * c)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 3 * c, order, -1)


class Layer:
    """One layer: member points and their neighbour lists (positions in the shard, -1 for none).

    A list gets up to ``most`` neighbours, grows to twice as many, and is then cut down again.
    """

    def __init__(self, unit: np.ndarray, most: int):
        self.unit, self.most = unit, most
        self.links = np.full((len(unit), 2 * most), -1, np.int32)
        self.used = np.zeros(len(unit), np.int32)

    def search(self, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest points found for each query, best first.

        All queries advance in step; a step expands the best open points of each beam, more of them in a wide one.
        """
        rows, n = len(queries), len(self.unit)
        beam = min(beam, n)
        wide = max(4, beam // 12)
        seen = np.zeros((rows, n + 1), bool)
        ids = np.full((rows, beam), n, np.int32)
        sims = np.full((rows, beam), -2.0, np.float32)
        done = np.ones((rows, beam), bool)
        ids[:, 0], done[:, 0] = entry, False
        sims[:, 0] = np.einsum("bd,bd->b", self.unit[entry], queries)
        seen[np.arange(rows), entry] = True
        live = np.arange(rows)
        while len(live):
            pick = np.argsort(np.where(done[live], 3.0, -sims[live]), 1, kind="stable")[:, :wide]
            is_open = ~np.take_along_axis(done[live], pick, 1)
            keep = is_open.any(1)
            live, pick, is_open = live[keep], pick[keep], is_open[keep]
            if not len(live):
                break
            at = np.take_along_axis(ids[live], pick, 1)
            done[live[:, None], pick] = True
            near = np.where(is_open[:, :, None], self.links[np.where(is_open, at, 0)], -1).reshape(len(live), -1)
            near = np.sort(near, 1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], near]
            near = np.where(fresh, near, n)
            seen[live[:, None], near] = True
            score = np.full(near.shape, -2.0, np.float32)
            r, c = np.nonzero(fresh)
            score[r, c] = np.einsum("kd,kd->k", self.unit[near[r, c]], queries[live[r]])
            all_ids, all_sims = np.concatenate([ids[live], near], 1), np.concatenate([sims[live], score], 1)
            all_done = np.concatenate([done[live], ~fresh], 1)
            order = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
            ids[live], sims[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_done))
        return ids, sims

    def link(self, points: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        """Give each point neighbours out of its candidates, and the neighbours the point."""
        c = min(ids.shape[1], BUILD_BEAM)
        order = np.argsort(-sims, 1, kind="stable")[:, :c]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.unit[np.minimum(ids, len(self.unit) - 1)]
        place = _choose(sims, np.einsum("bcd,bed->bce", v, v), self.most)
        chosen = np.where(place >= 0, np.take_along_axis(ids, np.maximum(place, 0), 1), -1)
        self.links[points, : chosen.shape[1]] = chosen
        self.used[points] = (chosen >= 0).sum(1)
        r, k = np.nonzero(chosen >= 0)
        target, source = chosen[r, k], points[r]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        for node, first, last in zip(*self._runs(target), strict=True):
            n, more = int(self.used[node]), last - first
            if n + more > 2 * self.most:
                own = np.concatenate([self.links[node, :n], source[first:last]])
                s = self.unit[own] @ self.unit[node]
                rank = np.argsort(-s, kind="stable")[: 2 * BUILD_BEAM]
                own, s = own[rank], s[rank]
                w = self.unit[own]
                p = _choose(s[None], (w @ w.T)[None], self.most)[0]
                own = own[p[p >= 0]]
                self.links[node] = -1
                self.links[node, : len(own)] = own
                self.used[node] = len(own)
            else:
                self.links[node, n : n + more] = source[first:last]
                self.used[node] = n + more

    @staticmethod
    def _runs(x: np.ndarray):
        cut = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
        return x[cut], cut, np.append(cut[1:], len(x)) if len(x) else cut


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


class Hierarchy:
    """Layers over the vectors of one shard; ``vectors`` are as given, ``weight`` counts equal ones."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weight: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.weight = ids[order], vectors[order], weight[order]
        self.unit = _unit(self.vectors)
        draw = mix(self.ids.astype(np.uint64) + np.uint64(77)).astype(np.float64) / 2**64
        level = np.floor(-np.log(np.maximum(draw, 1e-18)) / np.log(NEIGHBOURS)).astype(int)
        level[0] = level.max()  # one entry point at the top
        self.layers: list[Layer] = []  # top first
        for depth in range(level.max(), -1, -1):
            layer = Layer(self.unit, BASE_NEIGHBOURS if depth == 0 else NEIGHBOURS)
            self._fill(layer, np.flatnonzero(level > depth), np.flatnonzero(level == depth))
            self.layers.append(layer)

    def _fill(self, layer: Layer, above: np.ndarray, rest: np.ndarray) -> None:
        """Points of the layers above come first, from the first of them; the others start where those layers lead."""
        members, at, size = np.concatenate([above, rest]), 1, 1
        while at < len(members):
            room = len(above) - at if at < len(above) else size
            new = members[at : at + min(size, room, BATCH)]
            entry = np.full(len(new), members[0], np.int32) if at < len(above) else self._entry(self.unit[new])
            ids, sims = layer.search(self.unit[new], entry, BUILD_BEAM) if at > 1 else (np.full((len(new), 1), members[0], np.int32), (self.unit[new] @ self.unit[members[0]])[:, None])
            own = self.unit[new] @ self.unit[new].T
            own[np.triu_indices(len(new))] = -2.0  # earlier points of the batch only
            layer.link(new, np.concatenate([ids, np.broadcast_to(new, own.shape)], 1), np.concatenate([np.where(ids < len(self.unit), sims, -2.0), own], 1))
            at += len(new)
            size = at

    def _entry(self, queries: np.ndarray) -> np.ndarray:
        entry = np.zeros(len(queries), np.int32)
        for layer in self.layers:
            entry = layer.search(queries, entry, 2)[0][:, 0]
        return entry

    def near(self, unit: np.ndarray, slack: float, beam: int, hit: np.ndarray) -> None:
        """Mark in ``hit`` (query, point) similarities of at least ``slack``; a full beam is widened until something is below."""
        bottom, n = self.layers[-1], len(self.ids)

        def search(rows: np.ndarray, width: int) -> None:
            block = max(16, min(BATCH, (1 << 20) // max(1, min(width, n))))
            for k in range(0, len(rows), block):
                some = rows[k : k + block]
                ids, sims = bottom.search(unit[some], self._entry(unit[some]), width)
                full = (sims[:, -1] >= slack) & (width < n)
                r, c = np.nonzero((sims >= slack) & ~full[:, None])
                hit[some[r], ids[r, c]] = True
                if full.any():
                    search(some[full], 8 * width)

        search(np.arange(len(unit)), beam)

    def __getstate__(self) -> dict:
        return {"ids": self.ids, "vectors": self.vectors, "weight": self.weight, "links": [(x.most, x.links, x.used) for x in self.layers]}

    def __setstate__(self, state: dict) -> None:
        self.ids, self.vectors, self.weight = state["ids"], state["vectors"], state["weight"]
        self.unit = _unit(self.vectors)
        self.layers = []
        for most, links, used in state["links"]:
            layer = Layer(self.unit, most)
            layer.links, layer.used = links, used
            self.layers.append(layer)


def linked(g: Hierarchy, h: Hierarchy, least: float, beam: int, audit: int) -> tuple[np.ndarray, int, int]:
    """Which points of g and h have a cosine of at least ``least`` in double precision, as a boolean matrix.

    Each side's points are queries against the other's graph, and a pair counts if either search finds it. The audit
    compares ``audit`` points of h with all of g; while a pair of theirs is missing, beams are doubled. The other two
    results are the pairs audited and those of them that the first beam missed.
    """
    slack = np.float32(least - 1e-4)
    probe = np.arange(0, len(h.ids), max(1, len(h.ids) // audit))
    y, x = np.nonzero(h.unit[probe] @ g.unit.T >= slack)
    y, missed = probe[y], None
    hit = np.zeros((len(g.ids), len(h.ids)), bool)
    while True:
        g.near(h.unit, slack, beam, hit.T)
        if g is h:
            hit |= hit.T
        else:
            h.near(g.unit, slack, beam, hit)
        lost = int((~hit[x, y]).sum())
        missed = lost if missed is None else missed
        if not lost:
            break
        if beam >= max(len(g.ids), len(h.ids)):  # a graph in several parts: no beam finds all
            for k in range(0, len(hit), BATCH):
                hit[k : k + BATCH] |= g.unit[k : k + BATCH] @ h.unit.T >= slack
            break
        beam *= 2
    left, right = g.vectors.astype(np.float64), h.vectors.astype(np.float64)
    left_norm, right_norm = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    rows = max(1, (1 << 16) // len(h.ids))
    for k in range(0, len(hit), rows):
        p, q = np.nonzero(hit[k : k + rows])
        p += k
        hit[p, q] = np.einsum("kd,kd->k", left[p], right[q]) / (left_norm[p] * right_norm[q]) >= least
    if g is h:
        np.fill_diagonal(hit, False)
    return hit, len(x), missed


def _forest(hit: np.ndarray, shift: int, points: int) -> np.ndarray:
    """The smallest point reached from each of ``points``, over links of row r and column ``shift`` + c."""
    root, rows = np.arange(points), max(1, (1 << 20) // hit.shape[1])
    while True:
        new = root.copy()
        for k in range(0, len(hit), rows):
            a, b = np.nonzero(hit[k : k + rows])
            a, b = a + k, b + shift
            low = np.minimum(new[a], new[b])
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _pair_task(least: float, beam: int, audit: int):
    """For the graphs of two blocks of shards: forests ('edge': a, b), link counts ('count': a, n) and audits ('audited', 'missed': n)."""
    import pandas as pd

    def one(g: Hierarchy, h: Hierarchy) -> pd.DataFrame:
        hit, audited, missed = linked(g, h, least, beam, audit)
        ids, count, shift = g.ids, hit @ h.weight, 0
        if h is not g:
            ids, count, shift = np.concatenate([g.ids, h.ids]), np.concatenate([count, g.weight @ hit]), len(g.ids)
        root = _forest(hit, shift, len(ids))
        child, some = np.flatnonzero(root != np.arange(len(ids))), np.flatnonzero(count)
        return pd.DataFrame({
            "kind": ["edge"] * len(child) + ["count"] * len(some) + ["audited", "missed"],
            "a": pd.array([*ids[child], *ids[some], None, None], "Int64"),
            "b": pd.array([*ids[root[child]], *[None] * (len(some) + 2)], "Int64"),
            "n": np.concatenate([np.zeros(len(child)), count[some], [audited, missed]]).astype(np.int64),
        })

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        blobs = dict(zip(pdf["shard"], pdf["graph"], strict=True))
        of = lambda block: sorted(pdf["shard"][pdf["block"] == block])
        right = {k: pickle.loads(blobs[k]) for k in of(hi)}
        out = []
        for k in of(lo):
            g = right[k] if lo == hi else pickle.loads(blobs[k])
            out += [one(g, h) for m, h in right.items() if lo < hi or k <= m]
        return pd.concat(out)

    return run


def _build(pdf):
    import pandas as pd

    graph = Hierarchy(pdf["vec_id"].to_numpy(np.int64), np.array(pdf["embedding"].tolist(), np.float32), pdf["weight"].to_numpy(np.int64))
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "shards": pdf["shards"].iloc[:1], "graph": [pickle.dumps(graph, 5)]})


def _good() -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))


def _links(rows: DataFrame, least: float, shard_rows: int, beam: int, audit: int, together: int) -> tuple[DataFrame, DataFrame]:
    """The distinct vectors of ``rows``, and what the tasks of ``_pair_task`` found."""
    nodes = written(rows.where(_good()).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("embedding")), "nodes")
    sizes = nodes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    label = dict(nodes.dtypes)["label"]
    graphs = written(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, f"label {label}, dim int, shard int, shards int, graph binary"), "graphs")

    size = F.greatest(F.lit(1), F.least(F.lit(together), F.expr("shards div 32"))).cast("int")
    placed = graphs.withColumn("block", F.floor(F.col("shard") / size).cast("int")).withColumn("last", F.floor((F.col("shards") - 1) / size).cast("int"))
    ends = F.transform(F.sequence(F.lit(0), "last"), lambda k: F.struct(F.least(k, "block").alias("lo"), F.greatest(k, "block").alias("hi")))
    pairs = placed.select("label", "dim", "shard", "block", "graph", F.explode(ends).alias("e")).select("label", "dim", "e.lo", "e.hi", "block", "shard", "graph")
    found = pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(_pair_task(least, beam, audit), "kind string, a long, b long, n long")
    return nodes, written(found, "forests")


def audit_links(vectors: DataFrame, least: float = 0.93, shard_rows: int = 4096, beam: int = 48, audit: int = 256, together: int = 8) -> DataFrame:
    """One row: links ``audited`` by brute force over all pairs of shards, and those ``missed`` before beams were widened."""
    _, found = _links(vectors.select("vec_id", "embedding", "label"), least, shard_rows, beam, audit, together)
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)
    return found.agg(total("audited"), total("missed"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, shard_rows: int = 4096, beam: int = 48, audit: int = 256, together: int = 8) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors of the same label (null is none) and length are compared. A null or zero vector, one with a null or
    non-finite component, and one with a null id link with nothing. Rows that repeat an id count as vectors of their
    own but are one node of a component. An empty table gives an empty result; other columns are ignored.
    A label of many shards has them in blocks of up to ``together``; a task holds the graphs of two blocks.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    nodes, found = _links(rows, least, shard_rows, beam, audit, together)
    groups = components(found.where("kind = 'edge'").select("a", "b"))
    counts = found.where("kind = 'count'").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n"))
    by_node = nodes.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "vec_id", "weight").join(counts, "vec_id", "left").join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    by_node = by_node.select("_label", "_embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("_component"))
    joined = rows.withColumn("_good", _good()).join(by_node, F.col("_good") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("_component", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0
      WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT r.id, p.b FROM r JOIN p ON r.c = p.a),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = vec_id)::BIGINT AS n_links, coalesce(m.c, vec_id) AS component_id, vec_id = coalesce(m.c, vec_id) AS kept
FROM embeddings LEFT JOIN m ON m.id = vec_id
"""
