"""A Merkle manifest of a table: a tree of digests per source, a tree over the sources, and a proof for each row.

Each row is a leaf, the SHA-256 of its fields. A source's leaves are numbered in order of their ids; every run of
``ARITY`` neighbours becomes a parent until one node is left, the source's subroot, and the subroots likewise give
the root. The trees of all sources grow together, a level at a time:

* **Siblings.** A node asks for the nodes of its run by computed index (the start of the run plus its own slot shifted
  by 0, 1, ... around the run) and an equi-join on (tree, index) answers. The number of rows is at most ``ARITY``
  times that of the level, whatever the sizes of the sources: a source with a third of all rows is a tree like others.
  The row of a node then holds what stands left and right of it in its run.
* **Parents.** Rows of slot 0 hash their run and are the next level, a sixteenth of the last.
* **Proofs** go down again: a node's path is the siblings of its own level and the path of its parent, so a level joins
  to one sixteenth of its rows.

Leaves are numbered by a range-partitioned sort; nothing but partition sizes and the height reaches the driver.
Levels are written to the shared folder, as digests of 32 bytes, and deleted when the next reader has gone by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import forget, ranked, remainder, table, written

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(values: list[Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return digest(F.concat(*[field(v) for v in values]))


def joined(found: Column) -> Column:
    return F.aggregate(found, F.lit(bytearray(b"")), lambda held, x: F.concat(held, x["digest"]))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, at, n, digest, more), each with ``left`` and ``right``: the digests of its run before and after it.

    ``n`` is the number of nodes of the tree at this level, ``more`` passes through.
    """
    slot = F.col("at") % arity
    run = F.least(F.lit(arity).cast("long"), F.col("n") - F.col("at") + slot)
    asks = nodes.select("tree", "at", "n", "more", F.explode(F.sequence(F.lit(0).cast("long"), run - 1)).alias("shift"), slot.alias("slot"), run.alias("run"))
    sibling = F.col("at") - F.col("slot") + (F.col("slot") + F.col("shift")) % F.col("run")
    asks = asks.select("tree", "at", "n", F.when(F.col("shift") == 0, F.col("more")).alias("more"), sibling.alias("sibling"))
    answers = asks.join(nodes.select("tree", F.col("at").alias("sibling"), "digest"), ["tree", "sibling"])
    found = answers.groupBy("tree", "at", "n").agg(F.first("more", ignorenulls=True).alias("more"), F.array_sort(F.collect_list(F.struct("sibling", "digest"))).alias("run"))
    at = F.col("at")
    own = F.filter("run", lambda x: x["sibling"] == at)[0]["digest"]
    return found.select("tree", "at", "n", "more", own.alias("digest"), joined(F.filter("run", lambda x: x["sibling"] < at)).alias("left"), joined(F.filter("run", lambda x: x["sibling"] > at)).alias("right"))


def climb(nodes: DataFrame, height: int, arity: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels from the leaves up, and for each level and the one after the last the nodes that are alone in their tree."""
    levels, tops = [], []
    for k in range(height):
        tops.append(nodes.where("n = 1"))
        level = written(with_siblings(nodes.where("n > 1"), arity), f"{name}-{k}")
        levels.append(level)
        own = F.concat(F.col("left"), F.col("digest"), F.col("right"))
        up = level.where(F.col("at") % arity == 0)
        none = F.lit(None).cast(nodes.schema["more"].dataType)
        nodes = up.select("tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest(hex_text(own)).alias("digest"), none.alias("more"))
    return levels, [*tops, nodes]


def height_of(most: int, arity: int) -> int:
    height = 0
    while most > 1:
        most, height = -(-most // arity), height + 1
    return height


PATH = "array<struct<left: binary, right: binary>>"


def descend(levels: list[DataFrame], tops: list[DataFrame], base: DataFrame, arity: int) -> DataFrame:
    """Nodes of the lowest level with ``path``: siblings level by level, its own first, and then the path of ``base``.

    ``base`` has the column ``tree``, a row for each tree, ``path`` and columns that are passed on.
    """
    passed = [c for c in base.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(levels), -1, -1):
        now = tops[k].select("tree", "at", "digest", "more").join(base, "tree").select("tree", "at", "digest", "more", "path", *passed)
        if k < len(levels):
            own = F.array(F.struct("left", "right"))
            parents = above.select("tree", F.col("at").alias("_parent"), F.col("path").alias("_path"), *passed)
            held = levels[k].withColumn("_parent", F.expr(f"at div {arity}")).join(parents, ["tree", "_parent"])
            now = held.select("tree", "at", "digest", "more", F.concat(own, F.col("_path")).cast(PATH).alias("path"), *passed).unionByName(now)
        above = now
    return above


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, more: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root (lowercase hex) and ``path``.

    ``path`` is an array of struct(left, right), a struct for each level from the leaf's up to the root's: the digests
    before and after in the run; see ``fold``. ``more`` are further columns over ``docs``, passed through (a digest of
    a changed row, say); other columns of ``docs`` are ignored. Ids ascend with null first, and equal ids by leaf; rows
    equal in all fields are leaves of their own and interchangeable. Null is a source of its own, before all others. A
    table of one row has its leaf as subroot and root, and an empty path. An empty table gives an empty result.
    """
    kept = [F.col(id_col).alias("id"), *[c.alias(f"more_{k}") for k, c in (more or {}).items()]]
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    leaves = written(docs.select(key.alias("key"), F.struct(*kept).alias("more"), leaf([F.col(c) for c in fields]).alias("digest")), "leaves")
    numbered = ranked(leaves.withColumn("_id", F.col("more.id")), "key", F.col("_id").asc_nulls_first(), "digest", name="number")
    forget(leaves)
    sources = ranked(numbered.groupBy("key").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "key", name="tree")
    nodes = written(numbered.join(sources, "key").select("tree", (F.col("number") - F.col("first")).alias("at"), "n", "digest", "more"), "leaf-nodes")
    forget(numbered)
    most, trees = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()

    levels, tops = climb(nodes, height_of(most, arity), arity, "leaf-level")
    subroots = written(tops[0].unionByName(_union(tops[1:], nodes)).select("tree", "digest"), "subroots")
    forest = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), "digest", F.col("tree").alias("more"))
    high, high_tops = climb(forest, height_of(trees, arity), arity, "source-level")
    base = high_tops[-1].select("tree", F.array().cast(PATH).alias("path"), hex_text(F.col("digest")).alias("root"))
    paths = descend(high, high_tops, base, arity)
    base = paths.select(F.col("at").alias("tree"), "path", "root", hex_text(F.col("digest")).alias("subroot"))
    rows = descend(levels, tops, written(base, "source-paths"), arity)
    out = rows.select(F.col("more.id").alias(id_col), hex_text(F.col("digest")).alias("leaf"), "subroot", "root", "path", *[F.col(f"more.more_{k}").alias(k) for k in more or {}])
    forget(*high)
    return out


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out


def proof_text(path: Column) -> Column:
    """All siblings, level by level, left to right, as hex text."""
    return hex_text(F.aggregate(path, F.lit(bytearray(b"")), lambda held, x: F.concat(held, x["left"], x["right"])))


def fold(leaf_hex: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf_hex, lambda held, x: F.sha2(F.concat(hex_text(x["left"]), held, hex_text(x["right"])), 256))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 5) == 0), leaf([lowered if c == "text" else F.col(c) for c in FIELDS]))
    made = merkle_manifest(docs, more={"tampered": tampered})
    made = made.withColumn("folded_root", fold(F.coalesce(hex_text(F.col("tampered")), F.col("leaf")), F.col("path")))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of state ``s`` and one more byte ``b``, bit by bit, in SQL; 3988292384 is the reversed polynomial.
CRC_STEP = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, o: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))"


def _oracle() -> str:
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    fields = " || ".join(part(c) for c in FIELDS)
    changed = " || ".join(part("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS)
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, sha256({fields}) AS leaf, sha256({changed}) AS changed FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM t),
low AS (
  SELECT 0 AS level, tree, pos, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY level, tree, pos // {ARITY}, n),
subroots AS (SELECT tree, digest FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree AS pos, (SELECT count(*) FROM subroots) AS n, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // {ARITY}, n),
low_sides AS (
  SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.level = b.level AND a.tree = b.tree AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY ALL),
high_sides AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM high a JOIN high b ON a.level = b.level AND a.pos // {ARITY} = b.pos // {ARITY} WHERE a.n > 1 GROUP BY ALL),
sides AS (
  SELECT 0 AS part, level, tree, pos, l, r FROM low_sides UNION ALL SELECT 1, level, -1, pos, l, r FROM high_sides),
walk AS (
  SELECT row_number() OVER () AS row_id, doc_id, tree, leaf, pos AS node, n, 0 AS part, 0 AS level, '' AS proof,
         CASE WHEN doc_id IS NOT NULL AND crc % 5 = 0 THEN changed ELSE leaf END AS folded
  FROM (SELECT *, (list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b: {CRC_STEP})) AS raw, xor(raw, 4294967295::BIGINT) AS crc FROM leaves)
  UNION ALL
  SELECT row_id, doc_id, w.tree, leaf, CASE WHEN s.pos IS NULL THEN w.tree ELSE node // {ARITY} END, n, CASE WHEN s.pos IS NULL THEN 1 ELSE w.part END, CASE WHEN s.pos IS NULL THEN 0 ELSE w.level + 1 END,
         proof || coalesce(s.l || s.r, ''), CASE WHEN s.pos IS NULL THEN folded ELSE sha256(s.l || folded || s.r) END
  FROM walk w LEFT JOIN sides s ON s.part = w.part AND s.level = w.level AND s.pos = w.node AND s.tree = CASE WHEN w.part = 0 THEN w.tree ELSE -1 END
  WHERE w.part = 0 OR s.pos IS NOT NULL),
last AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY part DESC, level DESC) = 1)
SELECT doc_id, leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM last JOIN subroots s USING (tree), (SELECT digest AS root FROM high WHERE n = 1)
"""


ORACLE_SQL = _oracle()
