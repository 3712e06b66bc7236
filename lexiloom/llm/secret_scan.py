"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is DataFrame functions on one row at a time, so the job is a single scan without a shuffle. A text is
searched once per kind; positions are worked out only for texts with a match.

* Fixed patterns (the base): ``assign``, ``access`` and ``hex``, leftmost and without overlap per kind.
* Entropy: candidates are the maximal runs of a character class (``hexrun``: hexadecimal digits, ``token``: the
  base-64 alphabets) of at least ``WINDOW`` characters. A window slides over the candidate; its character counts are
  kept in a map, to which the entering character is added and from which the leaving one is taken, and the sum of
  c*log2(c) is updated from the two changed counts only. A candidate is reported if the largest entropy of its windows
  reaches the threshold of its class, it has digits and letters, no allow-list pattern matches it whole, and no base
  span contains it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table

WINDOW = 20
#: Least entropy in bits of the best window, by character class.
LEAST_BITS = {"hexrun": 3.05, "token": 3.95}

ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Kind, pattern, group that is measured, its least length. The order is the order of kinds in the output.
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
RUNS = [("hexrun", "[0-9A-Fa-f]{20,}"), ("token", "[A-Za-z0-9+/=_-]{20,}")]
#: Strings that look random but are not secrets: UUIDs, runs of words, version paths, whole alphabets and digits in order.
ALLOWED = "[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|([A-Z]?[a-z]+[/_-])+[A-Z]?[a-z]*[0-9]{0,4}|(0123456789|(?i:abcdefghijklmnopqrstuvwxyz)|(?i:abcdef))+"
KINDS = [k for k, *_ in BASE] + [k for k, _ in RUNS]


#: Matches that are appended to one array before the next is begun.
BLOCK = 128


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` as a lambda variable, so that it is worked out once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,rank,end,kind,value>> of the matches, in code points.

    The pieces between matches and the matches themselves alternate, so positions are running sums of their lengths.
    A literal ``{n,}`` prefix of a long run cannot shorten a match: the patterns are greedy.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(F.coalesce(x["match"], F.lit("")))
        found = F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
        good = x["match"].isNotNull() & (F.length(x["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(state["spans"], found)).otherwise(state["spans"]).alias("spans"))

    def block(state: Column, xs: Column) -> Column:
        return bound(
            F.aggregate(xs, F.struct(state["at"].alias("at"), empty.alias("spans")), step),
            lambda s: F.struct(s["at"].alias("at"), F.concat(state["spans"], F.array(s["spans"])).alias("spans")),
        )

    zipped = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), values.alias("value"))
    named = F.transform(zipped, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), x["value"].alias("value")))
    # In blocks: appending to one array for each match would cost the square of their number.
    blocks = bound(named, lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))))
    folded = F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,rank:int,end:int,kind:string,value:string>>>").alias("spans")), block, lambda s: s["spans"]))
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def most_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of the windows of ``value`` (0 if it is shorter than a window).

    A step takes the character that enters and the one that leaves, from two arrays made once, and a map of the at most
    ``window`` characters within, so the work is linear in the length of ``value``.
    """
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), 1, F.length(value))
    moves = F.zip_with(codes, leaving, lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    zero = F.struct(F.create_map().cast("map<int,int>").alias("n"), F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    count = lambda state, char: F.coalesce(F.element_at(state["n"], char), F.lit(0))

    def change(state: Column, char: Column, by: int) -> Column:
        old = count(state, char)
        rest = F.map_filter(state["n"], lambda k, _: k != char)
        held = F.when(old + by > 0, F.map_concat(rest, F.create_map(char, old + by))).otherwise(rest)
        return F.struct(held.alias("n"), state["at"].alias("at"), (state["sum"] + _weight(old + by) - _weight(old)).alias("sum"), state["best"].alias("best"))

    def finish(state: Column) -> Column:
        bits = F.lit(float(window))
        at = state["at"] + 1
        entropy = F.log2(bits) - state["sum"] / bits
        return F.struct(state["n"].alias("n"), at.alias("at"), state["sum"].alias("sum"), F.when(at >= window, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"))

    def step(state: Column, move: Column) -> Column:
        entered = bound(state, lambda s: change(s, move["enters"], 1))
        left = bound(entered, lambda s: F.when(move["leaves"] >= 0, change(s, move["leaves"], -1)).otherwise(s))
        return bound(left, finish)

    return F.aggregate(moves, zero, step, lambda s: s["best"])


def secret_scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of struct(start, rank, end, kind, value), both sorted.

    Null text counts as empty and gives empty arrays; every row is kept, repeated rows included, with its other
    columns. Columns named ``base`` or ``found`` are replaced. Spans of different kinds may overlap; equal starts are
    ordered by kind.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base", F.array_sort(F.concat(*[spans(text, k, p, g, n) for k, p, g, n in BASE])))
    runs = F.concat(*[spans(text, k, p) for k, p in RUNS])
    base = F.col("base")

    def secret(x: Column) -> Column:
        least = F.when(x["kind"] == "hexrun", LEAST_BITS["hexrun"]).otherwise(LEAST_BITS["token"])
        looks = x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~x["value"].rlike(f"^({ALLOWED})$")
        inside = F.exists(base, lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"]))
        return F.when(~looks | inside, F.lit(False)).otherwise(most_entropy(x["value"]) >= least)

    return out.withColumn("found", F.array_sort(F.concat(base, F.filter(runs, secret))))


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    of = lambda kind: F.filter("base", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k, *_ in BASE]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for kind, pattern, group, least in [*BASE, *((k, p, 0, 0) for k, p in RUNS)]:
        parts.append(f"""
SELECT row_id, {KINDS.index(kind)} AS rank, '{kind}' AS kind, start, start + len AS stop, value FROM (
  SELECT row_id, length(match) AS len, value, sum(length(gap)) OVER (PARTITION BY row_id ORDER BY i)
         + coalesce(sum(length(match)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT row_id, unnest(range(len(m))) AS i, unnest(m) AS match, unnest(v) AS value, unnest(g[1:len(m)]) AS gap
        FROM (SELECT row_id, regexp_extract_all(text, {quote(pattern)}) AS m, regexp_extract_all(text, {quote(pattern)}, {group}) AS v,
                     string_split_regex(text, {quote(pattern)}) AS g FROM t))) WHERE length(value) >= {least}""")
    base, runs = " UNION ALL ".join(parts[: len(BASE)]), " UNION ALL ".join(parts[len(BASE) :])
    return f"""
WITH t AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
runs AS ({runs}),
extra AS (
  SELECT * FROM runs r WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT regexp_full_match(value, {quote(ALLOWED)})
    AND list_max(list_transform(range(1, length(value) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(value, i, {WINDOW}), ''), 'entropy')))
        >= CASE kind WHEN 'hexrun' THEN {LEAST_BITS["hexrun"]} ELSE {LEAST_BITS["token"]} END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = r.row_id AND b.start <= r.start AND r.stop <= b.stop)),
b AS (SELECT row_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s, count(*) FILTER (kind = 'assign') AS n_assign,
             count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM base GROUP BY 1),
a AS (SELECT row_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s
      FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM t LEFT JOIN b USING (row_id) LEFT JOIN a USING (row_id)
"""


ORACLE_SQL = _oracle()
