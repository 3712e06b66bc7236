"""Readings of words in context, and dictionary keys that a document uses as something else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.runs import Spots, chunks, holds
from lexiloom.operators.consistency import repeated
from lexiloom.sources.shared import bit_table, sized, written

# Tags of the analyser, and particles that are never part of a noun.
VERB_TAGS = ("VV", "VA", "VX")
ENDING_TAGS = ("ETM", "EF", "EC", "EP")
NOMINAL_TAGS = ("NNG", "NNP", "NNB", "NP", "NR", "XSN", "XPN")
CLEAR_PARTICLES = ("에서", "에게", "으로", "까지", "부터", "와의", "과의", "은", "는", "을", "를", "와", "과", "의", "에", "로", "도", "만")

READING = "struct<n: int, cost: int, morphemes: array<struct<form: string, tag: string>>>"
PLACE = ("doc_id", "key", "occ")


def key_places(words: DataFrame, keys: DataFrame, most: int = 4) -> DataFrame:
    """The first ``most`` places of each key in each document: doc_id, key, occ (from 1), idx. ``words``: doc_id, idx, eojeol.

    If ``words`` has ``near`` (array of struct(off, eojeol), the words around), places have it too.
    """
    order = Window.partitionBy("doc_id", "key").orderBy("idx")
    near = [c for c in words.columns if c == "near"]
    met = words.select("doc_id", "idx", F.col("eojeol").alias("key"), *near).join(sized(keys.select("key").where("key is not null").distinct(), "keys"), "key")
    return met.withColumn("occ", F.row_number().over(order)).where(F.col("occ") <= most).select(*PLACE, "idx", *near)


def best_readings(places: DataFrame, words: DataFrame, readings: DataFrame, follows: dict[tuple[str, str], int], strange: int, around: int = 2) -> DataFrame:
    """``places`` (doc_id, key, occ, idx) with ``reading``: the one on the best path through the words around.

    ``readings``: eojeol, readings (array of struct(n, cost, morphemes), ``n`` distinct in a word). The words from ``around`` before
    a place to ``around`` after it and their readings are a lattice; a path takes one reading of each and costs
    those of its readings and, where one follows another, ``follows`` by the last tag of the one and the first of the
    other, ``strange`` for pairs that it has not. The cheapest path wins, of equal ones that with the smaller ``n`` at the place.
    A word without readings ends the path on both sides: what stands next to it costs nothing more.

    Places with ``near`` bring the words around along, so that ``words`` is not read again.

    A lattice is a few words in one row, folded from left to right: for each reading of the word so far the cost of the
    best path to it and what that takes at the place, so a step looks at no more than pairs of readings.
    """
    if "near" in places.columns:
        near = places.select(*PLACE, F.explode(F.filter("near", lambda x: x["off"].between(-around, around))).alias("w")).select(*PLACE, "w.off", "w.eojeol")
    else:
        near = places.select(*PLACE, F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("off"), "idx").withColumn("idx", (F.col("idx") + F.col("off")).cast(words.schema["idx"].dataType))
        near = near.join(words.select("doc_id", "idx", "eojeol"), ["doc_id", "idx"])
    met = near.join(readings, "eojeol", "left")
    none = F.array().cast(f"array<{READING}>")
    lattice = met.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce("readings", none).cast(f"array<{READING}>").alias("readings")))).alias("lattice"))
    costs = F.create_map(*[x for (a, b), c in follows.items() for x in (F.lit(f"{a}>{b}"), F.lit(c))]) if follows else F.create_map().cast("map<string, int>")
    state = "array<struct<cost: int, center: int, tag: string>>"
    first, last = lambda r: F.try_element_at(r["morphemes"], F.lit(1))["tag"], lambda r: F.try_element_at(r["morphemes"], F.lit(-1))["tag"]

    def step(paths: Column, word: Column) -> Column:
        def onward(r: Column) -> Column:
            reached = F.transform(paths, lambda p: F.struct((p["cost"] + r["cost"] + F.when(p["tag"].isNull(), 0).otherwise(F.coalesce(F.try_element_at(costs, F.concat_ws(">", p["tag"], first(r))), F.lit(strange)))).alias("cost"), F.when(word["off"] == 0, r["n"]).otherwise(p["center"]).alias("center"), last(r).alias("tag")))
            return F.array_min(reached)

        unread = F.transform(paths, lambda p: F.struct(p["cost"].alias("cost"), p["center"].alias("center"), F.lit(None).cast("string").alias("tag")))
        return F.when(F.size(word["readings"]) > 0, F.transform(word["readings"], onward)).otherwise(F.array(F.array_min(unread))).cast(state)

    start = F.array(F.struct(F.lit(0).alias("cost"), F.lit(None).cast("int").alias("center"), F.lit(None).cast("string").alias("tag"))).cast(state)
    center = F.array_min(F.aggregate("lattice", start, step))["center"]
    own = F.get(F.filter("lattice", lambda x: x["off"] == 0), 0)["readings"]
    # Not a filter by ``center``: Spark would put the whole path into its lambda, once a reading.
    chosen = lattice.withColumn("reading", F.get(own, (F.array_position(own["n"], center) - 1).cast("int")))
    return chosen.select(*PLACE, "reading")


def homograph_in_context(words: DataFrame, keys: DataFrame, readings: DataFrame, headwords: DataFrame, follows: dict[tuple[str, str], int], strange: int, listed: tuple[str, ...] = (), around: int = 2, most: int = 4) -> DataFrame:
    """For each key that is a word of a document, whether and why to hold it back: doc_id, key, hold.

    ``keys``: key (a spelling that a table would replace). ``hold`` is the first of: ``listed``, in that list;
    ``particle``, a headword of two syllables or more and a clear particle; ``verb``, one of its first ``most``
    places reads, on the best path through the words around, from a verb to an ending, and the verb that the first
    of those shows is no key itself; ``noun``, one of them reads as nouns and then particles that add up to the word,
    and the nouns of the first are a headword. Else it is null. Null keys and words are left out.
    """
    place = written(key_places(words, keys, most), "key-places")
    read = best_readings(place, words, readings, follows, strange, around).where("reading is not null")
    m = F.col("reading.morphemes")
    verb = F.try_element_at(m, F.lit(1))["tag"].isin(*VERB_TAGS) & F.try_element_at(m, F.lit(-1))["tag"].isin(*ENDING_TAGS)
    particles = F.size(m) - F.aggregate(m, F.lit(0), lambda n, t: F.when(t["tag"].startswith("J"), n).otherwise(n + 1))
    stem = F.slice(m, 1, F.greatest(F.size(m) - particles, F.lit(0)))
    text = lambda part: F.array_join(F.transform(part, lambda t: t["form"]), "")
    noun = (particles > 0) & (particles < F.size(m)) & F.forall(stem, lambda t: t["tag"].isin(*NOMINAL_TAGS)) & F.forall(F.slice(m, F.size(m) - particles + 1, F.greatest(particles, F.lit(1))), lambda t: t["tag"].startswith("J")) & (text(m) == F.col("key"))
    shown = read.select("doc_id", "key", "occ", F.when(verb, F.concat(F.try_element_at(m, F.lit(1))["form"], F.lit("다"))).alias("lemma"), F.when(noun, text(stem)).alias("base"))
    firsts = shown.groupBy("doc_id", "key").agg(F.min_by("lemma", F.when(F.col("lemma").isNotNull(), F.col("occ"))).alias("lemma"), F.min_by("base", F.when(F.col("base").isNotNull(), F.col("occ"))).alias("base"))

    return _held(place.select("doc_id", "key").distinct().join(firsts, ["doc_id", "key"], "left"), keys, headwords, listed)


def _held(firsts: DataFrame, keys: DataFrame, headwords: DataFrame, listed: tuple[str, ...]) -> DataFrame:
    """doc_id, key, hold of ``firsts`` (doc_id, key, lemma, base), those of ``keys`` only."""
    known = headwords.select("word").where("word is not null").distinct()
    cut = F.array(*[F.when(F.endswith("key", F.lit(p)), F.expr(f"substring(key, 1, length(key) - {len(p)})")) for p in CLEAR_PARTICLES])
    keys = keys.select("key").where("key is not null").distinct()
    stems = keys.select("key", F.explode(F.filter(cut, lambda b: F.length(b) >= 2)).alias("word"))
    particle = stems.join(known, "word", "left_semi").select("key").distinct().withColumn("by_particle", F.lit(True))
    out = firsts.join(sized(keys.join(particle, "key", "left"), "held-keys"), "key")
    out = out.join(sized(keys.select(F.col("key").alias("lemma")), "verbs").withColumn("odd_verb", F.lit(True)), "lemma", "left").join(sized(known.select(F.col("word").alias("base")), "bases").withColumn("known_base", F.lit(True)), "base", "left")
    hold = F.when(F.col("key").isin(*listed), "listed") if listed else F.when(F.lit(False), "listed")
    hold = hold.when(F.col("by_particle"), "particle").when(F.col("lemma").isNotNull() & F.col("odd_verb").isNull(), "verb").when(F.col("known_base"), "noun")
    return out.select("doc_id", "key", hold.alias("hold"))


Reader = Callable[[str], list[tuple[int, int, list[tuple[str, str]]]]]


class Lattices:
    """Best paths for many places at once, as ``best_readings`` takes them. A word counts by the costs and outer tags of its readings, its shape."""

    def __init__(self, read: Reader, follows: dict[tuple[str, str], int], strange: int, most: int = 1 << 18) -> None:
        self.read, self.most = read, most
        tags = sorted({t for pair in follows for t in pair})
        #: 0 is no tag, 1 any that ``follows`` has not.
        self.tags = {t: i + 2 for i, t in enumerate(tags)}
        self.follows = np.full((len(tags) + 2, len(tags) + 2), strange, np.int64)
        for (a, b), c in follows.items():
            self.follows[self.tags[a], self.tags[b]] = c
        self.follows[0] = 0
        self.shape_of: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}

    def shapes_for(self, words: list[str]) -> np.ndarray:
        """The shape of each word; the analyser is asked once for each, until too many are kept."""
        if len(self.shape_of) > self.most:
            self.shape_of, self.shapes = {}, {}
        tag = lambda m, k: self.tags.get(m[k][1], 1) if m else 0
        for w in words:
            if w not in self.shape_of:
                shape = tuple((cost, n, tag(m, 0), tag(m, -1)) for n, cost, m in self.read(w))
                self.shape_of[w] = self.shapes.setdefault(shape, len(self.shapes))
        return np.fromiter((self.shape_of[w] for w in words), np.int64, len(words))

    def best(self, lattice: np.ndarray, center: int) -> np.ndarray:
        """The number, from 0, of the reading that the word in column ``center`` has on the best path of each row; -1 without any.

        ``lattice`` has the shapes of words one after the other, -1 for none. Cost and rank of the reading at the
        place are one number, so that of equal paths the one with the smaller ``n`` is the least.
        """
        many = max([1, *map(len, self.shapes)])
        cost, first, last, rank, back = (np.zeros((len(self.shapes) + 1, many), np.int64) for _ in range(5))
        there = np.zeros((len(self.shapes) + 1, many), bool)
        for shape, k in self.shapes.items():
            by_n = sorted(range(len(shape)), key=lambda r: shape[r][1])
            for r, (c, _, a, b) in enumerate(shape):
                cost[k, r], first[k, r], last[k, r], rank[k, r], there[k, r], back[k, r] = c * many, a, b, by_n.index(r), True, by_n[r]
        far = np.int64(1) << 60
        best, tag = np.full((len(lattice), many), far), np.zeros((len(lattice), many), np.int64)
        best[:, 0] = 0
        for k in range(lattice.shape[1]):
            word = lattice[:, k]
            reads = there[word].any(1) & (word >= 0)
            steps = best[:, :, None] + self.follows[tag[:, :, None], first[word][:, None, :]] * many
            onward = np.where(there[word], steps.min(1) + cost[word] + (rank[word] if k == center else 0), far)
            unread = np.full_like(best, far)
            unread[:, 0] = best.min(1)
            met = (word >= 0)[:, None]
            best = np.where(met, np.where(reads[:, None], onward, unread), best)
            tag = np.where(met, np.where(reads[:, None], last[word], 0), tag)
        own = lattice[:, center]
        return np.where(there[own].any(1), back[own, best.min(1) % many], -1)


def _shown(key: str, m: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    """The verb and the noun that a reading of ``key`` shows."""
    if not m:
        return None, None
    lemma = m[0][0] + "다" if m[0][1] in VERB_TAGS and m[-1][1] in ENDING_TAGS else None
    j = len(m)
    while j and m[j - 1][1].startswith("J"):
        j -= 1
    noun = 0 < j < len(m) and all(t in NOMINAL_TAGS for _, t in m[:j]) and "".join(f for f, _ in m) == key
    return lemma, "".join(f for f, _ in m[:j]) if noun else None


def homograph_in_texts(docs: DataFrame, cut: Callable[[list[str]], tuple[np.ndarray, pa.Array]], keys: DataFrame, read: Reader, headwords: DataFrame, follows: dict[tuple[str, str], int], strange: int, listed: tuple[str, ...] = (), around: int = 2, most: int = 4) -> DataFrame:
    """``homograph_in_context`` with the words and their readings made where they stand, so that no word is shuffled.

    ``cut`` gives the words of some texts in order, and by number whose they are; ``read`` the readings (n, cost,
    morphemes) of a word. Each row of ``docs`` finds its first places of words that a bit table of ``keys`` lets pass, and
    the best paths there; what is no key goes by an exact join. Only ids of several rows are brought together.
    """
    table = bit_table(keys.select("key"))
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, t) for c, t in (("key", T.StringType()), ("idx", T.LongType()), ("lemma", T.StringType()), ("base", T.StringType())))])

    def places(each: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattices = Lattices(read, follows, strange)
            for batch in batches:
                done = 0
                for texts in chunks(batch.column("text").to_pylist(), 1 << 21):
                    whose, idx, names, key, lemma, base = _in_texts(texts, cut, table.value, lattices, around, most, each)
                    columns = [batch.column("doc_id").take(pa.array(whose + done)), names.take(pa.array(key)), pa.array(idx, pa.int64()), lemma, base]
                    yield pa.RecordBatch.from_arrays([c.cast(pa.string()) if k in (1, 3, 4) else c for k, c in enumerate(columns)], names=kind.names)
                    done += len(texts)

        return run

    again = repeated(docs)
    if again.isEmpty():
        firsts = docs.select("doc_id", "text").mapInArrow(places(False), kind)
    else:
        same = F.col("doc_id").eqNullSafe(F.col("id"))
        firsts = docs.join(again, same, "left_anti").select("doc_id", "text").mapInArrow(places(False), kind)
        more = docs.join(again, same, "left_semi").select("doc_id", "text").mapInArrow(places(True), kind)
        order = Window.partitionBy("doc_id", "key").orderBy("idx")
        more = more.withColumn("occ", F.row_number().over(order)).where(F.col("occ") <= most)
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("occ"))).alias(c)
        firsts = firsts.unionByName(more.groupBy("doc_id", "key").agg(F.min("idx").alias("idx"), first("lemma"), first("base")))
    # As in a join, no word stands around one of a document without an id.
    named = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return _held(firsts.select("doc_id", "key", named("lemma"), named("base")), keys, headwords, listed)


def _in_texts(texts: list[str], cut: Callable, table: np.ndarray, lattices: Lattices, around: int, most: int, each: bool) -> tuple:
    """Whose, place, words, word (by number), lemma and base of the first places of words that ``table`` holds; unless ``each``, one row for a text and word."""
    whose, words = cut(texts)
    coded = words.dictionary_encode()
    names, code = coded.dictionary.cast(pa.large_string()), coded.indices.to_numpy()
    bounds = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    maybe = holds(table, Spots(names.buffers()[2]).of(bounds[:-1], bounds[1:])) if len(names) else np.zeros(0, bool)
    at = np.flatnonzero(maybe[code])
    group = whose[at] * max(1, len(names)) + code[at]
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, np.int64)
    occ = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    at, group = at[occ < most], group[occ < most]
    near = at[:, None] + np.arange(-around, around + 1)
    inside = (near >= 0) & (near < len(code))
    near = np.clip(near, 0, max(0, len(code) - 1))
    inside &= whose[near] == whose[at][:, None] if len(code) else inside
    needed, back = np.unique(code[near], return_inverse=True)
    shapes = lattices.shapes_for(names.take(pa.array(needed)).to_pylist())
    reading = lattices.best(np.where(inside, shapes[back.reshape(near.shape)], -1), around) if len(at) else np.zeros(0, np.int64)
    pairs, pair = np.unique(code[at].astype(np.int64) * 1024 + reading + 1, return_inverse=True)
    shown = []
    for name, r in zip(names.take(pa.array(pairs // 1024)).to_pylist(), (pairs % 1024 - 1).tolist(), strict=True):
        shown.append(_shown(name, lattices.read(name)[r][2]) if r >= 0 else (None, None))
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(at) else np.zeros(0, np.int64)
    of = [pa.array([s[k] for s in shown], pa.large_string()) for k in (0, 1)]
    if each or not len(at):
        return whose[at], at - np.searchsorted(whose, whose[at]), names, code[at], *(o.take(pa.array(pair)) for o in of)
    found = []
    for o in of:
        has = ~np.asarray(o.is_null())[pair]
        first = np.minimum.reduceat(np.where(has, np.arange(len(at)), len(at)), begins)
        found.append(o.take(pa.array(pair[np.minimum(first, len(at) - 1)], mask=first == len(at))))
    at = at[begins]
    return whose[at], at - np.searchsorted(whose, whose[at]), names, code[at], *found
