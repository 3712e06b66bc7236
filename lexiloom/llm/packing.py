"""Packing documents into sequences of a fixed length by a configuration linear program.

1. **Pieces.** Each document is tokenized in one pass and ends with a separator. Longer ones are cut into pieces of the
   sequence length, of which the first may be shorter. Only lengths and check sums go on, to a table in the shared folder.
2. **Plan.** Pieces are counted by length: at most ``capacity`` counts reach the driver, at every size of the input. A
   configuration is a set of lengths that fits a sequence; the linear program asks for amounts of configurations that
   cover all counts with the fewest sequences. It is solved by multiplicative weights: prices of lengths shrink with
   their coverage, amounts of configurations grow with the coverage that they still lack, and a knapsack dynamic
   program over the capacity prices all configurations, adds those near the best, and gives a lower bound.
3. **Rounding.** Amounts are rounded while pieces are left, fullest configurations first; pieces left over, at most a few
   of each length, are packed by best fit, the longest first. Both work on counts.
4. **Places.** Pieces are numbered in order of length (a range-partitioned sort). A plan line says which numbers go to
   which sequences at which offset, so every row finds its place by itself; nothing is shuffled by sequence.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import forget, map_texts, ranked, table, written

CAPACITY = 1024
SEPARATOR = 2
#: Longer texts are tokenized in parts, cut before a space that follows a visible ASCII character.
LONG, SAFE_CUT = 1 << 22, re.compile(rb"(?<=[!-~]) ")


# -- tokens -----------------------------------------------------------------------------------


class _Ragged(Exception):
    """A word that ends with white space: its text has to be cut elsewhere than at every space."""


class WordIds(dict):
    """The ids, as little-endian 32-bit bytes, of a space and a word; filled as words come, emptied when full.

    A text's words between single spaces are tokenized on their own: a pre-token never reaches from a letter, digit or
    sign over a space, and takes at most one space in front. ``merge`` is the byte-pair encoder for words of the
    first code points, whose classes no version of Unicode changes; all others go to ``tokenizer``.
    """

    def __init__(self, tokenizer, merge, most: int = 300_000):
        super().__init__()
        self.tokenizer, self.merge, self.most = tokenizer, merge, most
        self.marks = {m: self.ids(m.decode()) for m in (b",", b".")}

    def ids(self, text: str) -> bytes:
        plain = "<|" not in text and (text.isascii() or max(text) < "ɐ")
        ids = self.merge(text) if plain else self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: bytes) -> bytes:
        text = " " + word.decode("utf-8", "replace")
        if text[-1].isspace():
            raise _Ragged
        if len(self) >= self.most:
            self.clear()
        if word[-1:] in self.marks and word[-2:-1].isalnum():  # a mark after a letter or digit is a pre-token of its own
            return self[word[:-1]] + self.marks[word[-1:]]
        found = self[word] = self.ids(text)
        return found

    def encode(self, raw: bytes) -> bytes:
        parts, at = [], 0
        while len(raw) - at > 2 * LONG and (cut := SAFE_CUT.search(raw, at + LONG)):
            parts.append(self.encode(raw[at : cut.start()]))
            at = cut.start()
        if parts:
            return b"".join([*parts, self.encode(raw[at:])])
        first, *words = raw.split(b" ")
        head = first.decode("utf-8", "replace")
        if not head[-1:].isspace():
            try:
                return b"".join([self.ids(head), *map(self.__getitem__, words)])
            except _Ragged:
                pass
        # Cut before a space that follows anything but white space: a pre-token ends there in any case.
        return b"".join(self.ids(part) for part in re.split(r"(?<=\S)(?= )", raw.decode("utf-8", "replace")))


@functools.lru_cache(maxsize=1)
def word_ids(tokenizer_path: str, ranks_path: str) -> WordIds:
    """One for each Python worker, kept for the tasks that follow."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    merge = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return WordIds(Tokenizer.from_file(tokenizer_path), merge.encode_ordinary)


def pieces_of(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    end = np.array([separator], "<u4").tobytes()

    def cut(texts: list[bytes]) -> dict:
        words, out = word_ids(tokenizer_path, ranks_path), []
        for text in texts:
            ids = words.encode(text) + end
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out.append([{"start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b])} for a, b in zip(edges[:-1], edges[1:], strict=True)])
        return {"_pieces": out}

    rows = map_texts(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), cut, "_pieces array<struct<start: long, length: long, ids_crc32: long>>", "_text")
    return rows.select(F.col("_id").alias(id_col), F.posexplode("_pieces").alias("piece", "_p")).select(id_col, "piece", "_p.*")


# -- the linear program -----------------------------------------------------------------------


def best_fill(lengths: np.ndarray, value: np.ndarray, capacity: int, slack: float, rng: np.random.RandomState) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each width up to ``capacity`` the most value of lengths within it, and how often each is taken.

    Among last lengths within ``slack`` of the best, one is drawn, so that calls with like prices give other fills;
    the values are those of the fills.
    """
    best, fill = np.zeros(capacity + 1), np.zeros((capacity + 1, len(lengths)), np.int16)
    draw = rng.random_sample(capacity + len(lengths))
    for w in range(1, capacity + 1):
        k, at, source = np.searchsorted(lengths, w, side="right"), -1, w - 1
        best[w] = best[w - 1]
        if k:
            got = best[w - lengths[:k]] + value[:k]
            top = got.max()
            if top > best[w - 1]:
                shift = rng.randint(capacity)
                at = int(np.where(got >= (1 - slack) * top, draw[shift : shift + k], -1.0).argmax())
                best[w], source = got[at], w - lengths[at]
        fill[w] = fill[source]
        if at >= 0:
            fill[w, at] += 1
    return best, fill


@dataclass
class Solution:
    configurations: np.ndarray  # a row each, the number of pieces of each length
    amounts: np.ndarray
    bound: float  # no packing, whole or fractional, takes fewer sequences


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 80, steps: int = 30, rate: float = 0.2, pull: float = 1.0, noise: float = 0.4, near: float = 0.97, seed: int = 1) -> Solution:
    """Amounts of configurations that cover ``counts``, by multiplicative weights with knapsack pricing.

    In each of ``rounds`` rounds the dynamic program prices configurations, for each length the best that holds it,
    under prices perturbed by up to ``noise`` / 2; those worth ``near`` of the best join the pool. Then ``steps`` times,
    prices are multiplied by a power of the inverse coverage, and amounts by the mean inverse coverage of what
    they hold and a power of what that is worth, next to the best. The bound is the largest value of the counts under any prices for which no configuration is worth over 1.
    """
    rng, m, n = np.random.RandomState(seed), len(lengths), counts.astype(float)
    prices, known, pool = lengths / capacity, set(), []
    row, col, times, amounts = (np.zeros(0, int) for _ in range(4))
    bound = float((lengths * n).sum() / capacity)
    size = lengths / capacity
    for step in range(rounds):
        exact, _ = best_fill(lengths, prices, capacity, 0.0, rng)
        bound = max(bound, float((prices * n).sum() / exact[-1]) * (1 - 1e-9))
        priced = prices * (1 + noise * (rng.random_sample(m) - 0.5))
        best, fill = best_fill(lengths, priced, capacity, noise / 10, rng)
        made = fill[capacity - lengths]
        made[np.arange(m), np.arange(m)] += 1
        value = made @ priced
        worth = (value >= near * value.max()) | (made @ lengths == capacity) | (step == 0)
        fresh = [x for x in made[worth] if (key := x.tobytes()) not in known and not known.add(key)]
        if fresh:
            at = np.nonzero(np.array(fresh))
            row, col, times = np.concatenate([row, at[0] + len(pool)]), np.concatenate([col, at[1]]), np.concatenate([times, np.array(fresh)[at]])
            share = bound * (0.3 if pool else 1.0) / len(fresh)
            amounts = np.concatenate([amounts * 0.7, np.full(len(fresh), share)])
            pool += fresh
        weight = times * size[col]
        held = np.bincount(row, weight, len(pool))
        for _ in range(steps):
            cover = np.maximum(np.bincount(col, times * amounts[row], m) / n, 1e-9)
            prices = prices * np.clip(cover, 0.1, 10.0) ** -rate
            worth = np.bincount(row, times * prices[col], len(pool))
            prices /= worth.max()
            amounts = amounts * (worth / worth.max()) ** pull * np.bincount(row, weight / cover[col], len(pool)) / held
    return Solution(np.array(pool), amounts, bound)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on counts by length (index = length): (pieces of each length, number of sequences) lines.

    Sequences that hold the same pieces are one group; a length goes to the group with the least room that takes it.
    """
    open_, lines = [[] for _ in range(capacity + 1)], []  # by room: [content, number]
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = next((r for r in range(length, capacity) if open_[r]), None)
            if room is None:  # new ones: full of this length as far as it goes
                each = capacity // length
                groups = [(each, left // each), (left % each, 1)]
                content, left = {}, 0
            else:
                content, number = open_[room].pop()
                each = min(room // length, left)
                taken = min(number, left // each)
                groups = [(each, taken)]
                if taken < number:
                    open_[room].append([content, number - taken])
                left -= each * taken
            for each, number in groups:
                if each and number:
                    free = (capacity if room is None else room) - each * length
                    open_[free].append([{**content, length: content.get(length, 0) + each}, number])
    for groups in open_:
        lines += groups
    return [(np.bincount(list(c), list(c.values()), capacity + 1).astype(int), n) for c, n in lines if c]


def rounded(lengths: np.ndarray, counts: np.ndarray, solution: Solution, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of configurations, and best fit for what is left: the best of a few ways to round."""
    full = solution.configurations @ lengths
    order = np.lexsort((-solution.amounts, -full))
    tried = []
    for least, up in [(capacity, 0.0), (capacity, 1.0), (0.99 * capacity, 0.0), (0.0, 0.0), (0.0, 0.5)]:
        left, lines = counts.copy(), []
        for k in order:
            if full[k] < least:
                break
            held = np.flatnonzero(solution.configurations[k])
            number = min(int(solution.amounts[k] + up), int((left[held] // solution.configurations[k, held]).min()))
            if number > 0:
                left[held] -= number * solution.configurations[k, held]
                lines.append((np.bincount(lengths, solution.configurations[k], capacity + 1).astype(int), number))
        rest = np.zeros(capacity + 1, int)
        rest[lengths] = left
        lines += best_fit(rest, capacity)
        tried.append((sum(n for _, n in lines), lines))
    return min(tried, key=lambda x: x[0])[1]


def plan(counts: np.ndarray, capacity: int, **options) -> tuple[np.ndarray, int, float]:
    """(lines, sequences, bound) for ``counts`` by length (index = length).

    A line is (first number of a piece, pieces a sequence, length, first sequence, offset): pieces are numbered from 0
    in order of length, and a line holds until the next one.
    """
    lengths = np.flatnonzero(counts[:capacity])
    lines = [(np.bincount([capacity], minlength=capacity + 1), int(counts[capacity]))] if counts[capacity] else []
    bound = float(counts[capacity])
    if len(lengths):
        solution = solve(lengths, counts[lengths], capacity, **options)
        bound += solution.bound
        lines += rounded(lengths, counts[lengths], solution, capacity)
    first = np.concatenate([[0], np.cumsum(counts)])[: capacity + 1]
    made, sequence = [], 0
    for content, number in lines:
        offset = 0
        for length in np.flatnonzero(content)[::-1]:
            made.append((first[length], content[length], length, sequence, offset))
            first[length] += number * content[length]
            offset += int(content[length] * length)
        sequence += number
    return np.array(sorted(made), np.int64).reshape(-1, 5), sequence, bound


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty and is one piece, the separator alone. Rows that repeat an id, and null ids, are separate
    documents. An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    found = written(pieces_of(docs, tokenizer_path, ranks_path, id_col, text_col, capacity, separator), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in found.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    lines, _, _ = plan(counts, capacity)
    numbered = ranked(found, "length", id_col, "piece", name="_number")
    forget(found)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            number = batch.column("_number").to_numpy()
            first, each, length, sequence, offset = lines[np.searchsorted(lines[:, 0], number, side="right") - 1].T
            ahead = number - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence + ahead // each), pa.array(offset + ahead % each * length)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = numbered.select(id_col, "piece", "start", "length", "ids_crc32", "_number")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
