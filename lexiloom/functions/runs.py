"""Letter runs of many texts at once, as numpy arrays, and a bit table of strings that may be asked for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters whose class and lower case all versions of Unicode agree on; without İ and Σ, whose lower case has two
#: characters or depends on what follows. Of the common ones first.
RANGES = (
    (0, 0x12F), (0x131, 0x377), (0x2000, 0x206F), (0x384, 0x38A), (0x38E, 0x3A1), (0x3A4, 0x52F), (0x1100, 0x11FF), (0x1E00, 0x1EFF), (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2190, 0x2BFF), (0x3000, 0x303F),
    (0x3041, 0x3096), (0x30A0, 0x30FF), (0x3131, 0x318E), (0x4E00, 0x9FFC), (0xAC00, 0xD7A3), (0xFF01, 0xFF9D), (0x1F300, 0x1FAFF),
)
_texts_of = lambda ranges: "^[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + r"]*\z"
#: Texts of these characters only: ``Runs`` cuts and lower-cases them as Spark does, and takes no others.
PLAIN = _texts_of(RANGES)
_COMMON = _texts_of(RANGES[:3])
BITS = 26
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point whether it is a letter, its lower case if that is one character, and whether it is in ``RANGES``."""
    chars = [chr(i) for i in range(0x30000)]
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    letter[: len(chars)] = [c.isalpha() for c in chars]
    lower[: len(chars)] = [ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)]
    plain = np.zeros(0x110000, bool)
    for a, b in RANGES:
        plain[a : b + 1] = True
    return letter, lower, plain


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo 2 ** 64, at least ``n``; kept for the next texts."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        _POWERS[base] = np.multiply.accumulate(factors)
    return _POWERS[base][:n]


def unlike(text: str) -> Column:
    """Whether ``Runs`` leaves this text to Spark. The common characters are asked for first, which is a third of the work."""
    return ~F.col(text).rlike(_COMMON) & ~F.col(text).rlike(PLAIN)


class Runs:
    """The letter runs of ``texts`` in order, their letters one after the other without what stands between; none of texts that are not ``PLAIN``.

    ``text``, ``place``: whose run it is, and its number there from 0; ``n``: its letters; ``pair``: one space, no more,
    leads to the next run of the text; ``letters``: code points as written; ``at``: where in them runs begin, and their end.
    """

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        if not _tables()[2][points].all():
            texts = [t if _tables()[2][np.frombuffer(t.encode("utf-32-le"), np.uint32)].all() else "" for t in texts]
            points = np.frombuffer("\n".join(texts).encode("utf-32-le"), np.uint32)
        is_letter = _tables()[0][points]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], is_letter, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self._first, self._starts = first, starts
        self.n = last - first
        self.letters = points[is_letter]
        self.at = np.concatenate([[0], np.cumsum(self.n)])
        self.pair = np.zeros(len(first), bool)
        if len(first) > 1:
            self.pair[:-1] = (first[1:] - last[:-1] == 1) & (points[last[:-1]] == 32)

    @cached_property
    def text(self) -> np.ndarray:
        return np.searchsorted(self._starts, self._first, "right") - 1

    @cached_property
    def place(self) -> np.ndarray:
        return np.arange(len(self._first)) - np.searchsorted(self._first, self._starts)[self.text]

    def lowered(self) -> tuple[pa.Buffer, np.ndarray]:
        """The lower-cased letters in UTF-8, and where runs begin in it."""
        low = self.lowered_letters()
        width = 1 + (low > 0x7F) + (low > 0x7FF) + (low > 0xFFFF)
        return pa.py_buffer(low.tobytes().decode("utf-32-le").encode()), np.concatenate([[0], np.cumsum(width)])[self.at]

    def lowered_letters(self) -> np.ndarray:
        """The code points of ``lowered``."""
        return _tables()[1][self.letters]

    def as_written(self, runs: np.ndarray) -> list[str]:
        """Single runs, by number."""
        every = self.letters.tobytes().decode("utf-32-le")
        return [every[a:b] for a, b in zip(self.at[runs].tolist(), self.at[runs + 1].tolist(), strict=True)]


def strings(data: pa.Buffer, at: np.ndarray) -> pa.LargeStringArray:
    """The strings that stand one after the other in ``data``."""
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int64)), data)


class Spots:
    """The place in the bit table of any piece of ``data``: a sum of its bytes times powers, so a difference of two sums."""

    def __init__(self, data: pa.Buffer) -> None:
        raw = np.frombuffer(data, np.uint8).astype(np.uint64)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.add.accumulate((raw + np.uint64(1)) * _powers(_BASE, len(raw)), out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), len(raw) + 1)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        h = (self.sums[last] - self.sums[first]) * self.back[first]
        h ^= h >> np.uint64(32)
        return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def holds(table: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether the bits at ``spots`` are set: so for all strings of the table, and for few others."""
    return (table[spots >> np.uint64(6)] >> (spots & np.uint64(63))) & np.uint64(1) == 1


def blocks_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of the bit table with bits of ``values`` (not null), and these."""
    values = values.cast(pa.large_string())
    at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if not len(values) or at[-1] == at[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spots = np.unique(Spots(values.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))).of(at[:-1] - at[0], at[1:] - at[0]))
    blocks, begins = np.unique(spots >> np.uint64(6), return_index=True)
    return blocks.astype(np.int64), np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), begins).view(np.int64)


def chunks(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[list[str]]:
    """``texts`` in lists of about ``most`` characters, a null as an empty text."""
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def pieces(texts: list[str], heads: np.ndarray, table: np.ndarray, low: int, high: int) -> tuple[np.ndarray, pa.StringArray]:
    """By number of a text and once each, its pieces of ``low`` to ``high`` characters that ``table`` holds, and ``heads`` their first ``low``."""
    every = "".join(texts)
    data = every.encode()
    ends = np.cumsum([len(t) for t in texts])
    whose = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80), len(data))
    spots = Spots(pa.py_buffer(data))
    first = np.flatnonzero(np.arange(len(every)) + low <= ends[whose]) if len(every) else np.zeros(0, np.int64)
    first = first[holds(heads, spots.of(at[first], at[first + low]))]
    found, of = [], [np.zeros(0, np.int64)]
    for n in range(low, high + 1):
        first = first[first + n <= ends[whose[first]]]
        hit = first[holds(table, spots.of(at[first], at[first + n]))]
        found += [every[i : i + n] for i in hit.tolist()]
        of.append(whose[hit])
    coded = pa.array(found, pa.string()).dictionary_encode()
    many = max(1, len(coded.dictionary))
    pairs = np.unique(np.concatenate(of) * many + coded.indices.to_numpy())
    return pairs // many, coded.dictionary.take(pa.array(pairs % many))
