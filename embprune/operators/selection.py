"""Exact cuts of an order by radix selection: counts of 16 bits a pass, no sort, and no row moves.

An order is a list of words: columns of doubles or 64-bit integers whose bit patterns are read as unsigned numbers of the same
order. A pass counts the next 16 bits of the rows that share what is known of a cut so far; all cuts share the passes. Three or
four passes tell doubles apart; ties go on with the next word. A cut is then a comparison, which Spark evaluates where the
rows lie.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16
_DIGITS, _MASK = 64 // DIGIT, (1 << DIGIT) - 1


def ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers in the order of doubles (-0 as 0, NaN last) or of 64-bit integers."""
    if values.dtype.kind == "f":
        bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
        values = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
    return values.view(np.uint64) ^ np.uint64(1 << 63)


def value_of(number: int, kind: str) -> float | int:
    """The double ("double") or integer of such a number."""
    signed = number - (1 << 63)
    if kind != "double":
        return signed
    found = float(np.array(signed if signed >= 0 else signed ^ (2**63 - 1), np.int64).view(np.float64))
    # No row has -0.
    return -5e-324 if found == 0 and signed < 0 else found


@dataclass
class Cut:
    """The first `size` rows of the order, or with `down` of the order in which the first word descends."""

    size: int
    down: bool = False
    #: Numbers of the words, as far as they are known; rows that are still wanted of those that share them.
    known: list[int] = field(default_factory=list)
    bits: int = 0
    wanted: int = 0
    whole: bool = False
    #: Of rows that are equal in all words, those that are wanted; None where all are.
    copies: int | None = None

    def prefix(self) -> tuple:
        return (*self.known, self.bits)

    def close(self, n_words: int) -> None:
        """Fill what is not known so that all rows that share the rest are before the cut."""
        full = list(self.known)
        self.known = [n if i < len(full) - 1 else self._filled(n, i) for i, n in enumerate(full)]
        self.known += [(1 << 64) - 1] * (n_words - len(full))

    def _filled(self, number: int, word: int) -> int:
        rest = 64 - self.bits
        return number << rest if self.down and word == 0 else (number << rest) | ((1 << rest) - 1)


def _counted(rows: DataFrame, prefixes: list[tuple]) -> dict[tuple, dict[int, int]]:
    """Numbers of rows by the next digit, for each prefix (numbers of whole words, then the bits known of the next)."""

    def run(batches):
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            words = [ordered(column.to_numpy(zero_copy_only=False)) for column in batch.columns]
            for at, prefix in enumerate(prefixes):
                *whole, part, bits = prefix
                here = np.ones(batch.num_rows, bool)
                for word, number in zip(words, whole):
                    here &= word == np.uint64(number)
                word = words[len(whole)]
                if bits:
                    here &= word >> np.uint64(64 - bits) == np.uint64(part)
                digits = (word[here] >> np.uint64(64 - bits - DIGIT)).astype(np.int64) & _MASK
                if len(digits):
                    counts[at] = counts.get(at, 0) + np.bincount(digits, minlength=_MASK + 1)
        for at, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), at)), pa.array(seen), pa.array(n[seen])], ["at", "digit", "n"])

    found: dict[tuple, dict[int, int]] = {p: {} for p in prefixes}
    table = rows.mapInArrow(run, "at long, digit long, n long").groupBy("at", "digit").agg(F.sum("n").alias("n")).toArrow()
    for at, digit, n in zip(*(column.to_pylist() for column in table.columns)):
        found[prefixes[at]][digit] = n
    return found


def place(rows: DataFrame, words: list[str], cuts: list[Cut]) -> None:
    """Find every cut in `rows`, a table that is cheap to read again; rows with a null word take no part."""
    rows = rows.select(*words).where(" AND ".join(f"`{w}` IS NOT NULL" for w in words))
    n = rows.count()
    open_ = []
    for cut in cuts:
        cut.wanted, cut.whole = cut.size, cut.size >= n
        if 0 < cut.size < n:
            cut.known = [0]
            open_.append(cut)
    while open_:
        counts = _counted(rows, sorted({c.prefix() for c in open_}))
        still = []
        for cut in open_:
            down = cut.down and len(cut.known) == 1
            for digit, there in sorted(counts[cut.prefix()].items(), reverse=down):
                if there >= cut.wanted:
                    break
                cut.wanted -= there
            cut.known[-1], cut.bits = cut.known[-1] << DIGIT | digit, cut.bits + DIGIT
            if there == cut.wanted:
                cut.close(len(words))
            elif cut.bits == 64 and len(cut.known) == len(words):
                cut.copies = cut.wanted
            else:
                if cut.bits == 64:
                    cut.known, cut.bits = [*cut.known, 0], 0
                still.append(cut)
        open_ = still


def before(cut: Cut, words: list[str], kinds: list[str], last: bool = True) -> Column:
    """Whether a row lies before the cut; with `last`, or equals it in all words."""
    if cut.whole or cut.size <= 0:
        return F.lit(cut.whole)
    values = [F.lit(value_of(n, kind)) for n, kind in zip(cut.known, kinds)]
    columns = [F.col(w) for w in words]
    found = F.lit(last)
    for i in reversed(range(len(words))):
        less = columns[i] > values[i] if cut.down and i == 0 else columns[i] < values[i]
        found = less | ((columns[i] == values[i]) & found)
    return found


def select(rows: DataFrame, words: list[str], cuts: list[tuple[Cut, list[Column]]], keep: list[str]) -> DataFrame:
    """The rows of each cut with columns of its own beside `keep`, which is among the words: exactly `size`, or all there are."""
    place(rows, words, [c for c, _ in cuts])
    kinds = [rows.schema[w].dataType.simpleString() for w in words]
    rows = rows.where(" AND ".join(f"`{w}` IS NOT NULL" for w in words))

    # Of rows that equal a cut in all words only some may be wanted: these are made from the cut itself.
    made = F.array(*(F.when(before(cut, words, kinds, cut.copies is None), F.struct(*own)) for cut, own in cuts))
    found = rows.select(*keep, F.explode(F.array_compact(made)).alias("__cut")).select("__cut.*", *keep)
    extra = [rows.limit(1).select(F.explode(F.array_repeat(F.struct(*own, *(F.lit(value_of(cut.known[words.index(k)], kinds[words.index(k)])).alias(k) for k in keep)), cut.copies)).alias("__cut")).select("__cut.*") for cut, own in cuts if cut.copies]
    return reduce(DataFrame.unionByName, extra, found)
