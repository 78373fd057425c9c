"""Runs of periodically repeated words, by probing a harmonic grid.

A run is a stretch of consecutive words in which words p apart are identical,
p being its smallest period, that no neighbouring word extends, and that holds
at least `min_words` words and `repeats` periods. The places i of a run at which
words i and i + p agree make up at least repeats - 1 periods, so they hold that
many multiples of p in a row, wherever the run begins. For each period p only
the words at jp and (j+1)p are compared, which is n/p comparisons for p and
n log n for all periods together; what survives is extended by comparing chunks
of the arrays, and grid points inside a run that is found already, of the same
period or of one that divides it, are skipped. A stretch with two periods has
their divisor for a period too if it is as long as both, so periods in
ascending order give each run once, with its smallest period.

Words are compared exactly: each text numbers its distinct words.

Scale: a map over rows, no shuffle. A worker holds one text at a time, its
distinct words and four bytes for each word of it; very long texts are split
into words in segments. Short periods are probed one by one along the grid,
long ones together for each j, so a text of n words takes about 2 sqrt(n) array
operations.

Defined cases: null and empty texts have no words and no runs, and an empty
collapsed text. Repeated rows and rows without an id are judged each. An empty
table gives an empty result. Other columns pass through; those named as results
are replaced.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEGMENT, WORD_PATTERN, fresh, prepare, texts

RUNS = "array<struct<start:long,length:long,period:long>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def numbered_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word among the distinct words, and those."""
    table: dict[bytes, int] = defaultdict(count().__next__)
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        words = data[at:end].split()  # at the white space of ASCII
        parts.append(np.fromiter(map(table.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32), [*table]


class _Search:
    def __init__(self, words: np.ndarray, min_words: int, repeats: int):
        self.words, self.n = words, len(words)
        self.min_words, self.repeats = min_words, repeats
        self.found: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends by period

    def least(self, p: int) -> int:
        return max(self.min_words, self.repeats * p)

    def row(self, p: int) -> int:
        """The grid points in a row that a run is sure of."""
        return (self.least(p) - p) // p

    def extended(self, i: int, p: int) -> tuple[int, int]:
        """The places around i, from a and before b, where words p apart agree."""
        w, top = self.words, self.n - p
        b, step = i, 64
        while b < top:
            c = min(step, top - b)
            differ = w[b : b + c] != w[b + p : b + p + c]
            k = int(differ.argmax())
            if differ[k]:
                b += k
                break
            b, step = b + c, min(4 * step, 1 << 16)
        a, step = i, 64
        while a:
            c = min(step, a)
            differ = (w[a - c : a] != w[a - c + p : a + p])[::-1]
            k = int(differ.argmax())
            if differ[k]:
                a -= k
                break
            a, step = a - c, min(4 * step, 1 << 16)
        return a, b

    def outside(self, periods: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Grid points (words at and at + period) outside found runs whose
        period divides theirs. Of runs of one period, the last that starts at
        or before a point holds it if any does."""
        keep = np.ones(len(at), bool)
        for q, (starts, ends) in self.found.items():
            some = np.flatnonzero(keep & (periods % q == 0) & (periods > q))
            if len(some):
                k = np.searchsorted(starts, at[some], "right") - 1
                keep[some] = (k < 0) | (at[some] + periods[some] >= np.asarray(ends)[k])
        return keep

    def survivors(self, p: int, grid: np.ndarray) -> None:
        """Extend the grid points (multiples of p, ascending) of one period. If
        the next one survived too, a run agrees at every place between them."""
        w, k = self.words, 0
        if len(grid) > 4 and self.row(p) > 1:
            for between in {1, p // 2, p - 1}:
                grid = grid[w[grid + between] == w[grid + between + p]]
        while k < len(grid):
            a, b = self.extended(int(grid[k]), p)
            if b + p - a >= self.least(p) and not self.inside(a, b + p, p):
                starts, ends = self.found.setdefault(p, ([], []))
                starts.append(a)
                ends.append(b + p)
            k = int(np.searchsorted(grid, b))

    def inside(self, start: int, end: int, p: int) -> bool:
        for q, (starts, ends) in self.found.items():
            if q < p and p % q == 0:
                k = bisect_right(starts, start) - 1
                if k >= 0 and ends[k] >= end:
                    return True
        return False

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start and then period."""
        w, n = self.words, self.n
        longest = n // self.repeats if n >= self.min_words else 0
        # from `split` on, a run is sure of repeats - 1 grid points in a row
        split = min(longest, max(isqrt(n), -(-self.min_words // self.repeats)))
        for p in range(1, split + 1):
            grid = w[::p]
            equal = grid[1:] == grid[:-1]
            row = self.row(p)
            if row > 1:
                sums = np.concatenate(([0], np.cumsum(equal)))
                equal = sums[row:] - sums[:-row] == row
            at = np.flatnonzero(equal) * p
            if len(at):
                self.survivors(p, at[self.outside(np.full(len(at), p), at)] if self.found else at)
        periods, places = [], []
        rows: list[np.ndarray] = []  # equality at the last j, j + 1, ... for all long periods
        j = 0
        while (top := min(longest, (n - 1) // (j + 1))) > split:
            p = np.arange(split + 1, top + 1)
            rows = [*rows, w[j * p] == w[(j + 1) * p]][1 - self.repeats :]
            if len(rows) == self.repeats - 1:
                equal = rows[0][: len(p)]
                for r in rows[1:]:
                    equal = equal & r[: len(p)]
                some = p[equal]
                if len(some):
                    at = (j - len(rows) + 1) * some
                    keep = self.outside(some, at)
                    periods.append(some[keep])
                    places.append(at[keep])
            j += 1
        if periods:
            p, at = np.concatenate(periods), np.concatenate(places)
            order = np.lexsort((at, p))
            p, at = p[order], at[order]
            first = np.flatnonzero(np.diff(p, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(p)]):
                self.survivors(int(p[a]), at[a:b])
        return sorted((s, e - s, p) for p, (starts, ends) in self.found.items() for s, e in zip(starts, ends))


def find_runs(words: np.ndarray, min_words: int = 24, repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in an array of word numbers."""
    if repeats < 2:
        raise ValueError("a run holds at least two periods")
    return _Search(words, min_words, repeats).runs()


def collapsed(words: np.ndarray, names: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = words[keep]
    of = names.__getitem__
    return b" ".join([b" ".join(map(of, words[k : k + (1 << 16)].tolist())) for k in range(0, len(words), 1 << 16)])


def collapse_runs(docs: DataFrame, text_col: str = "text", min_words: int = 24, repeats: int = 3) -> DataFrame:
    """docs with n_words, runs (an array of start, length and period, by start
    and period, in words from 0) and collapsed: the words of the text joined by
    one space, without those that a run repeats."""
    results = {"n_words": "long", "runs": RUNS, "collapsed": "string"}
    names = [c for c in docs.columns if c not in results]
    body = fresh(names, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, kept = [], [], []
            for data in texts(batch.column(0)):
                words, distinct = numbered_words(data)
                runs = find_runs(words, min_words, repeats)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": p} for s, m, p in runs])
                kept.append(collapsed(words, distinct, runs))
            made = [pa.array(n, pa.int64()), pa.array(found, _RUNS), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch([*batch.columns[1:], *made], [*names, *results])

    prepare(docs.sparkSession)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema]
    kinds += [f"`{k}` {v}" for k, v in results.items()]
    return docs.select(F.col(text_col).cast("string").alias(body), *names).mapInArrow(run, ", ".join(kinds))


def strongest(runs: Column) -> Column:
    """The run of the greatest length / period, compared exactly; of equals the
    first by start and period; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))


def runs_text(runs: Column) -> Column:
    """A line `start,length,period` for each run."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return F.concat_ws("", F.transform(runs, line))


def planted(docs: DataFrame, seed: Column, text_col: str = "text") -> DataFrame:
    """docs in which every tenth seed's text repeats from a word on: with n
    words and g = seed div 10, each word i >= a = g % n becomes word a + (i - a)
    % p, p = 1 + (n - a) div (3 + g % 8). For measuring what is found; all in
    the JVM, and only the chosen texts are split."""
    words, g = (fresh(docs.columns, x) for x in ("words", "g"))
    chosen = F.when(seed % 10 == 0, F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(WORD_PATTERN), F.lit(0)))
    rows = docs.withColumns({words: chosen, g: F.floor(seed / 10).cast("long")})
    n, a, p = (fresh([*docs.columns, words, g], x) for x in ("n", "a", "p"))
    rows = rows.withColumn(n, F.size(words)).withColumn(a, F.when(F.col(n) > 0, F.col(g) % F.col(n)).cast("int"))
    rows = rows.withColumn(p, (F.lit(1) + F.floor((F.col(n) - F.col(a)) / (F.lit(3) + F.col(g) % 8))).cast("int"))
    other = F.transform(words, lambda w, i: F.when(i < F.col(a), w).otherwise(F.get(F.col(words), (F.col(a) + (i - F.col(a)) % F.col(p)).cast("int"))))
    return rows.withColumn(text_col, F.when(F.col(n) > 0, F.array_join(other, " ")).otherwise(F.col(text_col))).select(*docs.columns)
