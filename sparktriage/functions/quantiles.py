"""Exact medians of many columns at any number of rows: a radix select on the bits of doubles, distributed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AT_ONCE = 200_000
DIGITS = (11, 11, 11, 11, 11, 9)  # bits looked at in each pass
_TOP = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 counts as 0, NaN comes last."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.uint64)
    return np.where(bits >= _TOP, ~bits, bits | _TOP)


def double_of(bits: int) -> float:
    raw = np.uint64(bits ^ (1 << 63) if bits >> 63 else ~bits & ((1 << 64) - 1))
    return float(np.array([raw]).view(np.float64)[0])


def _digit_counts(targets: list[tuple[int, int]], shift: int, width: int):
    """How often each next digit follows the prefix of each target (column, prefix): a table of a fixed size a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(targets), 1 << width), np.int64)
        for b in batches:
            bits = [ordered_bits(c.drop_null().to_numpy(zero_copy_only=False)) for c in b.columns]
            for t, (c, prefix) in enumerate(targets):
                x = bits[c] if shift + width == 64 else bits[c][bits[c] >> np.uint64(shift + width) == np.uint64(prefix)]
                n[t] += np.bincount((x >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64), minlength=1 << width)
        t, digit = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(digit.astype(np.int32)), pa.array(n[t, digit])], ["t", "digit", "n"])

    return run


def _selected(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    """The middle values, digit by digit: each pass adds tables of 2^11 counts up and keeps the digit that holds the wanted rank."""
    ranks: dict[str, list[list[int]]] = {}  # by column: (rank among the values with the prefix, prefix), of the two middle ones
    shift = 64
    for width in DIGITS:
        shift -= width
        targets = sorted({(c, p) for c, k in enumerate(names) for _, p in ranks.get(k, [[0, 0]])})
        counts = df.mapInArrow(_digit_counts(targets, shift, width), "t int, digit int, n long").groupBy("t", "digit").agg(F.sum("n").alias("n"))
        table = np.zeros((len(targets), 1 << width), np.int64)
        for r in counts.collect():  # two targets a column and 2^11 digits at most
            table[r.t, r.digit] = r.n
        if not ranks:
            total = {k: int(table[targets.index((c, 0))].sum()) for c, k in enumerate(names)}
            ranks = {k: [[(n - 1) // 2, 0], [n // 2, 0]] for k, n in total.items() if n}
            names_ = {k: c for c, k in enumerate(names)}
        for k, both in ranks.items():
            for own in both:
                upto = table[targets.index((names_[k], own[1]))].cumsum()
                digit = int(np.searchsorted(upto, own[0], side="right"))
                own[0] -= int(upto[digit - 1]) if digit else 0
                own[1] = own[1] << width | digit
        targets = []
        names = [k for k in names if k in ranks] if len(ranks) < len(names) else names
        df = df.select(*names)
        names_ = {k: c for c, k in enumerate(names)}
        if not names:
            break
    return {k: 0.5 * double_of(a[1]) + 0.5 * double_of(b[1]) for k, (a, b) in ranks.items()}


def exact_medians(df: DataFrame, columns: Sequence[str] | dict[str, Column], at_once: int = AT_ONCE) -> dict[str, float | None]:
    """Median (mean of the two middle values if even; nulls left out) of each column; None for a column without values.

    Up to at_once rows, one aggregate holds the distinct values. Beyond, six passes over the columns count the digits of their sortable
    bits; a task holds two tables of 2^11 counts a column, however many rows there are. It runs jobs at once.
    """
    of = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    x = {k: c.cast("double").alias(k) for k, c in of.items()}
    if df.count() <= at_once:
        return df.agg(*[F.median(c).alias(k) for k, c in x.items()]).first().asDict()
    return dict.fromkeys(x) | _selected(df.select(*x.values()), list(x))
