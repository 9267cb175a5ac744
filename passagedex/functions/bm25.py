"""Okapi BM25 with an epsilon floor for negative inverse document frequency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameters:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


# Scores are summed as integers in units of 2^-40, so a score does not depend
# on the order in which Spark adds its parts and equal passages tie exactly.
SCORE_UNIT = float(2**40)


def raw_idf(df: Column, n_docs: int) -> Column:
    return F.ln(F.lit(float(n_docs)) - df + 0.5) - F.ln(df + 0.5)


def floored_idf(df: Column, n_docs: int, mean_idf: float, epsilon: float) -> Column:
    raw = raw_idf(df, n_docs)
    return F.when(raw >= 0, raw).otherwise(F.lit(float(epsilon * mean_idf)))


def saturated_tf(tf: Column, doc_len: Column, avgdl: float, p: Parameters) -> Column:
    norm = F.lit(p.k1 * (1 - p.b)) + F.lit(p.k1 * p.b) * doc_len / F.lit(float(avgdl))
    return tf * F.lit(p.k1 + 1) / (tf + norm)


def to_units(score: Column) -> Column:
    return F.rint(score * F.lit(SCORE_UNIT)).cast("bigint")


def from_units(units: Column) -> Column:
    return units / F.lit(SCORE_UNIT)


def rounded_units(units: Column) -> Column:
    """The score to 4 decimals as `round` gives it, by whole numbers: a third of the time.

    `round` takes the shortest decimal of a number. Where that could be a tie that the
    number itself is not, and beyond the whole numbers of a double, it is asked.
    """
    size = F.abs(units)
    part = size.bitwiseAND(F.lit((1 << 40) - 1)) * 10_000
    half = 1 << 39
    whole = F.shiftright(size, 40) * 10_000 + F.shiftright(part + half, 40)
    off = F.abs(part.bitwiseAND(F.lit((1 << 40) - 1)) - half)
    plain = (size < F.lit(1 << 53)) & ((off >= 10_000) | (off == 0))
    signed = F.when(units < 0, -whole).otherwise(whole)
    return F.when(plain, signed / F.lit(10_000.0)).otherwise(F.round(from_units(units), 4))
