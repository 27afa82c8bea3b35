"""Scalar functions on bases, categories and numbers, as columns and as plain functions."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..schemas import CATEGORY_BIT, TYPE_CODE


def normal_base(col):
    """Bases in upper case, all but A, C, G, T as N."""
    return F.regexp_replace(F.upper(col), "[^ACGT]", "N")


def base_code(col):
    """A, C, G, T as 0 to 3, anything else as 4: one character a base, in the order of comparisons."""
    return F.translate(F.regexp_replace(F.upper(col), "[^ACGT]", "N"), "ACGTN", "01234")


def base_codes(seq: str) -> list[int]:
    return ["ACGT".find(c) if c in "ACGT" else 4 for c in seq.upper()]


def type_code(col):
    return F.coalesce(*[F.when(col == t, F.lit(c)) for t, c in TYPE_CODE.items()])


def category_bit(col):
    """Bit of a category, 0 for names that have none."""
    return F.coalesce(*[F.when(col == c, F.lit(b)) for c, b in CATEGORY_BIT.items()], F.lit(0))


def has_category(col, mask: int):
    return category_bit(col).bitwiseAND(mask) != 0


def sort_pos(type_col="type", pos_col="pos"):
    """Position a site sorts by: that of its anchor base for indels."""
    return F.when(F.col(type_col) == "SNP", F.col(pos_col)).otherwise(F.col(pos_col) - 1)


def is_acgt(col):
    """Upper-case A, C, G, T only: lower case counts as ambiguous."""
    return col.rlike("^[ACGT]*$")


def six_digits(x: float | None) -> str:
    """A double with up to six significant digits, as C++ streams print it."""
    if x is None:
        return "."
    return f"{x:.6g}" if not math.isnan(x) else "nan"


def six_digits_column(col):
    """six_digits of fractions in [0, 1], with SQL functions: rounds to six significant digits, trailing zeros cut."""
    digits = F.when(col <= 0, F.lit(0)).otherwise(F.lit(5) - F.floor(F.log10(col)).cast("int"))
    scale = F.pow(F.lit(10.0), digits)
    text = F.format_number(F.bround(col * scale) / scale, 11)
    return F.when(col == 0, F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(text, ",", ""), r"\.?0+$", ""))


def allele_fraction(alt_col="alt_cov", total_col="total_cov"):
    """Share of the alternate allele as a double, 0 without depth."""
    return F.when(F.col(total_col) == 0, F.lit(0.0)).otherwise(F.col(alt_col).cast("double") / F.col(total_col).cast("double"))


def overlap_predicate(a_beg, a_fin, b_beg, b_fin):
    return (a_beg <= b_fin) & (a_fin >= b_beg)


def intersection_size(a, b):
    """Size of the intersection of two arrays of distinct values."""
    return F.size(F.array_intersect(a, b))


def mean_quality(op: dict, qual: bytes) -> int:
    """Mean base quality of an event, rounded down: a deletion has the two bases around it. 0 where it can't be told."""
    qi = op["qi"]
    if op["low_quality"] or qi < 0 or not qual:
        return 0
    if op["type"] == "DEL":
        first, last = (qi - 1, qi) if qi else (0, 0)
    else:
        first, last = qi, qi + op["len"] - 1
    if last >= len(qual) or last < first:
        return 0
    return sum(qual[first : last + 1]) // (last - first + 1)


def error_rate(qual: bytes) -> float:
    """Mean error probability of Phred qualities."""
    return sum(10 ** (-q / 10) for q in qual) / len(qual) if qual else 0.0
