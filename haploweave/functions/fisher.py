"""Two-tailed Fisher exact test for strand bias."""
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def fisher_two_tailed(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all tables with the same margins that are no likelier than this one.

    Counted in whole numbers, so that equally likely tables are equal whatever the rounding."""
    row, rest, column = a + b, c + d, a + c
    if row + rest <= 0:
        return 1.0
    ways = [comb(row, x) * comb(rest, column - x) for x in range(max(0, column - rest), min(row, column) + 1)]
    here = comb(row, a) * comb(rest, c)
    return sum(w for w in ways if w <= here) / sum(ways)


@lru_cache(maxsize=65_536)
def strand_pvalue(forward: int, reverse: int) -> float:
    """Alternate reads by strand against an even split; 1 where there is nothing to split."""
    half = (forward + reverse) // 2
    return fisher_two_tailed(forward, reverse, half, half) if half > 0 else 1.0


def strand_pvalue_column(forward, reverse):
    """strand_pvalue over columns, in Arrow batches: SQL has no log-gamma function. A pair of counts is worked out once a batch."""

    @F.pandas_udf("double")
    def pvalues(f: pd.Series, r: pd.Series) -> pd.Series:
        pairs, place = np.unique(np.stack([f, r], axis=1), axis=0, return_inverse=True)
        return pd.Series(np.array([strand_pvalue(int(x), int(y)) for x, y in pairs], float)[place.ravel()])

    return pvalues(forward, reverse)
