"""Column helpers for the null, text and rounding rules that differ from plain Spark.

Missing values are NULL everywhere; NaN is folded to NULL at ingest with `fold_nan`.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The season cut, and the least printed p value.
FIRST_FALL_MONTH = 8
LEAST_P, LEAST_P_LABEL = 0.001, "< .001"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- membership and comparison -------------------------------------------------------------

def is_in(c, values) -> Column:
    """Membership; a missing value is not a member."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def not_in(c, values) -> Column:
    """Non-membership; a missing value is outside the list, so its row is kept."""
    return ~is_in(c, values)


# --- text ------------------------------------------------------------------------------------

def unite(sep: str, *cols) -> Column:
    """Join columns to one key; a missing part is written as NA."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("NA")) for c in cols])


def separate(c, index: int) -> Column:
    """Piece `index` (1-based) of a key split at runs of non-alphanumeric characters, or NULL."""
    return F.try_element_at(F.split(col(c), "[^A-Za-z0-9]+"), F.lit(index))


def replace_first(c, pattern: str, replacement: str) -> Column:
    """Replace only the first match of `pattern`, which must have no groups of its own."""
    return F.regexp_replace(col(c), f"(?s)^(.*?)(?:{pattern})", "$1" + replacement)


def replace_all(c, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(col(c), pattern, replacement)


def canonical_pair(a, b, sep: str = "_") -> Column:
    """The same label for (a, b) and (b, a)."""
    return F.array_join(F.array_sort(F.array(col(a), col(b))), sep)


# --- numbers ---------------------------------------------------------------------------------

def to_number(c) -> Column:
    """Number from text that may hold other marks; those and NaN become NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def fold_nan(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


def round_even(c, digits: int) -> Column:
    return F.bround(col(c), digits)


def season(month) -> Column:
    """Months before August are spring, later ones fall; a missing month has no season."""
    m = col(month)
    return F.when(m < FIRST_FALL_MONTH, "spring").when(m >= FIRST_FALL_MONTH, "fall")


def even_grid(lo, hi, n: int) -> Column:
    """`n` evenly spaced points from lo to hi, both included."""
    if n < 2:
        return F.array(col(lo))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: col(lo) + i * (col(hi) - col(lo)) / F.lit(float(n - 1)))


def excludes_zero(lo, hi) -> Column:
    """True if both ends of an interval have the same sign."""
    return F.signum(col(lo)) == F.signum(col(hi))


def p_label(p, digits: int = 3) -> Column:
    """Printed p value: '< .001' below one thousandth."""
    return F.when(col(p) < LEAST_P, F.lit(LEAST_P_LABEL)).when(col(p).isNotNull(), F.bround(col(p), digits).cast("string"))


def log_gamma(x) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series after shifting the argument by eight."""
    x = col(x).cast("double")
    z = x + 8
    shift = F.log(reduce(lambda a, i: a * (x + i), range(1, 8), x))
    series = 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7)
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_choose(n, k) -> Column:
    n, k = col(n), col(k)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


# --- aggregates ------------------------------------------------------------------------------

def _strict(aggregate: Column, c) -> Column:
    return F.when(F.count(F.lit(1)) == F.count(col(c)), aggregate)


def strict_avg(c) -> Column:
    """Mean that is missing if any input is missing."""
    return _strict(F.avg(col(c)), c)


def strict_sum(c) -> Column:
    return _strict(F.sum(col(c)), c)


def strict_min(c) -> Column:
    return _strict(F.min(col(c)), c)


def strict_max(c) -> Column:
    return _strict(F.max(col(c)), c)


def strict_sd(c) -> Column:
    return _strict(F.stddev_samp(col(c)), c)


def n_distinct(*cols) -> Column:
    """Distinct count in which missing is a value of its own."""
    return F.count_distinct(F.struct(*[col(c) for c in cols]))


def first_argmax(position, value) -> Column:
    """Smallest position among the rows with the largest value."""
    return F.max_by(col(position), F.when(col(value).isNotNull(), F.struct(col(value), -col(position))))
