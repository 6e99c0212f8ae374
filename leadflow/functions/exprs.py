"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

import string
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow.functions.domains import DATE_FORMATS, WEEKLY_MAX_DAYS


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- dates

def _shape_of(fmt: str) -> str:
    """``yyyy-MM-dd`` -> ``dddd-dd-dd``: where the digits and separators go."""
    return "".join("d" if ch.isalpha() else ch for ch in fmt)


def _has_shape(s: Column, shape: str) -> Column:
    """Whether the separators and the length of ``s`` are those of ``shape``."""
    places = [F.substring(s, i, 1) == ch for i, ch in enumerate(shape, 1) if ch != "d"]
    return reduce(and_, [*places, F.length(s) == len(shape)])


def parse_mixed_date(c, formats=DATE_FORMATS) -> Column:
    """First format that parses wins, so ``dd/MM`` beats ``MM/dd``.

    Only formats with the separators and the length of the trimmed text are
    tried, in their listed order. Text of another shape cannot parse with a
    fixed-width pattern anyway, so results are those of trying every format in
    turn, without paying a failed parse per format. The pattern itself tells
    whether all other characters are digits: spelling out the text's digit
    shape for that cost more than the parse.
    ``try_to_date`` returns null instead of raising under ANSI mode.
    """
    s = F.trim(col(c).cast("string"))
    groups: dict[str, list[str]] = {}
    for f in formats:
        groups.setdefault(_shape_of(f), []).append(f)
    out = None
    for shape, fmts in groups.items():
        parsed = F.coalesce(*[F.try_to_date(s, f) for f in fmts]) if len(fmts) > 1 \
            else F.try_to_date(s, fmts[0])
        out = F.when(_has_shape(s, shape), parsed) if out is None else out.when(_has_shape(s, shape), parsed)
    return out


def week_start(c) -> Column:
    """Monday of the ISO week (DATE)."""
    return F.trunc(col(c), "week")


def granularity(duration_days) -> Column:
    return F.when(col(duration_days) <= WEEKLY_MAX_DAYS, F.lit("weekly")).otherwise(F.lit("monthly"))


def period_start_for(date_col, gran_col) -> Column:
    return F.when(col(gran_col) == "weekly", F.trunc(col(date_col), "week")) \
            .otherwise(F.trunc(col(date_col), "month"))


def period_end_for(bucket_col, gran_col) -> Column:
    return F.when(col(gran_col) == "weekly", F.date_add(col(bucket_col), 6)) \
            .otherwise(F.last_day(col(bucket_col)))


# ---------------------------------------------------------------- metrics

def is_yes(flag_col="take_up_flag") -> Column:
    return F.coalesce(F.upper(F.trim(col(flag_col))) == "YES", F.lit(False))


def rate_pct(num, den) -> Column:
    """num / den * 100 as DOUBLE; 0.0 when den is 0 or null (no ANSI error)."""
    return F.when(col(den) > 0, col(num).cast("double") / col(den).cast("double") * 100.0) \
            .otherwise(F.lit(0.0))


def money(c) -> Column:
    """Monetary value as exact cents (DECIMAL(18,2)): sums and averages of
    money are then independent of summation order."""
    return col(c).cast("decimal(18,2)")


def rnd(c, scale: int) -> Column:
    """Half-up rounding of a double, as SQL ``round`` does."""
    return F.round(col(c).cast("double"), scale)


# ---------------------------------------------------------------- text

SLUG_CHARACTERS = string.ascii_letters + string.digits + "_-"


def campaign_slug(name_col, date_col) -> Column:
    """``<name>_<yyyy-MM-dd>``, whitespace runs to ``_``, then every character
    that is not an ASCII word character or ``-`` removed. Null in, null out.

    A date holds no whitespace and no such character but the ``+`` of a
    five-digit year. In names they are rare, and looking for them with a negated
    character class costs several times all else, so names without any skip it.
    """
    name = F.regexp_replace(col(name_col), r"\s+", "_")
    odd = F.translate(name, SLUG_CHARACTERS, "")
    day = F.replace(F.date_format(col(date_col), "yyyy-MM-dd"), F.lit("+"), F.lit(""))
    return F.concat(F.when(odd == "", name).otherwise(F.regexp_replace(name, r"[^A-Za-z0-9_\-]", "")), F.lit("_"), day)


def blank_to_null(c) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)
