"""Pure Column builders used by every cleaning step.

All of these are native Spark expressions, so they stay inside whole-stage
codegen; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog import FLOOD_SEASON, NO_POPULATION_BAND, NON_FLOOD_SEASON, NULL_TOKENS

# Unicode white space as Python's str.isspace() defines it (includes the
# ideographic space U+3000, which Java's \s does not match). Derived by rule
# and used with btrim/translate, which are much cheaper than regexes.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
# Fixed value: the number pattern of quantities.
_NUMBER = r"-?\d+(?:\.\d+)?"
_FULLWIDTH_DIGITS = "０１２３４５６７８９"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sql_text(s: str) -> str:
    """A SQL string literal (raw characters; none needs escaping here)."""
    if "'" in s or "\\" in s:
        raise ValueError(f"cannot embed {s!r}")
    return f"'{s}'"


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


# Column-name inputs are built as one SQL expression: the JVM parses it in
# one call instead of one py4j round trip per literal and operator (wide
# cleaning projections otherwise spend seconds on the driver per plan).
def trim_ws(c: Column | str) -> Column:
    """Strip leading/trailing Unicode white space (``str.strip`` semantics)."""
    if isinstance(c, str):
        return F.expr(f"btrim({_sql_name(c)}, {_sql_text(WHITESPACE)})")
    return F.btrim(c, F.lit(WHITESPACE))


def is_missing(c: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """True for null or a missing-value token after trim + lower-case."""
    if isinstance(c, str):
        n = _sql_name(c)
        return F.expr(f"({n} IS NULL OR lower(btrim({n}, {_sql_text(WHITESPACE)})) IN "
                      f"({', '.join(_sql_text(t) for t in tokens)}))")
    return c.isNull() | F.lower(trim_ws(c)).isin(list(tokens))


def null_if_missing(c: Column | str) -> Column:
    return F.when(is_missing(c), F.lit(None).cast("string")).otherwise(col_(c))


def strip_all_ws(c: Column | str) -> Column:
    """Delete every white-space character (translate with no replacement)."""
    return F.translate(col_(c), WHITESPACE, "")


# Printable ASCII without white space that is no missing token: most cells, told by one regex.
_PLAIN_TEXT = r"\A(?!(?i:%s)\z)[!-~]+\z" % "|".join(re.escape(t) for t in NULL_TOKENS if t.isascii())


def normalize_text(c: Column | str) -> Column:
    """Missing → null, otherwise every white-space character removed."""
    text = col_(c)
    return F.when(text.rlike(_PLAIN_TEXT), text).when(is_missing(c), F.lit(None).cast("string")).otherwise(strip_all_ws(c))


def changed(before: Column | str, after: Column | str) -> Column:
    """Cell changed, null-safe (null → null is no change)."""
    return ~col_(before).eqNullSafe(col_(after))


# ---------------------------------------------------------------- dates ----

# Dates with a time of day that are read beside the configured formats.
DATE_TIMES = tuple(f"{d}{gap}{t}" for d in ("%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y年%m月%d日") for gap in (" ", "T") for t in ("%H:%M:%S", "%H:%M")
                   if gap == " " or d == "%Y-%m-%d")

_PY_TO_JAVA = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}


def java_pattern(py_format: str) -> str:
    """Translate a strptime format into a Spark datetime pattern.

    Single-letter month/day fields accept both padded and unpadded input,
    which is what strptime does.
    """
    out, i = [], 0
    while i < len(py_format):
        two = py_format[i:i + 2]
        if two in _PY_TO_JAVA:
            java = _PY_TO_JAVA[two]
            # Digits run together (``%Y%m%d``): fields need a fixed width.
            before = py_format[i - 2:i - 1] if i >= 2 else ""
            after = py_format[i + 2:i + 3]
            if "%" in (before, after) and len(java) == 1:
                java *= 2
            out.append(java)
            i += 2
            continue
        ch = py_format[i]
        out.append(f"'{ch}'" if ch.isascii() and ch.isalpha() else ch)
        i += 1
    return "".join(out)


def parse_date(c: Column | str, formats: Iterable[str]) -> Column:
    """First configured format that parses the whole text, else the first of
    ``DATE_TIMES``; anything else is null. A recorded decision: bare numbers
    (serial days) and times without a date are no dates, so a result never
    depends on the day of the run.

    Returns TIMESTAMP_NTZ (a naive date-time, like the source's timestamps).
    """
    text = trim_ws(c)

    def attempt(f: str) -> Column:
        parsed = F.try_to_timestamp(text, F.lit(java_pattern(f)))
        # a text without the format's separators is not tried (letters match in either case, and spaces are left to the parser)
        needed = sorted({ch for ch in re.sub("%.", "", f) if not ch.isspace() and not (ch.isascii() and ch.isalpha())})
        return F.when(reduce(and_, [text.contains(ch) for ch in needed]), parsed) if needed else parsed

    attempts = [attempt(f) for f in (*formats, *DATE_TIMES)]
    parsed = F.coalesce(*attempts).cast("timestamp_ntz")
    return F.when(is_missing(c), F.lit(None).cast("timestamp_ntz")).otherwise(parsed)


# ----------------------------------------------------------- quantities ----

def quantity_text(c: Column | str) -> Column:
    """Missing → null; otherwise trimmed text without thousands separators."""
    text = F.replace(F.replace(trim_ws(c), F.lit(","), F.lit("")), F.lit("，"), F.lit(""))
    return F.when(is_missing(c), F.lit(None).cast("string")).otherwise(text)


def ordered_units(units: Mapping[str, float]) -> list[tuple[str, float]]:
    """Longest unit first; equal lengths keep their configured order."""
    items = list(units.items())
    return [kv for _, kv in sorted(enumerate(items), key=lambda p: (-len(p[1][0]), p[0]))]


def factor_of_text(text: Column | str, units: Mapping[str, float]) -> Column:
    """Factor of the longest unit contained in ``quantity_text``; 1.0 if none."""
    if isinstance(text, str):
        n = _sql_name(text)
        arms = " ".join(f"WHEN contains({n}, {_sql_text(u)}) THEN CAST('{float(f)!r}' AS DOUBLE)"
                        for u, f in ordered_units(units))
        return F.expr(f"CASE {arms} ELSE CAST(1.0 AS DOUBLE) END" if arms else "CAST(1.0 AS DOUBLE)")
    text = col_(text)
    expr = F.lit(1.0)
    for unit, factor in reversed(ordered_units(units)):
        expr = F.when(text.contains(unit), F.lit(float(factor))).otherwise(expr)
    return expr


def number_of_text(text: Column | str) -> Column:
    """First signed decimal number of ``quantity_text`` (``10-20`` → 10,
    ``1e5`` → 1); full-width digits count as digits."""
    found = F.regexp_extract(F.translate(col_(text), _FULLWIDTH_DIGITS, "0123456789"), _NUMBER, 0)
    return F.when(found != "", found).try_cast("double")


def plain_integer(c: Column | str) -> Column:
    """A cell of digits alone as a number; null for any other text.

    Most cells are such, and need none of the trimming, token tests and
    replacements before ``number_of_text``, which gives the same number.
    """
    return F.when(col_(c).rlike(r"\A[0-9]{1,15}\z"), col_(c).try_cast("double"))


def unit_factor(c: Column | str, units: Mapping[str, float]) -> Column:
    return factor_of_text(quantity_text(c), units)


def parse_number(c: Column | str) -> Column:
    return number_of_text(quantity_text(c))


def parse_quantity(c: Column | str, units: Mapping[str, float]) -> Column:
    """Number × unit factor, in the metric's standard unit."""
    text = quantity_text(c)
    return number_of_text(text) * factor_of_text(text, units)


def unit_converted(c: Column | str, units: Mapping[str, float]) -> Column:
    """True when a value was found and its unit factor is not 1."""
    text = quantity_text(c)
    return number_of_text(text).isNotNull() & (factor_of_text(text, units) != F.lit(1.0))


# ---------------------------------------------------------------- codes ----

def normalize_code(c: Column | str) -> Column:
    """Missing → null; drop a trailing ``.0`` (spreadsheet float); trim."""
    code = col_(c)
    return F.when(code.rlike(r"\A[0-9]+\z"), code).when(is_missing(c), F.lit(None).cast("string")).otherwise(
        trim_ws(F.regexp_replace(code, r"\.0$", ""))
    )


# ------------------------------------------------------- derived fields ----

def season(month: Column | str, flood_months: Iterable[int]) -> Column:
    """Flood season by month; a null month is outside the season."""
    return F.when(col_(month).isin(list(flood_months)), F.lit(FLOOD_SEASON)).otherwise(F.lit(NON_FLOOD_SEASON))


def per_capita_band(loss: Column | str, population: Column | str,
                    bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins over loss / population; 0 population, null or out of
    range → the no-population label."""
    pop = col_(population)
    ratio = F.try_divide(col_(loss), F.when(pop != 0, pop))
    expr = F.lit(NO_POPULATION_BAND)
    for lo, hi, label in reversed(list(zip(bins[:-1], bins[1:], labels))):
        expr = F.when((ratio >= F.lit(float(lo))) & (ratio < F.lit(float(hi))), F.lit(label)).otherwise(expr)
    return expr


# ------------------------------------------------------------ reporting ----

def format_value(x: Column | str) -> Column:
    """Report number display: ≥ 10000 or integral → no decimals, else 2 dp,
    with thousands separators."""
    x = col_(x).cast("double")
    return (
        F.when(F.abs(x) >= 10000, F.format_number(x, 0))
        .when(x == F.floor(x), F.format_number(x, 0))
        .otherwise(F.format_number(x, 2))
    )
