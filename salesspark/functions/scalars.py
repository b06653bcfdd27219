"""Formatters and small numeric helpers as Column expressions.

They run inside whole-stage codegen like any built-in function. Number text uses
``format_number`` (rounds the exact binary value half-to-even, like Python's
format spec); grouping commas are removed where the reference prints none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesspark.schema import SHORT_MONTH_NAMES

# Indian number scale.
CRORE = 10_000_000
LAKH = 100_000

# Replacements applied before reducing text to Latin-1 (then anything else -> '?').
LATIN1_REPLACEMENTS = {
    "₹": "Rs.",
    "‘": "'", "’": "'",
    "“": '"', "”": '"',
    "–": "-", "—": "-",
    "…": "...",
    "•": "-",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def _fixed(x: Column, decimals: int, grouping: bool) -> Column:
    text = F.format_number(x, int(decimals))
    return text if grouping else F.regexp_replace(text, ",", "")


def format_inr(value, decimals: int = 2, symbol: str = "₹") -> Column:
    """``-₹1.23 Cr`` (>= 1e7), ``₹4.56 L`` (>= 1e5), else ``₹7,890.12``; NULL/NaN -> ``₹0.00``.

    ``symbol="Rs. "`` gives the ASCII variant.
    """
    x = _col(value).cast("double")
    a = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    body = (F.when(a >= CRORE, F.concat(_fixed(a / CRORE, decimals, False), F.lit(" Cr")))
            .when(a >= LAKH, F.concat(_fixed(a / LAKH, decimals, False), F.lit(" L")))
            .otherwise(_fixed(a, decimals, True)))
    return F.when(_missing(x), F.lit(f"{symbol}0.00")).otherwise(F.concat(sign, F.lit(symbol), body))


def format_inr_ascii(value, decimals: int = 2) -> Column:
    """The PDF-safe variant with an ``Rs.`` prefix."""
    return format_inr(value, decimals, "Rs. ")


def format_count(value, decimals: int = 0) -> Column:
    """``1,234`` with grouping; NULL/NaN -> ``0``."""
    x = _col(value).cast("double")
    return F.when(_missing(x), F.lit("0")).otherwise(_fixed(x, decimals, True))


def format_pct(value, decimals: int = 2) -> Column:
    """``12.34%`` for a value already scaled to 0-100; NULL/NaN -> ``0.00%``."""
    x = _col(value).cast("double")
    return F.when(_missing(x), F.lit("0.00%")).otherwise(F.concat(_fixed(x, decimals, False), F.lit("%")))


def delta_string(current, previous, suffix: str = "") -> Column:
    """struct(Delta_Text, Sentiment): ``▲ 12.3% YoY`` / ``▼ ...``; ``n/a``/neutral when previous is 0 or NULL."""
    cur, prev = _col(current).cast("double"), _col(previous).cast("double")
    change = F.lit(100.0) * (cur - prev) / prev
    up = change >= 0
    text = F.trim(F.concat(F.when(up, F.lit("▲")).otherwise(F.lit("▼")), F.lit(" "),
                           _fixed(F.abs(change), 1, False), F.lit("% " + suffix)))
    none = _missing(prev) | (prev == 0) | _missing(cur)
    return F.struct(
        F.when(none, F.lit("n/a")).otherwise(text).alias("Delta_Text"),
        F.when(none, F.lit("neutral")).when(up, F.lit("pos")).otherwise(F.lit("neg")).alias("Sentiment"))


def safe_divide(numerator, denominator, default: float = 0.0) -> Column:
    """N / d, ``default`` when d is 0, NULL or NaN."""
    n, d = _col(numerator).cast("double"), _col(denominator).cast("double")
    return F.when(_missing(d) | (d == 0), F.lit(float(default))).otherwise(n / d)


def month_short_name(month) -> Column:
    """1-12 -> Jan..Dec. Out of range: the reference indexes a Python list with
    ``month - 1``, so 0..-11 wrap to Dec..Jan; anything else is the number as text."""
    m = _col(month).cast("int")
    names = F.array(*[F.lit(n) for n in SHORT_MONTH_NAMES])
    return (F.when(m.between(1, 12), F.element_at(names, m))
            .when(m.between(-11, 0), F.element_at(names, m - 1))
            .otherwise(_col(month).cast("string")))


def to_latin1(text) -> Column:
    """Replace typographic characters, then every remaining non-Latin-1 code point by '?'."""
    out = _col(text)
    for src, dst in LATIN1_REPLACEMENTS.items():
        out = F.replace(out, F.lit(src), F.lit(dst))
    return F.regexp_replace(out, "[^\\x{00}-\\x{FF}]", "?")


def zero_to_one(value) -> Column:
    """A denominator with 0 replaced by 1."""
    x = _col(value)
    return F.when(x == 0, F.lit(1)).otherwise(x)


def clip_at_zero(value) -> Column:
    """X15."""
    return F.greatest(_col(value), F.lit(0.0))


def fill_template(template: str, **values) -> Column:
    """``"Net revenue {direction} {pct}% ..."`` -> one ``concat`` of literals and the given Columns."""
    import re

    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            parts.append(values[piece])
    return F.concat(*parts) if len(parts) > 1 else parts[0]
