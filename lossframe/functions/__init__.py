"""Column expression builders (JVM-side, codegen-friendly)."""

from .exprs import (  # noqa: F401
    changed,
    format_value,
    is_missing,
    java_pattern,
    normalize_code,
    normalize_text,
    null_if_missing,
    parse_date,
    parse_number,
    parse_quantity,
    per_capita_band,
    season,
    strip_all_ws,
    trim_ws,
    unit_converted,
    unit_factor,
)
