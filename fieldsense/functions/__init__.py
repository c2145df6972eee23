"""Column-level building blocks (pure ``pyspark.sql.functions`` expressions)."""

from .flags import drop_flag, empty_flags, is_pending, set_flag
from .jsonfn import canonical_json, canonical_variant, exact_number, is_one_json, marked_json, object_key_count, unmarked_json, whole_json, whole_variant, with_default_key
from .numeric import decimal_number, finite_number, integer_in, integer_text, integer_within, real_number, real_within, round_numeric, round_to_short
from .timefn import bucket_start, calendar_bucket, calendar_next, day_range, day_start, hours, is_ntz, micros_between, minutes, ts_literal, utc_day

__all__ = [
    "bucket_start", "calendar_bucket", "calendar_next", "canonical_json", "canonical_variant", "day_range", "day_start", "decimal_number", "drop_flag", "empty_flags", "exact_number", "finite_number", "hours", "integer_in",
    "integer_text", "integer_within", "is_one_json", "marked_json",
    "is_ntz", "is_pending", "object_key_count", "micros_between", "minutes", "real_number", "real_within", "round_numeric",
    "round_to_short", "set_flag", "ts_literal", "unmarked_json", "utc_day", "whole_json", "whole_variant", "with_default_key",
]


def with_computed(df, **exprs):
    """Add columns whose expressions are expensive (JSON parsing, checks)
    so that each is evaluated once per row.

    A filter on a plain derived column is pushed below the projection by
    inlining the expression, which evaluates it twice (in the filter and in
    the projection). Producing the values through a one-row generator puts
    them behind a plan node that filters cannot be pushed through."""
    from pyspark.sql import functions as _F

    packed = _F.struct(*[e.alias(k) for k, e in exprs.items()])
    return df.select(*[c for c in df.columns if c not in exprs], _F.inline(_F.array(packed)))
