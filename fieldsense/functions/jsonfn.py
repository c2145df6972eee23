"""JSON helpers for free-form payload columns (state ``data``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A JSON string, or the whole part of a number that a double prints as ``n.0``.
_WHOLE_DOUBLE = r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0(?=[,\]}])'


def canonical_variant(v: Column) -> Column:
    """Canonical text of a VARIANT: keys sorted, numbers normalised (1.0 and
    1e0 -> 1; exponents beyond what a double prints plainly are kept),
    strings kept apart from numbers ("1" vs 1)."""
    return F.regexp_replace(F.to_json(v), F.lit(_WHOLE_DOUBLE), F.lit("$1$2"))


def canonical_json(text: Column) -> Column:
    """Canonical text of a JSON document, the same for equal values and for no others;
    NULL for a text that is not one JSON value."""
    return unmarked_json(whole_variant(marked_json(text)))


#: A JSON string; a number, or what may be one; anything else.
_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_STRING = f'"{_REST}'
_TOKEN = rf'(?s){_STRING}|-?\d[\d.eE+-]*+|[^"\d-]++|.'
_NUMBER = r"^-?(0|[1-9]\d*+)(?:\.(\d++))?(?:[eE]([+-]?\d++))?$"
#: A marked number; a string that begins with the mark; another string.
_MARKED = rf'(?s)"~n([^"\\]*+)"|(")~(~{_REST})|({_STRING})'
#: Powers of ten up to which numbers are written without one.
_PLAIN_POWER = 400
#: A whole number that is its own ``exact_number``.
_EXACT = rf"^(?:0|-?[1-9]\d{{0,{_PLAIN_POWER - 1}}}+)$"


def _with_value(value: Column, f) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def exact_number(text: Column) -> Column:
    """The one text of a JSON number's value: its digits, without a power of ten
    up to the 400th. NULL for a power of over 18 digits."""
    part = lambda k: F.regexp_extract(text, _NUMBER, k)
    zeros = lambda n: F.repeat(F.lit("0"), F.least(n, F.lit(_PLAIN_POWER)).cast("int"))

    def trimmed(p: Column) -> Column:
        digits = F.ltrim(F.concat(p["whole"], p["rest"]), F.lit("0"))
        return F.struct(digits.alias("digits"), F.rtrim(digits, F.lit("0")).alias("core"), p["rest"].alias("rest"), p["power"].alias("power"))

    def placed(p: Column) -> Column:
        given = F.when(p["power"] == "", F.lit(0).cast("bigint")).otherwise(p["power"].try_cast("bigint"))
        return F.struct(p["core"].alias("core"),
                        (given - F.length(p["rest"]) + F.length(p["digits"]) - F.length(p["core"])).alias("power"))

    def written(p: Column) -> Column:
        core, power = p["core"], p["power"]
        point = F.length(core) + power
        size = (F.when((power > _PLAIN_POWER) | (point < -_PLAIN_POWER), F.concat(core, F.lit("e"), power.cast("string")))
                .when(power >= 0, F.concat(core, zeros(power)))
                .when(point > 0, F.concat(F.substring(core, F.lit(1), point.cast("int")), F.lit("."),
                                          F.substring(core, (point + 1).cast("int"), F.length(core))))
                .otherwise(F.concat(F.lit("0."), zeros(-point), core)))
        return F.when(core == "", F.lit("0")).when(power.isNotNull(), F.concat(F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")), size))

    parts = F.struct(part(1).alias("whole"), part(2).alias("rest"), part(3).alias("power"))
    return _with_value(parts, lambda p: _with_value(trimmed(p), lambda t: _with_value(placed(t), written)))


def marked_json(text: Column) -> Column:
    """A JSON text whose numbers are strings that hold their exact text behind a
    mark, so that a VARIANT of it loses no digit; NULL for a text that is not one JSON value."""
    def token(t: Column) -> Column:
        return (F.when(t.rlike(_EXACT), F.concat(F.lit('"~n'), t, F.lit('"')))
                .when(t.rlike(_NUMBER), F.concat(F.lit('"~n'), exact_number(t), F.lit('"')))
                .when(t.rlike(r'^"(~|\\u007[eE])'), F.concat(F.lit('"~'), F.substring(t, F.lit(2), F.length(t))))
                .otherwise(t))

    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), token)
    # a number without a text makes the document none
    joined = _with_value(tokens, lambda ts: F.when(~F.exists(ts, F.isnull), F.array_join(ts, "")))
    return F.when(is_one_json(text), F.when(text.rlike(r"[\d~]"), joined).otherwise(text))   # else nothing to mark


def unmarked_json(v: Column) -> Column:
    """Canonical text of a VARIANT of ``marked_json``: keys sorted, each number in
    the one text of its value."""
    return F.regexp_replace(F.to_json(v), F.lit(_MARKED), F.lit("$1$2$3$4"))


def is_one_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else; NULL for NULL.

    A parser stops after the value it was asked for. Put into an array before
    one element, and before two, a whole value gives arrays of two and of three
    elements. A text that closes the array itself hides what stands behind it,
    so it gives the same number both times."""
    return ((F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit(",0]"))), F.lit(0)) == 2)
            & (F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit(",0,0]"))), F.lit(0)) == 3))


def whole_json(text: Column, schema: str) -> Column:
    """``from_json`` of a text that is one JSON value and nothing else, else NULL."""
    ddl = schema if isinstance(schema, str) else schema.simpleString()
    return F.when(is_one_json(text), F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{ddl}>"), F.lit(0)))


def whole_variant(text: Column, checked: bool = False) -> Column:
    """The same as a VARIANT. An object with repeated keys keeps the last of
    each, as jsonb does; in nested objects too where the session has
    ``spark.sql.variant.allowDuplicateKeys``, as ``get_session`` sets it, else a
    document with those is NULL. A ``checked`` text is known to be one JSON value, or NULL."""
    value = F.try_parse_json(text) if checked else F.when(is_one_json(text), F.try_parse_json(text))
    entries = F.map_entries(whole_json(text, "map<string,variant>"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.coalesce(value, F.when(F.ltrim(text).startswith("{"), F.try_parse_json(F.to_json(F.map_from_entries(last)))))


def object_key_count(v: Column) -> Column:
    """Top-level key count of a parsed JSON value (VARIANT); NULL unless an object."""
    return F.size(F.try_variant_get(v, "$", "map<string,variant>"))


def with_default_key(v: Column, key: str, default_json: str, text=canonical_variant) -> Column:
    """Add ``key: default`` to a JSON object (VARIANT) when the key is absent
    or JSON null (``jsonb_set`` when ``->>key`` is NULL); its ``text`` out."""
    current = F.try_variant_get(v, f"$.{key}", "variant")
    others = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: k != F.lit(key))
    patched = F.map_concat(others, F.create_map(F.lit(key), F.parse_json(F.lit(default_json))))
    return (F.when(current.isNull() | F.is_variant_null(current), text(F.try_parse_json(F.to_json(patched))))
            .otherwise(text(v)))
