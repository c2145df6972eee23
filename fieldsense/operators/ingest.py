"""Ingest: validate batches of device readings, reshape them into rows,
receipts, the direct JSON insert and the layout upgrade of old tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import decimal_number, empty_flags, integer_text, integer_within, real_number, real_within, ts_literal, whole_json, with_computed

SHORT_MIN, SHORT_MAX = -32768, 32767


def _short_text(text: Column) -> Column:
    """A smallint as an integer column reads it from text, else NULL."""
    return integer_text(text, SHORT_MIN, SHORT_MAX).cast("smallint")


def _string(v: Column) -> Column:
    """The text of a VARIANT that is a string, else NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


#: What an item can fail, in the order in which a batch's rules are looked at.
ITEM_RULES = ("sid", "value", "type", "battery", "desc")


def _first_fault(*rules) -> Column:
    """The number of the first rule that holds, else NULL."""
    fault = F.when(rules[0], F.lit(0))
    for k, rule in enumerate(rules[1:], 1):
        fault = fault.when(rule, F.lit(k))
    return fault


def _typed_items(items: Column, types: list[str]) -> Column:
    """The items with their columns' types and ``fault``, the first of
    ``ITEM_RULES`` that each fails. Every text is read once, in a first pass."""
    kind = F.schema_of_variant
    read = F.transform(items, lambda x: F.struct(
        decimal_number(x["sid"]).alias("sid"), x["type"].alias("type"), x["desc"].alias("desc"), kind(x["desc"]).alias("kind"),
        decimal_number(x["value"]).alias("val"), x["battery"].isNotNull().alias("powered"),
        decimal_number(x["battery"]).alias("battery")))
    short = lambda number: integer_within(number, SHORT_MIN, SHORT_MAX).cast("smallint")
    return F.transform(read, lambda x: F.struct(
        short(x["sid"]).alias("sid"), x["type"].alias("type"),
        F.when(x["kind"] == "STRING", F.try_variant_get(x["desc"], "$", "string")).alias("description"),
        real_within(x["val"]).cast("float").alias("val"), short(x["battery"]).alias("battery"),
        _first_fault(short(x["sid"]).isNull(), real_within(x["val"]).isNull(), x["type"].isNull() | ~x["type"].isin(types),
                     x["powered"] & short(x["battery"]).isNull(), ~x["kind"].isin("STRING", "VOID")).alias("fault")))


def _row_id(*parts: Column) -> Column:
    """A positive id of a row that is the same on every run: a hash of what
    names the row. Rows keep their order by (batch, pos), not by it."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 63) - 1))


def validate_batches(raw: DataFrame, batch_col: str = "batch_id", raw_col: str = "raw",
                     valid_types=S.READING_TYPES):
    """Check batches ``{mac, battery?, data: [{sid, value, type, desc?}, ...]}``.

    Returns ``(good, rejected)``. ``good``: batch id, ``mac``, ``battery``
    (float or NULL) and ``items`` (array of structs in the columns' types). ``rejected``:
    batch id, raw text and the first failing rule as ``reason``:
    ``json`` (not one JSON object), ``mac`` (missing, empty or no string), ``battery``
    (not a number), ``data`` (missing, not a list or empty), then, over
    all items, ``sid`` (integer within smallint), ``value`` (number),
    ``type`` (one of ``valid_types``) and the optional per-item
    ``battery`` (integer within smallint), and ``desc`` (a string, may be
    empty or absent). One bad item
    rejects its whole batch. Unknown keys are allowed. Everything is a
    per-row expression: no shuffle."""
    doc = F.col(raw_col)
    parsed = whole_json(doc, S.RAW_BATCH)
    reason = (
        F.when(F.col("_b").isNull() | ~F.ltrim(doc).startswith("{"), F.lit("json"))
        .when(F.coalesce(F.col("_mac"), F.lit("")) == "", F.lit("mac"))
        .when(F.col("_b.battery").isNotNull() & F.col("_battery").isNull(), F.lit("battery"))
        .when(F.col("items").isNull() | (F.size("items") < 1), F.lit("data"))
        # an item's first fault, and of those the first of the batch
        .otherwise(F.get(F.array(*map(F.lit, ITEM_RULES)), F.array_min(F.col("items.fault"))))
    )
    read = with_computed(with_computed(raw, _b=parsed), _mac=_string(F.col("_b.mac")), _battery=real_number(F.col("_b.battery")),
                         items=_typed_items(F.col("_b.data"), list(valid_types)))
    tagged = with_computed(read, reason=reason)
    good = (tagged.where(F.col("reason").isNull())
            .select(batch_col, F.col("_mac").alias("mac"), F.col("_battery").cast("float").alias("battery"), "items"))
    rejected = tagged.where(F.col("reason").isNotNull()).select(batch_col, raw_col, "reason")
    return good, rejected


def reshape_batches(good: DataFrame, as_of, batch_col: str = "batch_id", ntz: bool = True) -> DataFrame:
    """One measurement row per item: the batch's ``mac`` copied in, ``desc``
    -> ``description`` (missing stays NULL), ``value`` -> ``val``; the batch
    ``battery`` is dropped, a per-item battery kept; ``ts`` is the arrival
    time ``as_of``, sync flags empty. ``pos`` is the item's place in its
    batch, so (batch, pos) identifies the row, and ``id`` is a hash of the two."""
    rows = good.select(batch_col, "mac", F.posexplode("items").alias("pos", "_i"))
    return rows.select(_row_id(F.col(batch_col).cast("string"), F.col("pos")).alias("id"), batch_col, "pos", "mac", "_i.sid",
                       "_i.type", "_i.description", "_i.val", "_i.battery",
                       ts_literal(as_of, ntz).alias("ts"), empty_flags().alias("sync"))


def ingest_receipt(rows: DataFrame, as_of, batch_col: str = "batch_id", ntz: bool = True) -> DataFrame:
    """Per batch: ``new_records`` (rows written) and the arrival time."""
    return (rows.groupBy(batch_col).agg(F.count(F.lit(1)).alias("new_records"))
            .withColumn("ts", ts_literal(as_of, ntz)))


INSERT_ITEM = "struct<mac:variant,sid:string,type:string,description:variant,val:string,battery:string>"


def _insert_items(items: Column) -> Column:
    """The items with the table's types and ``bad``, whether one cannot be
    stored. Every text is read once, in a first pass."""
    read = F.transform(items, lambda x: F.struct(
        x["mac"].alias("mac"), F.schema_of_variant(x["mac"]).alias("mac_kind"), _short_text(x["sid"]).alias("sid"), x["type"].alias("type"),
        x["description"].alias("desc"), F.schema_of_variant(x["description"]).alias("kind"),
        x["val"].isNotNull().alias("valued"), decimal_number(x["val"]).alias("val"),
        x["battery"].isNotNull().alias("powered"), _short_text(x["battery"]).alias("battery")))
    text = lambda v, kind: F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    return F.transform(read, lambda x: F.struct(
        text(x["mac"], x["mac_kind"]).alias("mac"), x["sid"], x["type"], text(x["desc"], x["kind"]).alias("description"),
        real_within(x["val"]).cast("float").alias("val"), x["battery"],
        ((F.coalesce(x["mac_kind"], F.lit("")) != "STRING") | x["sid"].isNull() | x["type"].isNull()
         | ~F.coalesce(x["kind"], F.lit("VOID")).isin("STRING", "VOID")
         | x["powered"] & x["battery"].isNull() | x["valued"] & real_within(x["val"]).isNull()).alias("bad")))


def insert_measurements(raw: DataFrame, as_of, raw_col: str = "raw", ntz: bool = True):
    """Direct insert of a JSON object or array of readings: only mac, sid,
    type, description, val and battery are kept (other keys ignored), ts is
    ``as_of`` and sync empty. A document with any row that cannot be stored
    (missing mac/sid/type, mac or description no string, sid or battery not a
    smallint written as an integer, val not a number) is rejected whole: ``(rows, rejected)``.
    ``id`` is a hash of the request's columns and ``pos``."""
    doc = F.col(raw_col)
    parsed = F.when(F.ltrim(doc).startswith("{"), F.array(whole_json(doc, INSERT_ITEM))) \
        .when(F.ltrim(doc).startswith("["), whole_json(doc, f"array<{INSERT_ITEM}>"))
    parsed = F.when(~F.exists(parsed, lambda x: x.isNull()), parsed)
    keep = [c for c in raw.columns if c != raw_col]
    reason = F.when(F.col("_items").isNull(), F.lit("json")).when(F.array_max(F.col("_items.bad")), F.lit("row"))
    read = with_computed(with_computed(raw, _items=parsed), _items=_insert_items(F.col("_items")))
    tagged = with_computed(read, reason=reason)
    rows = (tagged.where(F.col("reason").isNull())
            .select(*keep, F.posexplode("_items").alias("pos", "_i"))
            .select(_row_id(*(F.col(c).cast("string") for c in keep), F.col("pos")).alias("id"), *keep, "pos",
                    "_i.mac", "_i.sid", "_i.type", "_i.description", "_i.val", "_i.battery",
                    ts_literal(as_of, ntz).alias("ts"), empty_flags().alias("sync")))
    rejected = tagged.where(F.col("reason").isNotNull()).drop("_items")
    return rows, rejected


def upgrade_measurements(v1: DataFrame, dest: str = S.CLOUD) -> DataFrame:
    """First layout -> current: the boolean ``sync`` is kept as ``sync_old``,
    the new ``sync`` map is ``{dest: sync_old}`` (NULL when the old flag is
    NULL, as the original patch leaves it), ``agg`` is dropped."""
    old = F.col("sync_old")
    new = F.when(old.isNull(), F.lit(None).cast(S.SYNC_MAP)) \
        .otherwise(F.create_map(F.lit(dest), old).cast(S.SYNC_MAP))
    return (v1.withColumnRenamed("sync", "sync_old").drop("agg")
            .withColumn("sync", new))
