"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight, which sets how many words the mix takes from it,
and a schedule, which says how its share of the words changes over training.
The integral of a schedule is the source's cumulative demand; a copy of a
document takes the position at which that demand reaches the copy. DataFrame
functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents

#: Knots (time, rate) of the schedules, dealt to the sources in turn: rising, even, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
WEIGHTS = (3, 1, 2)
#: Rows of a bin of the running totals, about.
BIN_ROWS = 16_384


def _position(q: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral, as a share of the whole,
    reaches ``q``: in the segment that holds it, the root of a quadratic."""
    areas = [(t1 - t0) * (v0 + v1) / 2 for (t0, v0), (t1, v1) in zip(knots, knots[1:])]
    out, before, total = None, 0.0, sum(areas)
    if total <= 0 or any(v < 0 for _, v in knots):
        raise ValueError("a schedule's rates are not negative, and not all zero")
    for ((t0, v0), (t1, v1)), area in zip(zip(knots, knots[1:]), areas):
        if area == 0:  # nothing is taken while the rate is zero
            continue
        a, need = (v1 - v0) / (t1 - t0), q * total - before
        if a == 0:
            at = F.lit(t0) + need / v0
        else:
            at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(v0 * v0) + need * (2 * a), F.lit(0.0))) - v0) / a
        before += area
        out = F.when(q * total <= before, at) if out is None else out.when(q * total <= before, at)
    return F.least(out.otherwise(F.lit(knots[-1][0])), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """From (source_key, source, source_size): each source's target, by weight
    but at most ``most`` times its size, with the excess dealt to the others by
    weight. ``level`` words for a unit of weight meet the total: with the
    sources in the order of cap to weight, those whose cap lies under the
    level that the sources from there on would have are at their cap.

    The table has one row for each source, which is what bounds its window."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("at"))
    before, whole = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = (sizes.withColumn("at", F.row_number().over(order) - 1)
         .withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("at") % len(weights) + 1).cast("int")))
         .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
         .withColumn("demand", F.lit(float(share)) * F.sum("source_size").over(whole))
         .withColumn("left", F.col("demand") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("full", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest"))
         .withColumn("level", (F.col("demand") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
                     / F.nullif(F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole), F.lit(0.0))))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return s.select("source_key", "source_size", "at", target.alias("target"))


def _keyed(docs: DataFrame, source_col: str, text_col: str, id_col: str, seed: int, carry: Sequence[str]) -> DataFrame:
    """The ``carry`` columns as one struct, with the size, the source without null, and the
    place in the source's order: a digest of the id and the text, whose first digits are the bin."""
    text = F.col(text_col).cast("string")
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"),
                           F.md5(F.coalesce(text, F.lit("")))))
    return docs.select(
        F.struct(*carry).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), mixed.alias("place"))


def curriculum_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0,
                   schedules=SCHEDULES, seed: int = 1, bin_digits: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (its columns, or those of ``carry``), size,
    source_size, target, ``copies`` the mix takes and their ``positions`` in
    training, from 0 to 1.

    Every source goes round its documents in the order of a digest of the id
    and text: whole rounds first, then the documents whose middle lies before the rest
    of the target, so its words miss the target by half a document at most.
    Running totals come from a total for each (source, bin) and a window in
    each bin, so a source that holds a third of all rows is spread over
    16 ** ``bin_digits`` groups, by default as many as leave a bin some
    ``BIN_ROWS`` rows, and 4,096 at least.

    A null source is a source of its own, the last; a null text has size 0
    and is taken as often as its source's whole rounds; null and repeated ids
    are told apart by their texts; rows alike in id and text are documents of
    their own in one bin, and tie in any order without effect on the totals;
    an empty table gives no rows.
    """
    if bin_digits is None:
        bin_digits = max(3, math.ceil(math.log(max(docs.count(), 1) / BIN_ROWS, 16)))
    keyed = (_keyed(docs, source_col, text_col, id_col, seed, docs.columns if carry is None else carry)
             .withColumn("bin", F.substring("place", 1, bin_digits)))
    bins = keyed.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    sizes = (bins.groupBy("source_key").agg(F.sum("bin_size").alias("source_size"))
             .withColumn("source", F.when(F.col("source_key") != "", F.expr("substring(source_key, 2)"))))
    targets = source_targets(sizes, weights, share, most)
    run = Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (bins.select("source_key", "bin", F.coalesce(F.sum("bin_size").over(run), F.lit(0)).alias("bin_start"))
               .join(targets, "source_key"))
    in_bin = (Window.partitionBy("source_key", "bin").orderBy("place", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("in_bin", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
              .join(offsets, ["source_key", "bin"])
              .withColumn("start", F.col("bin_start") + F.col("in_bin")))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.col("target") - F.col("rounds") * F.col("source_size")
    q = lambda j: F.least((F.col("start") + j * F.col("source_size") + F.col("size") / 2) / F.col("target"), F.lit(1.0))
    position = lambda j: F.coalesce(_by_source(q(j), schedules), F.lit(0.0))
    return (placed.withColumn("rounds", rounds.cast("int"))
            .withColumn("copies", F.col("rounds") + ((F.col("size") > 0) & (F.col("start") + F.col("size") / 2 <= rest)).cast("int"))
            .withColumn("positions", F.transform(F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))
                                                 .otherwise(F.array().cast("array<int>")), position))
            .select("row", "size", "source_size", "target", "copies", "positions"))


def _by_source(q: Column, schedules) -> Column:
    out, kind = None, F.col("at") % len(schedules)
    for k, knots in enumerate(schedules):
        out = F.when(kind == k, _position(q, knots)) if out is None else out.when(kind == k, _position(q, knots))
    return out


def in_training_order(mix: DataFrame, position: str | None = None, copy: str | None = None) -> DataFrame:
    """The taken copies as rows with the columns of the documents, sorted by
    position over all partitions. Files keep no order: with the names ``position``
    and ``copy`` given, the rows carry their place in training and the copy's
    number, from 0, by which the order can be had again; columns of these names
    that the documents have are replaced."""
    copies = mix.select("row", F.posexplode("positions").alias("_copy", "_position")).orderBy("_position", "_copy")
    added = [F.col(c).alias(name) for c, name in (("_position", position), ("_copy", copy)) if name]
    own = [f.name for f in mix.schema["row"].dataType.fields if f.name not in (position, copy)]
    return copies.select(*(F.col("row").getField(c).alias(c) for c in own), *added)


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words, at most twice each,
    sorted by the position of a document's first copy."""
    mix = curriculum_mix(documents(spark, sf_dir), carry=["doc_id"])
    first = F.element_at(F.when(F.size("positions") > 0, F.col("positions")), 1)
    return (mix.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"),
                       (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("int").alias("copies"),
                       F.round(first, 9).alias("first_position"))
            .orderBy(F.col("first_position").asc_nulls_last(), "doc_id"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
c AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST(k % 3 AS INT) + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap,
             1.5::DOUBLE * sum(source_size) OVER () AS demand FROM w),
r AS (SELECT *, demand - coalesce(sum(cap) OVER b, 0) AS room,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest
      FROM c WINDOW b AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, room * weight >= cap * rest AS full_ FROM r),
l AS (SELECT *, (demand - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())
               / nullif(sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER (), 0) AS level FROM f),
t AS (SELECT source, source_size, k, CASE WHEN full_ THEN cap ELSE least(cap, weight * level) END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.k,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END AS rounds
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CAST(rounds + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= target - rounds * source_size
                                   THEN 1 ELSE 0 END AS INT) AS copies,
             least((start + size / 2.0::DOUBLE) / nullif(target, 0), 1.0) AS q FROM p),
z AS (SELECT *, CASE k % 3
        WHEN 0 THEN (sqrt(0.25 + q * 2.0) - 0.5) / 1.0
        WHEN 1 THEN q
        ELSE CASE WHEN q * 1.0 <= 0.625 THEN (sqrt(greatest(2.25 + q * -2.0, 0)) - 1.5) / -1.0
                  ELSE 0.5 + (sqrt(greatest(1.0 + (q * 1.0 - 0.625) * -2.0, 0)) - 1.0) / -1.0 END END AS pos FROM n)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(size * copies AS BIGINT) AS taken, copies,
       CASE WHEN copies > 0 THEN round(least(coalesce(pos, 0.0), 1.0), 9) END AS first_position
FROM z
"""
