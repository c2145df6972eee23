"""Winnowing fingerprints, in DataFrame functions only.

Units are words (very long ones in pieces), a gram is ``k`` units hashed by a
cyclic polynomial, and of every ``w`` grams in a row the one with the smallest
hash is kept, the rightmost of equals. Two texts that share ``k + w - 1`` units
in a row therefore share a kept gram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents

K, W = 4, 8
#: A run without white space counts as several units beyond so many characters.
UNIT_CHARS = 16
_POSITION_BITS = 31
_LAST = (1 << _POSITION_BITS) - 1


def _rotate(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _roll(j: int):
    return lambda a, b: _rotate(a, j).bitwiseXOR(b)


def with_fingerprint(df: DataFrame, text_col: str, name: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``name``: the kept grams as longs, each the gram's hash (32
    bits) above its place counted from the end of the number range, so that the
    smallest of a window is the one with the smallest hash and, of equals, the
    rightmost. A text of fewer than ``k`` units has one gram, one without
    units none.

    The rolling hash of 2j units is that of the first j, rotated, with that of
    the next j (``k`` is a power of two). Each step is a column of its own, as
    an expression that is used twice in a lambda function is computed twice."""
    units, width = f"__{name}_units", f"__{name}_1"
    df = df.withColumn(units, F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]{1,%d}" % UNIT_CHARS), F.lit(0)))
    df = df.withColumn(width, F.transform(units, lambda x: F.xxhash64(x)))
    made, j = [units, width], 1
    while j < k:
        h, rest = made[-1], F.greatest(F.size(made[-1]) - j, F.lit(0))
        made.append(f"__{name}_{2 * j}")
        df = df.withColumn(made[-1], F.zip_with(F.slice(h, F.lit(1), rest), F.slice(h, F.lit(j + 1), rest), _roll(j)))
        j *= 2
    mark = lambda h, i: F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), _POSITION_BITS).bitwiseOR(F.lit(_LAST) - i)
    whole = F.when(F.size(units) > 0, F.array(F.xxhash64(F.array_join(units, " ")))).otherwise(F.array().cast("array<bigint>"))
    grams, least = f"__{name}_grams", f"__{name}_least"
    df = df.withColumn(grams, F.transform(F.when(F.size(units) >= k, F.col(made[-1])).otherwise(whole), mark))
    df = df.withColumn(least, F.transform(F.sequence(F.lit(1), F.greatest(F.size(grams) - w + 1, F.lit(1))),
                                          lambda i: F.array_min(F.slice(F.col(grams), i, F.lit(w)))))
    df = df.withColumn(name, F.when(F.size(grams) > 0, F.array_distinct(least)).otherwise(F.col(grams)))
    return df.drop(*made, grams, least)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, _POSITION_BITS)))


def places(fingerprint: str) -> Column:
    return F.transform(fingerprint, lambda x: F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST)))


def as_string(fingerprint: str) -> Column:
    """``hash@place`` of the kept grams in the order of the text."""
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(
        F.hex(F.shiftright(x, _POSITION_BITS)), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Share of the different hashes that both have; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, places) of every row of ``docs``, places in units from 0."""
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_fingerprint(df, "text", "fp", k, w).select(
        "doc_id", F.transform("fp", lambda x: F.shiftright(x, _POSITION_BITS)).alias("hashes"), places("fp").alias("places"))


def _chunk(docs: DataFrame, id_col: str, rows: int) -> Column:
    """The chunk of ``doc_id``, in the order of the ids: 256 quantiles of the
    ids, and between two of them equal ranges that hold about ``rows`` rows each
    if ids are spread evenly there. Where they are not, a chunk holds no more
    than the rows between two quantiles."""
    n, low, high, at = docs.select(F.col(id_col).cast("bigint").alias("id")).agg(
        F.count("id"), F.min("id"), F.max("id"), F.percentile_approx("id", [k / 256 for k in range(1, 256)], 10_000)).first()
    if not n:
        return F.lit(0).cast("bigint")
    starts = sorted({low, *at})
    each = max(1.0, n / len(starts) / rows)  # chunks between two quantiles
    widths = [max(1.0, (float(b) - float(a)) / each) for a, b in zip(starts, [*starts[1:], high + 1])]
    k = F.size(F.filter(F.array(*(F.lit(x).cast("bigint") for x in starts)), lambda x: x <= F.col("doc_id")))
    start = F.element_at(F.array(*(F.lit(float(x)) for x in starts)), k)
    width = F.element_at(F.array(*map(F.lit, widths)), k)
    return F.when(F.col("doc_id").isNotNull(), F.shiftleft(k.cast("bigint"), 40)
                  + F.floor((F.col("doc_id").cast("double") - start) / width).cast("bigint"))


def with_next(docs: DataFrame, rows: int = 256, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document, its fingerprint
    and those of the next one by descending id, after the last the first.

    Ids are cut into chunks of about ``rows`` rows, which a single exchange of
    the texts brings together; a chunk's last document gets the first one of
    the next chunk that there is. Chunks are put in order in groups, and groups
    by one row for each. Null ids come last, in chunks by a hash of the text,
    which also orders repeated ids."""
    null = F.lit(-(1 << 62))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    df = df.withColumn("c1", F.coalesce(_chunk(docs, id_col, rows), null)) \
           .withColumn("c2", F.when(F.col("doc_id").isNull(), F.shiftright("tie", 52)).otherwise(F.lit(0).cast("bigint")))
    chunks = df.groupBy("c1", "c2").agg(F.lit(1).alias("one")).select("c1", "c2", F.shiftright("c1", 10).alias("part"))
    df = df.repartition("c1", "c2")
    down = Window.partitionBy("c1", "c2").orderBy(F.col("doc_id").desc(), F.col("tie").desc())
    heads = df.withColumn("n", F.row_number().over(down)).where("n = 1")
    heads = with_fingerprint(heads, "text", "fp", k, w)
    tops = chunks.groupBy("part").agg(F.max(F.struct("c1", "c2")).alias("top"))
    parts = Window.orderBy(F.col("part").desc())
    tops = tops.select("part", F.coalesce(F.lead("top").over(parts), F.first("top").over(parts)).alias("after"))
    after = F.coalesce(F.lead(F.struct("c1", "c2")).over(Window.partitionBy("part").orderBy(F.col("c1").desc(), F.col("c2").desc())),
                       F.col("after"))
    after = chunks.join(tops, "part").select("c1", "c2", after.alias("after"))
    heads = (after.join(heads.select(F.struct("c1", "c2").alias("after"), F.col("text").alias("head_text"), F.col("fp").alias("head_fp")),
                        "after").select("c1", "c2", "head_text", "head_fp"))
    own = with_fingerprint(df, "text", "fp", k, w).withColumn("next", F.lead(F.struct("text", "fp")).over(down))
    both = own.join(heads, ["c1", "c2"], "left")
    last = F.col("next").isNull()
    return both.select("doc_id", "text", "fp", F.when(last, F.col("head_text")).otherwise(F.col("next.text")).alias("next_text"),
                       F.when(last, F.col("head_fp")).otherwise(F.col("next.fp")).alias("next_fp"))


def fingerprint_edits(docs: DataFrame, k: int = K, w: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of the text
    whose last half is replaced by the start of the next document, and how
    alike its fingerprint is to that one and to the next document's.

    A null text counts as empty; an empty text has the empty fingerprint; the
    only row is its own next one; for null and repeated ids see
    :func:`with_next`; an empty table gives no rows; other columns are ignored.
    """
    df = with_next(docs, k=k, w=w, id_col=id_col, text_col=text_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("n_chars", n.cast("bigint")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    df = with_fingerprint(df, "edited", "edited_fp", k, w)
    for name in ("fp", "edited_fp", "next_fp"):
        df = df.withColumn(f"{name}_hashes", hashes(name))
    return df.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                     as_string("fp").alias("fingerprint"), as_string("edited_fp").alias("edited_fingerprint"),
                     likeness("fp_hashes", "edited_fp_hashes").alias("near_edited"),
                     likeness("fp_hashes", "next_fp_hashes").alias("near_next"))


def op6_winnowing(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(documents(spark, sf_dir))
