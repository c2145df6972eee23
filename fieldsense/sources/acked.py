"""A day-partitioned table with its acknowledgements beside it, in folders.

    base/day=...      the rows, with the flags of the last fold
    sent/tick=<n>     ids and days of the rows of message n
    acks/tick=<n>     the ids that the answer to message n acknowledged
    marks/seq=<n>     days that the n-th fold or append closed or opened
    folded/seq=<n>    the tick up to which the n-th fold has taken acknowledgements

Each number writes its own folder, so a step that is repeated after a failure
overwrites what its first try left. Appends and folds of a table come from
one writer, with rising numbers; messages and answers may go on meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.acks import ACKS, MARKS, SENT, acknowledgements, closed_days, pending_delta, sent_rows, with_acks
from ..operators.sync import pending_predicate, reset_sync
from ..session import cut_lineage
from .epochs import exists
from .tables import overwrite_partitions, with_day


@dataclass(frozen=True)
class AckedTable:
    """``source`` names the table in messages; ``version_col`` is for rows that
    can change after they were sent."""

    spark: SparkSession
    path: str
    source: str
    dest: str = S.CLOUD
    ts: str = "ts"
    version_col: str | None = None

    # --- folders ---

    def _folder(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def base(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/base")

    def acks(self) -> DataFrame:
        return self._folder("acks", ACKS)

    def folded(self) -> int | None:
        """The tick up to which the stored flags are right."""
        return self._folder("folded", "tick bigint, seq bigint").agg(F.max("tick")).first()[0]

    def closed(self) -> list:
        """Days without rows to send; as many as the table has days at most."""
        rows = closed_days(self._folder("marks", MARKS), self.source, self.dest).collect()
        return [r["day"] for r in rows if r["day"] is not None]

    # --- steps ---

    def _mark(self, days: DataFrame, seq: int) -> None:
        """``days`` (day, open) as the marks of ``seq``."""
        marks = days.select(F.lit(self.source).alias("source"), F.lit(self.dest).alias("dest"), "day", "open")
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/marks/seq={int(seq)}")

    def append(self, rows: DataFrame, seq: int) -> None:
        """Add rows. Their days are open before the rows are there, so that a
        failure in between leaves a day open for nothing, never closed with rows."""
        rows = with_day(rows, self.ts)
        self._mark(rows.select("day").where(F.col("day").isNotNull()).distinct().withColumn("open", F.lit(True)), seq)
        rows.write.mode("append").partitionBy("day").parquet(f"{self.path}/base")

    def pending(self, limit: int | None = S.DEFAULT_SYNC_LIMIT, columns=None, order_by="id") -> DataFrame:
        """The oldest rows to send, from the days that can hold some."""
        return pending_delta(self.base(), self.acks(), self.source, self.dest, limit, columns, order_by,
                             after=self.folded(), closed=self.closed(), version_col=self.version_col)

    def merged(self) -> DataFrame:
        """The table with its flags as all acknowledgements leave them."""
        return with_acks(self.base(), self.acks(), self.source, self.dest, self.folded(), version_col=self.version_col)

    def note_sent(self, rows: DataFrame, tick: int) -> None:
        """Keep what message ``tick`` holds; one message's rows."""
        sent_rows(self.source, rows, self.ts, version_col=self.version_col).coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/sent/tick={int(tick)}")

    def acknowledge(self, reply: DataFrame, tick: int, status: int) -> bool:
        """The answer to message ``tick``: with status 200 its ids are added,
        with any other nothing is. Only ids are written."""
        if status != 200 or not exists(self.spark, f"{self.path}/sent/tick={int(tick)}"):
            return False
        sent = self.spark.read.schema(SENT).parquet(f"{self.path}/sent/tick={int(tick)}")
        acks = acknowledgements(reply, sent, tick, self.dest).drop("tick")
        acks.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/acks/tick={int(tick)}")
        return True

    def fold(self, seq: int) -> list:
        """Write the acknowledged flags into the days that have any, close the
        days that have nothing left to send, and note up to which tick. Returns
        the days rewritten. Other partitions aren't read.

        A fold that fails on the way can be repeated: flags set twice are the
        same, and readers go on with the acknowledgements until it is noted."""
        after = self.folded()
        acks = self.acks()
        if after is not None:
            acks = acks.where(F.col("tick") > after)
        own = acks.where((F.col("source") == self.source) & (F.col("dest") == self.dest))
        until = own.agg(F.max("tick")).first()[0]
        if until is None:
            return []
        own = own.where(F.col("tick") <= until)
        days = [r["day"] for r in own.select("day").distinct().collect()]  # as many as the table has at most
        rows = self.base().where(F.col("day").isin([F.lit(str(d)).cast("date") for d in days if d is not None])
                                 | (F.col("day").isNull() if None in days else F.lit(False)))
        changed = cut_lineage(with_acks(rows, own, self.source, self.dest, version_col=self.version_col))
        overwrite_partitions(changed, f"{self.path}/base", ["day"])
        left = changed.groupBy("day").agg(F.max(pending_predicate(changed, self.dest)).alias("open"))
        self._mark(left.where(F.col("day").isNotNull()), seq)
        self.spark.createDataFrame([(until,)], "tick bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/folded/seq={int(seq)}")
        return sorted(d for d in days if d is not None)

    def reset(self, seq: int, tick: int) -> None:
        """Mark every row unsent, for a full resync: the one step that rewrites
        the whole table. ``tick`` is the last message answered so far."""
        rows = cut_lineage(reset_sync(self.base(), self.dest))
        overwrite_partitions(rows, f"{self.path}/base", ["day"])
        self._mark(rows.select("day").where(F.col("day").isNotNull()).distinct().withColumn("open", F.lit(True)), seq)
        self.spark.createDataFrame([(int(tick),)], "tick bigint").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/folded/seq={int(seq)}")
