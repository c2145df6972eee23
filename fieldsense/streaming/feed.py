"""The aggregate table as a change feed: a streaming data source whose offsets
are the ticks that were written, so that every row is read once, in the order of
its tick and id, and goes out at least once across restarts."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..operators.sync import AGGREGATE_COLUMNS
from ..sources.epochs import done
from . import outbox

#: Ticks that one micro-batch takes at most.
TICKS_PER_BATCH = 64


class _Ticks(InputPartition):
    def __init__(self, tick: int):
        super().__init__(tick)
        self.tick = tick


class TickFeed(DataSource):
    """``spark.readStream.format("tick_feed")``: one row (tick) for each tick
    folder of ``path`` that has been written whole. ``start`` is the first
    tick to read, ``ticksPerBatch`` how many a micro-batch takes.

    A tick is there once its folder has its success file. Ticks are read without
    a gap: a later one waits until those before it are there, as they may still
    be written, unless ``gaps`` is true."""

    @classmethod
    def name(cls) -> str:
        return "tick_feed"

    def schema(self) -> str:
        return "tick bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TickReader(dict(self.options))


class _TickReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.start = options["path"], int(options.get("start", 0))
        self.most, self.gaps = int(options.get("ticksperbatch", TICKS_PER_BATCH)), options.get("gaps", "false") == "true"
        self.at: int | None = None

    def _written(self) -> list[int]:
        """Numbers of the folders that are there whole, by the file system Spark knows the path by."""
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        found = []
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            m = re.fullmatch(r"tick=(\d+)", f.base_name)
            if m and system.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File:
                found.append(int(m.group(1)))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        """The tick after the last that may be read now."""
        at = self.start if self.at is None else self.at
        written = [t for t in self._written() if t >= at]
        end = at
        for t in written[:self.most]:
            if t != end and not self.gaps:
                break
            end = t + 1
        self.at = end
        return {"next": end}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = max(end["next"], self.at or 0)  # after a restart the offsets go on where they were
        return [_Ticks(t) for t in self._written() if start["next"] <= t < end["next"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.tick,)

    def commit(self, end: dict) -> None:
        self.at = max(end["next"], self.at or 0)


def changed_rows(spark: SparkSession, agg_dir: str, ticks: list[int], schema=None) -> DataFrame:
    """The rows of some ticks, read from their folders alone."""
    paths = [f"{agg_dir}/tick={t}" for t in ticks if done(spark, f"{agg_dir}/tick={t}")]
    reader = spark.read.schema(schema or S.AGGREGATES).option("basePath", agg_dir)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema or S.AGGREGATES)


def feed_stream(spark: SparkSession, agg_dir: str, outbox_dir: str, checkpoint: str, limit: int = S.DEFAULT_SYNC_LIMIT,
                schema=None, start: int = 0, ticks_per_batch: int = TICKS_PER_BATCH, trigger: dict | None = None) -> StreamingQuery:
    """Change notification: the rows of each new tick go to ``outbox_dir`` in
    messages of ``limit`` rows in the order of their ids.

    A micro-batch reads the folders of its ticks and no others, and each folder
    once; a micro-batch that is repeated after a failure sends the same messages
    under the same names. A message is made by one task from the rows of its
    own number, which serial ids give without counting."""
    spark.dataSource.register(TickFeed)

    def on_batch(df: DataFrame, batch: int) -> None:
        ticks = sorted(r["tick"] for r in df.collect())  # ``ticks_per_batch`` at most
        if ticks:
            rows = changed_rows(df.sparkSession, agg_dir, ticks, schema)  # the micro-batch's own session
            rows = rows.select(*AGGREGATE_COLUMNS)
            outbox.write_messages(outbox.messages(rows, limit), outbox_dir, batch)

    feed = (spark.readStream.format("tick_feed").option("path", agg_dir).option("start", start)
            .option("ticksPerBatch", ticks_per_batch).load())
    return (feed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())
