"""An outbox as a sink with commit: documents that tasks write become visible
together, once every task is done, or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from .state import live_state_rows


def _system(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    """What one task wrote: its file, still under a hidden name, and its documents' number."""

    file: str
    documents: int


class Outbox(DataSource):
    """``df.write.format("outbox").option("batch", n).save(path)`` for rows
    (name, document): one file of JSON lines for each task with rows.

    Tasks write under ``path/_tmp``, a folder of the attempt's own. When all are
    done, their files move to ``path/batch=<n>`` and a list of them,
    ``_COMMITTED``, comes last: readers take what the list names
    (``delivered``). If a task fails, or the job does, nothing is listed. A
    batch that is written again replaces its list."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _OutboxWriter(dict(self.options))


class _OutboxWriter(DataSourceWriter):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.batch = options["path"].rstrip("/"), int(options.get("batch", 0))
        self.attempt = uuid.uuid4().hex
        self.temporary = f"_tmp/{self.batch}-{self.attempt}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _system(self.path)
        name, out, n = f"part-{uuid.uuid4().hex}.jsonl", None, 0
        try:
            for row in rows:
                if out is None:
                    system.create_dir(f"{root}/{self.temporary}", recursive=True)
                    out = system.open_output_stream(f"{root}/{self.temporary}/{name}")
                out.write((json.dumps({"name": row[0], "document": row[1]}, ensure_ascii=False) + "\n").encode())
                n += 1
        finally:
            if out is not None:
                out.close()
        return _Written(name if n else "", n)

    def commit(self, messages: list) -> None:
        system, root = _system(self.path)
        target = f"{root}/batch={self.batch}"
        system.create_dir(target, recursive=True)
        files = sorted((m.file, m.documents) for m in messages if m is not None and m.file)
        for file, _ in files:
            system.move(f"{root}/{self.temporary}/{file}", f"{target}/{file}")
        with system.open_output_stream(f"{target}/_COMMITTED.{self.attempt}") as out:
            out.write(json.dumps([{"file": f, "documents": n} for f, n in files]).encode())
        system.move(f"{target}/_COMMITTED.{self.attempt}", f"{target}/_COMMITTED")

    def abort(self, messages: list) -> None:
        """Nothing was listed, so nothing is delivered; what tasks left goes."""
        from pyarrow import fs
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.temporary}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.temporary}")


def register_outbox(spark: SparkSession) -> None:
    spark.dataSource.register(Outbox)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """(batch, name, document) of the committed batches: the list of each batch
    says which files count, whatever else a failure left beside them."""
    from pyarrow import fs
    system, root = _system(path)
    files = []
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        at = f"{f.path}/_COMMITTED"
        if f.base_name.startswith("batch=") and system.get_file_info(at).type == fs.FileType.File:
            with system.open_input_stream(at) as src:
                files += [f"{path.rstrip('/')}/{f.base_name}/{x['file']}" for x in json.loads(src.read())]
    schema = "name string, document string"
    if not files:
        return spark.createDataFrame([], f"batch bigint, {schema}")
    rows = spark.read.schema(schema).json(files).withColumn("_file", F.input_file_name())
    return rows.select(F.regexp_extract("_file", r"batch=(\d+)/", 1).cast("bigint").alias("batch"), "name", "document")


def messages(rows: DataFrame, limit: int = S.DEFAULT_SYNC_LIMIT, id_col: str = "id") -> DataFrame:
    """(name, document): rows in messages of ``limit`` ids each, a JSON array
    in the order of the ids. Serial ids divide into messages by themselves, so
    no message has more than ``limit`` rows and none needs a global sort."""
    number = F.floor((F.col(id_col) - 1) / F.lit(int(limit)))
    row = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    packed = rows.groupBy(number.alias("_number")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("_id"), row.alias("row")))).alias("items"))
    text = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["row"]), ","), F.lit("]"))
    return packed.select(F.concat(F.lit("message-"), F.col("_number").cast("string")).alias("name"), text.alias("document"))


def write_messages(documents: DataFrame, outbox_dir: str, batch: int) -> None:
    register_outbox(documents.sparkSession)
    documents.select("name", "document").write.format("outbox").option("batch", batch).mode("append").save(outbox_dir)


def live_stream(runs: DataFrame, outbox_dir: str, checkpoint: str, segment: str = S.GPIO_SEGMENT,
                trigger: dict | None = None) -> StreamingQuery:
    """Live push: the runs of ``segment`` that a micro-batch of the state stream
    opens or changes go to the outbox, one document for each run version."""
    register_outbox(runs.sparkSession)

    def push(df: DataFrame, batch: int) -> None:
        rows = live_state_rows(df, segment, ("id", "n_obs"))
        name = F.concat_ws("-", *(F.col(c).cast("string") for c in ("device_id", "id", "n_obs")))
        write_messages(rows.select(name.alias("name"), F.col("payload").alias("document")), outbox_dir, batch)

    return (runs.writeStream.foreachBatch(push).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())
