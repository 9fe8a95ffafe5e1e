"""Jobs over what arrives: each runs over all there is, then ends; a later run goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from voxmill.sources.tables import exists, fresh_path


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. The path is a pattern, for a stream takes no single file by its plain name."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def score_arriving(stream: DataFrame, how: Callable[[DataFrame], DataFrame], at: str) -> DataFrame:
    """``how`` applied to each batch of a stream, written under the batch's number: a batch that is run again replaces
    itself, so every row is written once. ``how`` must not look beyond a row of the stream."""

    def write(batch: DataFrame, number: int) -> None:
        how(batch).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{at}/rows").drop("batch")


#: State lies in RocksDB and is saved by its changes, so a batch costs what it brings and not what went before.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def new_points(stream: DataFrame, key: list[str], at: str) -> DataFrame:
    """The rows of each key that a stream brings for the first time, each once; a null is a value like others.

    Keys seen are the stream's state, split by key over the tasks: a batch reads its own rows and looks them up, earlier rows are
    not read again. A batch that is run again meets the state it met before and replaces its own rows.
    """
    spark = stream.sparkSession
    schema = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in key)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    with session(spark, STATE):
        job = stream.select(*key).dropDuplicates(key).writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    job.awaitTermination()
    if not exists(spark, f"{at}/rows"):  # nothing has arrived yet
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{at}/rows").select(*key)


@contextmanager
def session(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings of the session while a job starts; it keeps them, the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a job's rows and progress, shared by driver and executors."""
    return fresh_path(spark, name)
