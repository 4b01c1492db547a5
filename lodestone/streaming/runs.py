"""Streams that take what is there and end."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _set(spark: SparkSession, **values: str):
    """Settings of the session for as long as a stream starts, which copies them."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, values[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Append all that the stream has to ``out`` (Parquet), batch by batch, and read ``out``.

    Called again with the same ``checkpoint`` it goes on where it stopped: files that were read aren't read
    again, the state is that of the last finished batch. State lies in RocksDB, in as many partitions
    as the cluster runs tasks at once.
    """
    spark = stream.sparkSession
    with _set(spark, streaming__stateStore__providerClass=ROCKS, shuffle__partitions=str(spark.sparkContext.defaultParallelism)):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(out)
