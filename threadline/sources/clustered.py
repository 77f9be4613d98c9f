"""Tables bucketed and sorted by a key, kept as plain files and declared to the session when read.

A join or filter on the key needs no exchange of such a table, and a filter on few keys reads only their
buckets. The session's catalog only holds the declaration; dropping it leaves the files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows of a bucket, and the smallest and largest number of buckets.
BUCKET_ROWS = 1_000_000
BUCKETS = (16, 50_000)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for so many rows; never fewer than the session shuffles into, or joins would deal them again."""
    least = max(BUCKETS[0], int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(BUCKETS[1], max(least, -(-rows // BUCKET_ROWS)))


def _table_name(path: str, use: str) -> str:
    return f"threadline_{hashlib.md5(path.encode()).hexdigest()[:16]}_{use}"


def write_clustered(dealt: DataFrame, path: str, key: str, buckets: int, sort: tuple[str, ...] = ()) -> None:
    """Write rows already dealt by ``repartition(buckets, key)``: every task then writes one file.

    The path must not exist yet.
    """
    name = _table_name(path, "w")
    writer = dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key, *sort)
    writer.option("path", path).saveAsTable(name)
    dealt.sparkSession.sql(f"DROP TABLE {name}")  # external, so the files stay


def read_clustered(
    spark: SparkSession, path: str, schema: StructType, key: str, buckets: int, sort: tuple[str, ...] = ()
) -> DataFrame:
    name = _table_name(path, "r")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({', '.join((key, *sort))}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)
