"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}

# Runtime-changeable settings the operators rely on. Skewed lookups (many rows, few hot
# keys, unique right side) are left to the adaptive skew join; forcing it keeps the split
# even where it costs the following aggregation one more shuffle.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


#: Largest table, by the bytes of its files, that is broadcast before anything of it was read. Sorted ids take less
#: than a byte a row in files and some 70 in a broadcast, so that bytes of files say little about memory.
GUESSED_BROADCAST = 256 * 1024


def bound_broadcasts(spark: SparkSession) -> None:
    """Have tables broadcast by the size that was measured of their rows, and by that of files only if it is small.

    The session's threshold holds on for measured sizes, unless the session has one for these; a session that
    has no or a lower threshold keeps it.
    """
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if most <= GUESSED_BROADCAST:
        return
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, str(most))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(GUESSED_BROADCAST))


def build_session(app_name: str = "threadline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    bound_broadcasts(spark)
    return spark


#: Tasks for each core that a scan of texts is cut into. Work on a text is many times that of reading it, so
#: tasks by bytes alone, one for each core, leave most cores waiting for the last.
SCANS_PER_CORE = 4


def spread_scans(spark: SparkSession) -> None:
    """Have files read by a few tasks for each core, unless the session says how many tasks a scan has."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(SCANS_PER_CORE * spark.sparkContext.defaultParallelism))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the shared root in ``spark.checkpoint.dir``. Only a session within one
    process may fall back to a temporary folder.
    """
    app_id = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        if app_id not in _local_roots:
            _local_roots[app_id] = tempfile.mkdtemp(prefix="threadline-")
        root = _local_roots[app_id]
    return f"{root.rstrip('/')}/{app_id}/{label}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write once to the shared folder and read back.

    Unlike ``checkpoint`` the rows are computed once, the planner sees the real size of the
    result, and lost executors only cost a re-read.
    """
    bound_broadcasts(df.sparkSession)
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and return its number of rows, counted by the same job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]
