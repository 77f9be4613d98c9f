"""Helpers shared by the operators: whole-batch mapping, words, staged tables, bounded samples.

All operators read only the columns they name, so further columns of a table, whatever they are
called, have no effect. A null text counts as empty unless an operator says otherwise.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.session import write_stage

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch: bound the memory of a task with long texts.
BATCH_ROWS = "1000"
BATCH_BYTES = "8m"
#: Languages or labels that a sample is drawn from at most.
MAX_STRATA = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; a lost executor costs a re-read."""
    return write_stage(df, f"llm-{label}")


def prepare(spark: SparkSession) -> None:
    """Settings the operators rely on; all can be changed at run time."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES,
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def map_batches(
    df: DataFrame,
    start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | dict]],
    schema: str,
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """Apply a function to the Arrow batches of every partition.

    ``start`` runs once per task and returns the function, so that caches live as long as the task.
    ``finish`` runs when the task has read its last batch.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)
        del each
        if finish:
            finish()
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give the memory of a task back: Python processes outlive their tasks, and many kinds of task share one."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def filter_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, for which the function of a batch gives true."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(np.asarray(each(batch), bool)))
        del each
        release()

    return df.mapInArrow(run, df.schema)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.int64))


def list_array(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from the lengths of the rows and all values one after another."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


class WordTable(dict):
    """Numbers for the distinct words of one task, with values worked out once per word.

    ``ids`` numbers the words of a batch; ``describe`` is called with the words that are new and
    returns arrays with one row for each; ``values[k]`` then holds the k-th array for all words.
    The table is emptied when it has passed ``limit`` words, so its memory is bounded.
    """

    def __init__(self, describe: Callable[[list], tuple[np.ndarray, ...]], limit: int = 200_000):
        super().__init__()
        self._describe = describe
        self._limit = limit
        self._new: list = []
        self.values: list[np.ndarray] = []
        self._used = 0

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        self._new.append(word)
        return number

    def ids(self, words: list) -> np.ndarray:
        """Numbers valid until the next call."""
        if len(self) > self._limit:
            self.clear()
            self._used = 0
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._new:
            self._store(self._describe(self._new))
            self._new = []
        return out

    def _store(self, rows: tuple[np.ndarray, ...]) -> None:
        more = self._used + len(rows[0])
        if not self.values:
            self.values = [np.empty((0,) + r.shape[1:], r.dtype) for r in rows]
        for k, r in enumerate(rows):
            if len(self.values[k]) < more:
                grown = np.empty((max(more, 2 * len(self.values[k])),) + r.shape[1:], r.dtype)
                grown[: self._used] = self.values[k][: self._used]
                self.values[k] = grown
            self.values[k][self._used : more] = r
        self._used = more


def split_words(batch: pa.RecordBatch, column: str, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of a batch, one after another, and their number in each text."""
    words: list[bytes] = []
    counts = np.empty(batch.num_rows, np.int64)
    for i, text in enumerate(texts(batch, column)):
        data = text.encode()
        own = (data.lower() if lower else data).split()  # bytes.lower() changes A-Z only
        counts[i] = len(own)
        words += own
    return words, counts


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; a run may be empty."""
    out = np.zeros((len(counts),) + values.shape[1:], np.float64 if values.dtype.kind == "f" else np.int64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fold(id_column: str | Column) -> Column:
    """The share of the data a row belongs to, 0 to 3; rows of share 2 are held out of learning."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.pmod(F.crc32(column.cast("string")), F.lit(4)).cast("int")


def held_out(id_column: str | Column) -> Column:
    """False for a null id."""
    return F.coalesce(fold(id_column) == 2, F.lit(False))


def bounded_sample(rows: DataFrame, strata: str, per_stratum: int, key: str) -> DataFrame:
    """About ``per_stratum`` rows of each of the ``MAX_STRATA`` largest strata, picked by a hash of the key.

    Only the number of rows of each stratum is counted over the whole table; the picked rows are a
    fixed set for fixed data, whatever its partitions. The result never has more than
    ``2 * per_stratum`` rows per stratum on average, and all rows of rare strata.
    """
    sizes = rows.where(F.col(strata).isNotNull()).groupBy(strata).count().orderBy(F.desc("count"), strata).limit(MAX_STRATA)
    counts = {r[0]: r[1] for r in sizes.collect()}
    if not counts:
        return rows.limit(0)
    share = F.lit(0.0)
    for value, n in sorted(counts.items()):
        share = F.when(F.col(strata) == F.lit(value), F.lit(min(1.0, per_stratum / n))).otherwise(share)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        rows.where(F.col(strata).isNotNull() & (place < share))
        .orderBy(place, F.col(key))
        .limit(2 * per_stratum * len(counts))
    )
