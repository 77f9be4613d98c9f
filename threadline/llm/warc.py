"""WARC archives: pages written as records and read back by verified record boundaries.

Writing: a record is a header, its payload, and two line ends, so a text file of such records whose
line separator is two line ends is a valid WARC file, written by Spark with its own commit protocol.
Of records with equal payloads one is a response, the others are revisits that refer to it.

Reading: the files are split by Spark at double line ends, whatever their size. Every part that
begins like a record is a candidate; its length header gives the offset of its successor. The magic
line may also stand inside a payload, so a candidate counts only if it is reachable from the start
of its file. Reachability is found by pointer jumping: candidates of a split are chained inside the
task that reads it, and the jumps from split to split are doubled until nothing new is reached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.common import prepare, stage
from threadline.session import scratch_dir

GAP = "\r\n\r\n"
#: Smaller equal payloads are stored each.
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, one row for each distinct page.

    The payload is the text in UTF-8, nothing for a null. The smallest id of equal payloads of at
    least ``revisit_bytes`` is the response. A null id is never a response that others refer to.
    """
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = stage(
        pages.select(F.col(id_column).alias("page_id"), F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest")),
        "payloads",
    )
    several = stage(
        rows.where((F.col("payload_bytes") >= revisit_bytes) & F.col("page_id").isNotNull())
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first"),
        "several",
    )
    again = (F.col("payload_bytes") >= revisit_bytes) & (F.col("first") < F.col("page_id"))
    return rows.join(several, "payload_digest", "left").select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def _uuid(name) -> F.Column:
    """A URN that depends on the page alone."""
    h = F.sha2(F.concat(F.lit("page:"), name.cast("string")), 256)
    return F.concat(
        F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-4"), h.substr(14, 3), F.lit("-8"), h.substr(18, 3), F.lit("-"),
        h.substr(21, 12), F.lit(">"),
    )


def record_text(date: str) -> F.Column:
    """The record of a row of page_id, url, html, payload_digest, record_type, refers_to, without its two line ends."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    whole = F.col("record_type") == "response"
    body = F.when(whole, F.coalesce("html", F.lit(""))).otherwise(F.lit(""))
    # Line ends inside a URL would end the header line.
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "%0A")
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _uuid(F.coalesce(F.col("page_id").cast("string"), F.lit("null")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target),
        line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.octet_length(F.coalesce("html", F.lit(""))).cast("string")),
        F.when(
            ~whole,
            F.concat(
                line("WARC-Refers-To", _uuid(F.col("refers_to"))),
                line("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
                line("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(GAP),
        body,
    )


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record for every row of ``pages`` to the (new) folder, one file for each task.

    Rows with one id must be equal; repeated rows give repeated records.
    """
    plan = plan_records(pages, id_column, html_column)
    revisits = stage(plan.where(F.col("record_type") == "revisit").select("page_id", "refers_to").distinct(), "revisits")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = (
        pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
        .join(revisits, "page_id", "left")
        .select(
            "page_id", "url", "html", F.sha2(payload, 256).alias("payload_digest"), "refers_to",
            F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        )
    )
    rows.select(record_text(date).alias("value")).write.option("lineSep", GAP).text(folder)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """The bytes between double line ends, with what a record header says if one begins there.

    A payload that ends in a line end makes the reader see the double line end two bytes early; the
    record after it then begins after ``shift`` = 2 bytes.
    """
    value = F.col("value")
    begins = F.when(value.startswith("WARC/1."), F.lit(0)).when(value.startswith("\r\nWARC/1."), F.lit(2))
    length = F.regexp_extract(value, r"(?i)\r\ncontent-length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1)
    return (
        spark.read.option("lineSep", GAP)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), begins.alias("begins"))
        .select(
            "file", "split", "value",
            F.monotonically_increasing_id().alias("seq"),
            F.octet_length("value").cast("long").alias("size"),
            F.when(F.col("begins").isNotNull(), F.nullif(length, F.lit("")).cast("long")).alias("body"),
            "begins",
        )
    )


def _leaving(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For every candidate of a split, where its chain leaves the split: pointer jumping within the split."""
    place = np.minimum(np.searchsorted(offsets, following), len(offsets) - 1)
    jump = np.where(offsets[place] == following, place, np.arange(len(offsets)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return following[jump]
        jump = further


def candidates(lines: DataFrame) -> DataFrame:
    """``file, split, offset, leaves, bytes``: candidate records and where their chains leave the split.

    Offsets count from the beginning of the first part of the split. One more row for each split,
    with a null offset, gives the bytes of all its parts.
    """
    prepare(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[tuple[str, int], int] = {}
        found: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "split", "size", "begins", "body"))
            for file, split, size, begins, body in zip(*columns, strict=True):
                key = (file, split)
                offset = at.get(key, 0)
                at[key] = offset + size + len(GAP)
                own = found.setdefault(key, [])
                if body is not None:
                    own.append((offset + begins, offset + size + len(GAP) + body + len(GAP)))
        for (file, split), own in found.items():
            offsets = np.array([o for o, _ in own], np.int64)
            leaves = _leaving(offsets, np.array([f for _, f in own], np.int64)) if own else offsets
            n = len(own)
            yield pa.RecordBatch.from_pydict(
                {
                    "file": pa.array([file] * (n + 1), pa.string()),
                    "split": pa.array([split] * (n + 1), pa.int64()),
                    "offset": pa.array([*offsets.tolist(), None], pa.int64()),
                    "leaves": pa.array([*leaves.tolist(), None], pa.int64()),
                    "bytes": pa.array([None] * n + [at[(file, split)]], pa.int64()),
                }
            )

    return lines.select("file", "split", "size", "begins", "body").mapInArrow(
        run, "file string, split long, offset long, leaves long, bytes long"
    )


def _entries(found: DataFrame) -> DataFrame:
    """``file, split, base, entry``: where each split begins, and its first reachable record if it has one.

    Besides the start of the file only candidates that a chain of another split leads to can be
    entries. Jumps between them are doubled in every round, so the rounds grow with the logarithm of
    the number of splits of a file.
    """
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        found.where(F.col("offset").isNull()).select("file", "split", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("base")),
        "warc-splits",
    )
    chained = found.where(F.col("offset").isNotNull()).join(starts, ["file", "split"]).select(
        "file", "split", (F.col("base") + F.col("offset")).alias("offset"), (F.col("base") + F.col("leaves")).alias("leaves")
    )
    led_to = chained.select("file", F.col("leaves").alias("offset")).distinct()
    nodes = stage(
        chained.join(led_to, ["file", "offset"], "left_semi").union(chained.where(F.col("offset") == 0)).distinct(), "warc-entries"
    )
    jumps = nodes.select("file", "offset", "leaves")
    reached = nodes.where(F.col("offset") == 0).select("file", "offset")
    known = -1
    while (now := reached.count()) != known:
        known = now
        onward = reached.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))
        reached = stage(
            reached.union(onward.join(nodes.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), "warc-reached"
        )
        further = jumps.select("file", F.col("offset").alias("from"), F.col("leaves").alias("offset")).join(jumps, ["file", "offset"], "left")
        jumps = stage(further.select("file", F.col("from").alias("offset"), F.coalesce("leaves", "offset").alias("leaves")), "warc-jumps")
    entry = nodes.join(reached, ["file", "offset"]).groupBy("file", "split").agg(F.min("offset").alias("entry"))
    return stage(starts.join(entry, ["file", "split"], "left"), "warc-starts")


def _cut(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """``file, offset, header, body, payload`` of the records of every split.

    A record that goes on in the next split has fewer than ``body`` bytes of payload; what stands
    before the first record of a split is a row without header, at the offset of the split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = offset = expected = current = None
        kept: list[bytes] = []
        for batch in batches:
            out: list[tuple] = []
            columns = (batch.column(c).to_pylist() for c in ("file", "split", "value", "begins", "body", "base", "entry"))
            for file, split, value, begins, body, base, entry in zip(*columns, strict=True):
                if (file, split) != key:
                    if current:
                        out.append(_record(current, kept))
                    key, offset, expected, current, kept = (file, split), base, entry, (file, base, None, None), []
                if begins is not None and body is not None and offset + begins == expected:
                    out.append(_record(current, kept))
                    current, kept = (file, expected, value[begins:], body), []
                    expected = offset + len(value) + len(GAP) + body + len(GAP)
                else:
                    kept.append(value)
                offset += len(value) + len(GAP)
            yield _rows(out)
        if current:
            yield _rows([_record(current, kept)])

    return (
        lines.select("file", "split", "seq", F.col("value").cast("binary").alias("value"), "begins", "body")
        .join(entries, ["file", "split"])
        .sortWithinPartitions("file", "split", "seq")
        .select("file", "split", "value", "begins", "body", "base", "entry")
        .mapInArrow(run, "file string, offset long, header string, body long, payload binary")
        .where(F.col("header").isNotNull() | (F.length("payload") > 0))
    )


def _record(current: tuple, kept: list[bytes]) -> tuple:
    payload = b"".join(part + GAP.encode() for part in kept)
    file, offset, header, body = current
    return file, offset, None if header is None else header.decode(errors="replace"), body, payload if body is None else payload[:body]


def _rows(out: list[tuple]) -> pa.RecordBatch:
    file, offset, header, body, payload = zip(*out, strict=True) if out else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(header, pa.string()), pa.array(body, pa.int64()), pa.array(payload, pa.binary())],
        names=["file", "offset", "header", "body", "payload"],
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``file, offset, header, payload`` of every record that is reachable from the start of its file.

    A folder without records gives no rows. A chain that leads to no candidate ends there: what
    follows a broken record is not trusted, and a record cut off by the end of its file has the
    payload that is there.
    """
    lines = _lines(spark, folder)
    entries = _entries(stage(candidates(lines), "warc-candidates"))
    # Both uses below read the archives once more; keeping the payloads would cost more disk than that saves.
    cut = _cut(lines, entries)
    whole = F.col("header").isNotNull() & (F.length("payload") >= F.col("body"))
    # Only records over the edge of a split are put together: at most two rows for each split.
    order = Window.partitionBy("file").orderBy("offset", F.col("header").isNull())
    pieces = cut.where(~whole | F.col("header").isNull()).withColumn(
        "record", F.last(F.when(F.col("header").isNotNull(), F.col("offset")), ignorenulls=True).over(order)
    )
    joined = (
        pieces.where(F.col("record").isNotNull())
        .groupBy("file", "record")
        .agg(
            F.max("header").alias("header"),
            F.max("body").alias("body"),
            F.sort_array(F.collect_list(F.struct("offset", "payload"))).alias("parts"),
        )
        .select(
            "file", F.col("record").alias("offset"), "header",
            F.expr("substring(aggregate(parts, CAST('' AS BINARY), (a, p) -> concat(a, p.payload)), 1, CAST(body AS INT))").alias("payload"),
        )
    )
    return cut.where(whole).select("file", "offset", "header", "payload").union(joined)


def header_value(name: str) -> F.Column:
    """Value of a header line of column ``header``, null if there is none."""
    value = F.regexp_extract("header", rf"(?i)(?:^|\r\n){re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(F.length(value) > 0, value)


def round_trip(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read them back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to``. For responses size and
    digest are worked out from the payload that was read; a revisit has no payload of its own and
    states those of the payload it refers to.
    """
    spark = pages.sparkSession
    folder = scratch_dir(spark, "warc")
    write_archives(pages, folder, id_column, url_column, html_column)
    read = read_archives(spark, folder)
    response = header_value("WARC-Type") == "response"
    return read.select(
        header_value("WARC-Page-ID").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(header_value("WARC-Payload-Length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.regexp_replace(header_value("WARC-Payload-Digest"), "^sha256:", "")).alias("payload_digest"),
        header_value("WARC-Type").alias("record_type"),
        header_value("WARC-Refers-To-Page").cast("long").alias("refers_to"),
    )
