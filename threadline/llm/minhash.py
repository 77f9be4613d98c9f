"""Near-duplicate documents by min-max hashing of their word shingles.

1. One scan gives every document the size and a 128-bit key of its set of shingles and the hashes
   of its signature bands. Min-max hashing keeps the smallest and the largest value under each
   permutation, so 64 permutations give 128 signature values.
2. Documents with the same set form a class; its smallest id stands for it.
3. Classes that share a band are candidates. Components of the candidate graph (each bucket joined
   to its smallest member) are clusters; every pair of candidates lies within one.
4. The full sets of the documents of clusters are compared inside tasks. A cluster is cut into
   blocks of about ``block`` documents or ``block_shingles`` shingles, whatever is less; a task
   group holds two blocks. First the blocks are compared with the first one, and what is linked is
   joined. Then only documents outside the largest component of their cluster meet all others.
   A group emits a spanning forest of its links, never its pairs.
5. Components of the links, carried over to all documents of the classes.

With bands of 6 of 126 values a pair at the threshold of 0.85 is missed by all bands with a
probability of 5e-5, and in a group a single remaining path is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.common import WordTable, list_array, long_array, map_batches, stage
from threadline.llm.components import components
from threadline.llm.shingles import band_hashes, min_max_signatures, set_keys, shingle_sets, word_hashes

PERMUTATIONS = 64
BAND_ROWS = 6
BLOCK = 128
BLOCK_SHINGLES = 1 << 18
#: Columns of the 0/1 matrix multiplied at a time when a group is compared.
COLUMNS = 4096


def fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS
) -> DataFrame:
    """``id, n_shingles, key_a, key_b, bands`` of every row; a set without shingles has no bands."""

    def start():
        table = WordTable(word_hashes)

        def each(batch):
            values, sizes = shingle_sets(batch, text_column, table)
            high, low = set_keys(values, sizes)
            bands = band_hashes(min_max_signatures(values, sizes, permutations), band_rows)
            counts = np.where(sizes > 0, bands.shape[1], 0)
            return {
                "id": batch.column(id_column).cast(pa.int64()),
                "n_shingles": long_array(sizes),
                "key_a": long_array(high),
                "key_b": long_array(low),
                "bands": list_array(counts, bands[sizes > 0].ravel(), pa.int64()),
            }

        return each

    return map_batches(
        docs.select(id_column, text_column), start, "id long, n_shingles long, key_a long, key_b long, bands array<long>"
    )


def shingle_tables(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, n, shingles`` with the whole set as little-endian 64-bit numbers in ascending order."""

    def start():
        table = WordTable(word_hashes)

        def each(batch):
            values, sizes = shingle_sets(batch, text_column, table)
            cuts = np.concatenate([[0], np.cumsum(sizes)])
            sets = [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return {"id": batch.column(id_column).cast(pa.int64()), "n": long_array(sizes), "shingles": pa.array(sets, pa.binary())}

        return each

    return map_batches(docs.select(id_column, text_column), start, "id long, n long, shingles binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.full(len(counts), -1)
    column[counts > 1] = np.arange((counts > 1).sum())  # what only one set has is in no intersection
    codes = column[codes]
    owner, codes = owner[codes >= 0], codes[codes >= 0]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    out = np.zeros((len(sets), len(sets)))
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        a, b = np.searchsorted(codes, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], codes[a:b] - first] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def forest(ids: np.ndarray, names: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what ``linked`` joins and ``names`` does not join yet."""
    parent = {n: n for n in names.tolist()}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        a, b = root(int(names[i])), root(int(names[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((int(ids[i]), int(ids[j])))
    return links


def _compare(groups: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` found within the groups (columns cluster, left, right, id, name, n, shingles)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        n = rows.column("n").to_numpy()
        names = rows.column("name").to_numpy()
        links = []
        if len(set(names.tolist())) > 1:
            sets = [np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()]
            shared = shared_counts(sets)
            linked = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
            links = forest(rows.column("id").to_numpy(), names, linked)
        yield pa.RecordBatch.from_pydict(
            {"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())}
        )

    return groups.groupBy("cluster", "left", "right").applyInArrow(compare, "a long, b long")


def _salt(column: str, blocks) -> F.Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.col(column)), blocks)


def confirmed_links(sets: DataFrame, percent: int, block: int, block_shingles: int) -> DataFrame:
    """Links ``a, b`` that join all pairs of a cluster with a similarity of ``percent`` or more.

    ``sets``: cluster, id, n, shingles.
    """
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("long")
    sizes = stage(sets.groupBy("cluster").agg(blocks.alias("blocks")), "clusters")
    dealt = stage(
        sets.join(sizes, "cluster").select("cluster", "blocks", "id", "n", "shingles", _salt("id", F.col("blocks")).alias("own")),
        "blocks",
    )
    # The first block meets all blocks.
    partners = F.when(F.col("own") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = stage(
        _compare(
            dealt.select("cluster", F.explode(partners).alias("right"), "id", "n", "shingles").select(
                "cluster", F.lit(0).cast("long").alias("left"), "right", "id", F.col("id").alias("name"), "n", "shingles"
            ),
            percent,
        ),
        "links",
    )
    large = dealt.where(F.col("blocks") > 1)
    if large.isEmpty():
        return first
    joined = components(first)
    named = stage(
        large.join(joined.withColumnRenamed("node", "id"), "id", "left").select(
            "cluster", "blocks", "id", "n", "shingles", "own", F.coalesce("component", "id").alias("name")
        ),
        "named",
    )
    # What lies outside the largest component of its cluster meets everything.
    tally = named.groupBy("cluster", "blocks", "name").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("volume"))
    tops = stage(
        tally.groupBy("cluster", "blocks").agg(
            F.max(F.struct("members", "name"))["name"].alias("top"),
            F.greatest(
                F.ceil((F.sum("members") - F.max("members")) / block), F.ceil(F.sum("volume") / block_shingles)
            ).cast("long").alias("rest_blocks"),
            (F.count(F.lit(1)) > 1).alias("open"),
        ),
        "tops",
    )
    faced = stage(
        named.join(tops.where("open").select("cluster", "top", "rest_blocks"), "cluster"), "faced"
    )
    columns = ("cluster", "left", "right", "id", "name", "n", "shingles")
    everyone = faced.select(
        "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rest_blocks") - 1)).alias("left"), F.col("own").alias("right"),
        "id", "name", "n", "shingles",
    ).select(*columns)
    rest = faced.where(F.col("name") != F.col("top")).select(
        "cluster", "own", _salt("id", F.col("rest_blocks")).alias("left"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("right"), "id", "name", "n", "shingles",
    ).select(*columns)
    second = stage(_compare(everyone.union(rest), percent), "links")
    return first.union(second)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    percent: int = 85,
    permutations: int = PERMUTATIONS,
    band_rows: int = BAND_ROWS,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A null or wordless text has an empty set, is linked with nothing and is kept. Repeated rows get
    the same answer each. A row whose id is null is linked with nothing: its component is null and
    it is kept. If one id has several texts they count as one document that has the links of all.
    """
    prints = stage(fingerprints(docs, id_column, text_column, permutations, band_rows), "prints")
    known = prints.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = stage(
        known.groupBy("key_a", "key_b").agg(F.min("id").alias("class"), (F.max("id") > F.min("id")).alias("several")),
        "classes",
    )
    several = classes.where("several").select("key_a", "key_b", "class")
    members = stage(
        prints.select("id", "n_shingles", "key_a", "key_b")
        .join(several, ["key_a", "key_b"], "left")
        .select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class")),
        "members",
    )
    heads = known.join(
        several.select(F.col("key_a"), F.col("key_b"), "class"), ["key_a", "key_b"], "left"
    ).where(F.col("class").isNull() | (F.col("class") == F.col("id")))
    entries = stage(heads.select("id", F.posexplode("bands").alias("band", "hash")), "entries")
    buckets = stage(
        entries.groupBy("band", "hash").agg(F.min("id").alias("pivot"), (F.max("id") > F.min("id")).alias("open")).where("open").drop("open"),
        "buckets",
    )
    near = entries.join(buckets, ["band", "hash"]).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    clusters = stage(components(near), "clusters").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    wanted = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).join(clusters, "id", "left_semi")
    sets = stage(shingle_tables(wanted, "id", "text").where(F.col("n") > 0).join(clusters, "id"), "sets")
    joined = components(confirmed_links(sets, percent, block, block_shingles))
    component = F.coalesce("component", "class", "id")
    return (
        members.join(joined.withColumnRenamed("node", "class"), "class", "left")
        .select(
            F.col("id").alias(id_column),
            "n_shingles",
            component.alias("component_id"),
            (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
        )
    )
