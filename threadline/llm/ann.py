"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Rows are dealt to shards by a hash of their id. A task builds the hierarchical graph of one shard and
stores it as flat neighbour arrays, one table row for each shard. Every shard answers every block of
queries, and the answers of all shards are merged per query. Equal vectors of a shard are one node
with a list of ids, so large groups of copies neither break the graph nor hide one another.

Insertion and search work on many vectors at a time: the beam of every query is a row of a matrix.
Nodes of higher layers are inserted first, so that a layer is entered through the one above it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.common import list_array, prepare, stage

SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Links of a node in upper layers; twice as many in the lowest.
LINKS = 12
EF_BUILD = 64
EF_SEARCH = 256
BATCH = 512
#: Nodes of a beam that are expanded at a time.
EXPAND = 4


@dataclass
class Layer:
    """Nodes ``0..used`` of a graph in order of insertion; ``links`` holds -1 where there is none."""

    vectors: np.ndarray
    norms: np.ndarray
    links: np.ndarray
    used: int = 0

    @classmethod
    def empty(cls, vectors: np.ndarray, links: int) -> Layer:
        return cls(vectors, (vectors * vectors).sum(axis=1), np.full((len(vectors), links), -1, np.int32))

    def near(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its row of nodes (constant per query left out)."""
        return self.norms[nodes] - 2 * np.einsum("qnd,qd->qn", self.vectors[nodes], queries, optimize=True)

    def search(self, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` nearest nodes found from the entry nodes, nearest first; -1 where there are fewer."""
        count = len(queries)
        seen = np.zeros((count, self.used + 1), bool)  # the last column stands for no node
        rows = np.arange(count)[:, None]
        seen[rows, entry] = True
        beam = np.full((count, ef), -1, np.int32)
        far = np.full((count, ef), np.inf, np.float32)
        done = np.ones((count, ef), bool)
        width = min(ef, entry.shape[1])
        first = self.near(queries, entry)
        order = np.argsort(first, axis=1)[:, :width]
        beam[:, :width], far[:, :width], done[:, :width] = entry[rows, order], first[rows, order], False
        live = np.arange(count)
        while len(live):
            waiting = np.where(done[live], np.inf, far[live])
            picks = np.argpartition(waiting, min(EXPAND, ef) - 1, axis=1)[:, :EXPAND]
            chosen = np.take_along_axis(waiting, picks, 1) < np.inf
            done[live[:, None], picks] = True
            nodes = np.where(chosen, np.take_along_axis(beam[live], picks, 1), -1)
            found = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)  # a node that two expanded ones link to counts once
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            new = ~seen[live[:, None], found] & (found >= 0)
            seen[live[:, None], found] = True
            seen[:, -1] = False
            keep = new.any(axis=0)
            found, new = found[:, keep], new[:, keep]
            if found.shape[1]:
                distance = np.where(new, self.near(queries[live], found), np.inf).astype(np.float32)
                all_far = np.hstack([far[live], distance])
                best = np.argpartition(all_far, ef - 1, axis=1)[:, :ef]
                far[live] = np.take_along_axis(all_far, best, 1)
                beam[live] = np.take_along_axis(np.hstack([beam[live], np.where(new, found, -1)]), best, 1)
                done[live] = np.take_along_axis(np.hstack([done[live], ~new]), best, 1)
            live = live[(~done[live] & (far[live] < np.inf)).any(axis=1)]
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        return np.where(far < np.inf, np.take_along_axis(beam, order, 1), -1), far

    def choose(self, centers: np.ndarray, candidates: np.ndarray, links: int) -> np.ndarray:
        """Up to ``links`` of the candidates: those nearer to the centre than to any chosen before, then the nearest left."""
        distance = ((self.vectors[candidates] - centers[:, None]) ** 2).sum(axis=2)
        distance[candidates < 0] = np.inf
        order = np.argsort(distance, axis=1, kind="stable")[:, : 3 * links]
        candidates, distance = np.take_along_axis(candidates, order, 1), np.take_along_axis(distance, order, 1)
        own = self.vectors[candidates]
        square = (own * own).sum(axis=2)
        between = square[:, :, None] + square[:, None, :] - 2 * own @ own.transpose(0, 2, 1)
        rows, width = candidates.shape
        taken = np.zeros((rows, width), bool)
        closest = np.full((rows, width), np.inf)
        for k in range(width):
            good = (distance[:, k] < closest[:, k]) & (taken.sum(axis=1) < links) & (distance[:, k] < np.inf)
            taken[:, k] = good
            closest[good] = np.minimum(closest[good], between[good, k])
        rank = np.where(taken, 0, 1) * width + np.arange(width)
        rank[distance == np.inf] = 10 * width
        order = np.argsort(rank, axis=1)[:, :links]
        out = np.full((rows, links), -1, np.int32)
        picked = np.where(np.take_along_axis(rank, order, 1) < 10 * width, np.take_along_axis(candidates, order, 1), -1)
        out[:, : picked.shape[1]] = picked
        return out

    def insert(self, until: int, above: np.ndarray | None) -> None:
        """Insert the nodes up to ``until`` in batches; ``above`` gives an entry node for each of them."""
        width = self.links.shape[1]
        while self.used < until:
            first, last = self.used, min(until, self.used + max(16, min(BATCH, self.used)))
            batch = np.arange(first, last)
            own = self.vectors[batch]
            pairs = np.argsort(self.norms[batch][None, :] - 2 * own @ own.T + np.where(np.eye(len(batch), dtype=bool), np.inf, 0), axis=1)
            candidates = batch[pairs[:, : min(len(batch) - 1, width)]].astype(np.int32)
            if first:
                entry = above[batch][:, None] if above is not None else np.zeros((len(batch), 1), np.int32)
                entry = np.where(entry < first, entry, 0)
                found, _ = self.search(own, entry, EF_BUILD)
                candidates = np.hstack([found, candidates])
            self.used = last
            if candidates.shape[1]:
                links = self.choose(own, candidates, max(width // 2, 1))
                self.links[batch, : links.shape[1]] = links
                self._link_back(batch, links)

    def _link_back(self, batch: np.ndarray, links: np.ndarray) -> None:
        width = self.links.shape[1]
        source = np.repeat(batch, links.shape[1])[links.ravel() >= 0]
        target = links.ravel()[links.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        most = int(counts.max()) if len(counts) else 0
        new = np.full((len(nodes), most), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        new[np.repeat(np.arange(len(nodes)), counts), place] = source
        every = np.hstack([self.links[nodes], new])
        every.sort(axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        self.links[nodes] = self.choose(self.vectors[nodes], every, width)


@dataclass
class Graph:
    """Layers over the same nodes, the lowest first; a layer holds a leading part of them."""

    layers: list[Layer]

    @classmethod
    def build(cls, vectors: np.ndarray, links: int = LINKS) -> Graph:
        """``vectors`` in random order: the first are those of the highest layers."""
        sizes = [len(vectors)]
        while sizes[-1] > 4 * links:
            sizes.append(max(1, sizes[-1] // links))
        layers: list[Layer] = []
        for level in range(len(sizes) - 1, -1, -1):
            layer = Layer.empty(vectors[: sizes[level]], 2 * links if level == 0 else links)
            upper = cls(layers)
            if layers:
                layer.insert(sizes[level + 1], None)
                layer.insert(sizes[level], upper.enter(layer.vectors))
            else:
                layer.insert(sizes[level], None)
            layers = [layer, *layers]
        return cls(layers)

    def enter(self, queries: np.ndarray) -> np.ndarray:
        """The node nearest to each query that the layers lead to."""
        out = np.zeros(len(queries), np.int32)
        for first in range(0, len(queries), BATCH):
            part = queries[first : first + BATCH]
            entry = np.zeros((len(part), 1), np.int32)
            for layer in reversed(self.layers):
                entry = np.maximum(layer.search(part, entry, 8)[0][:, :4], entry[:, :1])
            out[first : first + BATCH] = entry[:, 0]
        return out

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """The ``k`` nearest nodes found for each query, -1 where there are fewer."""
        out = np.full((len(queries), k), -1, np.int64)
        for first in range(0, len(queries), BATCH):
            part = queries[first : first + BATCH]
            entry = Graph(self.layers[1:]).enter(part)[:, None] if len(self.layers) > 1 else np.zeros((len(part), 1), np.int32)
            found = self.layers[0].search(part, entry, max(ef, k))[0][:, :k]
            out[first : first + BATCH, : found.shape[1]] = found
        return out

    def save(self) -> bytes:
        data = io.BytesIO()
        np.savez(data, vectors=self.layers[0].vectors, **{f"links{i}": layer.links for i, layer in enumerate(self.layers)})
        return data.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as found:
            vectors, layers = found["vectors"], []
            for i in range(len(found.files) - 1):
                links = found[f"links{i}"]
                own = vectors[: len(links)]
                layers.append(Layer(own, (own * own).sum(axis=1), links, len(links)))
            return cls(layers)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector, dims`` of the rows that take part: an id, and a vector neither zero nor with null or non-finite parts."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
        .where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
        .withColumn("dims", F.size("vector"))
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def frame_of(nodes: np.ndarray) -> np.ndarray:
    """How a shard sees vectors, as (first scale, second scale, centre): see :func:`seen_as`."""
    first = float(np.abs(nodes).max(initial=0.0)) or 1.0
    centre = (nodes / first).mean(axis=0)
    second = float(np.abs(nodes / first - centre).max(initial=0.0)) or 1.0
    return np.concatenate([[first, second], centre])


def seen_as(frame: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Vectors centred and scaled in double precision, then as float32.

    Differences far from the origin would be lost in float32, and large values would overflow. A
    query far outside the shard is brought nearer along its direction, which is all that ranks it.
    """
    own = (vectors / frame[0] - frame[2:]) / frame[1]
    most = np.abs(own).max(axis=1, keepdims=True, initial=0.0)
    return np.where(most > 1e6, own * (1e6 / np.maximum(most, 1e6)), own).astype(np.float32)


def distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; squares that would leave its range are scaled first.

    A distance beyond the largest double is infinite.
    """
    with np.errstate(over="ignore"):
        apart = np.abs(rows - point)
    most = float(apart.max(initial=0.0))
    if not np.isfinite(most):  # ends of opposite sign near the largest double
        apart, most = np.abs(rows / 2 - point / 2), 0.0
        scale = float(apart.max()) or 1.0
        with np.errstate(over="ignore"):
            return 2 * (scale * np.sqrt(((apart / scale) ** 2).sum(axis=1)))
    if most > 1e150 or 0 < most < 1e-140:
        with np.errstate(over="ignore"):
            return most * np.sqrt(((apart / most) ** 2).sum(axis=1))
    return np.sqrt((apart**2).sum(axis=1))


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, links: int = LINKS, copies: int | None = None) -> DataFrame:
    """``dims, shard, graph, frame, exact, ids, id_counts``: one row for each shard.

    The number of shards follows from the number of rows; vectors of different length are in
    different shards. ``copies``: so many of the smallest ids of
    equal vectors are stored (all by default); more than a query asks for are never returned.
    """
    prepare(rows.sparkSession)
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.select("dims", F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), F.lit(shards)).alias("shard"), "vec_id", "vector")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches)).sort_by("vec_id")
        dims = own.column("dims")[0].as_py()
        ids, exact = own.column("vec_id").to_numpy(), _matrix(own.column("vector"), dims)
        exact += 0.0  # no negative zeros
        keys = exact.view(np.void if dims == 0 else f"V{8 * dims}").ravel()
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        # Random order, fixed by the ids.
        shuffle = np.random.default_rng(int(ids[0]) & 0xFFFFFFFF).permutation(len(first))
        node_of = np.empty(len(first), np.int64)
        node_of[shuffle] = np.arange(len(first))
        nodes = exact[first[shuffle]]
        lists: list[list[int]] = [[] for _ in range(len(first))]
        for node, vec_id in zip(node_of[group].tolist(), ids.tolist(), strict=True):
            if (not lists[node] or lists[node][-1] != vec_id) and (copies is None or len(lists[node]) < copies):
                lists[node].append(vec_id)
        frame = frame_of(nodes)
        graph = Graph.build(seen_as(frame, nodes), links)
        yield pa.RecordBatch.from_pydict(
            {
                "dims": pa.array([dims], pa.int32()),
                "shard": own.column("shard").slice(0, 1).combine_chunks(),
                "graph": pa.array([graph.save()], pa.binary()),
                "frame": pa.array([frame.tobytes()], pa.binary()),
                "exact": pa.array([nodes.tobytes()], pa.binary()),
                "ids": list_array(np.array([sum(map(len, lists))]), np.array([i for x in lists for i in x], np.int64), pa.int64()),
                "id_counts": list_array(np.array([len(lists)]), np.array(list(map(len, lists)), np.int64), pa.int64()),
            }
        )

    return dealt.groupBy("dims", "shard").applyInArrow(
        build, "dims int, shard long, graph binary, frame binary, exact binary, ids array<long>, id_counts array<long>"
    )


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, ef: int = EF_SEARCH, block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query (vec_id, vector, dims).

    Ties go to the smaller id; a query's own id is left out; with fewer candidates all are returned.
    """
    prepare(queries.sparkSession)
    count = max(1, -(-queries.count() // block))
    asked = queries.select("dims", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(count)).alias("block"), "vec_id", "vector")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(batches)).sort_by("vec_id")
        dims = own.column("dims")[0].as_py()
        ids, at = np.unique(own.column("vec_id").to_numpy(), return_index=True)
        yield pa.RecordBatch.from_pydict(
            {
                "dims": pa.array([dims], pa.int32()),
                "block": own.column("block").slice(0, 1).combine_chunks(),
                "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "query_vectors": pa.array([_matrix(own.column("vector"), dims)[at].tobytes()], pa.binary()),
            }
        )

    blocks = stage(asked.groupBy("dims", "block").applyInArrow(packed, "dims int, block long, query_ids binary, query_vectors binary"), "ann-queries")
    pairs = (
        index.select("dims", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("block"), "graph", "frame", "exact", "ids", "id_counts")
        .join(blocks, ["dims", "block"])
        .select("dims", "graph", "frame", "exact", "ids", "id_counts", "query_ids", "query_vectors")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dims = row["dims"]
                exact = np.frombuffer(row["exact"], np.float64).reshape(-1, dims)
                query_ids = np.frombuffer(row["query_ids"], "<i8")
                wanted = np.frombuffer(row["query_vectors"], np.float64).reshape(-1, dims)
                cuts = np.concatenate([[0], np.cumsum(row["id_counts"])])
                ids = np.array(row["ids"], np.int64)
                # The whole beam is ranked exactly: the graph's own distances only lead to it.
                asked = seen_as(np.frombuffer(row["frame"], np.float64), wanted)
                nodes = Graph.load(row["graph"]).search(asked, max(ef, k + 1), ef)
                smallest = ids[cuts[:-1]]
                out: list[tuple[int, int, float]] = []
                for q, query_id in enumerate(query_ids.tolist()):
                    own = nodes[q][nodes[q] >= 0]
                    score = distances(exact[own], wanted[q])
                    order = np.lexsort((smallest[own], score))[: k + 1]
                    last = score[order[-1]]
                    order = np.flatnonzero(score <= last)  # with all ties of the last
                    every = [
                        (s, i)
                        for n, s in zip(own[order].tolist(), score[order].tolist(), strict=True)
                        for i in ids[cuts[n] : cuts[n + 1]][: k + 1].tolist()
                    ]
                    out += [(query_id, i, s) for s, i in sorted(every) if i != query_id][:k]
                a, b, c = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_pydict(
                    {"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())}
                )

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", ef: int = EF_SEARCH,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` by Euclidean distance for every row of ``queries``.

    Rows whose id is null, or whose vector is null, zero or has null or non-finite parts, take no
    part on either side. Rows with one id count once. A query finds vectors of its own length only.
    Empty tables give no rows.
    """
    index = stage(build_index(usable(vectors, id_column, vector_column), shard_rows, copies=k + 1), "ann-index")
    return search_index(index, usable(queries, id_column, vector_column), k, ef)
