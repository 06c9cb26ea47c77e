"""Approximate nearest neighbours by a forest of random-projection trees.

A tree has orthonormal random directions, one for each level, and cuts every node of a level at the median of the level's projection. The
cuts are fitted on a bounded sample; every vector is put into its leaf of every tree. A query searches all trees at once through one
priority queue: the nearest open branch is taken next, where the distance of a branch is the sum of the squared margins to the cuts
that lie between (orthonormal directions make that a lower bound of the squared distance). It goes on until the leaves taken hold enough
candidates, which are then ranked by their exact cosines.

How many are enough is measured, not set: for a bounded sample of the queries the exact neighbours are found by brute force, and the
search is made as long as those need to be found with the wanted recall. Vectors that are equal are one node; a node keeps
as many of its smallest ids as a result can use.

Leaves are searched in blocks: subtrees of a size that a task can hold. Where more queries or vectors meet in a block than that, it is dealt to
several tasks as pieces of either side. A query has one short list of the best from each block it looks into.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import scratch, table

TREES = 8
#: Vectors of a leaf, as far as the sample allows; vectors that the cuts are fitted on (no more than a block's), and the least of these in a leaf.
LEAF = 64
SAMPLE = 1 << 16
LEAST = 8
#: Bytes of the vectors of a block, queries that a task compares with it, and cosines that are held at once.
BLOCK_BYTES = 1 << 25
PIECE = 1024
HELD = 1 << 22
#: Queries whose exact neighbours are looked up to measure recall, the recall asked for, and the fewest candidates of a search.
PROBES = 256
RECALL = 0.96
FEWEST = 512


class Forest:
    def __init__(self, sample: np.ndarray, n: int, width: int, trees: int = TREES) -> None:
        """sample: (rows, width) of unit vectors, out of n."""
        leaves = min(max(n / LEAF, 1), max(len(sample) / LEAST, 1))
        self.depth = int(min(np.ceil(np.log2(leaves)), width))
        self.trees, self.width = trees, width
        random = np.random.default_rng([11, width])
        directions = [np.linalg.qr(random.standard_normal((width, width)))[0][:, : self.depth] for _ in range(trees)]
        self.directions = np.stack(directions) if self.depth else np.zeros((trees, width, 0))
        #: cuts[tree][level] by the node's number in its level
        self.cuts = [self._cuts(sample @ own) for own in self.directions]

    def _cuts(self, projected: np.ndarray) -> list[np.ndarray]:
        cuts, node = [], np.zeros(len(projected), np.int64)
        for level in range(self.depth):
            values = projected[:, level]
            order = np.lexsort((values, node))
            begins = np.searchsorted(node[order], np.arange((1 << level) + 1))
            middle = (begins[:-1] + begins[1:]) // 2
            held = begins[1:] > begins[:-1]
            own = np.zeros(1 << level)
            own[held] = values[order[middle[held]]]
            cuts.append(own)
            node = node * 2 + (values >= own[node])
        return cuts

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each vector."""
        out = np.zeros((len(x), self.trees), np.int32)
        for tree in range(self.trees):
            projected, node = x @ self.directions[tree], np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = node * 2 + (projected[:, level] >= self.cuts[tree][level][node])
            out[:, tree] = node
        return out

    def search(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf), nearest first: one queue for all trees."""
        projected = [(vector @ own).tolist() for own in self.directions]
        queue = [(0.0, tree, 0, 0) for tree in range(self.trees)]
        while queue:
            distance, tree, level, node = heapq.heappop(queue)
            own, cuts = projected[tree], self.cuts[tree]
            while level < self.depth:
                margin = own[level] - cuts[level][node]
                near = margin >= 0
                level += 1
                heapq.heappush(queue, (distance + margin * margin, tree, level, 2 * node + (not near)))
                node = 2 * node + near
            yield tree, node


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """The vectors (as bytes of doubles) as rows of length 1."""
    x = np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(rows: DataFrame) -> DataFrame:
    """id, vec (bytes of doubles) of rows (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            values = np.asarray(v.flatten(), np.float64) + 0.0
            ends = (np.asarray(v.offsets) - v.offsets[0].as_py()).astype(np.int64) * 8
            vec = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), vec.cast(pa.binary())], names=["id", "vec"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vec binary")


def usable_rows(vectors: DataFrame) -> DataFrame:
    """id, vec of the rows whose vector is neither null, empty or zero nor holds null or non-finite components."""
    values = F.col("embedding").cast("array<double>")
    usable = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").alias("id"), F.when(F.coalesce(usable, F.lit(False)), values).alias("v"))
    return _packed(rows.where("v is not null"))


def nodes_of(vectors: DataFrame, kept: int) -> DataFrame:
    """node, vec, width, ids of the distinct usable vectors; ids: the ``kept`` smallest vec_ids, null last, repeated ones repeated.

    A vector's rows are cut to the smallest ids in the tasks that read them, before the shuffle.
    """
    rows = usable_rows(vectors)
    smallest = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))
    few = rows.withColumn("place", smallest).where(F.col("place") <= kept)
    ids = F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"])
    return few.groupBy("vec").agg(ids.alias("ids")).select(
        F.monotonically_increasing_id().alias("node"), "vec", (F.octet_length("vec") / 8).cast("int").alias("width"), "ids"
    )


def _best(scores: np.ndarray, x: np.ndarray, y: np.ndarray, node: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k best of each row of scores; the cosines that count are taken pair by pair, always in the same order of terms."""
    if scores.shape[1] > k:
        bar = np.partition(scores, -k, axis=1)[:, -k] - 1e-12
        at = np.nonzero(scores >= bar[:, None])
    else:
        at = tuple(i.reshape(-1) for i in np.indices(scores.shape))
    row, column = at
    exact = np.einsum("ij,ij->i", x[row], y[column])
    exact = np.where(np.isneginf(scores[at]), -np.inf, exact)
    order = np.lexsort((node[column], least[column], -exact, row))
    row, column, exact = row[order], column[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    some = (place < k) & np.isfinite(exact)
    return row[some], column[some], exact[some]


def _least():
    """A node's smallest id, for ties; a null one comes last."""
    return F.coalesce(F.col("ids")[0].cast("long"), F.lit((1 << 63) - 1)).alias("least")


def _true_neighbours(nodes: DataFrame, probes: list[tuple[int, bytes]], width: int, k: int) -> DataFrame:
    """query, vec of the k nearest other nodes of each probe, by brute force."""
    own = np.array([node for node, _ in probes], np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast((own, unit_rows(pa.array([vec for _, vec in probes], pa.binary()), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y, node = unit_rows(batch.column("vec"), width), batch.column("node").to_numpy()
            scores = np.where(own[:, None] == node[None, :], -np.inf, x @ y.T)
            row, column, exact = _best(scores, x, y, node, node, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[row]), pa.array(exact), pa.array(node[column]), batch.column("vec").take(pa.array(column))],
                names=["query", "score", "node", "vec"],
            )

    found = nodes.select("node", "vec").mapInArrow(run, "query long, score double, node long, vec binary")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "vec")


def _needed(nodes: DataFrame, queries: DataFrame, forest, counts, width: int, k: int, recall: float) -> int:
    """Candidates that a search has to see so that the wanted part of the exact neighbours of a sample of the queries is among them."""
    probes = queries.orderBy(F.xxhash64("vec"), "node").limit(PROBES).select("node", "vec").collect()
    truth = _true_neighbours(nodes, [(r["node"], bytes(r["vec"])) for r in probes], width, k)
    listed = truth.groupBy("query").agg(F.collect_list("vec").alias("found"))
    # a probe has at most k neighbours; its search is done in the task that holds it
    rows = listed.join(queries.select(F.col("node").alias("query"), "vec"), "query").select("vec", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes = forest.value, counts.value
        for batch in batches:
            needed: list[int] = []
            for x, found in zip(unit_rows(batch.column("vec"), width) if batch.num_rows else [], batch.column("found").to_pylist(), strict=True):
                at = trees.leaves(unit_rows(pa.array(found, pa.binary()), width))
                wanted = {(tree, leaf): [] for row in at.tolist() for tree, leaf in enumerate(row)}
                for i, row in enumerate(at.tolist()):
                    for tree, leaf in enumerate(row):
                        wanted[tree, leaf].append(i)
                left, seen = set(range(len(found))), 0
                for tree, leaf in trees.search(x):
                    seen += int(sizes[tree][leaf])
                    for i in wanted.get((tree, leaf), ()):
                        if i in left:
                            left.remove(i)
                            needed.append(seen)
                    if not left:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(needed, pa.int64())], names=["needed"])

    efforts = np.sort(np.array([r["needed"] for r in rows.mapInArrow(run, "needed long").collect()], np.int64))
    return int(efforts[int(np.ceil(recall * len(efforts))) - 1]) if len(efforts) else 0


def _visits(queries: DataFrame, forest, counts, width: int, span: int, enough: int) -> DataFrame:
    """query, vec, tree, block, leaves: what each query takes from the queue, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sizes = forest.value, counts.value
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                row, tree_of, block_of, leaves_of = [], [], [], []
                for i, x in enumerate(unit_rows(batch.column("vec"), width)):
                    seen, taken = 0, {}
                    for tree, leaf in trees.search(x):
                        taken.setdefault((tree, leaf // span), []).append(leaf)
                        seen += int(sizes[tree][leaf])
                        if seen >= enough:
                            break
                    for (tree, block), leaves in taken.items():
                        row.append(i)
                        tree_of.append(tree)
                        block_of.append(block)
                        leaves_of.append(leaves)
                part = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("vec"), pa.array(tree_of, pa.int32()), pa.array(block_of, pa.int32()), pa.array(leaves_of, pa.list_(pa.int32()))],
                    names=["query", "vec", "tree", "block", "leaves"],
                )

    return queries.select("node", "vec").mapInArrow(run, "query long, vec binary, tree int, block int, leaves array<int>")


def _candidates(placed: DataFrame, queries: DataFrame, forest, counts, span: int, width: int, enough: int, k: int) -> DataFrame:
    """query, node, score: the k best other nodes of each query in the leaves it takes."""
    by = ["tree", "block"]
    visits = scratch(_visits(queries, forest, counts, width, span, enough))
    each = F.posexplode("leaves").alias("tree", "leaf")
    members = placed.select("node", "vec", _least(), each).withColumn("block", F.floor(F.col("leaf") / span).cast("int"))
    most = block_rows(width)
    held = members.groupBy(*by).agg(F.ceil(F.count("*") / (2 * most)).alias("parts"))
    met = visits.groupBy(*by).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    sizes = scratch(held.join(met, by))
    upto = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias(name)
    left = visits.join(sizes, by).select(*by, F.pmod(F.xxhash64("query"), "pieces").alias("piece"), upto("parts", "part"), "query", "vec", "leaves")
    right = members.join(sizes, by).select(*by, upto("pieces", "piece"), F.pmod(F.xxhash64("node"), "parts").alias("part"), "node", "vec", "least", "leaf")

    def compare(asked: pa.Table, there: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and there.num_rows:
            there = there.sort_by("leaf")
            query, node = asked.column("query").to_numpy(), there.column("node").to_numpy()
            least, leaf = there.column("least").to_numpy(), there.column("leaf").to_numpy()
            x, y = unit_rows(asked.column("vec"), width), unit_rows(there.column("vec"), width)
            lists = asked.column("leaves").combine_chunks()
            row = np.repeat(np.arange(len(query)), np.diff(np.asarray(lists.offsets)))
            taken = np.asarray(lists.flatten())
            order = np.argsort(taken, kind="stable")
            row, taken = row[order], taken[order]
            for one in np.unique(taken).tolist():
                own = slice(np.searchsorted(leaf, one), np.searchsorted(leaf, one, "right"))
                if own.start == own.stop:
                    continue
                asks = row[np.searchsorted(taken, one) : np.searchsorted(taken, one, "right")]
                step = max(1, HELD // (own.stop - own.start))
                for i in (asks[begin : begin + step] for begin in range(0, len(asks), step)):
                    scores = np.where(query[i][:, None] == node[own][None, :], -np.inf, x[i] @ y[own].T)
                    at, to, exact = _best(scores, x[i], y[own], node[own], least[own], k)
                    out.append((query[i][at], node[own][to], exact, least[own][to]))
            if out:  # the best of all leaves of the block
                asked_by, to, exact, first = (np.concatenate(c) for c in zip(*out, strict=True))
                order = np.lexsort((to, first, -exact, asked_by))
                asked_by, to, exact = asked_by[order], to[order], exact[order]
                some = np.arange(len(order)) - np.searchsorted(asked_by, asked_by) < k
                return pa.table({"query": asked_by[some], "node": to[some], "score": exact[some]})
        return pa.table({"query": np.empty(0, np.int64), "node": np.empty(0, np.int64), "score": np.empty(0)})

    keys = [*by, "piece", "part"]
    columns = lambda names: [F.col(c).alias(c) for c in names]  # noqa: E731 - aliases keep the two sides' columns apart
    both = left.select(*columns([*keys, "query", "vec", "leaves"])).groupBy(*keys).cogroup(
        right.select(*columns([*keys, "node", "vec", "least", "leaf"])).groupBy(*keys)
    )
    # the same pair has the same score wherever it is compared
    return both.applyInArrow(compare, "query long, node long, score double").distinct()


def block_rows(width: int) -> int:
    return max(1, BLOCK_BYTES // (8 * width))


def _searched(nodes: DataFrame, holding: DataFrame, width: int, k: int, recall: float) -> DataFrame:
    """node, near: for each node of ``holding`` its own cosine and ids and those of the k + 1 best other nodes found, as (score, ids)."""
    context = nodes.sparkSession.sparkContext
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("vec"), "node").limit(min(SAMPLE, block_rows(width))).select("vec").toArrow().column("vec")
    fitted = Forest(unit_rows(sample, width), n, width)
    forest = context.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unit_rows(batch.column("vec"), width)
                found = forest.value.leaves(x)
                offsets = np.arange(0, found.size + 1, found.shape[1], dtype=np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, leaves, pa.array(np.einsum("ij,ij->i", x, x))], names=[*batch.schema.names, "leaves", "own"]
                )

    kind = nodes.schema["ids"].dataType.simpleString()
    schema = f"node long, vec binary, ids {kind}, leaves array<int>, own double"
    placed = scratch(nodes.select("node", "vec", "ids").mapInArrow(place, schema))
    sizes = np.zeros((fitted.trees, 1 << fitted.depth), np.int64)
    for r in placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect():
        sizes[r["tree"], r["leaf"]] = r["count"]
    counts = context.broadcast(sizes)
    queries = scratch(placed.join(holding, "node", "left_semi"))
    enough = max(FEWEST, _needed(placed, queries, forest, counts, width, k, recall))
    leaves = 1 << fitted.depth
    span = max(1, min(leaves, int(block_rows(width) * leaves / max(n, 1))))
    found = _candidates(placed, queries, forest, counts, span, width, enough, k + 1)
    named = found.join(placed.select("node", "ids", _least()), "node")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "least", "node"))
    others = named.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    joined = queries.select("node", F.struct(F.col("own").alias("score"), "ids").alias("self")).join(others.withColumnRenamed("query", "node"), "node", "left")
    return joined.select("node", "self", F.coalesce("near", F.expr(f"cast(array() as array<struct<score: double, ids: {kind}>>)")).alias("near"))


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the largest cosine found for each row of vectors (vec_id, embedding) that ``is_query`` holds for.

    ``is_query`` is a function of the column of an id. Cosines are in double precision; ties go to the smaller vec_id, null last. A row
    is no neighbour of itself, but other rows with an equal vector are, also those of the same id. Where there are fewer than k
    candidates all are returned. Null, empty and zero vectors and those with null or non-finite components take no part, and vectors of
    different lengths are no neighbours: each length has a forest, one after the other. A query row that is repeated has its rows
    repeated. An empty table gives an empty result; more columns of vectors are ignored.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    nodes = scratch(nodes_of(vectors, k + 1))
    result = vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    asked = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    asking = usable_rows(vectors.where(asked)).join(nodes.select("vec", "node", "width"), "vec")
    asking = scratch(asking.select("id", "node", "width"))
    for width in sorted(r["width"] for r in asking.select("width").distinct().collect()):
        rows = asking.where(F.col("width") == width).select("id", "node")
        found = scratch(_searched(nodes.where(F.col("width") == width), rows.select("node").distinct(), width, k, recall))
        result = result.unionByName(_ranked(rows.join(found, "node"), k))
    return result


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query row (id, self, near), whose own row is left out once."""
    place = F.array_position("self.ids", F.col("id")).cast("int")
    mine = F.when(place > 0, F.concat(F.slice("self.ids", 1, F.greatest(place - 1, F.lit(0))), F.slice("self.ids", place + 1, k + 1))).otherwise(F.col("self.ids"))
    rows = F.concat(F.array(F.struct(F.col("self.score").alias("score"), mine.alias("ids"))), "near")
    each = F.flatten(
        F.transform(rows, lambda n: F.transform(n["ids"], lambda i: F.struct((-n["score"]).alias("key"), i.isNull().alias("last"), i.alias("vec_id"))))
    )
    best = F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("place", "best")
    return found.select(F.col("id").alias("query_id"), best).select(
        "query_id", (F.col("place") + 1).alias("rank"), F.col("best.vec_id").alias("vec_id"), (-F.col("best.key")).alias("score")
    )


def op11_neighbours(spark, folder) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), lambda i: i % 50 == 0)
