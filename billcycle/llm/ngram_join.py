"""Jaccard self-join of documents on word n-grams: a blocked sparse product of the document by n-gram incidence.

The product is cut by columns. All documents share one order of the n-grams, from rare to frequent (by a fixed-size
count sketch of the whole corpus, then by hash). Two sets of similarity t overlap in the first |x| - ceil(t|x|) + 1
n-grams of each (the size-derived bound), so only this rare block of columns is multiplied in Spark, by n-gram. A
pair that it finds is kept if the sizes still allow t and then gets the overlap count of all columns, in blocks of pairs.

Columns may hold a third of all documents, so no column emits all its pairs. First each document is multiplied with one
leader of each of its columns and the links found are contracted to components; then only pairs of different components are left,
and of these every pair is multiplied, so the components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from billcycle.llm.common import SPACE, Words, grams, mixed, scratch, steps, table, texts_of, union_find_table

#: Counters of the sketch that orders the n-grams, and those of one row on its way to the sum.
SKETCH = 1 << 20
SLICE = 1 << 14
#: Bits of the filter by which a task knows the sets that may have a partner.
FILTER_BITS = 1 << 24
#: Rows of one column that are held together, or four times the sketch's mean if that is more (a 2^18th of all n-grams); by the
#: sketch, a column that may have more is cut into parts by node.
COLUMN = 1 << 16
#: Sets that a task remembers to have sent already.
SEEN = 200_000
#: Nodes of one side of a block in which a component's links are counted.
SIDE = 256


def set_sizes(n: int):
    """Function of a batch's texts that yields (row, sorted distinct n-gram hashes, id of the set)."""
    words = Words(SPACE)

    def sets(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, int]]:
        hashed, where = words.hashes(texts)
        cuts = np.searchsorted(where, np.arange(len(texts) + 1)).tolist()
        all_grams = grams(hashed, n)
        for i in range(len(texts)):
            size = cuts[i + 1] - cuts[i]
            if size >= n:
                found = all_grams[cuts[i] : cuts[i + 1] - n + 1]
            else:
                found = grams(hashed[cuts[i] : cuts[i + 1]], size or 1)
            found = np.sort(found)
            if len(found) > 1:
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
            # equal sets have equal ids: two independent sums over the members, and their number
            once = int(found.sum(dtype=np.uint64)) * 0x9E6C63D0876A9A47
            twice = int(np.bitwise_xor.reduce(mixed(found), initial=np.uint64(0))) + len(found) * 0xA24BAED4963EE407
            key = (once ^ twice) & ((1 << 64) - 1)
            yield i, found, key - (key >> 63 << 64)

    return sets


def _needed(size: int, percent: int) -> int:
    """Least overlap that a set of this size has with any partner: ceil(t * size)."""
    return -(-percent * size // 100)


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    """A row (doc_id, n_shingles, node) for each document and, from every task, the slices of its n-gram counts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = set_sizes(n), np.zeros(SKETCH, np.int64)
        names = ["doc_id", "n_shingles", "node", "slice", "counts"]
        for batch in steps(batches):
            sizes, nodes = [], []
            for _, found, key in sets(texts_of(batch)):
                sizes.append(len(found))
                nodes.append(key)
                np.add.at(counts, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.nulls(size, pa.int32()),
                    pa.nulls(size, pa.binary()),
                ],
                names=names,
            )
        if counts.any():
            many = SKETCH // SLICE
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(many, id_type),
                    pa.nulls(many, pa.int64()),
                    pa.nulls(many, pa.int64()),
                    pa.array(range(many), pa.int32()),
                    pa.array([zlib.compress(x.tobytes(), 1) for x in counts.reshape(many, SLICE)], pa.binary()),
                ],
                names=names,
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles long, node long, slice int, counts binary"
    )


def _sketch(slices: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts; its size is fixed, so it may come to the driver and go to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(own), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
            names=["slice", "counts"],
        )

    out = np.zeros((SKETCH // SLICE, SLICE), np.int64)
    for k, own in slices.select("slice", "counts").repartition("slice").mapInArrow(run, "slice int, counts binary").collect():
        out[k] = np.frombuffer(own, np.int64)
    return out.reshape(-1)


def _rare_block(docs: DataFrame, n: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """gram, part, cut, node, size, pos: the rarest n-grams of every set in order, as many as the bound asks for.

    A column that may have too many rows is cut into parts by node; the sketch never counts fewer than there are.
    """
    shared, most = docs.sparkSession.sparkContext.broadcast(sketch), max(COLUMN, 4 * int(sketch.mean()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, order, seen = set_sizes(n), shared.value, set()
        for batch in steps(batches):
            members, parts, cut, nodes, sizes, places = [], [], [], [], [], []
            for _, found, key in sets(texts_of(batch)):
                if not len(found) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                count = np.take(order, (found & np.uint64(SKETCH - 1)).astype(np.int64))
                first = np.argsort(count, kind="stable")[: len(found) - _needed(len(found), percent) + 1]
                own = found[first]
                several = -(-count[first] // most)
                members.append(own)
                parts.append(np.mod(np.int64(key), several).astype(np.int32))
                cut.append(several > 1)
                nodes.append(np.full(len(own), key, np.int64))
                sizes.append(np.full(len(own), len(found), np.int32))
                places.append(np.arange(len(own), dtype=np.int32))
            if members:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(members).view(np.int64)),
                        pa.array(np.concatenate(parts)),
                        pa.array(np.concatenate(cut)),
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(sizes)),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["gram", "part", "cut", "node", "size", "pos"],
                )

    return docs.select("text").mapInArrow(run, "gram long, part int, cut boolean, node long, size int, pos int")


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """Bits of all nodes, FILTER_BITS at most, or'ed on the executors."""
    place = F.pmod("node", F.lit(FILTER_BITS))
    bits = nodes.groupBy((place / 32).cast("int").alias("k")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(pmod(node, {FILTER_BITS}) % 32))")).alias("b")
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for batch in bits.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint64).astype(np.uint32)
    return out


def _whole_sets(docs: DataFrame, n: int, nodes: DataFrame) -> DataFrame:
    """node, grams (all n-grams of its set, as bytes) of at least the given nodes."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter_of(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, bits, seen = set_sizes(n), shared.value, set()
        for batch in steps(batches):
            keys, members = [], []
            for _, found, key in sets(texts_of(batch)):
                at = key % FILTER_BITS
                if key in seen or not bits[at // 32] >> np.uint32(at % 32) & np.uint32(1):
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                keys.append(key)
                members.append(found.tobytes())
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(members, pa.binary())], names=["node", "grams"]
                )

    found = docs.select("text").mapInArrow(run, "node long, grams binary")
    return scratch(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, distinct nodes) whose overlap over all columns reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * overlap >= percent * (len(x) + len(y) - overlap)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _may_link(percent: int) -> Column:
    """What the sizes of two sets, and the places of one common n-gram, ask for.

    Linked sets overlap in at least a = ceil(t / (1 + t) * (size + other)) n-grams, so one of these is among the first
    size - a + 1 of the one and the first other - a + 1 of the other. For sets of about one size that is half a rare block.
    """
    overlap = F.expr(f"int((size + other) * {percent} + {99 + percent}) div {100 + percent}")
    fits = F.least("size", "other") * 100 >= F.greatest("size", "other") * percent
    return fits & (F.col("pos") + overlap <= F.col("size")) & (F.col("other_pos") + overlap <= F.col("other"))


def _close(pairs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The pairs whose overlap can still reach the threshold, given what their rare blocks have in common.

    Of two rare blocks one ends first. Up to there both sets are whole in the blocks, and beyond it that set has
    ceil(t * size) - 1 n-grams.
    """
    one = blocks.select(F.col("node").alias("a"), F.col("size").alias("size"), F.col("rare").alias("x"))
    other = blocks.select(F.col("node").alias("b"), F.col("size").alias("other"), F.col("rare").alias("y"))
    most = F.size(F.array_intersect("x", "y")) + F.expr(f"(greatest(size, other) * {percent} + 99) div 100") - 1
    reached = most * (100 + percent) >= (F.col("size") + F.col("other")) * percent
    return pairs.join(one, "a").join(other, "b").where(reached).select("a", "b")


def _pair(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _ends(pairs: DataFrame) -> DataFrame:
    return scratch(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())


def _joined(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """What ngram_join returns, and label, the component's smallest node."""
    first = scratch(_sizes(docs, n))
    sketch = _sketch(first.where("slice is not null"))
    rows = first.where("slice is null").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")
    )
    column = Window.partitionBy("gram", "part")
    block = scratch(
        _rare_block(docs, n, percent, sketch)
        .repartition("gram", "part")
        .withColumn("low", F.min("node").over(column))
        .withColumn("high", F.max("node").over(column))
        # a part does not tell whether the column has other nodes; one that has none gives no pairs
        .where("cut or low < high")
        .dropDuplicates(["gram", "part", "node"])
        .select("gram", "node", "size", "pos")
    )
    may_link = _may_link(percent)
    shared = block.groupBy("node").agg(F.count("*").alias("shared"), F.min("size").alias("size"))

    # one leader for each column: the node with the largest share of its set in columns that others have too
    rank = F.struct(F.col("shared") / F.col("size"), F.col("node"), F.col("size"), F.col("pos"))
    ranked = block.join(shared.select("node", "shared"), "node")
    # written, as minor below, so that the join splits a column that many documents have
    leaders = scratch(ranked.groupBy("gram").agg(F.max(rank).alias("top")).select(
        "gram", F.col("top.node").alias("leader"), F.col("top.size").alias("other"), F.col("top.pos").alias("other_pos")
    ))
    led = (
        block.join(leaders, "gram")
        .where((F.col("node") != F.col("leader")) & may_link)
        .groupBy("node", "leader", "size", "other")
        .agg(F.count("*").alias("overlap"))
    )
    star = led.groupBy("node").agg(F.max_by("leader", F.struct("overlap", "leader")).alias("leader"))
    # a set's own rare block bounds its row
    blocks = scratch(block.groupBy("node").agg(F.min("size").alias("size"), F.collect_list("gram").alias("rare")))
    star = scratch(_close(star.select(*_pair("node", "leader")).distinct(), blocks, percent))
    sets = _whole_sets(docs, n, _ends(star))
    links = scratch(_links(star, sets, percent))
    labels = union_find_table(links)

    # what is left: pairs of different components that share a column; one of the two is not of its column's main component
    coloured = scratch(
        block.join(labels, "node", "left").select("gram", "node", "size", "pos", F.coalesce("label", "node").alias("label"))
    )
    main = coloured.groupBy("gram", "label").agg(F.count("*").alias("n")).groupBy("gram")
    main = scratch(
        main.agg(F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main"))
        .where("labels > 1")
        .select("gram", "main")
    )
    minor = scratch(coloured.join(main, "gram").where("label <> main"))
    peers = coloured.select(
        "gram",
        F.col("node").alias("peer"),
        F.col("size").alias("other"),
        F.col("pos").alias("other_pos"),
        F.col("label").alias("peer_label"),
    )
    # two that are both not of the main component meet twice; one meeting counts
    once = (F.col("peer_label") == F.col("main")) | (F.col("node") < F.col("peer"))
    met = minor.join(peers, "gram").where((F.col("label") != F.col("peer_label")) & once & may_link)
    open_pairs = met.select(*_pair("node", "peer")).distinct()
    open_pairs = scratch(_close(open_pairs.join(star, ["a", "b"], "left_anti"), blocks, percent))
    more = _ends(open_pairs).join(sets, "node", "left_anti")
    sets = sets.unionByName(_whole_sets(docs, n, more))
    links = links.unionByName(scratch(_links(open_pairs, sets, percent)))
    labels = union_find_table(links)

    found = rows.where("node is not null").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = scratch(found.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = found.join(smallest, "label").select("doc_id", "n_shingles", "node", "component_id", "label")
    alone = rows.where("node is null").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone, allowMissingColumns=True)


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, node, component_id for each row of docs (doc_id, text; more columns are ignored).

    Words are lower-cased (A-Z) runs without ASCII white space. Rows with fewer than n words have their whole sequence as
    their one n-gram; rows without words or with null text have an empty set, node null, and are their own component.
    Rows with equal sets are one node, so copies cost nothing and are always linked. component_id is the smallest doc_id
    that is linked by any chain; a null doc_id counts only if there is no other. An empty table gives an empty result.
    """
    return _joined(docs, n, percent).drop("label")


def ngram_links(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The columns of ngram_join and n_links, the number of other rows whose sets reach the threshold with the row's set.

    All pairs of nodes of a component are verified, in blocks of at most about SIDE nodes a side, and no pair is listed. Rows with
    an empty set link with nothing.
    """
    joined = scratch(_joined(docs, n, percent))
    nodes = joined.where("node is not null").groupBy("label", "node").agg(F.count("*").alias("copies"))
    nodes = scratch(nodes)
    parts = nodes.groupBy("label").agg(F.ceil(F.count("*") / SIDE).alias("parts"), F.count("*").alias("nodes"))
    members = scratch(nodes.join(parts.where("nodes > 1"), "label").withColumn("part", F.pmod(F.xxhash64("node"), "parts")))
    filled = members.join(_whole_sets(docs, n, members.select("node")), "node")
    upto = F.sequence(F.lit(0).cast("long"), F.col("part"))
    block = ["label", "row", "column"]
    rows = filled.select(
        "label", F.col("part").alias("row"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("column"), "node", "copies", "grams"
    )
    # a part is compared with itself without a second copy
    columns = filled.select("label", F.explode(upto).alias("row"), F.col("part").alias("column"), "node", "copies", "grams").where("row < column")

    def compare(key: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        same = key[1].as_py() == key[2].as_py()
        other = one if same else other
        if not one.num_rows or not other.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = one.column("node").to_numpy(), other.column("node").to_numpy()
        left = [np.frombuffer(x, np.uint64) for x in one.column("grams").to_pylist()]
        right = [np.frombuffer(x, np.uint64) for x in other.column("grams").to_pylist()]
        sizes = np.array([len(x) for x in right])
        flat = np.concatenate(right)
        order = np.argsort(flat)
        flat, owner = flat[order], np.repeat(np.arange(len(right)), sizes)[order]
        linked = np.zeros((len(left), len(right)), bool)
        for i, x in enumerate(left):
            low = np.searchsorted(flat, x)
            found = np.searchsorted(flat, x, side="right") - low
            at = np.repeat(low - np.cumsum(found) + found, found) + np.arange(found.sum())
            overlap = np.bincount(owner[at], minlength=len(right))
            linked[i] = (100 * overlap >= percent * (len(x) + sizes - overlap)) & (b != a[i])
        mine = linked @ other.column("copies").to_numpy()
        if same:
            return pa.table({"node": a, "n": mine})
        theirs = one.column("copies").to_numpy() @ linked
        return pa.table({"node": np.concatenate([a, b]), "n": np.concatenate([mine, theirs])})

    # written, so that the two sides' columns are different ones
    both = scratch(rows).groupBy(*block).cogroup(scratch(columns).groupBy(*block))
    links = both.applyInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    counted = scratch(nodes.join(links, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    linked = joined.where("node is not null").join(counted, "node")
    alone = joined.where("node is null").withColumn("n_links", F.lit(0).cast("long"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "node", "component_id", "n_links")


def op10_ngram_join(spark, folder) -> DataFrame:
    return ngram_join(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


def join_sql(docs: str = "documents") -> str:
    """The same from all pairs of documents that share a 5-gram, and all that a chain of links reaches."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {docs}),
s AS (SELECT DISTINCT rid, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
o AS (SELECT x.rid AS a, y.rid AS b, count(*) AS shared FROM s x JOIN s y USING (g) GROUP BY x.rid, y.rid),
l AS (SELECT a, b FROM o JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS rid, min(doc_id) AS component_id FROM r JOIN d ON d.rid = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
       CASE WHEN n IS NULL THEN doc_id ELSE component_id END::BIGINT AS component_id
FROM d LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)"""
