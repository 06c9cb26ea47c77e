"""Near-duplicate vectors by sorted projection passes.

A pass gives each distinct vector a key: the signs of its products with random directions, one bit after the other. Vectors are
sorted by key, so that those agreeing in many leading bits stand near each other, and each is compared with the next few
in this order. Vectors that agree in a prefix of the key are all compared: by those neighbours if they are few, else in blocks of bounded
size, but for those that are in one component already. A pair at the threshold agrees in a prefix with a chance that its angle alone
fixes, however crowded its surroundings are, so the length of the prefix gives the number of passes after which the pair has met
with the asked probability. The length is the cheapest by the sizes of the prefixes' groups as counted. Verified pairs of all passes are
united to components.

Links inside a component are then counted completely, also those that no window showed and without listing pairs: vectors
within half the threshold's angle of the component's mean direction are all linked to each other; only the others are compared with the
component, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import scratch, table, union_find_table

#: Neighbours that a vector is compared with in each pass, and sorted rows of one block.
NEIGHBOURS = 64
BLOCK = 4096
#: Rows of one side of a block in which a crowded prefix or the rest of a component is compared.
SIDE = 2048
#: Cost of a row copied into such a block, and of a block, in rows of a pass; passes whose prefixes are counted.
COPY, GROUP = 2, 20
PROBES = 2
KEY_BITS = 64
MISSED = 0.05


def passes_for(bits: float, threshold: float, missed: float = MISSED) -> int:
    """Passes after which a pair at the threshold has agreed in so many leading bits but for the given probability."""
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if met >= 1 - missed else math.ceil(math.log(missed) / math.log(1 - met))


def passes_needed(n: int, threshold: float, missed: float = MISSED) -> int:
    """Passes for the prefixes that vectors spread evenly need."""
    return passes_for(max(0.0, math.log2(max(n, 1) / NEIGHBOURS)), threshold, missed)


def _directions(dimensions: int, passes: int) -> np.ndarray:
    return np.random.default_rng([20, dimensions]).standard_normal((passes, dimensions, KEY_BITS))


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keys(nodes: DataFrame, first: int, passes: int) -> DataFrame:
    """d, pass, key, node for the passes from first on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            sizes = np.array([len(v) // 8 for v in whole.column("vec").to_pylist()])
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                for begin in range(0, len(own), 1024):
                    batch = whole.take(pa.array(own[begin : begin + 1024]))
                    x = _unit(batch.column("vec").to_pylist())
                    directions = known.setdefault(d, _directions(d, passes))
                    for k in range(first, passes):
                        bits = np.packbits(x @ directions[k] > 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
                        signed = (bits ^ np.uint64(1 << 63)).view(np.int64)
                        n = batch.num_rows
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(n, d, np.int32)),
                                pa.array(np.full(n, k, np.int32)),
                                pa.array(signed),
                                batch.column("node"),
                            ],
                            names=["d", "pass", "key", "node"],
                        )

    return nodes.select("node", "vec").mapInArrow(run, "d int, pass int, key long, node long")


def _ranked(keys: DataFrame) -> DataFrame:
    """d, pass, node, rank in the order of all keys; the order is written, so that partition and row number are fixed."""
    order = ["d", "pass", "key", "node"]
    placed = scratch(
        keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ).withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = placed.groupBy("part").agg(F.count("*").alias("n"))
    bases = scratch(bases.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    rank = F.col("base") + F.col("place").bitwiseAND((1 << 33) - 1)
    return placed.join(bases, "part").select("d", "pass", "node", rank.alias("rank"))


def _roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that unite two groups."""
    parent, kept = list(range(n)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _window_links(nodes: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """a, b: verified pairs that connect what the windows of all passes link."""

    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        own = block.column("own").to_numpy()
        run = block.column("d").to_numpy().astype(np.int64) << 32 | block.column("pass").to_numpy()
        node, raw = block.column("node").to_numpy(), block.column("vec").to_pylist()
        found: list[np.ndarray] = []
        for value in np.unique(run).tolist():
            at = np.flatnonzero(run == value)
            x = _unit([raw[i] for i in at.tolist()])
            for k in range(1, min(NEIGHBOURS, len(at) - 1) + 1):
                hit = np.flatnonzero((np.einsum("ij,ij->i", x[:-k], x[k:]) >= threshold) & own[at[:-k]])
                found.append(np.stack([at[hit], at[hit + k]], axis=1))
        pairs = np.concatenate(found).tolist() if found else []
        kept = np.array(_roots(len(node), pairs), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[kept[:, 0]]), "b": pa.array(node[kept[:, 1]])})

    ranked = _ranked(keys).join(nodes.select("node", "vec"), "node")
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    copies = F.when(
        (F.col("rank") % BLOCK < NEIGHBOURS) & (F.col("rank") >= BLOCK),
        F.array(F.struct(block.alias("block"), F.lit(True).alias("own")), F.struct((block - 1).alias("block"), F.lit(False).alias("own"))),
    ).otherwise(F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))
    return ranked.select("d", "pass", "node", "rank", "vec", F.inline(copies)).groupBy("block").applyInArrow(compare, "a long, b long")


def _prefix(bits: int):
    """The leading bits of the key, the same for all that agree in them."""
    return F.shiftright("key", KEY_BITS - bits) if bits else F.lit(0).cast("long")


def _labelled(keys: DataFrame, labels: DataFrame) -> DataFrame:
    return keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _groups(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sizes of the prefixes that the neighbours do not cover; parts (by, label, n) counts the members by component.

    A component of SIDE members or more has parts of its own, which are not compared with each other.
    """
    big = F.col("n") >= SIDE
    sizes = parts.groupBy(*by).agg(
        F.sum("n").alias("size"),
        F.count("*").alias("labels"),
        F.ceil(F.coalesce(F.sum(F.when(~big, F.col("n"))), F.lit(0)) / SIDE).alias("rest"),
        F.coalesce(F.sum(F.when(big, F.ceil(F.col("n") / SIDE))), F.lit(0)).alias("own"),
        F.coalesce(F.sum(F.when(big, F.col("n") * F.ceil(F.col("n") / SIDE))), F.lit(0)).alias("skipped"),
    )
    return sizes.where((F.col("size") > NEIGHBOURS + 1) & (F.col("labels") > 1))


def _cheapest_bits(keys: DataFrame, labels: DataFrame, n: int, probes: int, threshold: float) -> int:
    """Length of the prefix for which passes and blocks cost least, by the groups that the first passes show."""
    least = max(0, math.floor(math.log2(max(n, 1) / (16 * SIDE))))
    tried = range(least, min(KEY_BITS, least + 28), 2)
    prefixes = F.inline(F.array(*[F.struct(F.lit(b).alias("bits"), _prefix(b).alias("prefix")) for b in tried]))
    by = ["d", "pass", "bits", "prefix"]
    probed = _labelled(keys.where(F.col("pass") < probes), labels).select("d", "pass", "label", prefixes)
    found = _groups(probed.groupBy(*by, "label").agg(F.count("*").alias("n")), by).groupBy("bits")
    copies = F.sum(F.col("size") * (F.col("rest") + F.col("own")) - F.col("skipped"))
    counted = {r.bits: r.cost for r in found.agg((COPY * copies + GROUP * F.count("*")).alias("cost")).collect()}
    return min(tried, key=lambda b: (passes_for(b, threshold) * (n + counted.get(b, 0) / probes), b))


def _crowd_links(nodes: DataFrame, keys: DataFrame, labels: DataFrame, bits: int, threshold: float) -> DataFrame:
    """a, b: verified pairs that connect components within each prefix that the neighbours do not cover."""
    by = ["d", "pass", "prefix"]
    placed = scratch(_labelled(keys.select("d", "pass", _prefix(bits).alias("prefix"), "node"), labels))
    parts = scratch(placed.groupBy(*by, "label").agg(F.count("*").alias("n")))
    sizes = scratch(_groups(parts, by).select(*by, "rest"))
    own = scratch(
        parts.where(F.col("n") >= SIDE)
        .join(sizes, by)
        .select(*by, "label", F.col("label").alias("home"), F.ceil(F.col("n") / SIDE).alias("own"))
    )
    # the parts of each prefix: of large components (home), and of all other members together
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("part")
    rest = sizes.where("rest > 0").select(*by, F.lit(-1).cast("long").alias("home"), upto("rest"))
    all_parts = scratch(rest.unionByName(own.select(*by, "home", upto("own"))))
    others = all_parts.withColumnsRenamed({"home": "home2", "part": "part2"})
    same = F.col("home") == F.col("home2")
    pairs = all_parts.join(others, by).where(
        (F.col("home") < F.col("home2")) | (same & (F.col("home") < 0) & (F.col("part") <= F.col("part2")))
    )
    pairs = scratch(pairs)
    number = F.when(F.col("home").isNull(), F.pmod(F.xxhash64("label"), "rest")).otherwise(F.pmod(F.xxhash64("node"), "own"))
    members = (
        placed.join(sizes, by)
        .join(own, [*by, "label"], "left")
        .select(*by, "label", "node", number.alias("part"), F.coalesce("home", F.lit(-1)).alias("home"))
        .join(nodes.select("node", "vec"), "node")
    )
    one = members.join(pairs, [*by, "home", "part"])
    # a part is compared with itself without a second copy
    apart = pairs.where((F.col("home") != F.col("home2")) | (F.col("part") != F.col("part2")))
    other = members.withColumnsRenamed({"home": "home2", "part": "part2"}).join(apart, [*by, "home2", "part2"])
    block = [*by, "home", "part", "home2", "part2"]

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        other = other if other.num_rows else one
        found: list[tuple[int, int]] = []
        if one.num_rows:
            a, b = one.column("node").to_numpy(), other.column("node").to_numpy()
            names = np.concatenate([one.column("label").to_numpy(), other.column("label").to_numpy()])
            code = np.unique(names, return_inverse=True)[1]
            x, y = code[: len(a)], code[len(a) :]
            linked = _unit(one.column("vec").to_pylist()) @ _unit(other.column("vec").to_pylist()).T >= threshold
            linked &= x[:, None] != y[None, :]
            group = np.arange(code.max() + 1)
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                at = np.flatnonzero(linked[i])
                met, first = np.unique(group[y[at]], return_index=True)
                new = met != group[x[i]]
                if new.any():
                    found += [(int(a[i]), int(b[j])) for j in at[first[new]].tolist()]
                    group[np.isin(group, met)] = group[x[i]]
        kept = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(kept[:, 0]), "b": pa.array(kept[:, 1])})

    columns = [F.col(c).alias(c) for c in (*block, "node", "label", "vec")]  # aliases keep the two sides' columns apart
    both = one.select(*columns).groupBy(*block).cogroup(other.select(*columns).groupBy(*block))
    return both.applyInArrow(compare, "a long, b long")


def _labels(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, label: the components of the verified pairs of all that meets in a pass."""
    first = passes_needed(n, threshold)
    keys = scratch(_keys(nodes, 0, first))
    links = scratch(_window_links(nodes, keys, threshold))
    labels = scratch(union_find_table(links.distinct()))
    bits = _cheapest_bits(keys, labels, n, min(PROBES, first), threshold)
    passes = passes_for(bits, threshold)
    if passes > first:
        more = scratch(_keys(nodes, first, passes))
        links = links.unionByName(scratch(_window_links(nodes, more, threshold)))
        labels = scratch(union_find_table(links.distinct()))
        keys = keys.unionByName(more)
    crowded = scratch(_crowd_links(nodes, keys.where(F.col("pass") < passes), labels, bits, threshold))
    return labels if crowded.isEmpty() else scratch(union_find_table(links.unionByName(crowded).distinct()))


def _centres(members: DataFrame) -> DataFrame:
    """label, centre: the mean direction of each component, summed in tasks first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["label", "vec"],
            )

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for label, raw in zip(batch.column("label").to_pylist(), batch.column("vec").to_pylist(), strict=True):
                sums[label] = sums.get(label, 0) + _unit([raw])[0]
            if len(sums) > 10_000:
                yield out(sums)
                sums = {}
        yield out(sums)

    def whole(parts: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(v, np.float64) for v in parts.column("vec").to_pylist()], axis=0)
        return pa.table({"label": parts.column("label").slice(0, 1), "centre": pa.array([total.tobytes()], pa.binary())})

    parts = members.select("label", "vec").mapInArrow(part, "label long, vec binary")
    return parts.groupBy("label").applyInArrow(whole, "label long, centre binary")


def _is_inner(members: DataFrame, threshold: float) -> DataFrame:
    """members with inner: whether the vector is within half the threshold's angle of the centre."""
    near = math.cos(math.acos(threshold) / 2) + 1e-9
    schema = "node long, label long, copies long, vec binary, inner boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = []
            for raw, centre in zip(batch.column("vec").to_pylist(), batch.column("centre").to_pylist(), strict=True):
                c = np.frombuffer(centre, np.float64)
                size = np.sqrt(c @ c)
                inner.append(bool(size > 0 and _unit([raw])[0] @ c / size >= near))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("node", "label", "copies", "vec")), pa.array(inner)],
                names=["node", "label", "copies", "vec", "inner"],
            )

    return members.join(_centres(members), "label").select("node", "label", "copies", "vec", "centre").mapInArrow(run, schema)


def _outer_links(members: DataFrame, threshold: float) -> DataFrame:
    """node, n: rows linked to each node where one of the two is not an inner one."""
    sizes = members.groupBy("label").agg(F.count("*").alias("all"), F.count_if(~F.col("inner")).alias("outer"))
    sizes = scratch(sizes.where("outer > 0").withColumn("rows", F.ceil(F.col("outer") / SIDE)).withColumn("columns", F.ceil(F.col("all") / SIDE)))
    placed = members.join(sizes, "label")
    number = F.xxhash64("node")
    row = placed.where(~F.col("inner")).select(
        "label",
        F.pmod(number, "rows").alias("row"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("columns") - 1)).alias("column"),
        "node",
        "copies",
        "vec",
    )
    column = placed.select(
        "label",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"),
        F.pmod(number, "columns").alias("column"),
        "node",
        "copies",
        "vec",
        "inner",
    )

    def compare(outer: pa.Table, members: pa.Table) -> pa.Table:
        if not outer.num_rows or not members.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        a, b = outer.column("node").to_numpy(), members.column("node").to_numpy()
        linked = _unit(outer.column("vec").to_pylist()) @ _unit(members.column("vec").to_pylist()).T >= threshold
        linked &= a[:, None] != b[None, :]
        inner = members.column("inner").to_numpy()
        # an outer member's links are counted where it is a row
        mine = linked @ members.column("copies").to_numpy()
        theirs = (outer.column("copies").to_numpy() @ linked)[inner]
        return pa.table({"node": np.concatenate([a, b[inner]]), "n": np.concatenate([mine, theirs])})

    keys = ["label", "row", "column"]
    both = scratch(row).groupBy(*keys).cogroup(column.groupBy(*keys))
    return both.applyInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding; more columns are ignored).

    Cosines are taken in double precision. Null, empty and zero vectors and those with null or non-finite components link with
    nothing, nor do vectors of different lengths. Rows with equal vectors are compared once and all linked. Every row counts, also
    one that repeats another's id. component_id is the smallest vec_id of the component (null where all are). An empty table gives
    an empty result.
    """
    values = F.col("embedding").cast("array<double>")
    usable = F.coalesce(
        F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0),
        F.lit(False),
    )
    rows = vectors.select("vec_id", F.when(usable, values).alias("v"))
    nodes = scratch(
        rows.where("v is not null")
        .groupBy("v")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    packed = scratch(_packed(nodes.select("node", "v", "copies")))
    labels = _labels(packed, packed.count(), threshold)
    members = scratch(_is_inner(packed.join(labels, "node"), threshold))
    inner = members.where("inner").groupBy("label").agg(F.sum("copies").alias("inner_rows"))
    others = members.join(inner, "label", "left").join(_outer_links(members, threshold), "node", "left")
    counted = others.select(
        "node",
        "label",
        (F.when(F.col("inner"), F.col("inner_rows")).otherwise(F.col("copies")) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
    )
    named = nodes.join(counted, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = named.join(least, "label").select("v", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), "component_id")
    # copies of one vector may be a third of the rows: the small side is the written table of distinct vectors
    linked = rows.where("v is not null").join(scratch(known), "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _packed(nodes: DataFrame) -> DataFrame:
    """The vectors as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, np.float64).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(raw, pa.binary()), batch.column("copies")], names=["node", "vec", "copies"]
            )

    return nodes.mapInArrow(run, "node long, vec binary, copies long")


def op6_vectors(spark, folder) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def vectors_sql() -> str:
    """The same from the cosines of all pairs, and all that a chain of links reaches."""
    return """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS given FROM embeddings),
f AS (SELECT rid, list_filter(given, lambda x: x IS NOT NULL AND isfinite(x)) AS v, len(given) AS entries FROM e),
u AS (SELECT rid, v, sqrt(list_dot_product(v, v)) AS norm FROM f WHERE len(v) = entries AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT x.rid AS a, y.rid AS b FROM u x JOIN u y ON x.rid <> y.rid AND len(x.v) = len(y.v)
      WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= 0.9),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a),
r AS (SELECT rid AS a, rid AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS rid, min(vec_id) AS component_id FROM r JOIN e ON e.rid = b GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id,
       vec_id = coalesce(component_id, vec_id) AS kept
FROM e LEFT JOIN n USING (rid) LEFT JOIN c USING (rid)"""
