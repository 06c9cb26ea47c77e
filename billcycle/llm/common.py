"""Helpers shared by the operators of this subpackage: scratch tables, null-safe table reads, hot-path word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Bytes of text that one vectorised step looks at, unless one text is longer.
STEP_BYTES = 1 << 20
#: Bytes whose words are hashed at once.
STRETCH = 1 << 17
#: Edges of a step of the components for which one more file is written.
FILE_EDGES = 1 << 18


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as it takes to differ from all columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master may do without that setting: it gets a folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="billcycle-")
        _local[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Folder of a local application without that setting.
_local: dict[str, str] = {}
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, which their Python workers import; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver's own copy, which Spark serves
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def scratch(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends and sizes are known."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union_find_table(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): node, label (the smallest node of its component).

    Alternating large-star and small-star steps; each step's edges are a written table, so neither lineage nor the
    driver grows. The star minima are written before the join, so that Spark may split a hub's rows. No step has more edges
    than the one before, so few edges are few files, however many partitions the session shuffles into: on a ``file:`` folder
    each file starts processes that for a moment show the executor's memory a second time.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    stars = scratch(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = mark(stars)
    while True:
        files = before[0] // FILE_EDGES + 1
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(files))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch(large.coalesce(files))
        least = scratch(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(files))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = scratch(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        after = mark(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


# ---------------------------------------------------------------------------------------------- inside tasks


def steps(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES, rows: int = 1 << 14
) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds one row, or at most ``most`` bytes of text and ``rows`` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) if x is not None else 0 for x in batch.column(column).cast(pa.binary()).to_pylist()])
        begin, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > begin and (held + size > most or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of many texts at once, lower-cased (A-Z) or not; a word is a longest run of bytes outside ``gaps``.

    A word's polynomial is the difference of two running sums, shifted to the word's start; the sums begin anew in every
    stretch of STRETCH bytes (longer only inside a longer word), so memory does not follow the length of a text.
    """

    BASE = 0x100000001B3

    def __init__(self, gaps: bytes, lower: bool = True) -> None:
        self.inside = np.ones(256, bool)
        self.inside[np.frombuffer(gaps, np.uint8)] = False
        self.gap = gaps[:1]
        self.values = np.arange(1, 257, dtype=np.uint64)
        for upper in range(65, 91 if lower else 65):
            self.values[upper] = self.values[upper + 32]
        self._grow(2 * STRETCH)

    def _grow(self, n: int) -> None:
        self.powers = np.cumprod(np.full(n, self.BASE, np.uint64))
        self.back = np.cumprod(np.full(n, pow(self.BASE, -1, 1 << 64), np.uint64))

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word in the bytes."""
        inside = np.zeros(len(data) + 2, bool)
        np.take(self.inside, data, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], edge[1::2]

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each range of the bytes."""
        if len(data) >= len(self.powers):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(np.take(self.values, data) * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, number of the text it is in), in text order."""
        return self.located(texts)[:2]

    def located(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Also start and end of each word in the bytes of all texts with a gap between each two, and these bytes."""
        data = np.frombuffer(self.gap.join(x or b"" for x in texts), np.uint8)
        begin, hashed = 0, [np.empty(0, np.uint64)]
        starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while begin < len(data):
            end = min(begin + STRETCH, len(data))
            while end < len(data) and self.inside[data[end]]:  # to the end of the word
                rest = np.flatnonzero(~self.inside[data[end : end + STRETCH]])
                end += int(rest[0]) if len(rest) else min(STRETCH, len(data) - end)
            first, last = self.bounds(data[begin:end])
            starts.append(first + begin)
            ends.append(last + begin)
            hashed.append(self.ranges(data[begin:end], first, last))
            begin = end
        begins = np.cumsum([0] + [len(x or b"") + 1 for x in texts])
        places = np.concatenate(starts)
        where = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(places, begins)))
        return np.concatenate(hashed), where, places, np.concatenate(ends), data


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; empty where there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[k : k + count] * np.uint64(factor)
    return mixed(total)


#: ASCII white space (U+0020, U+0009 to U+000D), and all ASCII but digits and lower and upper case letters.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes(x for x in range(128) if not chr(x).isalnum())


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
