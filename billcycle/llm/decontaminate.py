"""Benchmark decontamination by winnowing.

Of every w consecutive k-gram hashes the smallest is kept, so two texts that share k + w - 1 words share a kept
hash inside that span. Windows of t words use k = min(5, t) and w = t - k + 1. A benchmark item of fewer than t words
is one window of its own length, so each such length that occurs is one more class of fingerprints.

Every kept hash carries the t - k words on each side. A window that a text and an item share holds a hash kept in both, and
lies within that context, so a hit is extended and checked where the fingerprints meet, without another look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import NOT_ALNUM, Words, mixed, scratch, steps, table, texts_of

#: Longest k-gram of a fingerprint.
GRAM = 5
#: Bits of the filter with the benchmark's hashes; its size does not depend on the benchmark.
FILTER_BITS = 1 << 24
#: Columns of the result; a column of the documents by such a name is replaced.
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "candidates", "rid", "items")
FINGERPRINT = "h: long, pos: int, t: int, ctx: binary"


def _within(where: np.ndarray, n: int) -> np.ndarray:
    """For every position whether n words from there on are of one text."""
    out = np.zeros(len(where), bool)
    if len(where) >= n:
        out[: len(where) - n + 1] = where[: len(where) - n + 1] == where[n - 1 :]
    return out


def fingerprints(words: np.ndarray, where: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the kept k-grams of all texts; of equal hashes in a window the last is kept."""
    k = min(GRAM, t)
    w = t - k + 1
    count = len(words) - t + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.full(len(words) - k + 1, t, np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[i : len(words) - k + 1 + i] * np.uint64(factor)
    hashes = mixed(total)
    best, place = hashes[:count].copy(), np.arange(count)
    for i in range(1, w):
        other = hashes[i : i + count]
        later = other <= best
        best[later] = other[later]
        place[later] = np.flatnonzero(later) + i
    kept = np.unique(place[_within(where, t)[:count]])
    return kept, hashes[kept]


def contexts(words: np.ndarray, where: np.ndarray, kept: np.ndarray, t: int, edge: int) -> np.ndarray:
    """The 2 t - k words around each kept k-gram; ``edge`` stands for what is beyond the text."""
    k = min(GRAM, t)
    at = kept[:, None] + np.arange(-(t - k), t)[None, :]
    inside = (at >= 0) & (at < len(words))
    at = np.where(inside, at, kept[:, None])
    inside &= where[at] == where[kept][:, None]
    return np.where(inside, words[at], np.uint64(edge))


def _item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """text_key, h, pos, t, ctx of each item text: (columns of FINGERPRINT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Words(NOT_ALNUM)
        for batch in steps(batches):
            words, where = splitter.hashes(texts_of(batch))
            lengths = np.bincount(where, minlength=batch.num_rows)
            for t in range(1, window + 1):
                own = (lengths >= t) if t == window else (lengths == t)
                if not own.any():
                    continue
                kept, hashes = fingerprints(words, where, t)
                mine = own[where[kept]] if len(kept) else np.empty(0, bool)
                kept, hashes = kept[mine], hashes[mine]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("text_key").take(pa.array(where[kept])),
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.full(len(kept), t, np.int32)),
                        pa.array([x.tobytes() for x in contexts(words, where, kept, t, 1)], pa.binary()),
                    ],
                    names=["text_key", "h", "t", "item_ctx"],
                )

    return items.select("text_key", "text").mapInArrow(run, "text_key string, h long, t int, item_ctx binary")


def _bits(hashes: DataFrame) -> np.ndarray:
    """A bit for each hash, or'ed on the executors; FILTER_BITS whatever the benchmark's size."""
    spread = f"pmod(h, {FILTER_BITS})"
    rows = hashes.groupBy(F.expr(f"int({spread} div 32)").alias("k")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int({spread} % 32))")).alias("b")
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint64).astype(np.uint32)
    return out


def _document_candidates(docs: DataFrame, classes: list[int], bits: np.ndarray) -> DataFrame:
    """The rows of docs with n_words and the fingerprints whose hash may be one of the benchmark's."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    docs = docs.drop(*ADDED)
    columns = docs.columns
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns if c != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, bits = Words(NOT_ALNUM), shared.value
        for batch in steps(batches):
            words, where = splitter.hashes(texts_of(batch))
            found: list[list] = [None] * batch.num_rows
            for t in classes:
                kept, hashes = fingerprints(words, where, t)
                at = (hashes & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                hit = (bits[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
                kept, hashes = kept[hit], hashes[hit]
                begins = np.searchsorted(where, np.arange(batch.num_rows))
                if len(kept):
                    around = contexts(words, where, kept, t, 0)
                    for p, h, c in zip(kept.tolist(), hashes.view(np.int64).tolist(), around, strict=True):
                        row = int(where[p])
                        found[row] = found[row] or []
                        found[row].append({"h": h, "pos": p - int(begins[row]), "t": t, "ctx": c.tobytes()})
            kind = pa.list_(
                pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("t", pa.int32()), ("ctx", pa.binary())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns if c != "text"]
                + [pa.array(np.bincount(where, minlength=batch.num_rows), pa.int64()), pa.array(found, kind)],
                names=[c for c in columns if c != "text"] + ["n_words", "candidates"],
            )

    return docs.mapInArrow(run, f"{schema}, n_words long, candidates array<struct<{FINGERPRINT}>>")


def _extended(met: DataFrame) -> DataFrame:
    """rid, text_key, first, last: the words covered by shared windows around each hit that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t").to_numpy()
            first, last = np.zeros(len(t), np.int64), np.full(len(t), -1, np.int64)
            for size in np.unique(t).tolist():
                rows = np.flatnonzero(t == size)
                k = min(GRAM, size)
                pick = pa.array(rows)
                mine, item = (
                    np.frombuffer(b"".join(batch.column(c).take(pick).to_pylist()), np.uint64).reshape(len(rows), -1)
                    for c in ("ctx", "item_ctx")
                )
                same = np.concatenate([np.zeros((len(rows), 1), int), np.cumsum(mine == item, axis=1)], axis=1)
                shared = same[:, size:] - same[:, :-size] == size  # by where a window begins in the context
                pos = batch.column("pos").to_numpy()[rows]
                begin = shared.argmax(axis=1)
                end = shared.shape[1] - 1 - shared[:, ::-1].argmax(axis=1) + size
                hit = shared.any(axis=1)
                first[rows[hit]] = (pos + begin - (size - k))[hit]
                last[rows[hit]] = (pos + end - (size - k))[hit]
            keep = pa.array(last >= 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("text_key"), pa.array(first), pa.array(last)],
                names=["rid", "text_key", "first", "last"],
            ).filter(keep)

    return met.select("rid", "text_key", "pos", "t", "ctx", "item_ctx").mapInArrow(
        run, "rid long, text_key string, first long, last long"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, without text, with n_words, n_hit, n_items, items_sha256, contaminated and the hit spans.

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII bytes. ``spans`` lists (first word, word after
    the last) of the covered parts. Null and empty texts have no words and no hits; an item without words has no
    windows; items that share an id are one; a null item_id counts as the empty id. Rows of docs may repeat and may have
    null or equal ids; all columns but text are passed through. Without benchmark rows nothing is contaminated.
    """
    items = benchmark.where("text is not null").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.md5(F.col("text").cast("binary")).alias("text_key"), "text"
    )
    # equal item texts are one text, whose hits count for all its items
    prints = scratch(_item_fingerprints(items.dropDuplicates(["text_key"]), window).distinct())
    classes = sorted(r.t for r in prints.select("t").distinct().collect())
    found = scratch(
        _document_candidates(docs, classes, _bits(prints)).withColumn("rid", F.monotonically_increasing_id())
    )
    met = found.select("rid", F.inline("candidates")).join(prints, ["h", "t"])
    hits = scratch(_extended(met).distinct())
    before = Window.partitionBy("rid").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("rid", "first", "last")
        .distinct()
        .withColumn("first", F.greatest("first", F.coalesce(F.max("last").over(before), F.lit(0))))
        .where("last > first")
        .groupBy("rid")
        .agg(F.sum(F.col("last") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    )
    named = (
        hits.select("rid", "text_key")
        .distinct()
        .join(items.select("item", "text_key").distinct(), "text_key")
        .groupBy("rid")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    return (
        found.drop("candidates")
        .join(covered, "rid", "left")
        .join(named, "rid", "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
        .withColumn("n_items", F.coalesce(F.size("items"), F.lit(0)).cast("long"))
        .withColumn("items_sha256", F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
        .drop("rid", "items")
    )


def op3_decontamination(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, folder, "benchmark")).drop("spans")


def decontamination_sql(docs: str = "documents", window: int = 10) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {window}) AS t, array_to_string(w[p : p + least(len(w), {window}) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {docs}),
dw AS (SELECT rid, t, p, array_to_string(w[p : p + t - 1], ' ') AS g
       FROM (SELECT rid, t, w, unnest(range(1, len(w) - t + 2)) AS p FROM d, (SELECT DISTINCT t FROM bw) WHERE len(w) >= t)),
hit AS (SELECT rid, item, p, dw.t FROM dw JOIN bw USING (t, g)),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + t)) AS q FROM (SELECT DISTINCT rid, p, t FROM hit)) GROUP BY rid),
i AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
      FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN i USING (rid)"""
