"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed position in its source's hash order. Words are summed by (source, hash bucket); the bucket in
which a source's budget runs out is its boundary bucket, and only the documents in boundary buckets are summed again, by
the next bits of the hash, until the boundary is one hash value. A document is in the mix when its hash is below its
source's threshold. Nothing is sorted; a hot source is summed in partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import free_name, scratch, table

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash bits used by one level and by all levels.
LEVEL_BITS = 12
HASH_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of id and text; equal rows share it and are taken or left together."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[float], most_repeats: int) -> DataFrame:
    """source, source_size, target: shares of the whole by weight, none above ``most_repeats`` times its size.

    ``sizes`` has a row for each source: the windows below see sources, not documents. Weights go to the sources by code
    point, null last, and start over. Sources fill up in order of size by weight; what a full one leaves is shared by
    weight among the others, so the level is that of the first source in this order that does not fill up (later ones
    give a lower figure).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    limit = F.col("source_size") * most_repeats
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum(
        "weight"
    ).over(rest)
    filled = (
        sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(Window.partitionBy()))
    )
    share = F.when(F.col("level").isNull(), limit.cast("double")).otherwise(
        F.least(F.col("level") * F.col("weight"), limit.cast("double"))
    )
    return filled.select("source", "source_size", share.alias("target"))


def thresholds(docs: DataFrame, weights: list[float] = (1, 2, 3), most_repeats: int = 3) -> tuple[DataFrame, DataFrame]:
    """The sized documents (doc_id, source, size, h), and for each source its target, whole repeats and hash threshold.

    A document is taken ``repeats`` times, and once more if its hash is below the threshold. The threshold is the one
    whose words come nearest to the target, the lower one of two.
    """
    sized = scratch(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            document_hash(F.col("doc_id"), F.col("text")).alias("h"),
        )
    )
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), most_repeats)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # below: the bits above the current level that the boundary has; missing: words that the boundary bucket is to give
    state = scratch(
        goal.withColumn("repeats", repeats.cast("long"))
        .withColumn("missing", F.col("target") - F.col("repeats") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
    )
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = sized.alias("d").join(
            state.select("source", "prefix").alias("s"),
            F.col("d.source").eqNullSafe(F.col("s.source"))
            & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("s.prefix")),
        )
        buckets = inside.groupBy(F.col("d.source").alias("source"), F.shiftright("d.h", shift).alias("bucket")).agg(
            F.sum("d.size").alias("words")
        )
        # at most 2^LEVEL_BITS rows of a source
        upto = Window.partitionBy("source").orderBy("bucket")
        summed = buckets.withColumn("upto", F.sum("words").over(upto))
        found = summed.alias("b").join(state.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        boundary = (
            found.where(F.col("b.upto") > F.col("s.missing"))
            .groupBy(F.col("s.source").alias("source"))
            .agg(F.min_by(F.struct("b.bucket", (F.col("b.upto") - F.col("b.words")).alias("lower"), "b.words"), "b.bucket").alias("x"))
        )
        state = scratch(
            state.alias("s")
            .join(boundary.alias("x"), F.col("s.source").eqNullSafe(F.col("x.source")), "left")
            .select(
                "s.source",
                "s.source_size",
                "s.target",
                "s.repeats",
                (F.col("s.missing") - F.coalesce(F.col("x.x.lower"), F.lit(0))).alias("missing"),
                # without a boundary (no documents, or none beyond the budget) everything in this prefix is taken
                F.coalesce(F.col("x.x.bucket"), F.shiftleft(F.col("s.prefix") + 1, LEVEL_BITS)).alias("prefix"),
                *([F.coalesce(F.col("x.x.words"), F.lit(0)).alias("words")] if shift == 0 else []),
            )
        )
    # the boundary is one hash value now: it is taken if that comes nearer to the target
    threshold = F.when(F.col("words") - F.col("missing") < F.col("missing"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return sized, state.select(
        "source",
        "source_size",
        "target",
        "repeats",
        # nothing is taken beyond the whole repeats that are allowed
        F.when(F.col("repeats") < most_repeats, threshold).otherwise(F.lit(0)).alias("threshold"),
    )


def mix(docs: DataFrame, weights: list[float] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, text, source; more are ignored).

    Null texts have size 0; a null source is a source of its own; documents without words take nothing; rows equal in id and
    text are taken equally often; an empty table gives an empty result.
    """
    sized, chosen = thresholds(docs, weights, most_repeats)
    times = F.col("s.repeats") + F.when(F.col("d.h") < F.col("s.threshold"), 1).otherwise(0)
    return sized.alias("d").join(chosen.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.doc_id", "d.source", "d.size", "s.source_size", "s.target", (F.col("d.size") * times).cast("long").alias("taken")
    )


def mixed_rows(docs: DataFrame, weights: list[float] = (1, 2, 3), most_repeats: int = 3) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it; the thresholds of the sources are all that is joined.

    Documents without words (null, empty or blank) are not taken; a null source is a source of its own; rows equal in id and text are
    taken equally often; an empty table gives an empty result.
    """
    _, chosen = thresholds(docs, weights, most_repeats)
    times = F.col("s.repeats") + F.when(
        document_hash(F.col("d.doc_id"), F.col("d.text")) < F.col("s.threshold"), 1
    ).otherwise(0)
    found = docs.alias("d").join(chosen.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))).alias(free_name(docs.columns, "copy"))
    return found.where(times > 0).select(*[F.col(f"d.`{c}`") for c in docs.columns], copies).select(*[f"`{c}`" for c in docs.columns])


def op1_mixing(spark, folder) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixing_sql(docs: str = "documents") -> str:
    """doc_id, size, source_size, target, taken; the cut of each source found in its sorted hash order."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, ''))[1:15])::BIGINT AS h
  FROM {docs}),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight FROM g),
fill AS (  -- share by weight, hold what is full, and share again
  SELECT 0 AS round, source, source_size, weight, false AS held,
         sum(source_size) OVER () * weight::DOUBLE / sum(weight) OVER () AS target FROM w
  UNION ALL
  SELECT round + 1, source, source_size, weight, held OR target >= 3 * source_size,
         CASE WHEN held OR target >= 3 * source_size THEN 3.0 * source_size
              ELSE (sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (held OR target >= 3 * source_size) OVER (), 0))
                   * weight::DOUBLE / sum(weight) FILTER (NOT held AND target < 3 * source_size) OVER () END
  FROM fill WHERE round <= (SELECT count(*) FROM w)),
t AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS reps
      FROM fill WHERE round = (SELECT max(round) FROM fill)),
hashes AS (SELECT source, h, sum(size) AS words FROM d GROUP BY ALL),
run AS (SELECT hashes.source, h, words, sum(words) OVER (PARTITION BY hashes.source ORDER BY h) AS upto,
               target - reps * source_size AS missing
        FROM hashes JOIN t ON hashes.source IS NOT DISTINCT FROM t.source),
cut AS (SELECT source, min(CASE WHEN upto > missing THEN
                 CASE WHEN upto - missing < missing - (upto - words) THEN h + 1 ELSE h END END) AS threshold
        FROM run WHERE upto > missing GROUP BY source)
SELECT d.doc_id, d.size::BIGINT AS size, t.source_size, round(t.target, 6) AS target,
       (d.size * t.reps + CASE WHEN t.reps < 3 AND (cut.threshold IS NULL OR d.h < cut.threshold) THEN d.size ELSE 0 END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source"""
