"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: words and word pairs, byte triples, and runs of up to three word shapes (kinds of characters, and
whether the word repeats the one before), hashed to a fixed number of places. The indicators are scaled by the
log ratio of their smoothed counts in the two classes, and the scaled vector, brought to length 1, goes to a linear hinge-loss model
that dual coordinate descent fits. A logistic curve, fitted on rows kept from the descent, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import SPACE, Words, crc_mod, mixed, scratch, steps, table, texts_of

FEATURE_BITS = 18
#: Rows of each class that a model is fitted on, at most.
ROWS_PER_CLASS = 3000
#: Bytes of their indicators, at most; beyond it fewer rows of both classes are taken.
SAMPLE_BYTES = 128 << 20
ROUNDS = 12
COST = 1.0
#: Every so many rows of the sample fit the logistic curve and not the model.
CALIBRATE_EVERY = 4
GOOD = 0.3

_KINDS = np.zeros(256, np.uint8)
for _bit, _bytes in enumerate(
    (range(97, 123), range(65, 91), range(48, 58), range(128, 256), b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")
):
    _KINDS[list(_bytes)] = 1 << _bit


class Features:
    """The indicators of many texts at once."""

    def __init__(self) -> None:
        self.words = Words(SPACE)

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, feature) of every distinct indicator, sorted by text; at most 2^14 texts."""
        hashed, where, starts, _, data = self.words.located(texts)
        place = np.uint64((1 << FEATURE_BITS) - 1)
        parts: list[np.ndarray] = []

        def add(of: np.ndarray, value: np.ndarray) -> None:
            parts.append((of.astype(np.uint32) << np.uint32(FEATURE_BITS)) | (value & place).astype(np.uint32))

        if len(hashed):
            add(where, hashed)
            inside = where[1:] == where[:-1]
            add(where[1:][inside], mixed(hashed[:-1] * np.uint64(3) + hashed[1:])[inside])
            repeats = np.zeros(len(hashed), np.uint64)
            repeats[1:] = (hashed[1:] == hashed[:-1]) & inside
            shape = np.bitwise_or.reduceat(_KINDS[data], starts).astype(np.uint64) << np.uint64(1) | repeats
            for n in (1, 2, 3):
                run = np.full(max(0, len(shape) - n + 1), n, np.uint64)
                for k in range(n):
                    run = run * np.uint64(131) + shape[k : len(shape) - n + 1 + k]
                same = where[n - 1 :] == where[: len(shape) - n + 1]
                add(where[: len(shape) - n + 1][same], mixed(run)[same])
        if len(data) > 2:
            triple = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
            # the gap after a text belongs to none
            of = np.repeat(np.arange(len(texts), dtype=np.uint32), [len(x or b"") + 1 for x in texts])[:-1]
            gap = np.cumsum([len(x or b"") + 1 for x in texts])[:-1] - 1
            of, inside = of[:-2], of[2:] == of[:-2]
            inside[(gap[:, None] - np.array([0, 1, 2])).clip(0, len(inside) - 1)] = False
            value = (triple * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURE_BITS)
            parts.append((of[inside] << np.uint32(FEATURE_BITS)) | value[inside])
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        found = np.sort(np.concatenate(parts))
        found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        return (found >> np.uint32(FEATURE_BITS)).astype(np.int64), (found & np.uint32((1 << FEATURE_BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, of: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        r = self.ratios[features]
        length = np.sqrt(np.bincount(of, r * r, minlength=n))
        return np.bincount(of, r * self.weights[features], minlength=n) / np.maximum(length, 1e-12) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def fit(rows: list[np.ndarray], good: np.ndarray, shares: tuple[float, float]) -> Model:
    """From the features of each row and whether it is good; ``shares`` are those of bad and good among all labelled rows."""
    held = np.arange(len(rows)) % CALIBRATE_EVERY == 0
    if len({*good[~held].tolist()}) < 2:
        held[:] = False
    size = 1 << FEATURE_BITS
    counts = []
    for value in (True, False):
        own = [rows[i] for i in np.flatnonzero(~held & (good == value)).tolist()]
        count = 1 + np.bincount(np.concatenate(own) if own else np.empty(0, np.int64), minlength=size)
        counts.append(count / count.sum())
    ratios = np.log(counts[0] / counts[1])
    scaled = []
    for row in rows:
        x = ratios[row]
        scaled.append(x / max(np.sqrt(x @ x), 1e-12))
    # dual coordinate descent for the hinge loss: one bounded dual variable a row, the bias as one more feature
    rng = np.random.default_rng(3)
    weights, bias = np.zeros(size), 0.0
    dual = np.zeros(len(rows))
    sign = np.where(good, 1.0, -1.0)
    learn = np.flatnonzero(~held)
    for _ in range(ROUNDS):
        for i in rng.permutation(learn).tolist():
            row, x, y = rows[i], scaled[i], sign[i]
            gradient = y * (x @ weights[row] + bias) - 1
            change = min(max(dual[i] - gradient / (x @ x + 1), 0), COST) - dual[i]
            if change:
                dual[i] += change
                weights[row] += change * y * x
                bias += change * y
    model = Model(ratios, weights, bias)
    check = np.flatnonzero(held)
    if len({*good[check].tolist()}) == 2:
        margins = np.array([scaled[i] @ weights[rows[i]] + bias for i in check.tolist()])
        model.slope, model.offset = _curve(margins, good[check], shares)
    return model


def _curve(margins: np.ndarray, good: np.ndarray, shares: tuple[float, float]) -> tuple[float, float]:
    """Slope and offset of the logistic curve, each class weighing its share of the labelled rows, targets smoothed."""
    weight = np.where(good, shares[1] / good.sum(), shares[0] / (~good).sum())
    target = np.where(good, 1 - 1 / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * np.array([at[0], 0])
        curvature = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curvature, gradient)
        at = at - step / max(1.0, np.abs(step).max())
    return float(max(at[0], 1e-3)), float(at[1])


def learn(
    docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> Model | None:
    """A model of labels (doc_id, label 0 or 1) on docs (doc_id, text); None without rows of both classes.

    The sample is bounded: about ``per_class`` rows of each class, chosen by a hash of the id, and ``sample_bytes`` of their indicators.
    What is beyond either bound goes by the rank of the hash, so that reruns and rows in any order give the same model. Null ids,
    labels and texts are left out; an id with both labels counts as 0, and of an id's different texts one is taken, by their hash.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("label") == 1, per_class / counts[1]).otherwise(per_class / counts[0])
    # the rank is 0 to 1 in either class; a bounded table, which may go to every task
    chosen = known.withColumn("rank", place / F.least(share, F.lit(1.0))).where("rank < 1").orderBy("rank", "doc_id").limit(3 * per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in steps(batches):
            of, found = features.of(texts_of(batch))
            cuts = np.searchsorted(of, np.arange(batch.num_rows + 1))
            rows = [found[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", "rank")), pa.array(rows, pa.binary())],
                names=["doc_id", "label", "rank", "row"],
            )

    labelled = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one_text = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    labelled = labelled.withColumn("nth", F.row_number().over(one_text)).where("nth = 1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = scratch(
        labelled.select("doc_id", "text", F.col("label").cast("int").alias("label"), "rank")
        .mapInArrow(run, f"doc_id {kind}, label int, rank double, row binary")
    )
    sizes = sample.select("rank", F.length("row").alias("size")).toArrow().sort_by("rank")
    within = np.cumsum(sizes.column("size").to_numpy()) <= sample_bytes
    if not within.all():
        sample = sample.where(F.col("rank") < float(sizes.column("rank")[int(within.argmin())].as_py()))
    found = sample.select("doc_id", "label", "row").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    good = found.column("label").to_numpy() == 1
    if len({*good.tolist()}) < 2:
        return None
    rows = [np.frombuffer(x.as_buffer(), np.uint32) for x in found.column("row")]
    order = np.random.default_rng(5).permutation(len(rows))
    total = counts[0] + counts[1]
    return fit([rows[i] for i in order.tolist()], good[order], (counts[0] / total, counts[1] / total))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs but text, with score (0 to 1, higher is better); 0.5 without a model.

    Only text is looked at; null and empty texts have no features and get the score of the model's bias.
    """
    docs = docs.drop("score")
    names = [c for c in docs.columns if c != "text"]
    if model is None:
        return docs.select(*names, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, model = Features(), shared.value
        for batch in steps(batches):
            scores = model.scores(model.margins(*features.of(texts_of(batch)), batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], names=[*names, "score"])

    return docs.mapInArrow(run, f"{schema}, score double")


def op8_quality(spark, folder) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 0
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    model = learn(docs.where("not held_out"), labels.where(~held_out))
    return score(docs, model).withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))
