"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of a fixed number of bytes. Filters of several widths run over the embedded bytes of a window, each
filter's largest response is pooled, and a softmax layer gives the window's language probabilities. A text's
probabilities are the mean of those of all its windows, weighted by their letters. Since bytes have few values, a trained filter
is a table: responses are looked up by byte pair and added, which is the same sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcycle.llm.common import crc_mod, steps, table, texts_of

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Training takes about this many texts of each language, and this many windows of each, spread over the text.
TEXTS_PER_LANGUAGE = 1000
WINDOWS_PER_TEXT = 4
#: Languages that get so many texts; more languages share the texts of these.
FULL_LANGUAGES = 200
EPOCHS = 6
#: Steps that are taken at least; a small sample is gone through more often.
LEAST_STEPS = 400

_ASCII_LETTER = re.compile(r"[A-Za-z]")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # (width * EMBEDDING, FILTERS) of each width
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the responses by byte pair, and for odd widths by the byte after the pairs."""
        out = []
        for width, filters in zip(WIDTHS, self.filters, strict=True):
            single = [self.embedding @ filters[k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(width)]
            pairs = [
                (single[k][:, None] + single[k + 1][None, :]).reshape(1 << 16, FILTERS) for k in range(0, width - 1, 2)
            ]
            out.append([*pairs, *single[width - width % 2 :]])
        return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts, the last of each filled up with zeros, and the number of windows of each text."""
    counts = [max(1, -(-len(x) // WINDOW)) for x in texts]
    data = b"".join(x.ljust(n * WINDOW, b"\0") for x, n in zip(texts, counts, strict=True))
    return np.frombuffer(data, np.uint8).reshape(-1, WINDOW), np.array(counts)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Minimise the cross entropy by Adam; the gradient of a pooled maximum goes to the place that had it."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
        [draw(w * EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw(len(WIDTHS) * FILTERS, len(languages)),
        np.zeros(len(languages), np.float32),
    )
    values = [net.embedding, *net.filters, *net.biases, net.weights, net.bias]
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in values]
    step, size = 0, 64
    for _ in range(max(epochs, math.ceil(LEAST_STEPS * size / len(windows)))):
        order = rng.permutation(len(windows))
        for begin in range(0, len(order), size):
            x, y = windows[order[begin : begin + size]], labels[order[begin : begin + size]]
            embedded = net.embedding[x]
            pooled, places, patches = [], [], []
            for width, filters, bias in zip(WIDTHS, net.filters, net.biases, strict=True):
                seen = np.concatenate([embedded[:, k : WINDOW - width + 1 + k] for k in range(width)], axis=2)
                response = seen @ filters
                place = response.argmax(axis=1)
                best = np.take_along_axis(response, place[:, None, :], axis=1)[:, 0] + bias
                pooled.append(np.maximum(best, 0))
                places.append(place)
                patches.append(seen[np.arange(len(x))[:, None], place])
            features = np.concatenate(pooled, axis=1)
            error = _softmax(features @ net.weights + net.bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ net.weights.T) * (features > 0)
            embedding_gradient = np.zeros_like(net.embedding)
            filter_gradients, bias_gradients = [], []
            for i, width in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                filter_gradients.append(np.einsum("bfk,bf->kf", patches[i], own))
                bias_gradients.append(own.sum(axis=0))
                down = own[:, :, None] * net.filters[i].T[None]
                for k in range(width):
                    at = np.take_along_axis(x, places[i] + k, axis=1)
                    np.add.at(embedding_gradient, at, down[:, :, k * EMBEDDING : (k + 1) * EMBEDDING])
            gradients = [embedding_gradient, *filter_gradients, *bias_gradients, features.T @ error, error.sum(axis=0)]
            step += 1
            for value, gradient, (one, two) in zip(values, gradients, moments, strict=True):
                one += 0.1 * (gradient - one)
                two += 0.001 * (gradient * gradient - two)
                value -= 0.003 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of each window."""
        out = []
        for begin in range(0, len(x), 256):
            part = x[begin : begin + 256]
            pairs = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            pooled = []
            for width, tables, bias in zip(WIDTHS, self.tables, self.net.biases, strict=True):
                places = WINDOW - width + 1
                response = tables[0][pairs[:, :places]]
                for k, more in enumerate(tables[1:], 1):
                    response += more[(pairs if len(more) > 256 else part)[:, 2 * k : 2 * k + places]]
                pooled.append(np.maximum(response.max(axis=1) + bias, 0))
            out.append(_softmax(np.concatenate(pooled, axis=1) @ self.net.weights + self.net.bias))
        return np.concatenate(out)

    def texts(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and its probability of each text; null texts and texts without a letter are unknown, with 0."""
        x, counts = windows_of([t or b"" for t in texts])
        weights = _LETTERS[x].sum(axis=1).astype(np.float64)
        begins = np.cumsum(counts) - counts
        total = np.add.reduceat(weights, begins)
        summed = np.add.reduceat(self.windows(x) * weights[:, None], begins, axis=0)
        best = summed.argmax(axis=1)
        score = summed[np.arange(len(best)), best] / np.maximum(total, 1)
        names, scores = [], []
        for text, b, s in zip(texts, best.tolist(), score.tolist(), strict=True):
            whole = (text or b"").decode("utf-8", "replace")
            known = bool(_ASCII_LETTER.search(whole)) or any(c.isalpha() for c in whole)
            names.append(self.net.languages[b] if known else UNKNOWN)
            scores.append(min(1.0, s) if known else 0.0)
        return names, scores


def learn(labelled: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> Network | None:
    """A network from the rows (doc_id, text, lang) that have both text and lang; None if there are none.

    Every language that occurs is learned. The texts are bounded: about ``per_language`` of each language, or an equal share of
    FULL_LANGUAGES times as many where there are more languages, but at least one. They are chosen by a hash of id and text,
    and WINDOWS_PER_TEXT windows of each are cut on the executors.
    """
    rows = labelled.where("text is not null and lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    has_letter = F.col("text").rlike("[A-Za-z]|[^\\x00-\\x7f]")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.when(has_letter, place)).alias("least")).collect()
    if not counts:
        return None
    languages = sorted(r.lang for r in counts)
    per_language = max(1, min(per_language, per_language * FULL_LANGUAGES // len(languages)))
    # the first text of each is always taken, however small the share
    shares = [(r.lang, max(per_language / r.n, 0.0 if r.least is None else math.nextafter(r.least, 2))) for r in counts]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, share double")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            parts, names, places = [], [], []
            for text, lang, at in zip(texts_of(batch), batch.column("lang").to_pylist(), batch.column("place").to_pylist(), strict=True):
                x, _ = windows_of([text])
                for i in np.unique(np.linspace(0, len(x) - 1, WINDOWS_PER_TEXT).astype(int)).tolist():
                    if _LETTERS[x[i]].any():
                        parts.append(x[i].tobytes())
                        names.append(lang)
                        places.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.binary()), pa.array(names, pa.string()), pa.array(places, pa.float64())], names=["w", "lang", "place"]
            )

    # rows that repeat count once; what chance takes beyond the bound goes by the rank of its place, so that reruns agree
    chosen = rows.join(F.broadcast(shares), "lang").where(place < F.col("share")).dropDuplicates(["doc_id", "text", "lang"])
    sample = chosen.select("text", "lang", place.alias("place")).mapInArrow(cut, "w binary, lang string, place double")
    most = 2 * per_language * WINDOWS_PER_TEXT * len(languages)
    found = sample.orderBy("place", "lang", "w").limit(most).select("w", "lang").toArrow()
    if not found.num_rows:
        return None
    # the order in which tasks end must not matter
    found = found.sort_by([("lang", "ascending"), ("w", "ascending")])
    x = np.frombuffer(b"".join(found.column("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(np.array(languages), np.array(found.column("lang").to_pylist()))
    return train(x, y, languages)


def predict(docs: DataFrame, net: Network | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs, with the language and its score (0 to 1) of the whole text; without a network all are unknown.

    Only text is looked at. Null and empty texts and those without a letter get ``und`` and 0. Columns of docs by the names
    of the new ones are replaced.
    """
    docs = docs.drop(*names)
    if net is None:
        return docs.withColumn(names[0], F.lit(UNKNOWN)).withColumn(names[1], F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = docs.columns
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in steps(batches):
            found, scores = predictor.texts(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, *names]
            )

    return docs.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def op5_language(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 4) == 2
    net = learn(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), net).drop("text")
