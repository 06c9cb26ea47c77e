"""The n-gram join against all pairs, and the sorted projection passes against all cosines."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from billcycle.llm import ngram_join as ngrams
from billcycle.llm import vector_dedup
from billcycle.llm.ngram_join import ngram_join
from billcycle.llm.vector_dedup import near_vectors, passes_needed
from tests.llm.conftest import ODD_TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def changed(text, seed, share):
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"new{seed}x{i}" for i, w in enumerate(text.split(" ")))


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                links.append((i, j))
    return [len(x) for x in sets], components(len(rows), links)


@pytest.mark.parametrize("column", [1 << 16, 3])
def test_join_equals_all_pairs(spark, prose, monkeypatch, column):
    """Groups of copies and of near copies around the threshold, chains, a passage in a third of all texts, odd texts; also with columns cut into parts of about three."""
    monkeypatch.setattr(ngrams, "COLUMN", column)
    passage = prose(999, 60)
    texts = [prose(i, 30 + i % 90) for i in range(90)]
    texts += [prose(200 + i, 40) + " " + passage for i in range(40)] + [passage] * 3
    texts += [changed(texts[1], s, 0.02) for s in range(40)] + [changed(texts[3], s, 0.045) for s in range(40)]
    texts += [texts[5]] * 30 + [texts[6].upper(), texts[7] + " end", *ODD_TEXTS, *ODD_TEXTS]
    chain = prose(77, 120)
    for i in range(8):
        chain = changed(chain, 500 + i, 0.02)
        texts.append(chain)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    sizes, groups = brute(rows)
    assert len(set(groups)) < len(rows) - 50
    found = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert found.n_shingles.tolist() == sizes
    assert found.component_id.tolist() == groups


def test_join_of_null_and_repeated_ids_and_of_nothing(spark, prose):
    text = prose(1, 30)
    rows = [(None, text, 1), (7, text, 2), (7, text, 3), (None, None, 4), (8, prose(2, 30), 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join(docs).collect())
    assert found == [(-1, 0, -1), (-1, 26, 7), (7, 26, 7), (7, 26, 7), (8, 26, 8)]
    assert ngram_join(docs.limit(0)).count() == 0


def cosines(rows, threshold):
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


def near(rng, base, cosine):
    noise = rng.standard_normal(len(base))
    noise -= noise @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((2500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [*base, *[near(rng, base[i], rng.uniform(0.88, 0.97)) for i in range(400)]]
    rows += [near(rng, base[2000], rng.uniform(0.93, 0.99)) for _ in range(150)]
    rows += [near(rng, base[2100], 0.995) for _ in range(300)] + [base[3]] * 40
    return [(i, v.tolist()) for i, v in enumerate(rows)]


def test_vectors_find_almost_all_links_and_none_too_many(spark, vectors):
    linked = cosines(vectors, 0.9)
    found = near_vectors(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).toPandas()
    found = found.sort_values("vec_id")
    assert (found.n_links.values <= linked.sum(axis=1)).all()
    assert found.n_links.sum() >= 0.95 * linked.sum()
    whole = components(len(vectors), zip(*np.nonzero(np.triu(linked)), strict=True))
    assert (found.component_id.values == np.array(whole)).mean() > 0.97
    assert (found.kept == (found.vec_id == found.component_id)).all()
    assert (found.component_id.values >= np.array(whole)).all()  # no link below the threshold


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]),
        (8, [2.0, 0.0]), (9, [1e300, 1e299]), (None, [0.0, 1.0]), (7, [1.0, 0.0]), (10, [1.0]), (11, [5e-324, 0.0]),
    ]
    found = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    links = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in found)
    assert links == [
        (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 4, 7), (7, 4, 7), (8, 4, 7),
        (9, 4, 7), (10, 0, 10), (11, 4, 7),
    ]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_passes_grow_with_the_vectors():
    assert passes_needed(10, 0.9) == 1
    assert 1 < passes_needed(10_000, 0.9) < passes_needed(10_000_000, 0.9) < 100


@pytest.mark.parametrize("cosine", [0.7, 0.8])
def test_vectors_of_one_topic(spark, monkeypatch, cosine):
    """A third of all rows share a direction (cosine to each other); pairs of 0.9 to 0.92 among them. Once by prefixes alone."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for i in range(2000):
        base[i] = near(rng, base[5999], np.sqrt(cosine))
    planted = [near(rng, base[i], rng.uniform(0.9, 0.92)) for i in range(400)]
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *planted])]
    linked = cosines(rows, 0.9)
    assert linked.sum() // 2 >= 400
    whole = np.array(components(len(rows), zip(*np.nonzero(np.triu(linked)), strict=True)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for copied in (vector_dedup.COPY, 1000):  # then blocks seem dear: short groups in many passes
        monkeypatch.setattr(vector_dedup, "COPY", copied)
        found = near_vectors(frame).toPandas().sort_values("vec_id")
        recall = found.n_links.sum() / linked.sum()
        print(f"cosine {cosine}, cost of a copy {copied}: {recall:.4f} of the links")
        assert (found.n_links.values <= linked.sum(axis=1)).all()
        assert recall >= 0.95
        assert (found.component_id.values == whole).mean() > 0.97


def test_links_of_each_document(spark, prose, monkeypatch):
    """Number of links by all pairs: copies, near copies around the threshold, a chain, empty and null texts; several blocks a component."""
    monkeypatch.setattr(ngrams, "SIDE", 8)
    texts = [prose(i, 60) for i in range(12)] + [prose(3, 60)] * 3 + ["", None]
    texts += [changed(texts[1], s, 0.03) for s in range(30)]
    chain = prose(77, 120)
    for i in range(6):
        chain = changed(chain, 500 + i, 0.02)
        texts.append(chain)
    sets = [shingles(t) for t in texts]
    linked = [[i != j and bool(x & y) and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)] for i, x in enumerate(sets)]
    frame = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.n_links for r in ngrams.ngram_links(frame).collect()}
    assert found == {None if i == 5 else i: sum(x) for i, x in enumerate(linked)}
    assert 0 < sum(linked[20]) < 30
