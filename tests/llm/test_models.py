"""Trained operators: held-out accuracy, the lattice against all segmentations, and odd rows."""

from __future__ import annotations

import itertools
import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from billcycle.llm import language, lattice_lm, quality
from billcycle.llm.token_ids import tokenizer_path
from tests.llm.conftest import ODD_TEXTS

FOLDER = "/root/testdata/sf0.01"
PIECES = tokenizer_path(lattice_lm.VOCABULARY)


def odd_documents(spark):
    rows = [(i, t, None, "x", 1) for i, t in enumerate(ODD_TEXTS)] + [(None, "the end", "en", None, 1), (1, "the end", "en", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


# ---- language


def test_languages_held_out(spark):
    found = language.op5_language(spark, FOLDER).toPandas()
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "n_chars").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out & (both.n_chars > 40)]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    windows = rng.integers(32, 120, (40, language.WINDOW)).astype(np.uint8)
    labels = rng.integers(0, 2, 40)
    net = language.train(windows, labels, ["a", "b"], epochs=2)
    pooled = []
    for width, filters, bias in zip(language.WIDTHS, net.filters, net.biases):
        seen = np.stack([net.embedding[windows[:, k : k + width]].reshape(40, -1) for k in range(language.WINDOW - width + 1)], 1)
        pooled.append(np.maximum((seen @ filters).max(axis=1) + bias, 0))
    direct = np.exp(np.concatenate(pooled, axis=1) @ net.weights + net.bias)
    assert np.allclose(language.Predictor(net).windows(windows), direct / direct.sum(axis=1, keepdims=True), atol=1e-4)


def test_languages_of_odd_rows(spark):
    docs = odd_documents(spark)
    net = language.learn(docs)
    assert net.languages == ["en"]
    found = {(r.doc_id, r.text): r for r in language.predict(docs, net).collect()}
    assert len(found) == docs.count()
    for (_, text), r in found.items():
        known = any(c.isalpha() for c in text or "")
        assert (r.lang_pred, r.score > 0) == (("en", True) if known else ("und", False))
    assert language.learn(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), net).count() == 0


# ---- quality


def test_quality_held_out(spark):
    found = quality.op8_quality(spark, FOLDER).toPandas()
    truth = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out]
    good, bad = held[held.quality == 1].score.values, held[held.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (held.predicted == held.quality).mean() > 0.93
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.3)).all()


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark).select("doc_id", "text", "score")
    labels = spark.createDataFrame([(0, 1), (4, 1), (5, 0), (5, 1), (8, 0), (None, 1), (9, None)], "doc_id long, label int")
    model = quality.learn(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    assert quality.learn(docs, labels.where("label = 1")) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def labelled_texts(spark, n=60):
    rows = [(i, " ".join(f"{'fine' if i % 2 else 'junk'}{(i * 7 + k) % 11}" for k in range(3 + i % 5))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.range(n).selectExpr("id as doc_id", "int(id % 2) as label")


def test_the_sample_of_quality_is_that_of_any_order(spark):
    """A third of all rows repeats one id, with the same text and with others; partitions and order differ."""
    docs, labels = labelled_texts(spark)
    hot = docs.where("doc_id = 7")
    others = spark.range(20).selectExpr("7L as doc_id", "concat('other ', id) as text")
    models = []
    for parts in (1, 3, 7):
        rows = docs.unionByName(others)
        for _ in range(20):
            rows = rows.unionByName(hot)
        models.append(quality.learn(rows.repartition(parts), labels, per_class=12))
    for model in models[1:]:
        assert (model.weights == models[0].weights).all() and (model.ratios == models[0].ratios).all()
        assert (model.bias, model.slope, model.offset) == (models[0].bias, models[0].slope, models[0].offset)


def test_the_sample_of_quality_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = labelled_texts(spark)
    seen = []
    fit = quality.fit
    monkeypatch.setattr(quality, "fit", lambda rows, good, shares: seen.append((rows, good)) or fit(rows, good, shares))
    assert quality.learn(docs, labels) and quality.learn(docs, labels, sample_bytes=2000)
    (whole, _), (part, good) = seen
    assert len(whole) == 60 and 2 < len(part) < 60 and sum(4 * len(x) for x in part) <= 2000 and len(set(good.tolist())) == 2


def fit_by_hand(rows, good):
    """Ratios, weights and bias by plain loops over dictionaries, in the order of rows that the descent takes."""
    held = [i for i in range(len(rows)) if i % quality.CALIBRATE_EVERY == 0]
    learn = [i for i in range(len(rows)) if i not in held]
    counts = {v: Counter(f for i in learn if good[i] == v for f in rows[i]) for v in (True, False)}
    size = 1 << quality.FEATURE_BITS
    total = {v: size + sum(counts[v].values()) for v in counts}
    ratio = {f: math.log((1 + counts[True][f]) / total[True]) - math.log((1 + counts[False][f]) / total[False]) for r in rows for f in r}
    vectors = []
    for row in rows:
        length = math.sqrt(sum(ratio[f] ** 2 for f in row))
        vectors.append({f: ratio[f] / length for f in row})
    weights, bias, dual = Counter(), 0.0, [0.0] * len(rows)
    rng = np.random.default_rng(3)
    for _ in range(quality.ROUNDS):
        for i in rng.permutation(np.array(learn)).tolist():
            x, y = vectors[i], 1.0 if good[i] else -1.0
            loss = y * (sum(weights[f] * v for f, v in x.items()) + bias) - 1
            moved = min(max(dual[i] - loss / (1 + sum(v * v for v in x.values())), 0.0), quality.COST)
            for f, v in x.items():
                weights[f] += (moved - dual[i]) * y * v
            bias += (moved - dual[i]) * y
            dual[i] = moved
    return ratio, weights, bias


def test_the_fit_equals_plain_loops():
    rng = np.random.default_rng(1)
    good = rng.random(90) < 0.4
    rows = [np.unique(rng.integers(0, 40, 12) + (25 if g else 0)).astype(np.uint32) for g in good]
    model = quality.fit(rows, good, (0.6, 0.4))
    ratio, weights, bias = fit_by_hand([r.tolist() for r in rows], good.tolist())
    assert model.bias == pytest.approx(bias, abs=1e-9)
    for f in ratio:
        assert model.ratios[f] == pytest.approx(ratio[f], abs=1e-9) and model.weights[f] == pytest.approx(weights[f], abs=1e-9)
    # margins and scores of rows, by the same dictionaries
    of, features = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]), np.concatenate(rows).astype(np.int64)
    margins = model.margins(of, features, len(rows))
    for row, margin, score in zip(rows, margins, model.scores(margins), strict=True):
        length = math.sqrt(sum(ratio[f] ** 2 for f in row.tolist()))
        by_hand = sum(ratio[f] * weights[f] for f in row.tolist()) / length + bias
        assert margin == pytest.approx(by_hand, abs=1e-9)
        assert score == pytest.approx(1 / (1 + math.exp(-(model.slope * by_hand + model.offset))), abs=1e-9)


def test_features_are_those_of_each_text_alone():
    texts = [(t or "").encode() for t in ODD_TEXTS] + [b"a b a b b", b"The the THE"]
    of, found = quality.Features().of(texts)
    for i, text in enumerate(texts):
        assert found[of == i].tolist() == quality.Features().of([text])[1].tolist()


# ---- lattice


def test_lattice_sums_all_segmentations():
    pieces = lattice_lm.read_pieces(PIECES)
    lattice = lattice_lm.Lattice(pieces)
    place = {(raw, begins): i for i, (raw, begins, _) in enumerate(pieces)}
    words = [b"a", b"the", b"tion", b"thenz", "é?".encode(), b"\xf0\x9f\x98\x80"]

    def by_hand(word):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
            parts = [word[a:b] for a, b in zip(at, at[1:])]
            for first in (True, False):
                if first:
                    keys = [(parts[0], True), *[(p, False) for p in parts[1:]]]
                else:
                    keys = [(b"", True), *[(p, False) for p in parts]]
                if all(k in place for k in keys):
                    total += math.prod(lattice.probabilities[place[k], 0] for k in keys) * lattice.stops[0]
        return math.log(total)

    assert np.allclose(lattice.log_probabilities(words)[:, 0], [by_hand(w) for w in words])


def test_expected_pieces_of_a_word_cover_it():
    pieces = lattice_lm.read_pieces(PIECES)
    lattice = lattice_lm.Lattice(pieces, 2)
    counts = np.zeros((len(pieces), 2))
    words = np.array([list(b"thention"), list(b"thention"), list(b"the\0\0\0\0\0"), list(b"onward\0\0")], np.uint8)
    lattice.expected(words, np.array([8, 8, 3, 6]), np.array([True, True, True, False]), np.array([0, 1, 1, 1]), counts)
    sizes = np.array([len(raw) for raw, _, _ in pieces])
    assert sizes @ counts == pytest.approx([8, 17]) and counts[lattice.begins].sum(axis=0) == pytest.approx([1, 2])


PLACES: dict[int, dict] = {}


def places(pieces) -> dict:
    if id(pieces) not in PLACES:
        PLACES[id(pieces)] = {(raw, begins): i for i, (raw, begins, _) in enumerate(pieces)}
    return PLACES[id(pieces)]


def plain_sum(lattice, pieces, word, kind=0):
    """Log of a word's sum over all segmentations, place by place with whole numbers of pieces, in logarithms."""
    p, place = lattice.probabilities[:, kind], places(pieces)
    sums = [math.log(p[place[b"", True]])] + [-np.inf] * len(word)
    for j in range(1, len(word) + 1):
        ways = [math.log(p[place[word[:j], True]])] if (word[:j], True) in place else []
        ways += [sums[i] + math.log(p[place[word[i:j], False]]) for i in range(max(0, j - lattice.longest), j) if (word[i:j], False) in place]
        sums[j] = np.logaddexp.reduce(ways)
    return sums[-1] + math.log(lattice.stops[kind])


def test_words_of_any_length(prose):
    """Short words, words cut at free places, and long stretches that no cut can divide, beside each other."""
    pieces = lattice_lm.read_pieces(PIECES)
    lattice = lattice_lm.Lattice(pieces, 2)
    rng = np.random.default_rng(3)
    lattice.fit(1, rng.random(len(pieces)) ** 4, 0.3)
    joined = prose(1, 400).replace(" ", "").encode()
    words = [b"a", joined[:48], joined[:49], joined[:700], b"x" * 49, b"x" * 1000, b"ab" * 333, bytes(rng.integers(128, 256, 300).tolist())]
    words += ["\N{CJK UNIFIED IDEOGRAPH-4E2D}\N{CJK UNIFIED IDEOGRAPH-6587}".encode() * 100, b"the" * 40 + b"\xff" * 90 + b"x" * 200]
    found = lattice.log_probabilities(words)
    for kind in range(2):
        assert np.allclose(found[:, kind], [plain_sum(lattice, pieces, w, kind) for w in words], rtol=1e-11)


def test_probabilities_of_a_lattice_add_up_to_one():
    """All words over two letters up to a length, of a vocabulary that has no other bytes; longer ones hold next to nothing."""
    pieces = [(b"", True, 0.3), (b"ab", True, 0.5), (b"b", True, 0.2), (b"a", False, 0.2), (b"b", False, 0.1), (b"aba", False, 0.3)]
    lattice = lattice_lm.Lattice(pieces)
    lattice.fit(0, np.array([3.0, 5, 2, 1, 2, 1]), 40.0)
    words = [bytes(w) for n in range(1, 17) for w in itertools.product(b"ab", repeat=n)]
    empty = lattice.probabilities[0, 0] * lattice.stops[0]
    assert np.exp(lattice.log_probabilities(words)).sum() + empty == pytest.approx(1, abs=1e-6)


def test_a_token_has_a_mass_of_one_in_every_kind():
    """Over the training words, what the lattice leaves for all others, and the end."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (500, 11)) * (rng.random((500, 11)) < 0.4)
    row, kind = np.nonzero(counts)
    texts = {f"k{k}": int(n) for k, n in enumerate(rng.integers(1, 50, 11))}
    columns = [(counts * 1.0).sum(axis=0), (counts > 0).sum(axis=0), (counts == 1).sum(axis=0), (counts == 2).sum(axis=0)]
    model = lattice_lm.Model(texts, *(np.array(c, float) for c in columns), int((counts.sum(axis=1) > 0).sum()))
    lattices = np.log(rng.dirichlet(np.ones(501), 11).T)  # of these words, and of all others together
    c = np.append(counts.sum(axis=1), 0)
    mass = np.exp(model.words_logs(lattices, c, row, kind, counts[row, kind].astype(float))).sum(axis=0) + model.ends / model.sizes
    assert np.allclose(mass, 1, rtol=1e-12)


def score_by_hand(rows, path):
    """log10 probability and lattice score of all texts: one token after the other, a model for each kind, one fitting."""
    pieces = lattice_lm.read_pieces(path)
    kinds = sorted({k or "" for _, _, learn, k in rows if learn})
    own = {k: Counter(w for _, t, learn, kind in rows if learn and (kind or "") == k for w in lattice_lm.tokens((t or "").encode())) for k in kinds}
    ends = {k: sum(learn and (kind or "") == k for _, _, learn, kind in rows) for k in kinds}
    every = sum(own.values(), Counter())
    lattice, start = lattice_lm.Lattice(pieces, len(kinds)), lattice_lm.Lattice(pieces)
    for i, k in enumerate(kinds):  # the expected number of each piece, word by word
        counts = np.zeros((len(pieces), len(kinds)))
        for w in own[k]:
            start.expected(np.frombuffer(w, np.uint8)[None], np.array([len(w)]), np.array([True]), np.array([0]), counts[:, i : i + 1])
        lattice.fit(i, counts[:, i], len(own[k]))
    n = {k: sum(own[k].values()) + ends[k] for k in kinds}
    d = {}
    for k in kinds:
        once, twice = (sum(c == x for c in own[k].values()) for x in (1, 2))
        d[k] = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5

    texts = [lattice_lm.tokens((t or "").encode()) for _, t, _, _ in rows]
    sums = {(w, i): math.exp(plain_sum(lattice, pieces, w, i)) for w in set().union(*texts) for i in range(len(kinds))}

    def p(word, i, k):
        rest = (1 - lattice_lm.SHARED) * sums[word, i] + lattice_lm.SHARED * every[word] / sum(every.values())
        return max(own[k][word] - d[k], 0) / n[k] + d[k] * len(own[k]) / n[k] * rest

    out = {}
    for doc_id, text, _, _ in rows:
        words, logs, lat = lattice_lm.tokens((text or "").encode()), [], 0.0
        for i, k in enumerate(kinds):
            log, seen = math.log(ends[k] / sum(ends.values())), Counter()
            for t, w in enumerate(words):
                log += math.log((lattice_lm.OWN * p(w, i, k) + seen[w]) / (lattice_lm.OWN + t))
                seen[w] += 1
            logs.append(log + math.log(lattice_lm.OWN * ends[k] / n[k] / (lattice_lm.OWN + len(words))))
        for w in words:
            lat += math.log10(sum(ends[k] / sum(ends.values()) * sums[w, i] for i, k in enumerate(kinds)))
        out[doc_id] = (np.logaddexp.reduce(logs) / math.log(10), lat + math.log10(sum(ends.values()) / sum(n.values())))
    return out


def test_scores_equal_the_model_written_out(spark, prose):
    """Eleven kinds, words that come often in a text, unknown words, odd texts."""
    texts = [*[t for t in ODD_TEXTS if t is None or len(t) < 100], *[prose(i, 12 + i) for i in range(30)], "ha " * 20 + "zzyx new new"]
    rows = [(i, t, i % 4 > 0, f"k{i % 11}" if i % 11 else None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean, lang string")
    expected = score_by_hand(rows, PIECES)
    for r in lattice_lm.score_texts(docs, PIECES, fittings=1, kind="lang").collect():
        assert (r.score, r.lattice_score) == pytest.approx(expected[r.doc_id], rel=1e-8)


def test_a_long_word_without_blanks_takes_time_by_its_bytes(spark):
    rows = [(1, "x" * 1_000_000, True, "a"), (2, "\N{CJK UNIFIED IDEOGRAPH-4E2D}" * 300_000, True, "b"), (3, "short words here", True, "a")]
    started = time.monotonic()
    found = {r.doc_id: r for r in lattice_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, learn boolean, lang string"), PIECES, kind="lang").collect()}
    assert found[1].n_tokens == 2 and all(-math.inf < r.score < 0 and -math.inf < r.lattice_score < 0 for r in found.values())
    assert time.monotonic() - started < 120


def base_by_hand(rows):
    tokens = {i: [*lattice_lm.tokens((t or "").encode()), None] for i, t, _ in rows}
    c = Counter(w for i, _, learn in rows if learn for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {
        i: (len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
        for i, own in tokens.items()
    }


def test_scores_of_texts(spark, prose, monkeypatch):
    """Base scores by hand; the same scores when almost no word is among the frequent ones; more training, better scores."""
    texts = [*ODD_TEXTS, *[prose(i, 60) for i in range(40)]]
    rows = [(i, t, i % 3 > 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "k" if r[0] % 2 else None, 1) for r in rows], "doc_id long, text string, learn boolean, lang string, score int")
    found = {r.doc_id: r for r in lattice_lm.score_texts(docs, PIECES, kind="lang").collect()}
    for i, (n_tokens, n_known, n, base) in base_by_hand(rows).items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score < 0
    monkeypatch.setattr(lattice_lm, "FREQUENT", 3)
    again = {r.doc_id: r.score for r in lattice_lm.score_texts(docs, PIECES, kind="lang").collect()}
    assert all(again[i] == pytest.approx(r.score, abs=1e-6) for i, r in found.items())


def test_scores_without_training_or_texts(spark):
    docs = spark.createDataFrame([(1, "a b", False), (2, None, False)], "doc_id long, text string, learn boolean")
    found = {r.doc_id: r for r in lattice_lm.score_texts(docs, PIECES).collect()}
    assert (found[1].n_tokens, found[1].n_known, found[1].train_tokens, found[1].score) == (3, 0, 0, -math.inf)
    assert found[2].base_score == 0.0
    assert lattice_lm.score_texts(docs.limit(0), PIECES).count() == 0


def test_log_gamma():
    x = np.array([1e-9, 0.3, 1.0, 5.5, 1e4])
    assert np.allclose(lattice_lm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_held_out_texts_score_better_than_by_words_alone(spark):
    found = lattice_lm.op9_lattice_lm(spark, FOLDER).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]


def test_every_language_is_learned(spark, monkeypatch):
    """More labels than get a full share, one of them frequent: each has windows in the sample, and the sample stays bounded."""
    rows = [(i, f"word{i % 230} text{i}", f"l{i % 230:03d}") for i in range(460)] + [(1000 + i, f"often {i}", "l000") for i in range(2000)]
    seen = {}
    monkeypatch.setattr(language, "train", lambda x, y, languages: seen.update(y=y, languages=languages))
    language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 2)
    assert seen["languages"] == [f"l{i:03d}" for i in range(230)]
    assert set(seen["y"].tolist()) == set(range(230))
    assert len(seen["y"]) <= 2 * 230 * language.WINDOWS_PER_TEXT


def test_lattice_has_the_longest_pieces():
    """All pieces of the vocabulary are in the lattice, and the sum is over all segmentations of a word of one of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    named = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    raws = [x.removeprefix(lattice_lm.MARK) for x in named]
    pieces = lattice_lm.read_pieces(PIECES)
    assert {x for x in raws if lattice_lm.MARK not in x} <= {raw for raw, _, _ in pieces}
    lattice = lattice_lm.Lattice(pieces)
    place = {(raw, begins): i for i, (raw, begins, _) in enumerate(pieces)}
    word = max((raw for raw, _, _ in pieces), key=len)
    assert len(word) > 16 and lattice.longest == len(word)
    logs = np.log(lattice.probabilities[:, 0])
    sums = [math.exp(logs[place[b"", True]])] + [0.0] * len(word)
    for j in range(1, len(word) + 1):
        if (word[:j], True) in place:
            sums[j] += math.exp(logs[place[word[:j], True]])
        sums[j] += sum(sums[i] * math.exp(logs[place[word[i:j], False]]) for i in range(j) if (word[i:j], False) in place)
    assert lattice.log_probabilities([word])[0, 0] == pytest.approx(math.log(sums[-1] * lattice.stops[0]))
