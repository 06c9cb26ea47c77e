from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from billcycle.llm.periodic_runs import periodic_runs, op12_periodic_runs
from tests.llm.conftest import ODD_TEXTS


def brute(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, from every lag."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs) -> bytes:
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text) -> list[bytes]:
    words = (text or "").encode().split()
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def repetitive(rng: random.Random) -> str:
    parts: list[str] = []
    for _ in range(rng.randint(0, 4)):
        alphabet = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])]
        unit = [rng.choice(alphabet) + rng.choice(["", "1", "é"]) for _ in range(rng.choice([1, 2, 3, 5, 16, 17, 20, 32, 33, 40, 64, 65, 90]))]
        parts += (unit * rng.choice([1, 2, 4, 5]))[: len(unit) * 5 - rng.randint(0, len(unit))]
    return "".join(w + rng.choice([" ", "\n", "\t ", "\x0b"]) for w in parts)


def test_runs_equal_all_lags(spark, documents):
    rng = random.Random(3)
    texts = [repetitive(rng) for _ in range(400)] + list(ODD_TEXTS)
    found = {r.doc_id: r for r in periodic_runs(documents([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert len(found) == len(texts)
    seen = set()
    for i, text in enumerate(texts):
        words = (text or "").encode().split()
        expected = brute(words)
        seen |= {q for _, _, q in expected}
        assert [(r.start, r.length, r.period) for r in found[i].runs] == expected
        assert found[i].collapsed.encode() == collapsed(words, expected)
    assert min(seen) == 1 and max(seen) >= 64  # lags and several scales


def test_one_long_text_with_runs_of_every_scale(spark, documents, prose):
    parts, expected, at = [], [], 0
    for k, period in enumerate([1, 3, 16, 17, 100, 1000, 4097]):
        between = prose(k, 50).split() + [f"left{k}"]
        unit = [f"u{k}x{j}" for j in range(period)]
        length = max(6, 4 * period) + k
        parts += between + (unit * (length // period + 1))[:length] + [f"right{k}"]
        expected.append((at + len(between), length, period))
        at += len(between) + length + 1
    (row,) = periodic_runs(documents([(1, " ".join(parts), "en", "s")])).collect()
    assert [(r.start, r.length, r.period) for r in row.runs] == expected
    assert row.collapsed.encode() == collapsed([w.encode() for w in parts], expected)


def test_only_the_same_word(spark, documents):
    """A million equal words are one run, found in time that follows the length."""
    (row,) = periodic_runs(documents([(1, "ha " * 1_000_000, "en", "s")])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 1_000_000, 1)] and row.collapsed == "ha"


def test_a_text_without_blanks(spark, documents):
    (row,) = periodic_runs(documents([(1, "x" * 3_000_000, "en", "s")])).collect()
    assert row.runs == [] and len(row.collapsed) == 3_000_000


def test_least_words_and_times(spark, documents):
    docs = documents([(1, "a b " * 5 + "z " * 7, "en", "s")])
    assert [tuple(r) for r in periodic_runs(docs, least=8, times=5).first().runs] == [(0, 10, 2)]
    with pytest.raises(ValueError):
        periodic_runs(docs, times=3)


def test_clashing_columns_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "a a a a a a", "mine", "gone", 5), (1, "a a a a a a", "mine", "gone", 5), (None, None, None, None, None)],
        "doc_id long, text string, period string, runs string, `odd name` int",
    )
    found = periodic_runs(docs)
    assert found.columns == ["doc_id", "period", "odd name", "runs", "collapsed"]
    rows = sorted(found.collect(), key=str)
    assert [r.collapsed for r in rows] == ["a", "a", ""] and rows[0].period == "mine" and rows[0]["odd name"] == 5
    assert periodic_runs(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, tmp_path, documents, prose):
    rng = random.Random(8)
    rows = [(i, prose(i, rng.randint(0, 300)) if i % 3 else repetitive(rng), "en", "s") for i in range(600)]
    rows += [(10_000 + i, t, None, None) for i, t in enumerate(ODD_TEXTS)] + [(None, "a b c " * 9, None, None), rows[7], rows[7]]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for doc_id, text, _, _ in rows:
        words = planted(doc_id, text)
        runs = brute(words)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        expected.append(
            (
                doc_id,
                len(runs),
                *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
                hashlib.sha256(lines.encode()).hexdigest(),
                hashlib.sha256(collapsed(words, runs)).hexdigest(),
            )
        )
    found = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
