"""The mix against sorted hash order, by hand and by its SQL."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from billcycle.llm.mixing import mix, mixed_rows
from tests.llm.conftest import ODD_TEXTS


def by_hand(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    hashes = [int(hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16) for i, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    whole = {s: sum(z for z, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(size) - sum(3 * whole[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * whole[s] if s in full else rest * weight[s] / share for s in names}
        more = {s for s in names if s not in full and target[s] >= 3 * whole[s]}
        if not more or not whole:
            break
        full |= more
        if len(full) == len(names):
            target = {s: 3 * whole[s] for s in names}
            break
    taken = [0] * len(rows)
    for s in names:
        times = int(target[s] // whole[s]) if whole[s] else 0
        missing, got = target[s] - times * whole[s], 0
        mine = sorted({hashes[k] for k, r in enumerate(rows) if r[2] == s})
        chosen = set()
        for h in mine:
            words = sum(size[k] for k, r in enumerate(rows) if r[2] == s and hashes[k] == h)
            if got + words > missing and got + words - missing >= missing - got:
                break
            chosen.add(h)
            got += words
            if got > missing:
                break
        for k, r in enumerate(rows):
            if r[2] == s:
                taken[k] = size[k] * (times + (times < 3 and hashes[k] in chosen))
    return size, target, taken


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_the_sorted_order(spark, documents, prose, seed):
    rng = random.Random(seed)
    sources = ["a", "B", "é", None, "tiny", "z"]
    rows = [(i, prose(i, rng.randint(1, 60)), rng.choice(["a", "a", "a", *sources])) for i in range(150)]
    rows = [(i, t, "tiny" if i < 3 else s if s != "tiny" else "a") for i, t, s in rows]
    rows += [(1000 + k, t, "odd") for k, t in enumerate(ODD_TEXTS)] + [(None, "no id", "a"), (5, rows[5][1], rows[5][2])]
    size, target, taken = by_hand(rows)
    docs = documents([(i, t, None, s) for i, t, s in rows])
    found = mix(docs).toPandas()
    assert sorted(found["size"]) == sorted(size)
    goals = {(None if s != s else s): t for s, t in zip(found.source, found.target)}
    assert {s: round(t, 6) for s, t in goals.items()} == {s: round(t, 6) for s, t in target.items()}
    key = lambda i, z: (-1 if i is None or i != i else int(i), int(z))
    assert sorted(key(*r) for r in found[["doc_id", "taken"]].itertuples(index=False)) == sorted(
        key(r[0], z) for r, z in zip(rows, taken)
    )
    again = mix(docs.repartition(7)).toPandas()
    assert sorted(again.taken) == sorted(found.taken)
    assert sum(len((r.text or "").split()) for r in mixed_rows(docs).collect()) == pytest.approx(sum(taken), abs=40)


def test_mix_of_nothing_and_of_empty_texts(spark, documents):
    assert mix(documents([])).count() == 0
    found = mix(documents([(1, None, None, None), (2, "", None, "a")])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in found} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
