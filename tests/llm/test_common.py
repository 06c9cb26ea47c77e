from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest

from billcycle.llm import common


def session(master, setting=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: setting),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_folder_is_the_clusters():
    assert common.shared_folder(session("yarn", "hdfs:///shared/")).startswith("hdfs:///shared/")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_folder(session(master))
    one, two = (common.shared_folder(session("local[2]")) for _ in range(2))
    assert one != two and one.rpartition("/")[0] == two.rpartition("/")[0]


def test_word_hashes_do_not_depend_on_neighbours(prose):
    texts = [None, b"", b"  ", b"Aa bB", prose(1, 3000).encode(), b"x" * 300_000 + b" y", "é É".encode()]
    words = common.Words(common.SPACE)
    hashed, where = words.hashes(texts)
    for i, text in enumerate(texts):
        own = (text or b"").lower().split()
        assert hashed[where == i].tolist() == [int(common.Words(common.SPACE).hashes([w])[0][0]) for w in own[:50]] + hashed[
            where == i
        ].tolist()[50:]
        assert (where == i).sum() == len(own)
    assert len(set(hashed.tolist())) == len({w for t in texts for w in (t or b"").lower().split()})


def test_grams_are_ordered_and_of_their_length():
    words = np.arange(10, dtype=np.uint64)
    assert len(common.grams(words, 5)) == 6 and len(common.grams(words, 11)) == 0
    assert common.grams(words, 2)[0] != common.grams(words[::-1], 2)[-1]


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (301, 300), (300, 301)]
    found = {r.node: r.label for r in common.union_find_table(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{k: 100 for k in range(100, 160)}, 300: 300, 301: 300}
    assert common.union_find_table(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_written_in_few_files(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(0, 300) if i % 7] + [(1000 + i, 1000 + i // 2) for i in range(1, 100)]
    data, small = spark.createDataFrame(edges, "a long, b long"), common.FILE_EDGES
    settings = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    found, files = [], []
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for most in (small, 120):
            monkeypatch.setattr(common, "FILE_EDGES", most)
            labels = common.union_find_table(data)
            files.append(len(labels.inputFiles()))
            found.append({r.node: r.label for r in labels.collect()})
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = {n: i - i % 7 + 1 for i in range(0, 300) if i % 7 for n in (i, i + 1)} | dict.fromkeys(range(1000, 1100), 1000)
    assert found == [whole, whole]
    assert files[0] == 1 and 1 < files[1] <= len(edges) // 120 + 1
