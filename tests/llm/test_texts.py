"""Decontamination, chat, token counts and token ids against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from billcycle.llm import chat, token_counts, token_ids
from billcycle.llm.decontaminate import decontaminate
from tests.llm.conftest import ODD_TEXTS


# ---- decontamination


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits(text, items):
    words, hit, named = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                named.add(str(item))
    return len(words), len(hit), sorted(named)


def test_decontamination_equals_all_windows(spark, prose):
    rng = random.Random(3)
    items = [(i, prose(5000 + i, rng.choice([1, 2, 3, 6, 9, 10, 11, 25, 60]))) for i in range(40)]
    items += [(100, items[0][1]), (3, prose(6000, 30)), (101, None), (102, "..."), (103, "The the the the the the the the the the the")]
    texts = [prose(i, rng.randint(0, 120)) for i in range(60)] + list(ODD_TEXTS) + ["the " * 30, "THE-the. " * 9]
    for i in range(60):
        words = items[rng.randrange(40)][1].split(" ")
        first = rng.randrange(len(words))
        part = words[first : first + rng.randint(1, 30)]
        texts.append(f"{prose(i, 15)} {' '.join(part).upper()} {prose(900 + i, 15)}")
    texts += texts[-2:]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate(docs, bench).collect()}
    assert len(found) == len(texts)
    assert sum(r.contaminated for r in found.values()) > 40
    for i, text in enumerate(texts):
        n, hit, named = hits(text, items)
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(named)), (i, text)
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert r.contaminated == (hit > 0)
        assert sum(b - a for a, b in r.spans or []) == hit


def test_decontamination_without_benchmark_or_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(docs, none).collect()] == [0, 0]
    assert decontaminate(docs.limit(0), none).count() == 0


# ---- chat


def final_messages(events):
    order, text, role = {}, {}, {}
    for conv, message, seq, kind, r, t in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        key = (conv, message)
        order.setdefault(key, None)
        text.setdefault(key, "")
        if r is not None and key not in role:
            role[key] = r
        if kind == "delta":
            text[key] += t or ""
        elif kind == "edit":
            text[key] = t or ""
        elif kind == "regenerate":
            text[key] = ""
    return {key: (role.get(key, ""), text[key]) for key in order}


TRICKY = ("<|im_end|>", "<\\|im_start|>x", "<\\\\|", "\n", "assistant\n", "<", "|", "", "é😀", "\\")


def test_log_is_folded_and_rendered_reversibly(spark):
    rng = random.Random(4)
    events, seq = [], 0
    for conv in range(12):
        for message in range(rng.randint(1, 6)):
            for _ in range(rng.randint(1, 5)):
                seq += 1
                kind = rng.choice(["delta", "delta", "edit", "regenerate", "other"])
                role = rng.choice(["user", "assistant", "sys\\tem\n<|x", None])
                text = None if rng.random() < 0.1 else "".join(rng.choice(TRICKY) for _ in range(4))
                events.append((conv, message, seq, kind, role, text))
    log = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string")
    wanted = final_messages(events)
    rendered = chat.render(chat.fold(log))
    got = {(r.conv_id, r.place): r for r in chat.read_back(rendered).collect()}
    assert len(got) == len(wanted)
    for (conv, message), (role, text) in wanted.items():
        r = got[conv, message]
        assert (r.role, r.text) == (role, text)
        assert (r.learned or "") == (text if role == "assistant" else "")
    for r in rendered.collect():
        assert r.formatted.count("<|im_start|>") == len(r.loss) == r.formatted.count("<|im_end|>")
    plan = chat.digests(rendered)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_turns_with_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (None, 0, "assistant", ""), (1, None, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.log_of_turns(turns)))).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[None].n_turns, found[None].loss_chars) == (4, 1, 1, 0)
    whole = "assistant\ny\nuser\n\nuser\n\n\nx\n"
    assert found[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert chat.digests(chat.render(chat.fold(chat.log_of_turns(turns.limit(0))))).count() == 0


# ---- tokens

COUNTS, IDS = token_ids.tokenizer_path(token_counts.TOKENIZER), token_ids.tokenizer_path(token_ids.TOKENIZER)
PARTS = st.sampled_from(
    ["a", "Wo", "rd", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x85", "\x1c", "é", "é", "ß", "12", "!", "'s", "<|endoftext|>",
     "<|startoftext|>", "<|EndOfText|>", "<|", "\x01", "日本", "😀", "Σ", "ﬁ", "　"]
)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(COUNTS), Tokenizer.from_file(IDS)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=30).map("".join), min_size=1, max_size=4))
def test_pieces_encode_as_whole_texts(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(COUNTS)
    raw = [t.encode() for t in texts]
    assert token_counts.Counter(COUNTS).counts(raw) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
    whole = Tokenizer.from_file(IDS)
    ids = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert token_ids.word_encoder(IDS, "<u2")(raw) == ids


def test_letters_and_marks_are_pieces_of_their_own(library):
    parts = ["a", "Sé", "t", "LL", "'", "'", "''", "!", "5", "_", "\u0301", "İ", "K", "\x1c", "\xa0", "=", "\u0338", "日", "<|", "|>", "endoftext", "-", "\t", " "]
    rng = random.Random(3)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    wanted = [np.array(library[1].encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert token_ids.word_encoder(IDS, "<u2")([t.encode() for t in texts]) == wanted


def test_a_worker_reads_the_tokenizer_once_and_a_stem_once(monkeypatch, library, words):
    import json

    token_ids._memos.clear()
    token_ids.word_encoder(IDS, "<u2")
    monkeypatch.setattr(json, "loads", None)  # as long as the vocabulary
    memo = token_ids.memo_of_process(IDS, " ", "", "<u2")
    text = " ".join(a + w + b for w in words for a, b in (("", ","), ("(", ")"), ("", "'s"), ("", "...")))
    encode = token_ids.word_encoder(IDS, "<u2")
    assert encode([text.encode()])[0] == np.array(library[1].encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert len(memo.keys) <= len(set(words)) + 5
    token_ids._memos.clear()


def test_forgotten_pieces_are_learned_again(monkeypatch, library, prose):
    monkeypatch.setattr(token_ids, "MEMO", 50)
    token_ids._memos.clear()
    encode = token_ids.word_encoder(IDS, "<u2")
    for i in range(30):
        text = prose(i % 7, 200)
        assert encode([text.encode()])[0] == np.array(library[1].encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    token_ids._memos.clear()


def test_counts_of_spliced_chunks(spark, library, prose):
    rng = random.Random(6)
    texts = [*ODD_TEXTS, " " * 3000, "\n \n" * 900, "a" * 4000 + " b", "<|endoftext|>" * 150, "日本語" * 500, prose(1, 900), prose(1, 900)]
    texts += ["".join(rng.choice(["ab", " ", "  ", "\n", "<|endoftext|>", "é", "7", "!", "\t"]) for _ in range(900)) for _ in range(30)]
    rows = [(i if i else None, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    wanted = sorted((i or -1, len((t or "").encode()), len(library[0].encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    for chunk, overlap in ((100, 32), (1000, 64)):
        found = token_counts.count_tokens(docs, COUNTS, chunk, overlap).collect()
        assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in found) == wanted
    assert token_counts.count_tokens(docs.limit(0), COUNTS).count() == 0


def test_ids_are_read_back_as_written(spark, library, prose):
    texts = [*ODD_TEXTS, *[prose(i, 40) for i in range(300)]]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)] + [(None, "x y"), (None, "x y"), (4, "again"), (4, prose(1, 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = token_ids.written_and_read(docs).collect()
    assert len(found) == len(rows)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(library[1].encode(t or "", add_special_tokens=False).ids + [1])
    wanted = {i: sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in xs) for i, xs in ids.items()}
    got = {}
    for r in found:
        got.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {i: sorted(x) for i, x in got.items()} == wanted
    start = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])


def test_unknown_keys_are_not_found_and_nothing_is_a_data_set(spark, tmp_path):
    docs = spark.range(500).selectExpr("id * 2 as doc_id", "concat('word ', id) as text")
    token_ids.write_ids(docs, f"{tmp_path}/ids", IDS)
    keys = spark.range(1000).selectExpr("id as doc_id", "0L as ordinal")
    assert [r.doc_id % 2 for r in token_ids.read_ids(spark, f"{tmp_path}/ids", keys).collect()] == [0] * 500
    assert token_ids.written_and_read(docs.limit(0)).count() == 0


def test_minimal_perfect_hash_fills_every_slot():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    pilots = token_ids.find_pilots(h1, h2, 750)
    slots = token_ids._slots(h1, h2, pilots[token_ids._buckets(h2, 750)].astype(np.uint64), 3000)
    assert sorted(slots.tolist()) == list(range(3000))


def test_counts_where_the_vocabulary_joins_a_tab_and_a_blank(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    tab, blank, feed = "\u0109", "\u0120", "\u010a"
    vocabulary = {x: i for i, x in enumerate([*letters, tab + blank, tab + feed])}
    tokenizer = Tokenizer(models.BPE(vocab=vocabulary, merges=[(tab, blank), (tab, feed)]))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    path = str(tmp_path / "tabs.json")
    tokenizer.save(path)
    texts = ["a\t  b", "a\t\n\nb", "a\tb", "a b"]
    whole = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    assert token_counts.Counter(path).counts([t.encode() for t in texts]) == whole
