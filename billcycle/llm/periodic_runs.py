"""Stretches of words that repeat with a period, found by minimizers of several scales.

A run of period q is a longest stretch in which words q apart are the same, q being its smallest period. Periods up to SHORT are found by
comparing the words with themselves, moved by each such lag. Longer ones are found scale by scale. At scale k, which is for the
periods in (k / 2, k], every window of k / 2 consecutive k-grams picks those with the smallest hash. Inside a run the windows at i and i + q hold the
same words and so pick the same places, q apart; a k-gram of at least a period occurs inside the run at multiples of the
period only, so that no equal one lies between the two. Neighbours among equal picked k-grams whose distance fits the scale are
therefore seeds, and each run of four periods or more has one. Seeds are extended to both sides in the words themselves, so no hash decides.

The texts of a batch are looked at together, with a number that no word has behind each. A scale only looks at texts
that are long enough for it. Nothing is shuffled; the largest work of one task is one text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcycle.llm.common import mixed, steps, table, texts_of

#: Longest period that is found by comparing all words at that lag; a power of two.
SHORT = 16
#: Bytes of a long text that are split into words at once.
PART = 1 << 20
#: The seed and scale argument holds from so many periods on.
LEAST_TIMES = 4


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, part by part."""
    begin = 0
    while begin < len(text):
        end = begin + PART
        while end < len(text) and not text[end - 1 : end].isspace():
            end += 1
        yield text[begin:end].split()
        begin = end


def _numbered(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """A number for each word, with one that no word has after each text; the begin of each text; the words by number."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts, begins, size = [], [], 0
    for i, text in enumerate(texts):
        begins.append(size)
        for words in _parts(text or b""):
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
            size += len(words)
        parts.append(np.array([-1 - i], np.int32))
        size += 1
    return np.concatenate(parts), np.array([*begins, size], np.int64), list(ids)


def _slid(values: np.ndarray, width: int, choose: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``width`` consecutive values, from running ones of blocks of that width."""
    count = len(values) - width + 1
    blocks = np.pad(values, (0, -len(values) % width), mode="edge").reshape(-1, width)
    ahead = choose.accumulate(blocks, axis=1).reshape(-1)
    behind = choose.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return choose(behind[:count], ahead[width - 1 : width - 1 + count])


def _picked(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least hash of some window of this width."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    least = np.pad(_slid(hashes, width, np.minimum), width - 1)  # zeros never are a maximum that counts
    return np.flatnonzero(_slid(least, width, np.maximum) == hashes)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries are the same."""
    done, step = 0, 64
    while done < len(a):
        apart = np.flatnonzero(a[done : done + step] != b[done : done + step])
        if len(apart):
            return done + int(apart[0])
        done, step = done + step, 2 * step
    return len(a)


def _short(words: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, lengths, period) of the stretches with a period up to SHORT."""
    for period in range(1, min(SHORT, len(words) - 1) + 1):
        same = np.zeros(len(words) - period + 2, np.int8)
        same[1:-1] = words[:-period] == words[period:]
        edges = np.flatnonzero(np.diff(same))
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + period
        long = lengths >= max(least, times * period)
        yield starts[long], lengths[long], period


def _scaled(words: np.ndarray, begins: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the stretches with a longer period; one may come with a multiple of its smallest period."""
    at, sizes = np.arange(len(words)), np.diff(begins) - 1
    hashes, k = mixed(words.astype(np.int64).view(np.uint64)), 1
    texts = np.arange(len(sizes))
    while len(texts):
        long = sizes[texts] >= times * (max(k, SHORT) + 1)  # texts that may hold a run of the next scale
        if not long.all():
            kept = np.repeat(long, sizes[texts] + 1)
            at, hashes, texts = at[kept], hashes[kept], texts[long]
        if not len(texts):
            return
        beyond = mixed(np.arange(min(k, len(hashes)), dtype=np.uint64) + np.uint64(1 << 63))  # k-grams past the end
        hashes = mixed(hashes * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([hashes[k:], beyond]))
        k *= 2
        if k <= SHORT:
            continue
        picked = _picked(hashes, k // 2)
        order = picked[np.argsort(hashes[picked], kind="stable")]
        apart = np.diff(order)
        near = np.flatnonzero((hashes[order[1:]] == hashes[order[:-1]]) & (apart > k // 2) & (apart <= k))
        seeds, periods = at[order[near]], apart[near]
        by_period = np.lexsort((seeds, periods))
        known = (0, -1)  # the period and the end of the last stretch
        for seed, period in zip(seeds[by_period].tolist(), periods[by_period].tolist(), strict=True):
            if known[0] == period and seed < known[1]:
                continue
            end = seed + _equal(words[seed : len(words) - period], words[seed + period :])
            start = seed - _equal(words[:seed][::-1], words[period : seed + period][::-1])
            known = (period, end)
            if end - start + period >= max(least, times * period):
                yield start, end - start + period, period


def runs_of(words: np.ndarray, begins: np.ndarray, least: int, times: int) -> np.ndarray:
    """(n, 3): start, length and smallest period of all runs, by start and then period.

    A stretch found with a multiple of its smallest period is found with that as well, with the same start and length.
    """
    found = [np.stack([s, n, np.full(len(s), p)], axis=1) for s, n, p in _short(words, least, times) if len(s)]
    found.append(np.array(list(_scaled(words, begins, least, times)), np.int64).reshape(-1, 3))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(words: np.ndarray, names: list[bytes], dropped: np.ndarray) -> bytes:
    kept = words[~dropped]
    return b" ".join(b" ".join(map(names.__getitem__, kept[i : i + PART].tolist())) for i in range(0, len(kept), PART))


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(docs: DataFrame, least: int = 6, times: int = LEAST_TIMES) -> DataFrame:
    """The columns of docs but text, with runs (start and length in words, smallest period; by start, then period) and collapsed.

    Words are what ASCII white space separates. A run is a stretch of at least ``least`` words and ``times`` periods that no
    neighbouring word extends. collapsed is the text without the words that some run holds after its first period, joined by one space. A null,
    empty or blank text has no run and collapses to the empty text. Every row counts, repeated ones too; an empty table
    gives an empty result. Other columns pass as they are, but those of docs named runs or collapsed do not.
    """
    if times < LEAST_TIMES:
        raise ValueError(f"runs are found from {LEAST_TIMES} periods on")
    names = [c for c in docs.columns if c not in ("text", "runs", "collapsed")]
    fields = [pa.field(x, pa.int64()) for x in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            texts = texts_of(batch)
            words, begins, known = _numbered(texts)
            runs = runs_of(words, begins, least, times)
            cuts = np.searchsorted(runs[:, 0], begins)
            dropped = np.zeros(len(words), bool)
            for start, length, period in runs.tolist():
                dropped[start + period : start + length] = True
            collapsed = [
                _collapsed(words[b : e - 1], known, dropped[b : e - 1]) if first < last else b" ".join(map(b" ".join, _parts(text or b"")))
                for text, b, e, first, last in zip(texts, begins.tolist(), begins[1:].tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False)
            ]
            own = runs[:, 0] - np.repeat(begins[:-1], np.diff(cuts))
            structs = pa.StructArray.from_arrays([pa.array(own), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=fields)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                names=[*names, "runs", "collapsed"],
            )

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(*[f"`{c}`" for c in names], "text").mapInArrow(run, f"{schema}runs {RUNS}, collapsed string")


def _digit_and_rest():
    """h % 10 and floor(h / 10) of the crc32 h of the id in decimal; a null id counts as empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return h % 10, F.floor(h / 10)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; of a tenth of the rows, by id, the words from one place on repeat the first of them with a period."""
    digit, rest = _digit_and_rest()
    words = F.filter(F.split(F.when(digit == 0, F.col("text")), r"[ \x09-\x0D]+"), lambda w: w != "")
    found = docs.select("doc_id", "text", words.alias("words"), rest.alias("g")).withColumn("n", F.size("words"))
    found = found.withColumn("a", F.expr("cast(pmod(g, greatest(n, 1)) as int)"))
    found = found.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    copies = "slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)"
    changed = F.expr(f"array_join(concat(slice(words, 1, a), {copies}), ' ')")
    return found.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """One row per row of found (doc_id, runs, collapsed): the number of runs, the one of the most periods, and digests.

    The quotient of length and period as a double tells fractions apart as long as a text has fewer than 2^26 words.
    """
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("k"), r["start"], r["period"], r["length"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic_runs(spark, folder) -> DataFrame:
    return run_digests(periodic_runs(with_planted_periods(table(spark, folder, "documents").select("doc_id", "text"))))


def runs_sql() -> str:
    """The same by gaps and islands: equal 4-grams at each distance, no minimizers.

    Words at a distance q are the same over 3 q places (5 at least) of a run, so equal 4-grams at that distance fill 2 places or more.
    """
    return """
with ids as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
    list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(coalesce(doc_id::varchar, '')) + 1),
        lambda i: ord(coalesce(doc_id::varchar, '')[i])::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
        lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) as crc
  from documents),
numbered as (
  select rid, doc_id, xor(crc, 4294967295) % 10 as digit, xor(crc, 4294967295) // 10 as g,
    list_filter(regexp_split_to_array(text, '[ \\x09-\\x0D]+'), lambda w: w <> '') as own
  from ids),
placed as (
  select *, len(own) as n, case when len(own) > 0 then g % len(own) end as a,
    case when len(own) > 0 then 1 + (len(own) - g % len(own)) // (3 + g % 8) end as p
  from numbered),
texts as (
  select rid, doc_id, n, case when digit = 0 and n > 0
    then list_transform(range(n), lambda i: own[case when i < a then i + 1 else a + (i - a) % p + 1 end]) else own end as words
  from placed),
grams as (
  select rid, unnest(range(n - 3)) as i, unnest(list_transform(range(n - 3), lambda i: array_to_string(words[i + 1 : i + 4], ' '))) as gram
  from texts where n >= 6),
pairs as (
  select x.rid, x.i, y.i - x.i as q
  from grams x join grams y on x.rid = y.rid and x.gram = y.gram and x.i < y.i join texts t on t.rid = x.rid
  where 4 * (y.i - x.i) <= t.n),
islands as (
  select rid, q, min(i) as start, max(i) - min(i) + 4 + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as island from pairs)
  group by rid, q, island),
runs as (
  select rid, start, length, min(q) as period from islands where length >= 6 and length >= 4 * q group by rid, start, length),
best as (
  select rid, count(*) as n_runs, min(struct_pack(k := -(length / period), start := start, period := period, length := length)) as best,
    sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as runs_sha256
  from runs group by rid),
gone as (select distinct rid, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select w.rid, string_agg(word, ' ' order by w.i) as collapsed
  from (select rid, unnest(range(n)) as i, unnest(words) as word from texts) w
    anti join gone g on g.rid = w.rid and g.i = w.i
  group by w.rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, best.start::bigint as start, best.length::bigint as length,
  best.period::bigint as period, (1000 * best.length // best.period)::bigint as exponent_milli,
  coalesce(runs_sha256, sha256('')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from texts left join best using (rid) left join kept using (rid)
"""
