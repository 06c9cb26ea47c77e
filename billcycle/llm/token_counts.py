"""Token counts of whole texts, where huge texts are encoded in overlapping chunks that are spliced again.

The tokenizer cuts a text into pieces from left to right by a pattern that looks at most one character ahead and never
behind, and merges bytes inside a piece only. So where two encodings of the same text both begin a piece, they agree from there
on, as long as the texts of both go on (far enough for the longest special string). Neighbouring chunks share
an overlap; the splice is their first common piece boundary in it. The part of the overlap next to the first chunk's end, where its
pieces and special strings may be cut short, is not used. Where no boundary is common, as inside one run of letters longer than the
overlap, the document's chunks are doubled until there is one; one chunk for the whole text always ends this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billcycle.llm.common import Words, scratch, steps, table, texts_of
from billcycle.llm.token_ids import ODD_SPACE, STEP_BYTES, memo_of_process, tokenizer_of_process, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Characters of a chunk, and of the overlap with the next one.
CHUNK = 1 << 14
OVERLAP = 256


class Counter:
    """Counts tokens of whole texts and lists the piece boundaries of chunks."""

    def __init__(self, path: str) -> None:
        import regex

        self.tokenizer, self.memo = tokenizer_of_process(path), memo_of_process(path, "", " \n", None)
        self.words = Words(b" \n", lower=False)
        self.odd = regex.compile(ODD_SPACE)
        #: Bytes that such white space may begin with
        self.maybe = np.zeros(256, bool)
        self.maybe[[*range(10), *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Characters next to a chunk's end that may be encoded otherwise when the text goes on
        self.margin = max([len(x) for x in special], default=0) + 2

    def _runs(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where runs of blanks and the word after them begin and end; a blank after another character begins a piece."""
        return np.unique(np.concatenate([self.words.bounds(data)[1], begins, ends]))

    def counts(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text, run by run; the library gets whole texts that have other white space."""
        if not texts:
            return []
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        begins = np.concatenate([[0], ends[:-1]])
        cuts = self._runs(data, begins, ends)
        starts, stops = cuts[:-1], cuts[1:]
        at = self.memo.places(self.words.ranges(data, starts, stops), starts, stops, joined)
        totals = np.bincount(np.searchsorted(ends, starts, side="right"), self.memo.sizes[at], len(texts)).astype(int)
        doubtful = np.add.reduceat(self.maybe[np.append(data, 0)], begins) * (ends > begins)
        for i in np.flatnonzero(doubtful).tolist():
            whole = texts[i].decode()
            if self.odd.search(whole):
                totals[i] = len(self.tokenizer.encode_batch_fast([whole], add_special_tokens=False)[0])
        return totals.tolist()

    def boundaries(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each chunk the characters at which pieces begin, the tokens before each, and the tokens in all.

        Pieces begin where runs do, or in chunks with other white space wherever the library's pieces do.
        """
        out: list = [None] * len(chunks)
        for i, chunk in enumerate(chunks):
            if self.odd.search(chunk):
                found = self.tokenizer.encode(chunk, add_special_tokens=False)
                # pieces cover the text without gaps, so a piece begins where its first token does
                firsts = np.flatnonzero(np.diff(np.array(found.word_ids, np.int64), prepend=-1))
                out[i] = (np.array(found.offsets, np.int64).reshape(-1, 2)[firsts, 0], firsts, len(found))
        plain = [i for i, x in enumerate(out) if x is None]
        raw = [chunks[i].encode() for i in plain]
        joined = b"".join(raw)
        data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum([0] + [len(x) for x in raw])
        cuts = self._runs(data, ends[:-1], ends[1:])
        starts, stops = cuts[:-1], cuts[1:]
        places = self.memo.places(self.words.ranges(data, starts, stops), starts, stops, joined)
        before = np.concatenate([[0], np.cumsum(self.memo.sizes[places])])
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first = np.searchsorted(cuts, ends)
        for k, i in enumerate(plain):
            a, b = first[k], first[k + 1]
            out[i] = (characters[starts[a:b]] - characters[ends[k]], before[a:b] - before[a], int(before[b] - before[a]))
        return out


_ENDS = "head array<struct<at: long, before: long>>, tail array<struct<at: long, before: long>>"
_CHUNK = "chunk int, begin long, last boolean, piece string"


def _cut(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Whole texts of at most a chunk and its overlap with their tokens; others as a row for each chunk, begin, piece."""
    passed = docs.drop("text").columns
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in steps(batches, most=STEP_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            short = [i for i, x in enumerate(texts) if len(x) <= chunk + overlap]
            raw = texts_of(batch)
            counts = counter.counts([raw[i] or b"" for i in short])
            rows = [(i, n, 0, 0, True, None) for i, n in zip(short, counts, strict=True)]
            for i, x in enumerate(texts):
                if len(x) > chunk + overlap:
                    begins = range(0, len(x) - overlap, chunk)
                    rows += [(i, None, k, b, b == begins[-1], x[b : b + chunk + overlap]) for k, b in enumerate(begins)]
            where, *found = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(where)) for c in passed] + [pa.array(x, k) for x, k in zip(found, kinds, strict=True)],
                names=[*passed, "n_tokens", "chunk", "begin", "last", "piece"],
            )

    return docs.mapInArrow(run, f"{schema}, n_tokens long, {_CHUNK}")


def _count_chunks(parts: DataFrame, path: str, overlap: int) -> DataFrame:
    """The rows of _cut with the tokens of each chunk in place of its text, and the boundaries in both its overlaps."""
    passed = parts.drop("piece", "n_tokens", "begin").columns
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in passed)
    pairs = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in steps(batches, "piece", STEP_BYTES):
            pieces, total, begins, chunks, lasts = (
                batch.column(c).to_pylist() for c in ("piece", "n_tokens", "begin", "chunk", "last")
            )
            heads, tails = [None] * len(pieces), [None] * len(pieces)
            cut = [i for i, x in enumerate(pieces) if x is not None]
            for i, (at, before, tokens) in zip(cut, counter.boundaries([pieces[i] for i in cut]), strict=True):
                total[i], size = tokens, len(pieces[i])
                head = at < overlap - counter.margin
                tail = (at >= size - overlap) & (at < size - counter.margin)
                for keep, out, wanted in ((head, heads, chunks[i] > 0), (tail, tails, not lasts[i])):
                    if wanted:
                        pair = zip(at[keep].tolist(), before[keep].tolist(), strict=True)
                        out[i] = [{"at": begins[i] + a, "before": b} for a, b in pair]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed]
                + [pa.array(total, pa.int64()), pa.array(heads, pairs), pa.array(tails, pairs)],
                names=[*passed, "n_tokens", "head", "tail"],
            )

    return parts.mapInArrow(run, f"{schema}, n_tokens long, {_ENDS}")


def _spliced(parts: DataFrame) -> DataFrame:
    """rid, n_tokens (null where two neighbours have no common boundary) of the documents with several chunks."""
    order = Window.partitionBy("rid").orderBy("chunk")
    common = F.expr("array_min(array_intersect(transform(tail, x -> x.at), transform(next_head, x -> x.at)))")
    at = lambda column: F.expr(f"get(filter({column}, x -> x.at = splice), 0).before")
    found = F.bool_and(F.col("last") | F.col("splice").isNotNull())
    return (
        parts.withColumn("next_head", F.lead("head").over(order))
        .withColumn("splice", common)
        # tokens up to the splice with the next chunk, less those that the next chunk has before it
        .withColumn("upto", F.when(F.col("last"), F.col("n_tokens")).otherwise(at("tail")))
        .withColumn("skipped", F.when(F.col("last"), F.lit(0)).otherwise(at("next_head")))
        .groupBy("rid")
        .agg(F.when(found, F.sum(F.col("upto") - F.col("skipped"))).alias("n_tokens"))
    )


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row of docs (doc_id, text; more columns are ignored).

    The counts are those of the library for the whole text: special strings as it handles them by default, no added tokens.
    Null and empty texts have none. doc_ids may be null or repeat: a row's chunks are joined by a number of its own. The
    chunks of huge texts are dealt out, so that one text is no task's burden.
    """
    bytes_of = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long"))
    huge = F.length("text") > chunk + overlap
    numbered = docs.select(
        "doc_id",
        "text",
        bytes_of.alias("n_bytes"),
        F.when(huge, F.md5(F.col("text").cast("binary"))).alias("text_key"),
        F.monotonically_increasing_id().alias("rid"),
    )
    cut = _cut(numbered, path, chunk, overlap).repartition("rid", "chunk")
    parts = scratch(_count_chunks(cut, path, overlap))
    done = parts.where("text_key is null").select("doc_id", "n_bytes", "n_tokens")
    several = parts.where("text_key is not null")
    named = several.where("chunk = 0").select("rid", "doc_id", "n_bytes", "text_key")
    counted = scratch(named.join(_spliced(several), "rid"))
    done = done.unionByName(counted.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
    unaligned = counted.where("n_tokens is null").select("text_key").distinct()
    if not unaligned.isEmpty():
        # equal texts align or fail together, so the texts that failed are found again by their digest
        again = docs.where(huge).withColumn("text_key", F.md5(F.col("text").cast("binary")))
        again = again.join(unaligned, "text_key", "left_semi").select("doc_id", "text")
        done = done.unionByName(count_tokens(again, path, 2 * chunk, 4 * overlap))
    return done


def op4_token_counts(spark, folder) -> DataFrame:
    counted = count_tokens(table(spark, folder, "documents"), tokenizer_path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
