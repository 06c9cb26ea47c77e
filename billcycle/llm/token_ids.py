"""Token ids of all documents in raw shard files, found by key through a minimal perfect hash index.

A data set is a folder. ``ids/`` has one file a shard: nothing but the documents' ids, little-endian unsigned 16-bit
(32-bit where the vocabulary needs it), in ascending doc_id order over the shards. ``shards`` (Parquet) names the file of
each shard, the ids before it, its number of ids and their width. ``index`` (Parquet) has a row for each part of the
index. A key (doc_id, ordinal among rows of that doc_id) belongs to the part that its hash names; there a pilot turns the
hash into a slot, and no two keys of the part share one. The slot holds the key's fingerprint, shard, offset and length, so
a look-up reads one row, one slot and one range of one file, and a key that is not in the index is told by its fingerprint.

Every attempt of a task writes a file of its own. Only the attempt that Spark commits has its file named in ``shards``,
so a lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from billcycle.llm.common import Words, mixed, shared_folder, steps, table, texts_of

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Expected keys of one part of the index, and of one bucket of a part.
PART_KEYS = 4096
BUCKET_KEYS = 4
#: Pieces of text whose ids a Python worker remembers.
MEMO = 400_000
#: Bytes of text that are encoded at once, unless one text is longer.
STEP_BYTES = 1 << 22
#: White space other than space and line feed, in the sense of any of the libraries.
ODD_SPACE = r"[^\S \n]|[\x1c-\x1f\x85]"
#: A pre-tokenizer that parts letters from all else, but for the letters of a short form from its apostrophe.
CLASS_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """What a tokenizer makes of pieces of text, by a 64-bit hash of the piece; the ones longest unused are forgotten."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], keep_ids: np.dtype | None) -> None:
        self.encode, self.kind = encode, keep_ids
        self.keys, self.sizes, self.used = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.starts, self.ids = np.empty(0, np.int64), np.empty(0, keep_ids or np.uint8)
        self.now = 0

    def places(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """For every piece (its hash and its range of the bytes) where it stands in the memo; valid until the next call."""
        self.now += 1
        wanted, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.ones(len(wanted), bool)
        if len(self.keys):
            near = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            new = self.keys[near] != wanted
            self.used[near[~new]] = self.now
        if new.any():
            at = first[new]
            pieces = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._learn(wanted[new], self.encode(pieces))
        found = np.searchsorted(self.keys, wanted)
        self.used[found] = self.now
        return found[back]

    def _learn(self, keys: np.ndarray, found: list[np.ndarray]) -> None:
        if len(self.keys) > MEMO:
            keep = self.used == self.now
            keep[np.argsort(-self.used, kind="stable")[: MEMO // 2]] = True
            if self.kind:
                taken = _spread(self.starts[keep], self.sizes[keep])
                self.ids = self.ids[taken]
                self.starts = np.cumsum(self.sizes[keep]) - self.sizes[keep]
            self.keys, self.sizes, self.used = self.keys[keep], self.sizes[keep], self.used[keep]
        sizes = np.array([len(x) for x in found], np.int64)
        place = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys = np.insert(self.keys, place, keys)
        self.used = np.insert(self.used, place, self.now)
        if self.kind:
            self.starts = np.insert(self.starts, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.ids = np.concatenate([self.ids, *found]).astype(self.kind)
        self.sizes = np.insert(self.sizes, place, sizes)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def splits_by_class(made: dict) -> bool:
    """Whether a tokenizer (its JSON) splits by CLASS_SPLIT, and changes texts before that in ways that never reach over an ASCII character."""
    normal, split = made["normalizer"] or {"normalizers": []}, made["pre_tokenizer"] or {}
    plain = all(
        x["type"] in ("NFC", "Lowercase") or (x["type"], x.get("pattern")) == ("Replace", {"Regex": r"\s+"})
        for x in normal.get("normalizers", [normal])
    )
    wanted = {"type": "Split", "pattern": {"Regex": CLASS_SPLIT}, "behavior": "Removed", "invert": True}
    return plain and split.get("pretokenizers", [split])[0] == wanted


def word_ends(tokenizer) -> np.ndarray | None:
    """Whether an id is the last one of a word, for words of letters; None where the vocabulary doesn't tell by a suffix."""
    from tokenizers.pre_tokenizers import ByteLevel

    made = json.loads(tokenizer.to_str())
    suffix, vocab = made["model"].get("end_of_word_suffix"), tokenizer.get_vocab()
    bytewise = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    if not suffix or suffix.isalpha() or not splits_by_class(made) or made["pre_tokenizer"].get("pretokenizers", [])[1:] != bytewise:
        return None
    if not all(x + suffix in vocab for x in ByteLevel.alphabet()):  # a word might end with nothing
        return None
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
    return last


def piece_encoder(path: str, between: str, begin: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Function that encodes many pieces in one call: joined by ``between``, the ids dealt out by the offsets of the library.

    The caller sees to it that ``between`` neither joins nor changes pieces. Those for which that may not hold are encoded alone: those
    with a special string, white space other than space and line feed, or white space at the end, and those that don't
    begin with one of ``begin`` where that is given. Where the last id of a word shows itself, words of letters do without offsets.
    """
    import regex

    tokenizer = tokenizer_of_process(path)
    last = word_ends(tokenizer) if between == " " else None
    special = [regex.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    doubtful = regex.compile("|".join([*special, ODD_SPACE]))

    def alone(piece: str) -> bool:
        return not piece or piece[-1] in " \n" or (begin and piece[0] not in begin) or bool(doubtful.search(piece))

    def encode(pieces: list[str]) -> list[np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(pieces)
        for first in range(0, len(pieces), 4096):
            part = range(first, min(first + 4096, len(pieces)))
            apart = [i for i in part if alone(pieces[i])] if begin or doubtful.search(between.join(pieces[i] for i in part)) else []
            if apart:
                whole = tokenizer.encode_batch_fast([pieces[i] for i in apart], add_special_tokens=False)
                for i, x in zip(apart, whole, strict=True):
                    found[i] = np.array(x.ids, np.int64)
                part = [i for i in part if found[i] is None]
            if last is not None:
                letters = [i for i in part if pieces[i].isalpha()]
                for some in (letters[a : a + 1024] for a in range(0, len(letters), 1024)):
                    ids = np.array(tokenizer.encode(between.join(pieces[i] for i in some), add_special_tokens=False).ids, np.int64)
                    cuts = (np.flatnonzero(last[ids]) + 1).tolist()
                    if len(cuts) == len(some):  # each is one word to the tokenizer
                        for i, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True):
                            found[i] = ids[a:b]
                part = [i for i in part if found[i] is None]
            if not part:
                continue
            joined = tokenizer.encode(between.join(pieces[i] for i in part), add_special_tokens=False)
            ids, places = np.array(joined.ids, np.int64), np.array(joined.offsets, np.int64).reshape(-1, 2)[:, 0]
            ends = np.cumsum([len(pieces[i]) + len(between) for i in part])
            cuts = np.searchsorted(places, ends).tolist()
            for i, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True):
                found[i] = ids[a:b]
        return found

    return encode


_memos: dict[tuple, Memo] = {}


def memo_of_process(path: str, between: str, begin: str, keep_ids: str | None) -> Memo:
    """The one of this Python worker, so that its tasks share what they have met."""
    key = (path, between, begin, keep_ids)
    if key not in _memos:
        _memos[key] = Memo(piece_encoder(path, between, begin), np.dtype(keep_ids) if keep_ids else None)
    return _memos[key]


class Runs(Words):
    """Words cut also where an ASCII letter and another visible ASCII character meet, but for a letter after an apostrophe.

    So a stem is one piece whatever marks stand beside it. ASCII characters compose with none before them, and of the matches
    of CLASS_SPLIT only those of short forms hold letters and others.
    """

    def __init__(self, gaps: bytes, lower: bool = True) -> None:
        super().__init__(gaps, lower)
        self.right = np.zeros(256, np.uint8)
        self.right[0x21:0x7F] = [1 if chr(x).isalpha() else 2 for x in range(0x21, 0x7F)]
        self.left = self.right.copy()
        self.left[ord("'")] = 0

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = super().bounds(data)
        cuts = np.flatnonzero(np.take(self.left, data[:-1]) + np.take(self.right, data[1:]) == 3) + 1
        starts, ends = (np.sort(np.concatenate([x, cuts]), kind="stable") for x in (starts, ends))
        return starts, ends


@functools.cache
def tokenizer_of_process(path: str):
    """The one of this Python worker: to read it takes some tenths of a second, for each of many tasks."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _traits(path: str) -> tuple[list[bytes], bool, bool]:
    """A tokenizer's special strings in small letters, whether it lower-cases, and whether Runs are cut as it cuts."""
    tokenizer = tokenizer_of_process(path)
    made = json.loads(tokenizer.to_str())
    special = [t.content.lower().encode() for t in tokenizer.get_added_tokens_decoder().values()]
    return special, '"Lowercase"' in json.dumps(made["normalizer"]), splits_by_class(made)


def word_encoder(path: str, width: str) -> Callable[[list[str | None]], list[bytes]]:
    """Function from texts (UTF-8) to their ids as bytes, for a tokenizer that drops white space and joins no words.

    Such a tokenizer gives a text the ids of its words one after the other, where words are cut at spaces and line feeds,
    and between letters and marks where it is known to cut there; the tests hold this against whole texts.
    """
    # where the tokenizer itself lower-cases, words that differ in the case of A to Z only are one
    tokenizer, (special, lower, by_class) = tokenizer_of_process(path), _traits(path)
    memo, words = memo_of_process(path, " ", "", width), (Runs if by_class else Words)(b" \n", lower=lower)

    def encode(texts: list[bytes | None]) -> list[bytes]:
        hashed, where, starts, ends, data = words.located(texts)
        joined = data.tobytes()
        at = memo.places(hashed, starts, ends, joined)
        sizes = memo.sizes[at]
        ids = memo.ids[_spread(memo.starts[at], sizes)].tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.bincount(where, sizes, len(texts)))]).astype(np.int64) * memo.kind.itemsize
        out = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        if any(s in joined.lower() for s in special):  # these are not lower-cased
            for i, text in enumerate(texts):
                if text and any(s in text.lower() for s in special):
                    whole = tokenizer.encode(text.decode(), add_special_tokens=False)
                    out[i] = np.array(whole.ids, memo.kind).tobytes()
        return out

    return encode


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Write the data set of docs (doc_id, text; more columns are ignored) to a new folder that all executors share.

    Null and empty texts are the end id alone. A null doc_id comes first and is a key like any other. Rows of one doc_id stand
    together, by the hash of their text; their ordinals count from 0. An empty table gives an empty data set.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    files, root = _files(folder)
    files.create_dir(f"{root}/ids", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, width)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        last = np.array([end_id], width).tobytes()
        files, root = _files(folder)
        out, offset, previous, ordinal = None, 0, object(), 0
        size = np.dtype(width).itemsize
        try:
            for batch in steps(batches, most=STEP_BYTES):
                out = out or files.open_output_stream(f"{root}/ids/{name}")
                keys = batch.column("doc_id").to_pylist()
                rows = []
                for key, ids in zip(keys, encode(texts_of(batch)), strict=True):
                    ordinal = ordinal + 1 if key == previous else 0
                    previous = key
                    out.write(ids)
                    out.write(last)
                    rows.append((ordinal, offset, len(ids) // size + 1))
                    offset += rows[-1][2]
                more = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, id_type), *more, pa.array([shard] * len(keys), pa.int32()), pa.array([name] * len(keys))],
                    names=["doc_id", "ordinal", "offset", "n_tokens", "shard", "file"],
                )
        finally:
            if out:
                out.close()

    ordered = docs.select("doc_id", "text").repartitionByRange(F.asc_nulls_first("doc_id"))
    directory = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text")).mapInArrow(
        run, f"doc_id {kind.simpleString()}, ordinal long, offset long, n_tokens long, shard int, file string"
    )
    directory.write.parquet(f"{folder}/directory")
    directory = spark.read.parquet(f"{folder}/directory")
    shards = directory.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn(
        "width", F.lit(width)
    ).write.parquet(f"{folder}/shards")
    n_rows = spark.read.parquet(f"{folder}/shards").agg(F.sum("n_rows")).first()[0] or 0
    parts = max(1, -(-n_rows // PART_KEYS))
    _keyed(directory, parts).groupBy("part").applyInArrow(_build_part, _INDEX).withColumn(
        "parts", F.lit(parts)
    ).write.parquet(f"{folder}/index")


def _keyed(keys: DataFrame, parts: int) -> DataFrame:
    """With the two hashes of the key and the part of the index."""
    one, two = F.xxhash64("doc_id", "ordinal"), F.xxhash64(F.lit("second"), "ordinal", "doc_id")
    return keys.withColumn("h1", one).withColumn("h2", two).withColumn("part", F.pmod("h1", F.lit(parts)).cast("int"))


_INDEX = (
    "part int, n long, buckets long, pilots binary, fingerprints binary, shards binary, offsets binary, lengths binary"
)


def _slots(h1: np.ndarray, h2: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h1 ^ mixed(h2 + mixed(pilots))) % np.uint64(n)).astype(np.int64)


def _buckets(h2: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(h2 ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)


def find_pilots(h1: np.ndarray, h2: np.ndarray, buckets: int) -> np.ndarray:
    """A pilot for each bucket such that all n keys have different slots below n; large buckets choose first."""
    n = len(h1)
    bucket = _buckets(h2, buckets)
    sizes = np.bincount(bucket, minlength=buckets)
    order = np.argsort(bucket, kind="stable")
    begins = np.cumsum(sizes) - sizes
    taken, pilots = np.zeros(n, bool), np.zeros(buckets, np.uint32)
    for b in np.argsort(-sizes, kind="stable").tolist():
        mine = order[begins[b] : begins[b] + sizes[b]]
        if not len(mine):
            break
        first = 0
        while True:
            tried = np.arange(first, first + 256, dtype=np.uint64)
            slots = _slots(h1[mine][None, :], h2[mine][None, :], tried[:, None], n)
            free = ~taken[slots].any(axis=1)
            if len(mine) > 1:
                ordered = np.sort(slots, axis=1)
                free &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if free.any():
                pilots[b] = first + int(free.argmax())
                taken[slots[free.argmax()]] = True
                break
            first += 256
    return pilots


def _build_part(rows: pa.Table) -> pa.Table:
    h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    n = len(h1)
    buckets = -(-n // BUCKET_KEYS)
    pilots = find_pilots(h1, h2, buckets)
    slots = _slots(h1, h2, pilots[_buckets(h2, buckets)].astype(np.uint64), n)

    def placed(values: np.ndarray, kind: str) -> list[bytes]:
        out = np.empty(n, kind)
        out[slots] = values
        return [out.tobytes()]

    return pa.table(
        {
            "part": pa.array([rows.column("part")[0].as_py()], pa.int32()),
            "n": pa.array([n], pa.int64()),
            "buckets": pa.array([buckets], pa.int64()),
            "pilots": pa.array([pilots.tobytes()], pa.binary()),
            "fingerprints": pa.array(placed(h2 >> np.uint64(32), "<u4"), pa.binary()),
            "shards": pa.array(placed(rows.column("shard").to_numpy(), "<u4"), pa.binary()),
            "offsets": pa.array(placed(rows.column("offset").to_numpy(), "<u8"), pa.binary()),
            "lengths": pa.array(placed(rows.column("n_tokens").to_numpy(), "<u8"), pa.binary()),
        }
    )


def _look_up(keys: pa.Table, index: pa.Table) -> pa.Table:
    shard = offset = length = None
    if index.num_rows and keys.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        h1, h2 = (keys.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        pilots = np.frombuffer(row["pilots"], np.uint32)[_buckets(h2, row["buckets"])]
        slots = _slots(h1, h2, pilots.astype(np.uint64), row["n"])
        known = np.frombuffer(row["fingerprints"], "<u4")[slots] == (h2 >> np.uint64(32)).astype(np.uint32)
        shard, offset, length = (
            pa.array(np.frombuffer(row[c], kind)[slots].astype(np.int64), mask=~known)
            for c, kind in (("shards", "<u4"), ("offsets", "<u8"), ("lengths", "<u8"))
        )
    none = pa.nulls(keys.num_rows, pa.int64())
    return pa.table(
        {
            "doc_id": keys.column("doc_id"),
            "ordinal": keys.column("ordinal"),
            "shard": none if shard is None else shard,
            "offset": none if offset is None else offset,
            "n_tokens": none if length is None else length,
        }
    )


def read_ids(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id, ordinal, start, n_tokens, ids (little-endian unsigned 32-bit) of the distinct keys (doc_id, ordinal).

    start counts the ids of all documents before. Keys that the data set doesn't have are left out.
    """
    kind = keys.schema["doc_id"].dataType.simpleString()
    index = spark.read.parquet(f"{folder}/index")
    first = index.select("parts").first()
    found = (
        _keyed(keys, first[0] if first else 1)
        .groupBy("part")
        .cogroup(index.groupBy("part"))
        .applyInArrow(_look_up, f"doc_id {kind}, ordinal long, shard long, offset long, n_tokens long")
        .where("n_tokens is not null")
    )
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "file", "base", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        name, source = None, None
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = []
                for file, offset, n, width in zip(
                    *(part.column(c).to_pylist() for c in ("file", "offset", "n_tokens", "width")), strict=True
                ):
                    if file != name:
                        if source:
                            source.close()
                        name, source = file, files.open_input_file(f"{root}/ids/{file}")
                    size = np.dtype(width).itemsize
                    ids.append(np.frombuffer(source.read_at(n * size, offset * size), width).astype("<u4").tobytes())
                start = pa.array(part.column("base").to_numpy() + part.column("offset").to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("ordinal"), start, part.column("n_tokens"), pa.array(ids, pa.binary())],
                    names=["doc_id", "ordinal", "start", "n_tokens", "ids"],
                )
        if source:
            source.close()

    return (
        found.join(shards, "shard")
        .select("doc_id", "ordinal", "shard", "offset", "n_tokens", "file", "base", "width")
        .repartition("shard")
        .sortWithinPartitions("shard", "offset")
        .mapInArrow(run, f"doc_id {kind}, ordinal long, start long, n_tokens long, ids binary")
    )


def keys_of(docs: DataFrame) -> DataFrame:
    """The keys (doc_id, ordinal) under which the rows of docs are stored."""
    counted = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal"))


def digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what was read."""
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def written_and_read(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    folder = shared_folder(docs.sparkSession)
    write_ids(docs, folder, tokenizer_path(tokenizer))
    return digests(read_ids(docs.sparkSession, folder, keys_of(docs)))


def op2_token_ids(spark, folder) -> DataFrame:
    return written_and_read(table(spark, folder, "documents"))
