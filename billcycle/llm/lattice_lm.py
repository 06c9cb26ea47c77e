"""Document likelihood by a subword lattice over the pieces of an existing vocabulary.

A word is any path through its lattice: first a piece of the vocabulary that begins a word, then pieces that go on, then a stop; every
piece and byte has a probability. The word's lattice probability is the sum over all segmentations, found by the forward
recursion; sums are logarithms wherever they could leave the range of a double. Piece probabilities start from the vocabulary's scores and are
fitted by expectation maximisation over all distinct training words. Each kind of training text (here: each language) has a lattice of its own, and gives its words their own mass, less a discount;
its discounts together, divided by the kind's tokens, are the part r of its tokens that its lattice gives to all words, known or not, with a share
of the counts of all kinds:

    P_kind(word) = max(c_kind - d, 0) / N_kind + r_kind * ((1 - SHARED) * P_lattice(word) + SHARED * c / words),    P_kind(end) = texts / N_kind

which add up to 1 over all words and the end. A text's kind is not looked at when it is scored: its probability is the sum over all kinds, of
which there are as many as the training texts have. Within a text a word that has come up is likelier to come again: token t is drawn with
(OWN * P(word) + earlier occurrences of it) / (OWN + t - 1), so the order of the words doesn't matter.

Every distinct word is scored once. The most frequent words, a fixed number of them, go to every task as a table; the other occurrences are joined.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcycle.llm.common import crc_mod, scratch, steps, table, texts_of
from billcycle.llm.token_ids import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "\N{LOWER ONE EIGHTH BLOCK}".encode()
FITTINGS = 2
#: Words that go to every task with their scores, times the number of kinds, and distinct words that a task counts before it sends them.
FREQUENT = 1_000_000
HELD_WORDS = 300_000
#: Bytes of words that are in one vectorised step.
STEP_BYTES = 1 << 18
#: Longest stretch whose sums stay within the range of a double, all weights times SCALE for each byte; bytes of a step of a longer one.
STRETCH = 48
SCALE = 1024.0
BLOCK = 32
PLACES = 1 << 17
#: Part of the pieces that go on which is spread evenly over the 256 bytes.
EVEN = 1e-5
#: Part of what the lattice gives that goes by the counts of all kinds, and tokens that a model weighs against those of the text itself.
SHARED = 0.1
OWN = 2000.0
#: Occurrences of a word in a text that are added up one by one; the others are by the gamma function.
REPEATS = 6


def read_pieces(path: str) -> list[tuple[bytes, bool, float]]:
    """(bytes, whether it begins a word, weight) of the pieces; every single byte is one that goes on.

    A score of a merge vocabulary is minus its rank, so the weight is one over the rank; a bare mark is the empty piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[tuple[bytes, bool], float] = {(bytes([b]), False): 1e-4 for b in range(256)}
    found[b"", True] = 1e-4
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).encode()
        begins = raw.startswith(MARK)
        raw = raw[len(MARK) :] if begins else raw
        if MARK not in raw:
            score = model.get_score(i)
            found[raw, begins] = 1 / (10 - score) if score > -1e6 else 1e-4
    return [(raw, begins, weight) for (raw, begins), weight in sorted(found.items())]


class Lattice:
    """The pieces and, for each kind, their probabilities: those that begin a word add up to 1, the others do with the stop."""

    BASE = 0x100000001B3
    BITS = 20

    def __init__(self, pieces: list[tuple[bytes, bool, float]], kinds: int = 1) -> None:
        self.kinds = kinds
        self.begins = np.array([b for _, b, _ in pieces])
        self.bare = next(i for i, (raw, b, _) in enumerate(pieces) if b and not raw)
        self.bytes = np.array([i for i, (raw, b, _) in enumerate(pieces) if not b and len(raw) == 1])
        #: Lengths in bytes that a piece has; the recursion goes through all of them
        self.lengths = sorted({len(raw) for raw, _, _ in pieces if raw})
        self.longest = self.lengths[-1]
        if self.longest > BLOCK:
            raise ValueError(f"pieces of more than {BLOCK} bytes")
        self.scales = SCALE ** np.array([len(raw) for raw, _, _ in pieces], float)
        self.powers = np.cumprod(np.full(self.longest + 1, self.BASE, np.uint64))
        self.sides = []
        for side in (True, False):
            ids = [i for i, (raw, b, _) in enumerate(pieces) if b == side and raw]
            keys = np.array([self._key(pieces[i][0]) for i in ids], np.uint64)
            order = np.argsort(keys)
            maybe = np.zeros(1 << self.BITS, bool)
            maybe[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True
            self.sides.append((keys[order], np.array(ids)[order], maybe))
        self.probabilities, self.stops = np.zeros((len(pieces), kinds)), np.zeros(kinds)
        #: probabilities times SCALE for each byte; the last row is that of no piece
        self.weights = np.zeros((len(pieces) + 1, kinds))
        for kind in range(kinds):
            self.fit(kind, np.array([w for _, _, w in pieces]), 1.0)

    def fit(self, kind: int, counts: np.ndarray, stops: float) -> None:
        """From expected counts of the pieces and of the stop, a little of which goes to pieces never seen."""
        counts = counts + 1e-3
        begin, onward = counts[self.begins].sum(), counts[~self.begins].sum() + stops
        found = counts / np.where(self.begins, begin, onward / (1 - EVEN))
        found[self.bytes] += EVEN / len(self.bytes)
        self.probabilities[:, kind], self.stops[kind] = found, stops / onward * (1 - EVEN)
        self.weights[:-1, kind] = found * self.scales

    def _key(self, raw: bytes) -> int:
        value = 0
        for k, byte in enumerate(raw):
            value += (byte + 1) * int(self.powers[k])
        return (value + len(raw)) * 0x9E3779B97F4A7C15 % (1 << 64)

    def arcs(self, words: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """For each length that pieces have, the length, the ids of the pieces at each place of words (n, size), -1 for none; and those that begin the word."""
        n, size = words.shape
        out = []
        value, plus = np.zeros((n, size), np.uint64), words + np.uint64(1)
        for length in range(1, min(self.longest, size) + 1):
            places = size - length + 1
            value = value[:, :places] + plus[:, length - 1 : length - 1 + places] * self.powers[length - 1]
            if length in self.lengths:
                key = (value + np.uint64(length)) * np.uint64(0x9E3779B97F4A7C15)
                out.append((length, self._find(key, 1), self._find(key[:, 0], 0)))
        return out

    def _find(self, key: np.ndarray, side: int) -> np.ndarray:
        keys, ids, maybe = self.sides[side]
        out = np.full(key.shape, -1, np.int32)
        at = np.nonzero(maybe[(key >> np.uint64(64 - self.BITS)).astype(np.int64)])
        near = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
        out[at] = np.where(keys[near] == key[at], ids[near], -1)
        return out

    def _weights(self, arcs: list, kind: np.ndarray | None) -> list[tuple[int, list]]:
        """For each length and place the words that have an arc there (None: all of them) and their weights, or None where no word has one.

        Weights are for all kinds, (n, kinds), or for a kind of each word, (n, 1).
        """
        out = []
        for k, ids, _ in arcs:
            places = []
            for i, held in enumerate((ids >= 0).sum(axis=0).tolist()):
                if not held:
                    places.append(None)
                    continue
                at = np.flatnonzero(ids[:, i] >= 0) if held < len(ids) else None
                own = ids[:, i] if at is None else ids[at, i]
                if kind is None:
                    places.append((at, self.weights[own]))
                else:
                    places.append((at, self.weights[own, kind if at is None else kind[at]][:, None]))
            out.append((k, places))
        return out

    def forward(self, arcs: list, weights: list, first: np.ndarray, size: int, kind: np.ndarray | None = None) -> np.ndarray:
        """Sums at each place, (size + 1, n, kinds) or (size + 1, n, 1), times SCALE for each byte before it."""

        def of(ids: np.ndarray | int) -> np.ndarray:
            return self.weights[ids] if kind is None else self.weights[ids, kind][:, None]

        n = len(first)
        sums = np.zeros((size + 1, n, self.kinds if kind is None else 1))
        sums[0] = np.where(first[:, None], of(np.full(n, self.bare)), 1.0)
        for k, _, begin in arcs:
            sums[k] += np.where(first[:, None], of(begin), 0.0)
        for j in range(1, size + 1):
            for k, places in weights:
                if k <= j and (held := places[j - k]) is not None:
                    at, own = held
                    if at is None:
                        sums[j] += sums[j - k] * own
                    else:
                        sums[j][at] += sums[j - k][at] * own
        return sums

    def expected(self, words: np.ndarray, sizes: np.ndarray, first: np.ndarray, kind: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected number of each piece in stretches of words of a kind (n, size; bytes beyond sizes don't count) to counts (pieces, kinds), by the backward recursion."""
        n, size = words.shape
        arcs = self.arcs(words)
        weights = self._weights(arcs, kind)
        sums = self.forward(arcs, weights, first, size, kind)[:, :, 0]
        back = np.zeros((size + 1, n))
        back[sizes, np.arange(n)] = 1 / sums[sizes, np.arange(n)]
        flat, number = np.zeros(counts.size), self.kinds
        for i in range(size - 1, -1, -1):
            for (k, places), (_, ids, _) in zip(weights, arcs, strict=True):
                if k <= size - i and (held := places[i]) is not None:
                    at, own = held
                    at = slice(None) if at is None else at
                    share = back[i + k][at] * own[:, 0]
                    back[i][at] += share
                    flat += np.bincount(ids[at, i] * number + kind[at], sums[i][at] * share, len(flat))
        flat += np.bincount(self.bare * number + kind[first], (sums[0] * back[0])[first], len(flat))
        for k, _, begin in arcs:
            own = np.flatnonzero(first & (begin >= 0))
            flat += np.bincount(begin[own] * number + kind[own], self.weights[begin[own], kind[own]] * back[k][own], len(flat))
        counts += flat.reshape(counts.shape)

    def by_size(self, stretches: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places in the list, bytes (n, size), sizes) of stretches of similar size, in bounded steps."""
        sizes = np.array([len(w) for w in stretches], np.int64)
        rounded = np.where(sizes <= 16, -(-sizes // 2) * 2, -(-sizes // 8) * 8)
        for size in np.unique(rounded).tolist():
            own = np.flatnonzero(rounded == size)
            most = max(1, STEP_BYTES // (size * self.kinds))
            for begin in range(0, len(own), most):
                part = own[begin : begin + most]
                raw = b"".join(stretches[i].ljust(size, b"\0") for i in part.tolist())
                yield part, np.frombuffer(raw, np.uint8).reshape(len(part), size), sizes[part]

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """(words, kinds): log of each word's sum over all segmentations."""
        out = np.tile(np.log(self.stops), (len(words), 1))
        stretches, of, first = [], [], []
        for i, word in enumerate(words):
            begin = 0
            for end in [len(word)] if len(word) <= STRETCH else self._free_cuts(word):
                if end - begin <= STRETCH:
                    stretches.append(word[begin:end])
                    of.append(i)
                    first.append(begin == 0)
                else:
                    out[i] += self._long(word[begin:end], begin == 0)
                begin = end
        where, starts = np.array(of, np.int64), np.array(first, bool)
        for part, block, sizes in self.by_size(stretches):
            arcs = self.arcs(block)
            sums = self.forward(arcs, self._weights(arcs, None), starts[part], block.shape[1])
            np.add.at(out, where[part], np.log(sums[sizes, np.arange(len(part))]) - sizes[:, None] * math.log(SCALE))
        return out

    def _free_cuts(self, word: bytes) -> list[int]:
        """Ends of the stretches of a long word, at places that no arc crosses: the last of these within STRETCH bytes, else the next."""
        data, crossed = np.frombuffer(word, np.uint8), np.zeros(len(word) + 2, np.int64)
        for low in range(0, len(data), PLACES):
            for k, ids, begin in self.arcs(data[None, low : low + PLACES + self.longest]):
                at = np.flatnonzero(ids[0, :PLACES] >= 0) + low if k > 1 else np.empty(0, np.int64)
                crossed[at + 1] += 1
                crossed[at + k] -= 1
                if low == 0 and begin[0] >= 0:
                    crossed[1] += 1
                    crossed[k] -= 1
        free = np.flatnonzero(np.cumsum(crossed)[1 : len(word)] == 0) + 1
        cuts, begin = [], 0
        while len(word) - begin > STRETCH:
            last = int(np.searchsorted(free, begin + STRETCH, "right"))
            if last and free[last - 1] > begin:
                begin = int(free[last - 1])
            elif last < len(free):
                begin = int(free[last])
            else:
                break
            cuts.append(begin)
        return cuts if begin == len(word) else [*cuts, len(word)]

    def _long(self, stretch: bytes, begins: bool) -> np.ndarray:
        """Log, for each kind, of the sum of a stretch that can't be cut: what each block makes of the sums before it is a matrix, found for all blocks at once."""
        width, size = self.longest, len(stretch)
        whole = np.frombuffer(stretch, np.uint8)
        # the sums at the end of the first block
        arcs = self.arcs(whole[None, :BLOCK])
        sums = self.forward(arcs, self._weights(arcs, None), np.array([begins]), BLOCK)
        states, logs = sums[BLOCK - width + 1 :, 0][::-1].copy(), np.full(self.kinds, -size * math.log(SCALE))
        for low in range(BLOCK, size, PLACES):
            high = min(low + PLACES, size)
            blocks = -(-(high - low) // BLOCK)
            found = [(k, ids[0, : width + high - low]) for k, ids, _ in self.arcs(whole[None, low - width : high + width])]
            at = width + np.arange(blocks) * BLOCK
            for kind in range(self.kinds):
                # weights of the arcs at the places from low - width on; past the end a byte of weight 1 goes on
                weights = []
                for k, ids in found:
                    own = np.zeros(width + blocks * BLOCK)
                    own[: len(ids)] = self.weights[ids, kind]
                    if k == 1:
                        own[width + high - low :] = 1.0
                    if own.any():
                        weights.append((k, own))
                rows = [np.zeros((blocks, width)) for _ in range(width)]
                for i, row in enumerate(rows):
                    row[:, width - 1 - i] = 1.0
                for t in range(1, BLOCK + 1):
                    new = np.zeros((blocks, width))
                    for k, own in weights:
                        new += own[at + (t - k)][:, None] * rows[-k]
                    rows = [*rows[1:], new]
                state = states[:, kind]
                for step in np.stack(rows[::-1], axis=1):  # (place from the end, place before)
                    state = step @ state
                    most = state.max()
                    state, logs[kind] = state / most, logs[kind] + math.log(most)
                states[:, kind] = state
        return logs + np.log(states[0])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by its series at x + 8."""
    shift, low = x + 8, np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    series = 1 / (12 * shift) - 1 / (360 * shift**3) + 1 / (1260 * shift**5) - 1 / (1680 * shift**7)
    return (shift - 0.5) * np.log(shift) - shift + 0.5 * math.log(2 * math.pi) + series - low


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space, which is what bytes are split at."""
    return (text or b"").lower().split()


def word_counts(docs: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """word, c (occurrences in rows with ``learn``), by (those of each kind, as (kind, c)) of all words of docs (text, learn, kind).

    A task counts its own words first; what it sends goes to the word's place once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, others = defaultdict(Counter), set()

        def out(words: list, kind: int, counts: list[int]) -> pa.RecordBatch:
            size = len(words)
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array([kind] * size, pa.int32()), pa.array(counts, pa.int64())],
                names=["word", "kind", "c"],
            )

        def all_out() -> Iterator[pa.RecordBatch]:
            for kind, own in learned.items():
                yield out(list(own), kind, list(own.values()))
            learned.clear()
            yield out(list(others), 0, [0] * len(others))
            others.clear()

        for batch in steps(batches):
            columns = (texts_of(batch), batch.column("learn").to_pylist(), batch.column("kind").to_pylist())
            for text, learn, kind in zip(*columns, strict=True):
                (learned[kinds[kind]] if learn else others).update(tokens(text))
            if sum(map(len, learned.values())) + len(others) > HELD_WORDS:
                yield from all_out()
        yield from all_out()

    found = docs.select("text", "learn", "kind").mapInArrow(run, "word string, kind int, c long").repartition("word")
    own = found.groupBy("word", "kind").agg(F.sum("c").alias("c"))
    own = own.groupBy("word").agg(F.sum("c").alias("c"), F.collect_list(F.when(F.col("c") > 0, F.struct("kind", "c"))).alias("by"))
    return own


def fit_pieces(words: DataFrame, path: str, kinds: int, fittings: int = FITTINGS) -> Lattice:
    """A lattice fitted to the distinct words (word, by) of each kind, each of the same weight; each fitting sees all of them, very long words in stretches."""
    lattice = Lattice(read_pieces(path), kinds)
    size = len(lattice.begins) + 1
    spark = words.sparkSession
    for _ in range(fittings):
        shared = spark.sparkContext.broadcast(lattice)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, counts = shared.value, np.zeros((size, kinds))
            for batch in batches:
                row, kind, _ = _listed(batch.column("by"), "c")
                counts[-1] += np.bincount(kind, minlength=kinds)
                listed = batch.column("word").cast(pa.binary()).to_pylist()
                cut = [
                    (w[i : i + STRETCH], i == 0, k) for w, k in zip(map(listed.__getitem__, row.tolist()), kind.tolist(), strict=True) for i in range(0, len(w), STRETCH)
                ]
                first, of = np.array([f for _, f, _ in cut], bool), np.array([k for *_, k in cut], np.int64)
                for part, block, sizes in lattice.by_size([w for w, *_ in cut]):
                    lattice.expected(block, sizes, first[part], of[part], counts[:-1])
            yield _slices(counts.reshape(-1))

        parts = words.select("word", "by").mapInArrow(run, "slice int, counts binary")
        total = np.zeros(kinds * size)
        for k, own in parts.repartition("slice").mapInArrow(_added, "slice int, counts binary").collect():
            own = np.frombuffer(own)
            total[k * 4096 : k * 4096 + len(own)] += own
        for kind, own in enumerate(total.reshape(size, kinds).T):
            if own[-1]:
                lattice.fit(kind, own[:-1], own[-1])
        shared.unpersist()
    return lattice


def _slices(counts: np.ndarray) -> pa.RecordBatch:
    parts = [counts[i : i + 4096].tobytes() for i in range(0, len(counts), 4096)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(own)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "counts"]
    )


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words with the highest c, so many at most: those above a threshold that a histogram of c gives, without a sort."""
    exact = 1 << 12
    level = F.when(F.col("c") < exact, F.col("c")).otherwise(exact + F.floor(F.log2(F.col("c") / exact) * 64)).cast("long")
    left, lowest = most, None
    for r in sorted(words.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        lowest = r["level"]
    return words.where(level >= lowest) if lowest is not None else words.limit(0)


#: Columns made on the way; a column of the documents by such a name is not passed on.
ADDED = ("text", "n_tokens", "n_known", "train_tokens", "base_score", "lattice_score", "score", "base", "lat", "sums", "rare", "rid", "more", "more_sums")


class Model:
    """What is known of the training tokens of each kind."""

    def __init__(self, texts: dict[str, int], words: np.ndarray, seen: np.ndarray, once: np.ndarray, twice: np.ndarray, v: int) -> None:
        #: texts, and words and texts, by kind
        self.ends = np.array(list(texts.values()) or [0], float)
        self.sizes = np.maximum(words + self.ends, 1)
        self.words, self.texts = int(words.sum()), int(self.ends.sum())
        self.n = self.words + self.texts
        self.below = math.log10(self.n + v + (self.texts > 0) + 1)
        self.discounts = np.where(once > 0, np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.95), 0.5)
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(self.discounts * seen / self.sizes)

    def words_logs(self, lattices: np.ndarray, c: np.ndarray, row: np.ndarray, kind: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(words, kinds): log P_kind of words, from the logs of their lattices, their counts, and those by kind of the words ``row``."""
        with np.errstate(divide="ignore"):
            p = np.exp(self.log_rest) * ((1 - SHARED) * np.exp(lattices) + SHARED * c[:, None] / max(self.words, 1))
            p[row, kind] += (count - self.discounts[kind]) / self.sizes[kind]
            # a word too long for a double is its lattice alone
            return np.where(p > 0, np.log(p), self.log_rest + math.log(1 - SHARED) + lattices)

    def total(self, sums: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of texts with so many tokens from the sums of their words by kind."""
        if not self.texts:
            return np.full(len(sums), -np.inf)
        with np.errstate(divide="ignore"):
            logs = np.log(self.ends / self.texts) + math.log(OWN) + np.log(self.ends / self.sizes) + sums
        divided = log_gamma(OWN + size) - log_gamma(np.array([OWN]))
        return (np.logaddexp.reduce(logs, axis=1) - divided) / math.log(10)


def rising(logs: np.ndarray, times: np.ndarray) -> np.ndarray:
    """(words, kinds): log of OWN * p * (OWN * p + 1) * ... of so many factors, from the logs of p."""
    out = logs + math.log(OWN)
    again = np.flatnonzero(times > 1)
    weight, times = OWN * np.exp(logs[again]), times[again]
    for j in range(1, REPEATS):
        more = np.flatnonzero(times > j)
        out[again[more]] += np.log(weight[more] + j)
    many = np.flatnonzero(times > REPEATS)
    out[again[many]] += log_gamma(weight[many] + times[many][:, None]) - log_gamma(weight[many] + REPEATS)
    return out


def _sums(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """(rows, kinds): the values (n, kinds) added up by row."""
    return np.stack([np.bincount(row, own, rows) for own in values.T], axis=1).astype(float)


def _arrays(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), width)


def _listed(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, value) of a column of lists of (kind, value)."""
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), np.asarray(flat.field("kind")).astype(np.int64), np.asarray(flat.field(name))


def score_texts(docs: DataFrame, path: str, fittings: int = FITTINGS, kind: str | None = None) -> DataFrame:
    """The columns of docs but text, with n_tokens, n_known, train_tokens, base_score, lattice_score and score of the whole text.

    Rows whose ``learn`` is true are learned from, all are scored. Tokens are words and one end a text; null and empty texts are
    the end alone. base_score adds log10((c + 1) / (N + V + 1)) over the tokens, with c, N and V of the training tokens. lattice_score
    adds the log10 of the words' sums over all segmentations and of P(end). score is the log10
    probability of the text by the model above. Both are minus infinity if nothing was learned. ``kind`` names a column by which training
    texts are of one kind (null is a kind, like the empty text); it is not an input of a score. Texts of any length and words of any
    length are scored whole. Repeated rows count and are scored as often as they come; an empty table gives an empty result. A column of docs
    by the name of a new one is not passed on.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ADDED]
    value = F.coalesce(F.col(f"`{kind}`").cast("string"), F.lit("")) if kind else F.lit("")
    texts = {r["kind"]: r["count"] for r in docs.where("learn").groupBy(value.alias("kind")).count().orderBy("kind").collect()}
    kinds, number = {k: i for i, k in enumerate(texts)}, max(len(texts), 1)

    words = scratch(word_counts(docs.select("text", F.coalesce("learn", F.lit(False)).alias("learn"), value.alias("kind")), kinds))
    counts = {r["kind"]: r for r in words.select(F.inline("by")).groupBy("kind").agg(
        F.sum("c").alias("words"), F.count("*").alias("seen"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")
    ).collect()}
    columns = [np.array([counts[k][x] if k in counts else 0 for k in range(number)], float) for x in ("words", "seen", "once", "twice")]
    model = Model(texts, *columns, words.where("c > 0").count())
    lattice = spark.sparkContext.broadcast(fit_pieces(words.where("c > 0"), path, number, fittings))
    shares = model.ends / max(model.texts, 1)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lattices = lattice.value.log_probabilities(batch.column("word").cast(pa.binary()).to_pylist())
            c = batch.column("c").to_numpy().astype(float)
            with np.errstate(divide="ignore"):
                mean = np.logaddexp.reduce(lattices + np.log(shares), axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"),
                    batch.column("c"),
                    pa.array(np.log10(c + 1.0) - model.below),
                    pa.array(mean / math.log(10)),
                    _arrays(model.words_logs(lattices, c, *_listed(batch.column("by"), "c"))),
                ],
                names=["word", "c", "base", "lat", "logs"],
            )

    scored = scratch(words.mapInArrow(score_words, "word string, c long, base double, lat double, logs array<double>"))
    top = _frequent(scored, max(FREQUENT // number, 1000)).toArrow().combine_chunks()
    frequent = spark.sparkContext.broadcast(
        (
            top.column("word").cast(pa.binary()).to_pylist(),
            top.column("c").to_numpy() > 0,
            *(top.column(c).to_numpy() for c in ("base", "lat")),
            np.concatenate([np.zeros((0, number)), *(_matrix(x, number) for x in top.column("logs").chunks)]),
        )
    )
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    end_base = math.log10(model.texts + 1) - model.below
    end_lattice = math.log10(model.texts / model.n) if model.texts else -math.inf

    def score_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, known, bases, lats, logs = frequent.value
        place = {w: i for i, w in enumerate(listed)}
        for batch in steps(batches):
            counted = [Counter(tokens(text)) for text in texts_of(batch)]
            size, sizes = len(counted), np.array([len(c) for c in counted])
            total, of = int(sizes.sum()), np.repeat(np.arange(len(counted)), sizes)
            words = list(chain.from_iterable(counted))
            times = np.fromiter(chain.from_iterable(c.values() for c in counted), np.int64, total)
            at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, total)
            rare = np.flatnonzero(at < 0)
            here = np.flatnonzero(at >= 0)
            n_tokens = np.bincount(of, times, size).astype(np.int64) + 1
            at, times_here, of_here = at[here], times[here], of[here]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=size))])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names),
                    pa.array(n_tokens),
                    pa.array(np.bincount(of_here, times_here * known[at], size).astype(np.int64) + (model.texts > 0)),
                    pa.array(np.bincount(of_here, times_here * bases[at], size) + end_base),
                    pa.array(np.bincount(of_here, times_here * lats[at], size) + end_lattice),
                    _arrays(_sums(of_here, rising(logs[at], times_here), size)),
                    pa.MapArray.from_arrays(
                        pa.array(cuts, pa.int32()),
                        pa.array([words[i] for i in rare.tolist()], pa.binary()).cast(pa.string()),
                        pa.array(times[rare]),
                    ),
                ],
                names=[*names, "n_tokens", "n_known", "base", "lat", "sums", "rare"],
            )

    new = f"n_tokens long, n_known long, base double, lat double, sums array<double>, rare map<string, long>"
    picked = docs.select(*[f"`{c}`" for c in names], "text")
    found = scratch(picked.mapInArrow(score_docs, schema + new).withColumn("rid", F.monotonically_increasing_id()))
    rest = found.select("rid", F.explode("rare").alias("word", "k")).join(scored, "word").select("rid", "k", "c", "base", "lat", "logs")

    def score_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rid, times, c, base, lat = (batch.column(x).to_numpy() for x in ("rid", "k", "c", "base", "lat"))
                each = rising(_matrix(batch.column("logs"), number), times)
                columns = [rid, np.where(c > 0, times, 0), times * base, times * lat, *each.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["rid", "known", "base", "lat", *of_kind])

    of_kind = [f"p{k}" for k in range(number)]
    each = rest.mapInArrow(score_rest, "rid long, known long, base double, lat double, " + ", ".join(f"{x} double" for x in of_kind))
    of_text = each.groupBy("rid").agg(
        F.struct(*[F.sum(x).alias(x) for x in ("known", "base", "lat")]).alias("more"), F.array(*[F.sum(x) for x in of_kind]).alias("more_sums")
    )
    none = F.lit(0.0)
    whole = found.join(of_text, "rid", "left").select(
        *[f"`{c}`" for c in names],
        "n_tokens",
        (F.col("n_known") + F.coalesce("more.known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        F.round(F.col("base") + F.coalesce("more.base", none), 9).alias("base_score"),
        F.round(F.col("lat") + F.coalesce("more.lat", none), 9).alias("lattice_score"),
        F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more_sums", lambda a, b: a + b)).alias("sums"),
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The end, what every token was divided by, and the sum over the kinds."""
        for batch in batches:
            if batch.num_rows:
                score = model.total(_matrix(batch.column("sums"), number), batch.column("n_tokens").to_numpy().astype(float))
                kept = [c for c in batch.schema.names if c != "sums"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(np.round(score, 9))], names=[*kept, "score"])

    new = "n_tokens long, n_known long, train_tokens long, base_score double, lattice_score double, score double"
    return whole.mapInArrow(add_up, schema + new)


def op9_lattice_lm(spark, folder) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", "lang", held_out.alias("held_out"), (~held_out).alias("learn")
    )
    return score_texts(docs, tokenizer_path(VOCABULARY), kind="lang").drop("learn", "lang")
