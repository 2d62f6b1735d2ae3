"""Language-model scores by online logistic context mixing over hashed contexts.

A text's tokens are its words (A to Z in lower case) and one end. A token is coded in bits: words
that make up at least 1 / ``share`` of all training tokens (and come ``least`` times) have a Huffman code of their own, any
other word has the escape's code followed by its bytes and a space, in a Huffman code of bytes.
Three predictors say how likely each bit is 1, from counts of both values under a context's hash:

- word bits: no context, a coarse and a fine class of the word before (commonest words are their own class)
- spelled bits: the two bytes before, the three before, the word so far

Their log odds are mixed with weights that a gate chooses by how much evidence the two longer
contexts have. Weights, and an adaptive map from mixed to observed odds, are learned in one online
pass over everything in the training texts (a Newton step for each piece), where a bit's own
occurrence is taken out of its counts. A text is scored by several such mixers that trust their
inputs more or less; their shares start even and are refined by each token of the text, which comes
to a mixture of their probabilities. So a score depends on the text and the model only, and the
probabilities of all texts add up to at most 1.

Everything learned covers all training rows: exact word counts (one aggregation), bit counts (a
table of each task goes out in blocks, and blocks are added where they meet), weights (sums of
each task). Bits of equal words after equal classes are alike, so each task works on its distinct
ones with their numbers. What is broadcast is bounded by settings: at most ``share`` words and a table
of two bytes a slot. The base score needs every word's count; words without a code of their own
meet their counts by a join on the word, and no such word holds 1 / ``share`` of the training tokens.

A null text is empty: its only token is the end. Rows with a null id are scored but not learned
from. Repeated rows each count and get equal scores. Without training rows every count is 0 and
every bit has even odds. A word of over 32 KiB is spelled in runs of that size. Texts are lower-cased
and split as bytes, so they are not decoded.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_map, stored

END = b""
#: Bytes of texts that are split at a time and that are worked on at a time; bytes of a run of a long word; pairs and bytes in a piece.
GROUP, PART, LONGEST, PIECE = 1 << 20, 1 << 23, 1 << 15, 1 << 15
#: Inputs of a mixer, gates, buckets of the map, and the largest log odds.
INPUTS, GATES, BUCKETS, LIMIT = 3, 32, 33, 12.0
#: Words before that are classes of their own, coarse and fine.
COARSE, FINE = 32, 1024
#: How far the mixers trust their inputs.
TRUST = (0.7, 1.0, 1.25)
#: Slots in a block of the table.
BLOCK = 1 << 14
#: What is added to both counts of a bit; strength of the start weights.
SMALL, PRIOR = 0.3, 50.0
_START = np.full((GATES, INPUTS), 0.4)
_ONE, _TWO, _THREE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass(frozen=True)
class Settings:
    """Words with 1 / ``share`` of the tokens, ``least`` times at least, have a code; the largest contexts have 2 ** ``bits`` slots."""

    share: int = 1 << 19
    least: int = 8
    bits: int = 22

    def common(self, tokens: int) -> Column:
        return (F.col("n") * self.share >= tokens) & (F.col("n") >= self.least) & (F.length("word") > 0)


# ---------------------------------------------------------------- codes


@dataclass(frozen=True)
class Code:
    """Bits of each symbol's code: nodes and bits of symbol i are ``node[at[i] : at[i] + size[i]]`` and alike, root first."""

    at: np.ndarray
    size: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(weights: np.ndarray) -> Code:
    """A code for at least two symbols; of equal weights the earlier goes first."""
    n = len(weights)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for made in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = made
        side[b[1]] = 1
        heapq.heappush(heap, (a[0] + b[0], made))
    symbol, here, levels = np.arange(n), np.arange(n), []
    while len(symbol):
        levels.append((symbol, parent[here] - n, side[here]))
        going = parent[here] != 2 * n - 2
        symbol, here = symbol[going], parent[here][going]
    size = np.bincount(np.concatenate([s for s, _, _ in levels]), minlength=n)
    at = np.cumsum(size) - size
    node, bit = np.zeros(size.sum(), np.int32), np.zeros(size.sum(), np.uint8)
    for k, (s, up, x) in enumerate(levels):
        place = at[s] + size[s] - 1 - k
        node[place], bit[place] = up, x
    return Code(at, size, node, bit)


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of each run, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)


# ---------------------------------------------------------------- counts as two bytes


_STEP = 1.115
_VALUE = np.concatenate([np.arange(33.0), 32 * _STEP ** np.arange(1, 224)])


def coded(counts: np.ndarray) -> np.ndarray:
    """A byte for each count: exact up to 32, beyond it steps of about a ninth."""
    large = np.log(np.maximum(counts, 32) / 32) / np.log(_STEP)
    return np.where(counts <= 32, counts, np.minimum(255, 32 + np.rint(large))).astype(np.uint8)


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + SMALL) / (zeros + SMALL)).astype(np.float32)


def _evidence(total: np.ndarray) -> np.ndarray:
    return np.digitize(total, [0.5, 2.5, 19.5]).astype(np.uint8)


_ZEROS, _ONES = np.tile(_VALUE, 256), np.repeat(_VALUE, 256)
#: Log odds and evidence of a state (code of ones << 8 | code of zeros), and both by state << 1 | bit with one such bit less.
ODDS, EVIDENCE = _odds(_ONES, _ZEROS), _evidence(_ONES + _ZEROS)
ODDS_LESS = np.stack([_odds(_ONES, np.maximum(0, _ZEROS - 1)), _odds(np.maximum(0, _ONES - 1), _ZEROS)], axis=1).ravel()
EVIDENCE_LESS = np.stack([_evidence(_ONES + np.maximum(0, _ZEROS - 1)), _evidence(np.maximum(0, _ONES - 1) + _ZEROS)], axis=1).ravel()


# ---------------------------------------------------------------- texts as bits


@dataclass(frozen=True)
class Book:
    """Training totals, the words with a code (the end first) and their counts, both codes and the size of the largest contexts."""

    tokens: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    word_code: Code
    byte_code: Code
    bits: int

    def regions(self) -> np.ndarray:
        """Where the slots of each predictor start (words, then spelling), and the number of all."""
        largest = 1 << self.bits
        return np.cumsum([0, len(self.words), largest // 4, largest, largest // 8, largest // 4, largest // 2])


@dataclass
class Bits:
    """Slots of the predictors, values, and the number of bits of each pair or run."""

    kind: int
    slots: list[np.ndarray]
    bit: np.ndarray
    size: np.ndarray


class Part:
    """Some texts as numbers of pairs (class of the word before, word or escape) and, if asked for, of spelled words."""

    def __init__(self, coder: Coder, spelled: bool):
        self.coder, self.n_tokens, self.bytes = coder, [], 0
        # the escape is the number after those of the book's words
        self.escape = len(coder.book.words)
        self.spelled: dict[bytes, int] | None = {} if spelled else None
        self._word: list[np.ndarray] = []
        self._rare: list[np.ndarray] = []

    def add(self, texts: list[bytes]) -> None:
        words: list[bytes] = []
        before = 0
        for text in texts:
            words += text.lower().split()
            words.append(END)
            self.n_tokens.append(len(words) - before)
            before = len(words)
            self.bytes += len(text)
        number = np.fromiter(map(self.coder.number.get, words, repeat(self.escape)), np.int32, len(words))
        self._word.append(number)
        if (spelled := self.spelled) is not None:
            rare = np.flatnonzero(number == self.escape).tolist()
            self._rare.append(np.fromiter((spelled.setdefault(words[i], len(spelled)) for i in rare), np.int32, len(rare)))

    def close(self) -> None:
        self.word = np.concatenate(self._word)
        # a text starts after an end, which has number 0
        before = np.minimum(np.concatenate([[0], self.word[:-1]]), FINE - 1)
        self.pair = before.astype(np.int64) * (self.escape + 1) + self.word
        if self.spelled is not None:
            self.rare, self.rare_at = np.concatenate(self._rare), np.flatnonzero(self.word == self.escape)
        self._word = self._rare = []


class Coder:
    def __init__(self, book: Book):
        self.book, self.number = book, {w: i for i, w in enumerate(book.words)}
        self.region = book.regions()

    def pair_bits(self, pairs: np.ndarray) -> Iterator[tuple[slice, Bits]]:
        """Bits of the words of pairs, in pieces."""
        code, escape = self.book.word_code, len(self.book.words)
        for start in range(0, len(pairs), PIECE):
            before, word = np.divmod(pairs[start : start + PIECE], escape + 1)
            before = before.astype(np.uint32)
            size = code.size[word]
            run = spread(code.at[word], size)
            node = code.node[run]
            key = node.astype(np.uint32) * _THREE
            coarse, fine = (np.minimum(before, COARSE - 1) + np.uint32(1)) * _ONE, (before + np.uint32(1)) * _TWO
            slots = [node.astype(np.intp), *(self._slot(r, np.repeat(c, size), key) for r, c in ((1, coarse), (2, fine)))]
            yield slice(start, start + len(word)), Bits(0, slots, code.bit[run], size)

    def spelled_bits(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, Bits]]:
        """Bits of spelled words in pieces, with the number of the word that each run belongs to."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        runs = np.maximum(1, -(-sizes // LONGEST))
        of = np.repeat(np.arange(len(words)), runs)
        within = (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * LONGEST
        length = np.minimum(LONGEST, sizes[of] - within)
        last = within + LONGEST >= sizes[of]
        piece = np.cumsum(length + 1) // (4 * PIECE)
        cuts = np.searchsorted(piece, np.arange(piece[-1] + 2)) if len(piece) else []
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                raw = b"".join(words[w][i : i + n] + b" " * x for w, i, n, x in zip(of[a:b].tolist(), within[a:b].tolist(), length[a:b].tolist(), last[a:b].tolist()))
                yield of[a:b], self._run_bits(np.frombuffer(raw, np.uint8), length[a:b] + last[a:b])

    def _run_bits(self, data: np.ndarray, width: np.ndarray) -> Bits:
        code = self.book.byte_code
        first = np.cumsum(width) - width
        place = np.arange(len(data)) - np.repeat(first, width)
        back = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), data])[: len(data)], 0).astype(np.uint32) for k in (1, 2, 3)]
        # the hash of a word so far: a sum of its bytes times powers, from the start of the word
        summed = np.cumsum((data + np.uint32(1)) * _powers(int(width.max(initial=1)))[place], dtype=np.uint32)
        before = np.concatenate([[0], summed[:-1]]).astype(np.uint32)
        two = (back[0] | back[1] << np.uint32(8)) + np.uint32(1)
        three = two + (back[2] << np.uint32(16))
        prefix = before - np.repeat(before[first], width) + place.astype(np.uint32)
        size = code.size[data]
        run = spread(code.at[data], size)
        key = code.node[run].astype(np.uint32) * _THREE
        slots = [self._slot(r, np.repeat(c * _ONE, size), key) for r, c in ((3, two), (4, three), (5, prefix))]
        return Bits(1, slots, code.bit[run], np.add.reduceat(size, first))

    def _slot(self, region: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        size = self.region[region + 1] - self.region[region]
        mixed = context + node
        mixed ^= mixed >> np.uint32(15)
        mixed *= _TWO
        mixed >>= np.uint32(33 - int(size).bit_length())
        out = mixed.astype(np.intp)
        out += self.region[region]
        return out


_POWERS = [np.ones(1, np.uint32)]


def _powers(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2 ** 32, n at least."""
    if len(_POWERS[0]) < n:
        size = max(64, 1 << (n - 1).bit_length())
        _POWERS[0] = np.concatenate([np.ones(1, np.uint32), np.cumprod(np.full(size - 1, 0x01000193, np.uint32), dtype=np.uint32)])
    return _POWERS[0]


def byte_groups(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """First row and UTF-8 bytes (null: empty) of the next rows of a batch, about GROUP bytes at a time."""
    column = batch.column(name).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + GROUP, "right")))
        yield start, [t or b"" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def parts(batch: pa.RecordBatch, coder: Coder, name: str = "text", spelled: bool = False) -> Iterator[tuple[int, Part]]:
    """First row and numbers of the next texts of a batch, about PART bytes at a time."""
    part, first = Part(coder, spelled), 0
    for start, texts in byte_groups(batch, name):
        if part.bytes >= PART:
            part.close()
            yield first, part
            part, first = Part(coder, spelled), start
        part.add(texts)
    if part.n_tokens:
        part.close()
        yield first, part


# ---------------------------------------------------------------- learning


@dataclass(frozen=True)
class Model:
    """The book, the table of states, the mixer's weights by gate, and half the map's correction by gate and bucket."""

    book: Book
    states: np.ndarray
    weights: np.ndarray
    correction: np.ndarray


def word_counts(train: DataFrame, text_col: str = "text") -> DataFrame:
    """word (bytes, empty for the end) and n of all tokens."""

    def make():
        def work(batch: pa.RecordBatch):
            found: Counter[bytes] = Counter()
            for _, texts in byte_groups(batch):
                for text in texts:
                    found.update(text.lower().split())
                found[END] += len(texts)
            yield {"word": list(found), "n": list(found.values())}

        return work

    return arrow_map(train, {"text": text_col}, "word binary, n bigint", make).groupBy("word").agg(F.sum("n").alias("n"))


def make_book(counts: DataFrame, settings: Settings) -> Book:
    """Totals and codes. The words that the driver gets hold 1 / ``share`` of all tokens each, so there are at most ``share`` of them."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(total[0]), int(total[1])
    found = sorted((-r.n, bytes(r.word)) for r in counts.where(settings.common(tokens)).select("word", "n").toLocalIterator())
    end = counts.where(F.length("word") == 0).first()
    words = [END, *(w for _, w in found)]
    number = np.array([end.n if end else 0, *(-n for n, _ in found)], np.int64)

    def make():
        def work(batch: pa.RecordBatch):
            flat, n = batch.column("word"), np.asarray(batch.column("n"))
            sizes = pc.binary_length(flat).to_numpy(zero_copy_only=False)
            data = np.frombuffer(b"".join(flat.to_pylist()), np.uint8)
            sums = np.bincount(data, weights=np.repeat(n, sizes).astype(np.float64), minlength=256).astype(np.int64)
            sums[0x20] += n.sum()
            yield {"byte": np.flatnonzero(sums), "n": sums[sums > 0]}

        return work

    spelled = arrow_map(_rare(counts, tokens, settings), {"word": "word", "n": "n"}, "byte int, n bigint", make)
    weights = np.zeros(256, np.int64)
    for r in spelled.groupBy("byte").agg(F.sum("n").alias("n")).collect():
        weights[r.byte] = r.n
    rare = tokens - int(number.sum())
    return Book(tokens, distinct, words, number, huffman(np.append(number, rare) * 2 + 1), huffman(weights * 2 + 1), settings.bits)


def pieces(batch: pa.RecordBatch, coder: Coder) -> Iterator[tuple[Bits, np.ndarray]]:
    """Bits and how often each occurs: of the pairs in a batch of texts, or of the words in one of words with their counts."""
    if "word" in batch.schema.names:
        words, n = batch.column("word").to_pylist(), np.asarray(batch.column("n"))
        for of, bits in coder.spelled_bits(words):
            yield bits, np.repeat(n[of], bits.size)
    else:
        for _, part in parts(batch, coder):
            pairs, n = np.unique(part.pair, return_counts=True)
            for own, bits in coder.pair_bits(pairs):
                yield bits, np.repeat(n[own], bits.size)


def _rare(counts: DataFrame, tokens: int, settings: Settings) -> DataFrame:
    """Words without a code of their own."""
    return counts.where((F.length("word") > 0) & ~settings.common(tokens))


def bit_states(train: DataFrame, rare: DataFrame, book: Book) -> np.ndarray:
    """The table: for each slot the codes of how often its context saw a one and a zero in all training texts.

    A task counts in a table of its own and hands it on in compressed blocks, which are added where
    a block's parts meet, one part after another. The driver gets two bytes a slot.
    """
    shared = train.sparkSession.sparkContext.broadcast(book)
    size = int(-(-book.regions()[-1] // BLOCK) * BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = None, None
        for batch in batches:
            if coder is None:
                coder, table = Coder(shared.value), np.zeros(2 * size, np.int64)
            for bits, n in pieces(batch, coder):
                for slots in bits.slots:
                    np.add.at(table, slots * 2 + bits.bit, n)
        if table is not None:
            blocks = table.reshape(-1, 2 * BLOCK)
            for k in np.flatnonzero(blocks.any(axis=1)):
                yield _block(k, blocks[k])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column("block").to_pylist(), batch.column("part")):
                values = np.frombuffer(pa.decompress(part.as_buffer(), 16 * BLOCK, "zstd"), np.int64)
                sums[k] = sums[k] + values if k in sums else values
        for k, values in sums.items():
            both = coded(values.reshape(-1, 2)).astype(np.uint16)
            yield _block(k, both[:, 1] << 8 | both[:, 0])

    schema = "block int, part binary"
    found = train.mapInArrow(count, schema).union(rare.mapInArrow(count, schema))
    states = np.zeros(size, np.uint16)
    for r in found.repartition("block").mapInArrow(add, schema).toLocalIterator():
        states[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(pa.decompress(bytes(r.part), 2 * BLOCK, "zstd"), np.uint16)
    return states


def _block(k: int, values: np.ndarray) -> pa.RecordBatch:
    part = pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["block", "part"])


def bucket(odds: np.ndarray) -> np.ndarray:
    return np.rint((odds + LIMIT) * ((BUCKETS - 1) / (2 * LIMIT))).astype(np.intp)


def mixer(train: DataFrame, rare: DataFrame, book: Book, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by gate and the map's correction, from one online pass over all training texts.

    Each task starts from the same weights and takes a Newton step for each piece. Tasks hand on
    their second moments, those times their weights, and bit counts by bucket, all of which add
    up; the merged weights are the tasks' weights averaged by second moments.
    """
    context = train.sparkSession.sparkContext
    shared, table = context.broadcast(book), context.broadcast(states)
    width = INPUTS * INPUTS + INPUTS + 2 * BUCKETS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        weights, second = _START.copy(), np.tile(np.eye(INPUTS) * PRIOR, (GATES, 1, 1))
        seen = np.zeros((GATES, 2 * BUCKETS))
        for batch in batches:
            coder = coder or Coder(shared.value)
            for bits, n in pieces(batch, coder):
                _learn_piece(bits, n, table.value, weights, second, seen)
        if coder:
            moved = np.einsum("gij,gj->gi", second, weights) - PRIOR * _START
            rows = np.hstack([(second - np.eye(INPUTS) * PRIOR).reshape(GATES, -1), moved, seen])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows.size, dtype=np.int32)), pa.array(rows.ravel())], ["place", "value"])

    schema = "place int, value double"
    found = train.mapInArrow(learn, schema).union(rare.mapInArrow(learn, schema)).groupBy("place").agg(F.sum("value").alias("value"))
    sums = np.zeros(GATES * width)
    for r in found.collect():
        sums[r.place] = r.value
    sums = sums.reshape(GATES, width)
    second = sums[:, : INPUTS * INPUTS].reshape(GATES, INPUTS, INPUTS) + np.eye(INPUTS) * PRIOR
    moved = sums[:, INPUTS * INPUTS : INPUTS * INPUTS + INPUTS] + PRIOR * _START
    weights = np.round(np.linalg.solve(second, moved[:, :, None])[:, :, 0], 6)
    zeros, ones = sums[:, -2 * BUCKETS : -BUCKETS], sums[:, -BUCKETS:]
    centre = np.linspace(-LIMIT, LIMIT, BUCKETS)
    likely = 1 / (1 + np.exp(-centre))
    # as if each bucket had seen some bits as likely as its centre says
    found = np.log((ones + 20 * likely) / (zeros + 20 * (1 - likely)))
    return weights, np.round((found - centre) / 2, 6)


def _gates(states: list[np.ndarray], kind: int, evidence: np.ndarray) -> np.ndarray:
    return evidence[states[1]] * np.uint8(4) + evidence[states[2]] + np.uint8(16 * kind)


def _learn_piece(bits: Bits, n: np.ndarray, table: np.ndarray, weights: np.ndarray, second: np.ndarray, seen: np.ndarray) -> None:
    states = [table[s].astype(np.int32) * 2 + bits.bit for s in bits.slots]
    gate = _gates(states, bits.kind, EVIDENCE_LESS)
    order = np.argsort(gate, kind="stable")
    cuts = np.cumsum(np.bincount(gate, minlength=GATES))
    x = np.stack([ODDS_LESS[s[order]] for s in states])
    if bits.kind == 0:
        # a word bit without context has been seen often: the counts of its code's balanced nodes say nothing without one of them
        x[0] = ODDS[states[0][order] >> 1]
    bit, n = bits.bit[order], n[order].astype(np.float32)
    for g in np.flatnonzero(np.diff(cuts, prepend=0)):
        own = slice(cuts[g - 1] if g else 0, cuts[g])
        inputs, value, times = x[:, own], bit[own], n[own]
        odds = np.clip(weights[g].astype(np.float32) @ inputs, -LIMIT, LIMIT)
        p = 1 / (1 + np.exp(-odds))
        seen[g] += np.bincount(bucket(odds) + BUCKETS * value.astype(np.intp), weights=times, minlength=2 * BUCKETS)
        second[g] += inputs @ (inputs * (times * p * (1 - p))).T
        weights[g] += np.linalg.solve(second[g], inputs @ (times * (value - p)))


def fit(df: DataFrame, learn: Column, text_col: str = "text", settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """A model of the rows where ``learn`` holds, and the counts of all their tokens (written in the shared folder)."""
    train = df.where(learn).select(F.col(f"`{text_col}`").alias("text"))
    counts = stored(word_counts(train))
    book = make_book(counts, settings)
    rare = _rare(counts, book.tokens, settings)
    states = bit_states(train, rare, book)
    return Model(book, states, *mixer(train, rare, book, states)), counts


# ---------------------------------------------------------------- scoring


class Scorer:
    def __init__(self, model: Model):
        self.model, self.coder = model, Coder(model.book)
        self.weights = model.weights.T.astype(np.float32).copy()
        self.correction = model.correction.astype(np.float32).ravel()
        self.known = np.append(np.log10(model.book.counts + 1.0), 0.0)
        self.seen = np.append(model.book.counts > 0, False)

    def costs(self, bits: Bits) -> list[np.ndarray]:
        """Bits that each pair or run takes, by mixer."""
        states = [self.model.states[s] for s in bits.slots]
        gate = _gates(states, bits.kind, EVIDENCE)
        mixed = sum(w[gate] * ODDS[s] for w, s in zip(self.weights, states))
        at = gate.astype(np.intp) * BUCKETS
        sign = bits.bit.astype(np.float32) * 2 - 1
        starts = np.cumsum(bits.size) - bits.size
        found = []
        for trust in TRUST:
            odds = np.clip(mixed * np.float32(trust), -LIMIT, LIMIT)
            odds += self.correction[bucket(odds) + at]
            odds *= sign
            found.append(np.add.reduceat(np.log2(1 + np.exp(-odds)), starts, dtype=np.float64))
        return found

    def total_bits(self, part: Part) -> np.ndarray:
        """Bits of each text of a part, as the mixture of all mixers codes it."""
        count = len(part.n_tokens)
        doc = np.repeat(np.arange(count), part.n_tokens)
        pairs, which = np.unique(part.pair, return_inverse=True)
        words = list(part.spelled)
        pair_costs, word_costs = np.zeros((len(TRUST), len(pairs))), np.zeros((len(TRUST), len(words)))
        for own, bits in self.coder.pair_bits(pairs):
            pair_costs[:, own] = self.costs(bits)
        for of, bits in self.coder.spelled_bits(words):
            for m, found in enumerate(self.costs(bits)):
                np.add.at(word_costs[m], of, found)
        sums = [
            np.bincount(doc, weights=p[which], minlength=count) + np.bincount(doc[part.rare_at], weights=w[part.rare], minlength=count)
            for p, w in zip(pair_costs, word_costs)
        ]
        return np.log2(len(TRUST)) - np.logaddexp2.reduce(-np.array(sums), axis=0)


def score(df: DataFrame, model: Model, counts: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep``, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability), total_bits, n_bytes and bits_per_byte of every row.

    One pass scores all rows; words without a code of their own come out as rows (kept in the
    shared folder beside the scores) and meet their counts by a join.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`_keep{i}` {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))

    def make():
        scorer = Scorer(shared.value)

        def work(batch: pa.RecordBatch):
            size = pc.fill_null(pc.binary_length(batch.column("_text").cast(pa.binary())), 0).cast(pa.int64())
            for start, part in parts(batch, scorer.coder, "_text", spelled=True):
                count = len(part.n_tokens)
                doc = np.repeat(np.arange(count), part.n_tokens)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[part.rare_at], minlength=count))])
                yield {f"_keep{i}": batch.column(f"_keep{i}").slice(start, count) for i in range(len(keep))} | {
                    "n_tokens": part.n_tokens,
                    "known": np.bincount(doc, weights=scorer.seen[part.word], minlength=count).astype(np.int64),
                    "logs": np.bincount(doc, weights=scorer.known[part.word], minlength=count),
                    "total_bits": scorer.total_bits(part),
                    "n_bytes": size.slice(start, count),
                    "rare": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(list(part.spelled), pa.binary()).take(pa.array(part.rare))),
                }

        return work

    columns = {f"_keep{i}": c for i, c in enumerate(keep)} | {"_text": text_col}
    schema = f"{kinds}, n_tokens bigint, known bigint, logs double, total_bits double, n_bytes bigint, rare array<binary>"
    scored = stored(arrow_map(df, columns, schema, make).withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode("rare").alias("word"))
    more = rare.join(counts, "word").groupBy("_row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    book, zero = model.book, F.lit(0)
    return scored.drop("rare").join(more, "_row", "left").select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(book.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(book.tokens + book.distinct + 1)))).alias("base_score"),
        (F.col("total_bits") * F.lit(-float(np.log10(2.0)))).alias("score"),
        "total_bits",
        "n_bytes",
        F.try_divide(F.col("total_bits"), F.col("n_bytes")).alias("bits_per_byte"),
    )
