"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Documents are tokenized and cut into pieces of at most one sequence. Pieces are dealt to blocks of
bounded size; each block is packed best-fit first and then improved: pieces of the emptiest bin
move, one for nothing, one for one, two for one or one for two, into fuller bins wherever that
raises the sum of squared fills, until the bin is empty. Bins that stay underfull at the end of a
round are dissolved and packed again, over fewer blocks, until one block is left.

Null texts are empty documents of the end token alone. Repeated rows are packed as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.bpe import byte_table
from framesift.llm.common import Remembered, arrow_map, checkpoint, cut_points, text_groups

#: Characters tokenized at a time, and pieces that a worker process remembers.
RUN_CHARS, CACHE = 1 << 18, 300_000
_LATER = re.compile("[^\x00-\u052f]")
#: Pieces of a block, and the fill below which a bin is dissolved for the next round.
BLOCK, OPEN_BELOW = 1 << 15, 0.98
#: Bins in a row that the search fails to empty before it ends.
PATIENCE = 12


class WordIds:
    """Token ids of texts as little-endian bytes; a worker process remembers the ids of pieces it has met.

    A text is normalized, split by the pattern in the vocabulary file, and each new piece goes to
    the library's model byte by byte as printable characters. Up to U+00FF the pattern's classes
    are written out for Python's own expressions, which are faster. Texts with characters from
    U+0530 on, whose classes depend on the Unicode version, or with what may be a special token's
    text, are encoded by the library alone, run by run.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.model, self.normalizer = self.whole.model, self.whole.normalizer
        pattern = json.loads(self.whole.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern).findall
        self.latin_pieces = re.compile(latin_pattern(pattern)).findall
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.printable = {b: c for c, b in byte_table().items()}
        self.known = Remembered(self._ids, CACHE)

    def _ids(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.printable))
        return array("I", [t.id for t in tokens]).tobytes()

    def _run(self, run: str) -> bytes:
        if any(t in run for t in self.specials):
            return self._by_library(run)
        try:
            run.encode("latin-1")
        except UnicodeEncodeError:
            if _LATER.search(run):
                return self._by_library(run)
            pieces = self.pieces(self.normalizer.normalize_str(run))
        else:
            pieces = self.latin_pieces(run.lower())  # such characters are in normal form already
        return b"".join(map(self.known.__getitem__, pieces))

    def _by_library(self, run: str) -> bytes:
        return np.array(self.whole.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return b"".join(map(self._run, cut_points(text, RUN_CHARS)))


def latin_pattern(pattern: str) -> str:
    """The pattern for characters up to U+00FF, with the classes of letters, numbers and spaces written out."""
    members = lambda kind: "".join(re.escape(c) for c in map(chr, range(256)) if regex.match(kind, c))
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        pattern = pattern.replace(kind, members(kind))
    return pattern


@functools.lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    """One encoder for a worker process."""
    return WordIds(vocabulary)


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of each document: doc_id, piece, start, length and ids_crc32; a document ends with ``end_id``."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def make():
        tokens, last = word_ids(vocabulary), np.array([end_id], "<u4").tobytes()

        def work(batch: pa.RecordBatch):
            for first, texts in text_groups(batch):
                rows, at = [], []
                for k, ids in enumerate(map(tokens.ids, texts), first):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
                        at.append(k)
                yield {"doc_id": batch.column("key").take(pa.array(at))} | dict(zip(("piece", "start", "length", "ids_crc32"), zip(*rows)))

        return work

    return arrow_map(df, {"key": id_col, "text": text_col}, schema, make)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of lengths. The set of free capacities is a bit mask."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for length in sorted(lengths, reverse=True):
        fits = mask >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            place = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
            bins[place].append(length)
        else:
            room, place = capacity, len(bins)
            bins.append([length])
        room -= length
        if room:
            with_room[room].append(place)
            mask |= 1 << room
    return bins


def _exchange(low: list[int], high: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """Lengths to move out of ``low`` and back out of ``high`` so that ``high`` gains most, within its room.

    One for nothing, one for one, two for one and one for two. Moving length from the emptier to
    the fuller bin raises the sum of squared fills. None if nothing moves length that way.
    """
    ones = sorted(low)
    best, move = 0, None
    pairs = sorted((low[i] + low[j], i, j) for i in range(len(low)) for j in range(i))
    sums = [p[0] for p in pairs]
    for back in [[], *([x] for x in dict.fromkeys(high))]:
        limit = room + sum(back)
        k = bisect_right(ones, limit) - 1
        if k >= 0 and ones[k] - sum(back) > best:
            best, move = ones[k] - sum(back), ([ones[k]], back)
        k = bisect_right(sums, limit) - 1
        if k >= 0 and sums[k] - sum(back) > best:
            best, move = sums[k] - sum(back), ([low[pairs[k][1]], low[pairs[k][2]]], back)
        if best == room:
            return move
    for i, a in enumerate(high):
        for b in high[:i]:
            k = bisect_right(ones, room + a + b) - 1
            if k >= 0 and ones[k] - a - b > best:
                best, move = ones[k] - a - b, ([ones[k]], [a, b])
    return move


def local_search(bins: list[list[int]], capacity: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empty underfull bins by exchanges that raise squared fill, the emptiest bin first.

    Ends when the bins are as few as their total allows, or after ``patience`` bins in a row that
    no exchange empties; a bin that failed keeps what it gained or gave.
    """
    fills = [sum(b) for b in bins]
    fewest = -(-sum(fills) // capacity)
    alive, failed = len(bins), 0
    order = sorted((i for i in range(len(bins)) if fills[i] < capacity), key=fills.__getitem__)
    tried: set[int] = set()
    while alive > fewest and failed < patience:
        victim = min((i for i in order if bins[i] and i not in tried), key=fills.__getitem__, default=None)
        if victim is None:
            break
        tried.add(victim)
        moved = True
        while moved and bins[victim]:
            moved = False
            for i in reversed(order):  # the fullest first: their rooms take the exact fits
                room = capacity - fills[i]
                if i == victim or not room or not bins[i] or fills[i] < fills[victim]:
                    continue
                found = _exchange(bins[victim], bins[i], room)
                if not found:
                    continue
                out, back = found
                for x in out:
                    bins[victim].remove(x)
                for x in back:
                    bins[i].remove(x)
                bins[victim] += back
                bins[i] += out
                gain = sum(out) - sum(back)
                fills[victim] -= gain
                fills[i] += gain
                moved = True
                if not bins[victim]:
                    break
        if bins[victim]:
            failed += 1
        else:
            alive, failed = alive - 1, 0
            tried.clear()
    return [b for b in bins if b]


def pack(found: DataFrame, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """``found`` (rows with an integer ``length``) with sequence_id and offset added.

    A row of full length is a sequence of its own. The others go to blocks by a hash of their
    place in the checkpointed table, so a hot value spreads like any other; each round packs what
    is left over in blocks of about ``block`` rows.
    """
    names = found.columns
    rows = checkpoint(found).withColumn("_row", F.monotonically_increasing_id())
    full = F.col("length") >= capacity
    done = rows.where(full).select(*names, F.col("_row").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left, turn = rows.where(~full), 0
    n = left.count()
    schema = f"{left.schema.toDDL()}, sequence_id bigint, offset bigint, _open boolean"

    while n:
        blocks = -(-n // block)
        final = blocks == 1

        def fill(key: tuple, part, final: bool = final, turn: int = turn):
            bins = local_search(best_fit(part["length"].tolist(), capacity), capacity)
            # rows of one length are alike: each bin takes the next of that length
            part = part.sort_values(["length", "_row"], kind="stable").reset_index(drop=True)
            values, starts = np.unique(part["length"].to_numpy(), return_index=True)
            following = dict(zip(values.tolist(), starts.tolist()))
            sequence, offset = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
            again = np.zeros(len(part), bool)
            base = ((turn + 1) << 56) | (int(key[0]) << 24)
            for i, lengths in enumerate(bins):
                at, reopen = 0, not final and sum(lengths) < OPEN_BELOW * capacity
                for length in lengths:
                    k = following[length]
                    following[length] += 1
                    sequence[k], offset[k], again[k] = base + i, at, reopen
                    at += length
            return part.assign(sequence_id=sequence, offset=offset, _open=again)

        dealt = left.withColumn("_block", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(blocks)))
        packed = checkpoint(dealt.groupBy("_block").applyInPandas(lambda key, part: fill(key, part.drop(columns="_block")), schema))
        done = done.unionByName(packed.where("not _open").select(*names, "sequence_id", "offset"))
        left = packed.where("_open").select(*names, "_row")
        before, n = n, 0 if final else left.count()
        if n > before * 0.5:  # little was closed: the next round would not differ, so all of it closes
            done = done.unionByName(packed.where("_open").select(*names, "sequence_id", "offset"))
            n = 0
        turn += 1
    return done


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(pieces(df, vocabulary, id_col, text_col, capacity, end_id), capacity)
