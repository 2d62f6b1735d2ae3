"""Edit-aware token counts: a segment tree of pre-token runs per document, updated edit by edit.

A document is cut into runs of pre-tokens at places between a non-space and a space, where byte
pair encoding never joins the two sides. The tree's leaves hold each run's characters and tokens,
its inner nodes their sums. An edit descends to the runs it touches, widens to the neighbour
where it touches a cut, encodes only that region again and updates the sums above it.

Null texts are empty. Edits apply in the order of their sequence number; positions beyond the text
are moved into it, edits with a null field and edits of unknown documents do nothing. The edits of
one document are one sequence and run in one task; documents are independent. Repeated document
rows each get the edits; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_map, cut_points, text_groups

#: Characters of a run, about; a run without a space is longer.
RUN = 512

_EDITS = "array<struct<seq:bigint,start:bigint,stop:bigint,insert:string>>"


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str, pattern: str):
    """The byte-level encoding of a rank file; one for a worker process."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class CountTree:
    """Segment tree over runs: characters and tokens of each, and their sums in every inner node."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.used = len(runs)
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (chars, tokens) in enumerate(runs, self.size):
            self.chars[i], self.tokens[i] = chars, tokens
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf with any for the text's end), and where it starts."""
        i, start = 1, 0
        at = min(at, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def leaf(self, i: int) -> tuple[int, int]:
        return self.chars[self.size + i], self.tokens[self.size + i]

    def runs(self) -> list[tuple[int, int]]:
        return [r for r in map(self.leaf, range(self.used)) if r[0]]

    def replace(self, first: int, last: int, runs: list[tuple[int, int]]) -> "CountTree":
        """Put new runs in place of leaves first to last. Grows into a new tree if they don't fit there."""
        if len(runs) > last - first + 1:
            return CountTree([*map(self.leaf, range(first)), *runs, *map(self.leaf, range(last + 1, self.used))])
        for i, (chars, tokens) in enumerate(runs + [(0, 0)] * (last - first + 1 - len(runs)), self.size + first):
            self.chars[i], self.tokens[i] = chars, tokens
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2
        return self


@dataclass
class Document:
    """A text and its tree; ``encoded`` counts the characters that edits have had encoded again."""

    text: str
    tree: CountTree
    count: object
    encoded: int = 0

    @classmethod
    def build(cls, text: str, count) -> "Document":
        return cls(text, CountTree([(len(r), count(r)) for r in cut_points(text, RUN) if r]), count)

    def edit(self, start: int, stop: int, insert: str) -> None:
        start = min(max(0, start), len(self.text))
        stop = min(max(start, stop), len(self.text))
        if not self.text:
            self.text = insert
            self.tree = Document.build(insert, self.count).tree
            self.encoded += len(insert)
            return
        first, begin = self.tree.find(start)
        if begin and start <= begin:  # the cut before this run may go: take the run before it, too
            first, begin = self.tree.find(begin - 1)
        last, last_begin = self.tree.find(stop)
        end = last_begin + self.tree.leaf(last)[0]
        if stop >= end < len(self.text):  # the same for the cut after it
            last, last_begin = self.tree.find(end)
            end = last_begin + self.tree.leaf(last)[0]
        region = self.text[begin:start] + insert + self.text[stop:end]
        self.text = self.text[:begin] + region + self.text[end:]
        self.tree = self.tree.replace(first, last, [(len(r), self.count(r)) for r in cut_points(region, RUN) if r])
        self.encoded += len(region)

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens[1] if len(self.tree.tokens) > 1 else 0


def build(df: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The state of each document: the columns ``keep``, text, run_chars, run_tokens (arrays) and n_tokens."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        encode = encoding(vocabulary, pattern).encode_ordinary

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch, "_text"):
                runs = [[(len(r), len(encode(r))) for r in cut_points(t, RUN) if r] for t in texts]
                yield {c: batch.column(f"_keep{i}").slice(start, len(texts)) for i, c in enumerate(keep)} | {
                    "text": texts,
                    "run_chars": [[c for c, _ in r] for r in runs],
                    "run_tokens": [[n for _, n in r] for r in runs],
                    "n_tokens": [sum(n for _, n in r) for r in runs],
                }

        return work

    schema = f"{kinds}, text string, run_chars array<int>, run_tokens array<int>, n_tokens bigint"
    return arrow_map(df, {f"_keep{i}": c for i, c in enumerate(keep)} | {"_text": text_col}, schema, make)


def grouped(edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Edits (id, seq, start, stop, insert) as one array for each document, in order."""
    entry = F.struct(*(F.col(c).cast("bigint").alias(c) for c in ("seq", "start", "stop")), F.col("insert").cast("string").alias("insert"))
    return edits.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("edits"))


def apply_edits(state: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The state after the edits in its column ``edits`` (null: none), with ``encoded_chars``: how much was encoded again."""
    kinds = ", ".join(f"`{c}` {state.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        encode = encoding(vocabulary, pattern).encode_ordinary
        count = lambda run: len(encode(run))

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch, "text"):
                part = {c: batch.column(c).slice(start, len(texts)) for c in ("run_chars", "run_tokens", "edits")}
                done = []
                for text, chars, tokens, edits in zip(texts, *(part[c].to_pylist() for c in part)):
                    document = Document(text, CountTree(list(zip(chars, tokens))), count)
                    for e in sorted(edits or [], key=lambda e: (e["seq"] is None, e["seq"])):
                        if None not in e.values():
                            document.edit(e["start"], e["stop"], e["insert"])
                    done.append(document)
                runs = [d.tree.runs() for d in done]
                yield {c: batch.column(f"_keep{i}").slice(start, len(texts)) for i, c in enumerate(keep)} | {
                    "text": [d.text for d in done],
                    "run_chars": [[c for c, _ in r] for r in runs],
                    "run_tokens": [[n for _, n in r] for r in runs],
                    "n_tokens": [d.n_tokens for d in done],
                    "encoded_chars": [d.encoded for d in done],
                }

        return work

    schema = f"{kinds}, text string, run_chars array<int>, run_tokens array<int>, n_tokens bigint, encoded_chars bigint"
    columns = {f"_keep{i}": c for i, c in enumerate(keep)} | {c: c for c in ("text", "run_chars", "run_tokens")} | {"edits": F.col("edits").cast(_EDITS)}
    return arrow_map(state, columns, schema, make)


def sample_edits(id_col: str = "doc_id", n_chars_col: str = "text", n: int = 4):
    """Edits of a document that follow from its id and length: an insertion, a deletion, a replacement by turns."""
    length = F.length(F.col(n_chars_col)).cast("bigint")
    entries = []
    for k in range(n):
        start = F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), length + 1)
        insert = ["  new words", "", "replaced\n\n text'", "x"][k % 4]
        entries.append(F.struct(F.lit(k).cast("bigint").alias("seq"), start.alias("start"), (start + [0, 9, 30, 1][k % 4]).alias("stop"), F.lit(insert).alias("insert")))
    return F.array(*entries)
