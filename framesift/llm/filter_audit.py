"""Interaction of filters: what each removes at each step of every order, from additive counters.

Five filters judge whole texts (null: empty; words are runs of anything but ASCII white space):

- A: under 100 words
- B: 100 * distinct words < 80 * words
- C: 100 * letters A to Z > 10 * code points
- D: holds one of ``#$%&*|``
- E: identical to the text of a row with a smaller id, wherever that is

Duplicates are found by sorting: rows are dealt over ranges of (text fingerprint, id), so that even
one text's copies are many tasks, and sorted there by fingerprint, whole text and id; each row is compared with
its predecessor's run. Runs of the first and last fingerprint of a range may go on in its neighbours: their rows
carry the text's digest, as do those of runs longer than HELD rows, and the smallest id of each such digest
settles them (two runs a range and one for HELD rows at most, so that broadcast is bounded).

A row's failures are a mask of five bits. All figures of a part follow from the number of its rows
with each mask (and of those with a good or a toxic label), so 32 sums a part are everything that
is expanded to the 120 orders and five steps.

A null id is smaller than none and larger than none: it neither fails E nor makes others fail. Repeated rows with equal ids
don't fail each other. A null part is the empty string. Rows without a label count as neither good
nor toxic; of several labels of an id a 1 wins. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import stored

FILTERS = "ABCDE"
#: Rows of one fingerprint that a task holds back.
HELD = 100_000
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_INSIDE = bytes(range(0x80, 0xC0))
_SYMBOL = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: at ASCII white space
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INSIDE))
    failed = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * points, _SYMBOL.search(text) is not None)
    return sum(_BIT[f] for f, x in zip(FILTERS, failed) if x)


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """_id, _part and _mask (bits of the failed filters, A lowest) of every row."""
    key = F.col(f"`{id_col}`").cast("bigint")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(key.alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("_part"), text.alias("_text"), F.xxhash64(text).alias("_print"))
    # the fingerprint and id say where a row goes; the text itself would make the ranges' sampled bounds large
    dealt = rows.repartitionByRange("_print", "_id").sortWithinPartitions("_print", "_text", "_id")
    scanned = stored(dealt.mapInArrow(_scan, "_id bigint, _part string, _mask int, _edge binary"))
    firsts = scanned.where("_edge IS NOT NULL").groupBy(F.col("_edge").alias("_digest")).agg(F.min("_id").alias("_first"))
    joined = scanned.join(F.broadcast(firsts), F.col("_edge") == F.col("_digest"), "left")
    again = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False))
    return joined.select("_id", "_part", F.when(again, F.col("_mask").bitwiseOR(_BIT["E"])).otherwise(F.col("_mask")).alias("_mask"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of the sorted rows of one range; ``_edge`` is the text's digest in the range's first and last fingerprint and in long runs, else null.

    Whether a fingerprint is the last shows at the end only, so the rows of the one in work are held
    back without their texts, HELD at most.
    """
    run: bytes | None = None  # text of the run
    smallest = mask = digest = None
    first = current = None
    edge = False
    held: list[tuple] = []
    for batch in batches:
        done: list[tuple] = []
        texts, prints = batch.column("_text").cast(pa.binary()), batch.column("_print").to_pylist()
        for i, (key, part) in enumerate(zip(batch.column("_id").to_pylist(), batch.column("_part").to_pylist())):
            if prints[i] != current:
                done += held if edge else [(*r[:3], None) for r in held]
                held, run, current = [], None, prints[i]
                first = current if first is None else first
                edge = current == first
            if (text := texts[i].as_py()) != run:
                run, smallest, mask, digest = text, None, text_mask(text), hashlib.sha256(text).digest()
            failed = mask | _BIT["E"] if smallest is not None and key > smallest else mask
            smallest = key if smallest is None else smallest
            held.append((key, part, failed, digest))
            edge = edge or len(held) > HELD
        if edge:
            done, held = done + held, []
        if done:
            yield _rows(done)
    if held:
        yield _rows(held)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("_id", pa.int64()), ("_part", pa.string()), ("_mask", pa.int32()), ("_edge", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def audit(counts: DataFrame) -> DataFrame:
    """The report (part, filter_order, step and the counts) from _part, _mask, _n, _good and _toxic, a row for each part and mask."""
    orders = F.split(F.lit(",".join(map("".join, itertools.permutations(FILTERS)))), ",")
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    mask, order, step = F.col("_mask"), F.col("filter_order"), F.col("step")
    own, passed = F.substr(order, step, F.lit(1)), F.substr(order, F.lit(1), step - 1)
    failed = F.concat(*[F.when(mask.bitwiseAND(bit) != 0, f).otherwise("") for f, bit in _BIT.items()])
    fails = F.contains(failed, own)
    # a failed filter stands before this one: taking the failed letters out changes what has passed
    earlier = F.call_function("translate", passed, failed, F.lit("")) != passed
    total = lambda when, n="_n": F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0)).cast("bigint")
    # of the 120 orders, the filter comes first among a row's k failed ones in 120 / k
    share = F.col("_n") * F.try_divide(F.lit(120), F.bit_count(mask)).cast("bigint")
    return rows.groupBy(F.col("_part").alias("part"), order, step).agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(failed == own).alias("unique_fails"),
        total(fails & ~earlier, "_good").alias("good_lost"),
        total(fails & ~earlier, "_toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).cast("bigint").alias("shapley"),
    )


def filter_audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Masks of all rows, their labels by id, counters of each part and mask, and the report."""
    one = lambda c: F.max((F.col(c) == 1).cast("int"))
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("_doc")).agg(one("quality").alias("_q"), one("toxic").alias("_t"))
    rows = masks(df, id_col, text_col, part_col).join(marks, F.col("_id") == F.col("_doc"), "left")
    number = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return audit(rows.groupBy("_part", "_mask").agg(F.count("*").alias("_n"), number("_q").alias("_good"), number("_t").alias("_toxic")))
