"""N-gram Jaccard join: near-duplicate documents by word shingles, with multiple-global-order filtering.

Two documents link when the Jaccard similarity of their sets of word shingles is at least
``percent`` per cent; the join returns each document's component under these links. Every filter
below keeps every pair that links. Shingles are told apart by 64 bits and sets by 128, so the
result is exact but for accidents of these hashes: for two sets of 10,000 shingles about one in
10^11, for 10^10 different sets about one in 10^18.

1. Under one global order of shingles, by hash, the first shingles of each document are counted
   over all documents. Two documents that link share the first few of their common shingles inside
   these prefixes, so a document with too few shared ones links with nothing and goes.
2. Of what is left, equal sets count as one, and all shingles are counted. The second order puts
   rare shingles first: linked documents share a shingle of its (shorter) prefixes, at places that
   leave room for the overlap they need.
3. Pairs that pass must also share a prefix shingle under the first order and under its reverse.
   Only these prefixes, a fifth or less of a set at 90 per cent, are joined to the pairs for that;
   whole sets are joined to, and intersected for, the pairs that all three orders leave.

Pairs are never formed within a whole group of documents that share a shingle. Each group first
meets its most central document; what that links forms one component, and afterwards only pairs
across components are formed, between members outside a group's largest component and the others.
Groups are dealt over as many parts as their size asks for, so no shingle's group meets in one task.

Words are runs of bytes other than ASCII space, A to Z read as a to z. A text with fewer words
than a shingle has is one shingle; one without words, or null, has none and links with nothing.
Repeated rows and ids are kept; rows with a null id take part and get the smallest id of their
component, if it has one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_map, checkpoint, free_name, stored, text_groups

#: Words that a worker process remembers.
CACHE = 50_000
#: Rows of a shingle's group that one part of it holds, about.
PART = 512
#: Occurrences from which on a shingle's number in the second order tells them by their logarithm alone.
OFTEN = 1 << 14
_known: dict[bytes, int] = {}


@dataclass(frozen=True)
class Settings:
    """Words of a shingle, least similarity, how far the first order's prefixes are extended (per cent of a set), and ids that may be broadcast."""

    words: int = 5
    percent: int = 80
    extend: int = 8
    broadcast_ids: int = 1_000_000

    def need(self, n: Column) -> Column:
        """Least overlap of a set of n with any set that it links with."""
        return F.floor((self.percent * n + 99) / 100)

    def first_prefix(self, n: int) -> int:
        need = (self.percent * n + 99) // 100
        return min(n, n - need + 1 + self.extend * n // 100)

    def first_shared(self, n: Column) -> Column:
        """Shingles of the first prefix that a set of n shares with any set that it links with."""
        return 1 + F.floor(self.extend * self.need(n) / 100)

    def prefix(self, n: Column) -> Column:
        return n - self.need(n) + 1

    def enough(self, overlap: Column, n: Column, m: Column) -> Column:
        """Whether an overlap makes sets of n and m similar enough."""
        return (100 + self.percent) * overlap >= self.percent * (n + m)


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit numbers of the text's shingles."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_known) > CACHE:
        _known.clear()
    number = xxhash.xxh3_64_intdigest
    for w in [w for w in set(words) if w not in _known]:
        _known[w] = number(w)
    h = np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    mixed = np.full(n, min(k, len(h)), np.uint64)
    for j in range(min(k, len(h))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _node(values: np.ndarray) -> bytes:
    """A set's name: equal sets have equal names, others differ in their 128 bits."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _bits(tokens: int) -> int:
    """Bits of a hash that tell so many shingles apart but for a sixty-fourth of them.

    Counts need no more: shingles that share these bits count as one, which only keeps documents
    and pairs that a later step looks at whole.
    """
    return min(48, max(16, max(1, tokens).bit_length() + 6))


def _signatures(df: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """row (a number), id, node, n and the first prefix of each row, its shingles by their low bits; written once, in the shared folder."""
    kind = df.schema[id_col].dataType.simpleString()
    bits = _bits(128 * df.count())
    item, mask = ("int", np.int32) if bits <= 32 else ("bigint", np.int64), np.uint64((1 << bits) - 1)

    def make():
        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                sets = [shingles(t, settings.words) for t in texts]
                yield {
                    "id": batch.column("id").slice(start, len(texts)),
                    "node": list(map(_node, sets)),
                    "n": list(map(len, sets)),
                    "prefix": [(s[: settings.first_prefix(len(s))] & mask).astype(item[1]) for s in sets],
                }

        return work

    found = arrow_map(df, {"id": id_col, "text": text_col}, f"id {kind}, node binary, n bigint, prefix array<{item[0]}>", make)
    return stored(found.withColumn("row", F.monotonically_increasing_id()))


def _sets(df: DataFrame, ids: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """row (a number), node, n, shingles, and the prefixes low and high under the order by hash and its reverse, of the distinct sets of ``ids`` (id, node)."""
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    wanted = ids.select("id").distinct()
    # a bounded list of ids spares the shuffle of all texts
    found = texts.join(F.broadcast(wanted) if ids.count() <= settings.broadcast_ids else wanted, "id", "left_semi")
    # sets that only rows with a null id hold: no id finds those rows, so all of them are read
    texts = found.unionByName(texts.where("id IS NULL")) if ids.where("id IS NULL").limit(1).count() else found

    def make():
        def work(batch: pa.RecordBatch):
            for _, group in text_groups(batch):
                sets = [shingles(t, settings.words) for t in group]
                yield {"node": list(map(_node, sets)), "n": list(map(len, sets)), "shingles": [s.view(np.int64) for s in sets]}

        return work

    found = arrow_map(texts, {"text": "text"}, "node binary, n bigint, shingles array<bigint>", make)
    # an id may stand on several rows with other texts
    found = found.join(ids.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    # the shingles are sorted by hash; 32 of their bits are enough to let every common one through
    length = settings.prefix(F.col("n")).cast("int")
    short = lambda part: F.transform(part, lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int"))
    low, high = short(F.slice("shingles", F.lit(1), length)), short(F.slice("shingles", -length, length))
    return stored(found.select(F.monotonically_increasing_id().alias("row"), "node", "n", low.alias("low"), high.alias("high"), "shingles"))


def _survivors(signatures: DataFrame, settings: Settings) -> DataFrame:
    """node and one id (null if only null-id rows hold it) of each distinct set that shares enough of its first prefix with other rows."""
    # token rows are as small as can be: a short row number and some bits of a hash
    rows = signatures.where("n > 0")
    tokens = rows.select("row", F.explode("prefix").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    shared = tokens.join(often, "token").groupBy("row").agg(F.count("*").alias("shared"))
    kept = rows.select("row", "id", "node", "n").join(shared, "row")
    return kept.where(F.col("shared") >= settings.first_shared(F.col("n"))).groupBy("node").agg(F.min("id").alias("id"))


def _prefixes(sets: DataFrame, settings: Settings) -> DataFrame:
    """token, row, n, place and centre: each set's shared shingles in its prefix under the order that puts rare ones first.

    ``place`` is the number of the set's shingles that come before; ``centre`` is how often the
    set's shingles occur on average. Shingles of one set alone come first of all and match nothing.
    The order is that of one number: how often a shingle occurs (its logarithm from OFTEN on) above
    some bits of its hash.
    """
    mask = F.lit((1 << _bits(sets.agg(F.sum("n")).first()[0] or 0)) - 1)
    tokens = sets.select("row", F.explode(F.transform("shingles", lambda x: x.bitwiseAND(mask))).alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    level = F.when(F.col("times") < OFTEN, F.col("times")).otherwise(OFTEN + F.floor(F.log2(F.col("times") / OFTEN)))
    rank = F.shiftleft(level.cast("bigint"), 48).bitwiseOR(F.col("token"))
    shared = tokens.join(often, "token").groupBy("row").agg(F.count("*").alias("shared"), F.sum("times").alias("sum"), F.array_sort(F.collect_list(rank)).alias("order"))
    shared = shared.join(sets.select("row", "n"), "row")
    alone = F.col("n") - F.col("shared")
    length = (settings.prefix(F.col("n")) - alone).cast("int")
    shared = shared.where(length > 0)
    placed = shared.select("row", "n", (F.col("sum") / F.col("n")).alias("centre"), alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), length)).alias("at", "token"))
    return placed.select("token", "row", "n", (F.col("alone") + F.col("at")).alias("place"), "centre")


def _parts(token: Column) -> Column:
    """Parts that a shingle's group is dealt over: its number tells how often it occurs."""
    level = F.shiftrightunsigned(token, 48)
    return F.when(level < OFTEN, 1 + F.floor(level / PART)).otherwise(OFTEN // PART * F.pow(F.lit(2.0), level - OFTEN + 1)).cast("bigint")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (token, row, ...) with the part of their shingle's group that they fall in."""
    return rows.withColumn("part", F.pmod(F.xxhash64("row"), _parts(F.col("token"))))


def _everywhere(rows: DataFrame) -> DataFrame:
    """One row for each shingle, repeated for every part of its group."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), _parts(F.col("token")) - 1)))


def _room(settings: Settings, a: str, b: str) -> Column:
    """Whether a shingle's places leave room for the overlap that sets of these sizes need."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return settings.enough(F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place")), n, m)


def _verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) of set rows that link: first by their prefixes under the other orders, then by whole sets."""
    of = lambda side, *columns: sets.select(F.col("row").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
    near = pairs.join(of("b", "low", "high"), "b").join(of("a", "low", "high"), "a")
    near = near.where(F.arrays_overlap("low_a", "low_b") & F.arrays_overlap("high_a", "high_b")).select("a", "b")
    whole = near.join(of("b", "n", "shingles"), "b").join(of("a", "n", "shingles"), "a")
    overlap = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return whole.where(settings.enough(overlap, F.col("n_a"), F.col("n_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node that links reach, of every node on a link (a, b).

    Each turn every node takes the smallest label among its neighbours and itself and then its
    label's label, until nothing changes.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        # cut off, so that Spark may split the nodes of a large component when they meet its label
        taken = checkpoint(labels.join(near, "node").select("node", "comp", F.least("comp", "least").alias("new")))
        jump = taken.select(F.col("node").alias("new"), F.col("new").alias("next"))
        following = checkpoint(taken.join(jump, "new", "left").select("node", "comp", F.least("new", F.coalesce("next", "new")).alias("new")))
        changed = following.where("new <> comp").limit(1).count()
        labels = following.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def _link_components(sets: DataFrame, settings: Settings) -> DataFrame:
    """row and comp of every set (row, n, low, high, shingles) that links with another."""
    placed = checkpoint(_dealt(_prefixes(sets, settings)))
    several = placed.groupBy("token").agg(F.max(F.struct("centre", "row", "n", "place")).alias("pivot"), F.count("*").alias("members")).where("members > 1")
    pivots = _everywhere(several.select("token", "pivot.row", "pivot.n", "pivot.place")).alias("p")
    star = placed.alias("x").join(pivots, (F.col("x.token") == F.col("p.token")) & (F.col("x.part") == F.col("p.part")))
    star = star.where((F.col("x.row") != F.col("p.row")) & _room(settings, "x", "p"))
    first = checkpoint(_verified(star.select(F.col("p.row").alias("a"), F.col("x.row").alias("b")).distinct(), sets, settings))
    labels = components(first)

    known = labels.withColumnRenamed("node", "row")
    members = placed.join(known, "row", "left").select("token", "part", "row", "n", "place", F.coalesce("comp", "row").alias("comp"))
    sizes = members.groupBy("token", "comp").agg(F.count("*").alias("size"))
    several = sizes.groupBy("token").agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    # a grid over each group: members outside the largest component by all members, PART by PART
    blocks = lambda n: 1 + F.floor(n / PART)
    several = several.select("token", F.col("top.comp").alias("top"), blocks(F.col("all") - F.col("top.size")).alias("down"), blocks(F.col("all")).alias("across"))
    members = checkpoint(members.join(_everywhere(several), ["token", "part"]).withColumn("minor", F.col("comp") != F.col("top")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    own = lambda n: F.pmod(F.xxhash64("row"), n)
    x = members.where("minor").withColumn("i", own(F.col("down"))).withColumn("j", every(F.col("across"))).alias("x")
    y = members.withColumn("j", own(F.col("across"))).withColumn("i", every(F.col("down"))).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = ~F.col("y.minor") | (F.col("x.row") < F.col("y.row"))
    across = x.join(y, same & (F.col("x.comp") != F.col("y.comp")) & once & _room(settings, "x", "y")).select(F.col("x.row").alias("a"), F.col("y.row").alias("b")).distinct()
    rest = checkpoint(_verified(across, sets, settings))
    # links across components join those components; a set without a label is its own
    lifted = rest.join(labels.alias("la"), F.col("la.node") == F.col("a"), "left").join(labels.alias("lb"), F.col("lb.node") == F.col("b"), "left")
    merged = components(lifted.select(F.coalesce("la.comp", "a").alias("a"), F.coalesce("lb.comp", "b").alias("b"))).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    found = known.unionByName(merged.select(F.col("comp").alias("row"), "comp")).dropDuplicates(["row"])
    return found.join(merged, "comp", "left").select("row", F.coalesce("top", "comp").alias("comp"))


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """id_col, n_shingles and component_id of every row: the size of its set, and the smallest id that links reach from it."""
    found = _joined(df, id_col, text_col, settings)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _joined(df: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """id, node, n and component_id of every row, and keeper (id, node): the row of its class that stays; null for a class of one row."""
    signatures = _signatures(df, id_col, text_col, settings)
    kept = checkpoint(_survivors(signatures, settings))
    sets = _sets(df, kept, id_col, text_col, settings)
    linked = _link_components(sets, settings)
    nodes = sets.select("row", "node")
    tops = nodes.select(F.col("row").alias("comp"), F.col("node").alias("top"))
    labels = checkpoint(nodes.join(linked, "row").join(tops, "comp").select("node", F.col("top").alias("comp")))
    rows = signatures.select("id", "node", "n")
    smallest = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    # classes of one row need no name
    classes = smallest.join(labels, "node", "left").where("comp IS NOT NULL OR copies > 1").withColumn("comp", F.coalesce("comp", "node"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), F.col("low").alias("id"), "node"))
    # the keepers are cut off, so that Spark may split the rows of a large class when it joins them
    keepers = checkpoint(classes.groupBy("comp").agg(first.alias("keeper")))
    named = checkpoint(classes.select("comp", "node", "copies").join(keepers, "comp").select("node", "keeper", "copies"))
    # sets with many copies meet their rows by broadcast: at most a thousand have a thousandth of all rows
    often = F.col("copies") > max(PART, rows.count() // 1000)
    hot, others = F.broadcast(named.where(often).select("node", "keeper")), named.where(~often).select("node", "keeper")
    found = rows.join(hot, "node").unionByName(rows.join(hot, "node", "left_anti").join(others, "node", "left"), allowMissingColumns=True)
    component = F.when(F.col("n") > 0, F.when(F.col("keeper").isNull(), F.col("id")).otherwise(F.col("keeper.id"))).otherwise(F.col("id"))
    return found.select("id", "node", "n", component.alias("component_id"), F.when(F.col("n") > 0, F.col("keeper")).alias("keeper"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row of each class of linked rows, that with the smallest id, with all columns of ``df``.

    Each row is decided by its own text, whatever other rows its id stands on. Rows without words
    link with nothing and stay. Of rows that repeat id and text one stays, any of them if they
    differ in other columns. Rows with a null id go where their class has an id; of a class
    without one, a row stays.
    """
    other, chosen, gone_id, gone_node = (free_name(c, df.columns) for c in ("_key", "_set", "_gone_id", "_gone_node"))
    found = _joined(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text")), "_id", "_text", settings)
    alone = F.col("keeper").isNull()
    stays = alone | (F.col("id").eqNullSafe(F.col("keeper.id")) & (F.col("node") == F.col("keeper.node")))
    rows = checkpoint(found.groupBy("id", "node").agg(F.bool_or(~stays).alias("extra"), (F.bool_or(~alone) & (F.count("*") > 1)).alias("repeated")))
    # ids all of whose rows go; ids (null among them) whose rows have to be looked at one by one
    by_id = rows.groupBy("id").agg(F.bool_or("extra").alias("some"), F.bool_and("extra").alias("all"), F.bool_or("repeated").alias("repeated"))
    ids = checkpoint(by_id.where("all AND id IS NOT NULL").select(F.col("id").alias(other)))
    mixed = checkpoint(by_id.where("(some OR repeated) AND (NOT all OR id IS NULL)").select(F.col("id").alias(other)))
    # a bounded list of ids spares the shuffle of all texts
    bounded = lambda x: F.broadcast(x) if x.count() <= settings.broadcast_ids else x
    columns = [F.col(f"`{c}`") for c in df.columns]
    key = F.col(f"`{id_col}`")
    kept = df.join(bounded(ids), key == F.col(other), "left_anti").select(*columns)
    if not mixed.limit(1).count():
        return kept
    no_ids = mixed.where(F.col(other).isNull()).limit(1).count() > 0
    known = bounded(mixed.where(F.col(other).isNotNull()))
    whole = kept.join(known, key == F.col(other), "left_anti").select(*columns)
    parts = kept.join(known, key == F.col(other), "left_semi").select(*columns)
    if no_ids:
        whole, parts = whole.where(key.isNotNull()), parts.unionByName(kept.where(key.isNull()))

    @F.arrow_udf("binary")
    def node(texts: pa.Array) -> pa.Array:
        sets = [shingles(t or "", settings.words) for t in texts.to_pylist()]
        return pa.array([_node(s) if len(s) else None for s in sets], pa.binary())

    gone = rows.where("extra").join(mixed, F.col("id").eqNullSafe(F.col(other)), "left_semi").select(F.col("id").alias(gone_id), F.col("node").alias(gone_node))
    marked = parts.withColumn(chosen, node(F.col(f"`{text_col}`")))
    marked = marked.join(gone, (F.col(chosen) == F.col(gone_node)) & key.eqNullSafe(F.col(gone_id)), "left_anti")
    # of repeated rows one stays, but for those without words
    once = marked.where(F.col(chosen).isNotNull()).dropDuplicates([id_col, chosen]).unionByName(marked.where(F.col(chosen).isNull()))
    return whole.unionByName(once.select(*columns))
