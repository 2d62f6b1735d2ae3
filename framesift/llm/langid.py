"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the character n-grams (one to four
letters or word breaks) that occur in both, over the square root of the product of their numbers
of n-grams. Landmark texts of each language give a Nyström approximation of it, on which
one-versus-rest kernel ridge regression is fitted. The fitted weights fold into one matrix from
n-grams to languages, so a batch is scored by one product of its presence rows with that matrix.

Learning uses a bounded sample: ``sample`` ids of each language (all, where it has fewer), in the
order of a hash of the id, whole texts; of an id with several texts of a language the one that sorts
first. So no language that the learning rows hold with a letter is lost, however often ids repeat. Null texts and texts without a letter get ``und`` and score 0. Repeated
rows get equal results, an empty table an empty one; with nothing to learn from all is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framesift.llm.common import arrow_map, checkpoint, text_groups
from framesift.llm.toxicity import hash_share

UNKNOWN = "und"
#: n-gram lengths, and bits of an n-gram's number: n-grams are hashed to this many bits.
LENGTHS, BITS = (1, 2, 3, 4), 18


@dataclass(frozen=True)
class Settings:
    """Sample rows and landmarks of each language (``landmarks`` in all, at least 4 each), ridge penalty and score sharpness."""

    sample: int = 1000
    landmarks: int = 128
    ridge: float = 1e-3
    sharpness: float = 6.0


class Grams:
    """Numbers of the n-grams that are present in a text."""

    def __init__(self):
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.code = np.where(letters, np.arange(0x110000, dtype=np.uint32), np.uint32(0))
        self.mark = np.zeros(1 << BITS, bool)

    def present(self, text: str) -> np.ndarray:
        """Sorted distinct numbers; empty if the text has no letter."""
        code = self.code[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        code = np.concatenate(([0], code, [0])).astype(np.uint32)
        code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]  # one break between words
        if len(code) < 2:
            return np.empty(0, np.int64)
        mixed = np.zeros(len(code), np.uint32)
        for n in LENGTHS:
            if n > len(code):
                break
            # a running hash of n codes, then a multiplicative hash down to BITS bits
            mixed = (mixed[: len(code) - n + 1] + code[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
            self.mark[(mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)] = True
        found = self.mark.nonzero()[0]
        self.mark[found] = False
        return found


@dataclass(frozen=True)
class Model:
    """Languages, each n-gram's row of the folded matrix (-1: none), that matrix, and the constant of each language."""

    languages: list[str]
    row: np.ndarray
    folded: np.ndarray
    constant: np.ndarray
    sharpness: float


def fit(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Learn from the rows where ``learn`` holds and the language isn't null."""
    rows = df.where(learn & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    rows = rows.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    # each language's share of hashes that holds half as many ids again as the sample, so that no language's rows meet in one task;
    # ids are counted, not rows (an id may stand on many), to within a few percent
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key", 0.02).alias("ids"))
    cut = sizes.select("lang", hash_share(F.lit(settings.sample), F.col("ids")).alias("cut"))
    few = rows.select("key", "lang", F.xxhash64("key").alias("hash")).join(F.broadcast(cut), "lang").where("hash <= cut").select("key", "lang", "hash").distinct()
    order = Window.partitionBy("lang").orderBy("hash", "key")
    picked = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= settings.sample).select("key", "lang", "n")
    # at most ``sample`` ids of each language, so their broadcast is bounded
    chosen = rows.join(F.broadcast(picked), ["key", "lang"]).groupBy("key", "lang", "n").agg(F.min("text").alias("text"))

    def make():
        grams = Grams()

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                found = [grams.present(t).astype(np.int32) for t in texts]
                yield {"lang": batch.column("lang").slice(start, len(texts)), "n": batch.column("n").slice(start, len(texts)), "grams": found}

        return work

    sample = checkpoint(arrow_map(chosen, {"lang": "lang", "n": "n", "text": "text"}, "lang string, n int, grams array<int>", make).where(F.size("grams") > 0))
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return Model([], np.full(1 << BITS, -1, np.int32), np.zeros((0, 0)), np.zeros(0), settings.sharpness)
    each = max(4, settings.landmarks // len(languages))
    first = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("n"))).where(F.col("place") <= each)
    marks = [np.array(r.grams, np.int32) for r in first.select("grams").toLocalIterator()]
    known = np.unique(np.concatenate(marks))
    row = np.full(1 << BITS, -1, np.int32)
    row[known] = np.arange(len(known))
    presence = np.zeros((len(known), len(marks)), np.float32)
    for j, g in enumerate(marks):
        presence[row[g], j] = len(g) ** -0.5
    kernel = np.stack([presence[row[g]].sum(axis=0, dtype=np.float64) * len(g) ** -0.5 for g in marks])
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > 1e-8 * values.max()
    half = vectors[:, good] * values[good] ** -0.5  # landmark similarities -> Nyström features
    shared = df.sparkSession.sparkContext.broadcast((row, presence, half, {x: i for i, x in enumerate(languages)}))
    width = half.shape[1] + 1

    def moments():
        row, presence, half, number = shared.value

        def work(batch: pa.RecordBatch):
            lists = batch.column("grams")
            values, cuts = np.asarray(lists.values), lists.offsets.to_pylist()
            # sums over the batch of the outer products of features, and of features and +-1 targets, by language
            for name in set(langs := batch.column("lang").to_pylist()):
                own = [values[a:b] for a, b, x in zip(cuts, cuts[1:], langs) if x == name]
                near = np.stack([presence[r[r >= 0]].sum(axis=0, dtype=np.float64) * len(g) ** -0.5 for g in own for r in (row[g],)])
                features = np.hstack([near @ half, np.ones((len(own), 1))])
                yield {"lang": [name], "n": [len(own)], "outer": [(features.T @ features).ravel()], "total": [features.sum(axis=0)]}

        return work

    sums = arrow_map(sample.repartition(8), {"lang": "lang", "grams": "grams"}, "lang string, n bigint, outer array<double>, total array<double>", moments).collect()
    count, outer, total = {}, {}, {}
    for r in sums:
        count[r.lang] = count.get(r.lang, 0) + r.n
        outer[r.lang] = outer.get(r.lang, 0) + np.array(r.outer).reshape(width, width)
        total[r.lang] = total.get(r.lang, 0) + np.array(r.total)
    # languages weigh alike, however many rows each has
    gram = sum(outer[x] / count[x] for x in languages) / len(languages)
    means = np.stack([total[x] / count[x] for x in languages], axis=1) / len(languages)
    target = 2 * means - means.sum(axis=1, keepdims=True)
    weights = np.linalg.solve(gram + settings.ridge * np.eye(width), target)
    return Model(languages, row, presence.astype(np.float64) @ (half @ weights[:-1]), weights[-1], settings.sharpness)


def predict(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score (softmax of the sharpened ridge outputs) of each row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        grams, model = Grams(), shared.value

        def guess(texts: list[str]) -> tuple[list[str], np.ndarray]:
            sizes, rows = [], []
            for text in texts:
                found = grams.present(text)
                sizes.append(len(found))
                r = model.row[found]
                rows.append(r[r >= 0])
            names, scores = [UNKNOWN] * len(sizes), np.zeros(len(sizes))
            if model.languages and any(sizes):
                starts = np.cumsum([0, *map(len, rows)])[:-1]
                # presence rows times the folded matrix; a zero row at the end keeps empty rows apart
                flat = np.vstack([model.folded[np.concatenate(rows)], np.zeros((1, len(model.languages)))])
                sums = np.add.reduceat(flat, starts, axis=0) * (np.array([len(r) for r in rows]) > 0)[:, None]
                outputs = sums / np.sqrt(np.maximum(sizes, 1))[:, None] + model.constant
                odds = np.exp(model.sharpness * (outputs - outputs.max(axis=1, keepdims=True)))
                best = outputs.argmax(axis=1)
                share = odds[np.arange(len(best)), best] / odds.sum(axis=1)
                names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, sizes)]
                scores = np.where(np.array(sizes) > 0, share, 0.0)
            return names, scores

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch, "_text"):
                names, scores = guess(texts)
                yield {c: batch.column(f"_keep{i}").slice(start, len(texts)) for i, c in enumerate(keep)} | {"lang_pred": names, "score": scores}

        return work

    return arrow_map(df, {f"_keep{i}": c for i, c in enumerate(keep)} | {"_text": text_col}, f"{kinds}, lang_pred string, score double", make)
