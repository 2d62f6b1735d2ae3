"""Toxicity by a subsequence string-kernel support vector machine.

A text is read as sentences of units: words in lower case without marks at their ends, and runs of
single characters ("i d i o t") as one unit. The kernel of two units is the normalised product of
their weighted counts of three-character subsequences, gaps included and damped, so insults with
inserted characters stay close to the plain word. A sentence compares to a landmark unit as its
closest unit does. Landmarks are units that mark toxic training documents and the clean units most
like those; over their Nyström features a linear support vector machine is trained on sentences
labelled by their documents: of a toxic document the sentence closest to the landmarks, of a clean
one its two closest. A document's score is that of its worst sentence, calibrated to 0 to 1.

Learning uses a bounded sample of labelled rows (``sample`` of each class, in the order of a hash
of the id); of an id that stands on several rows the text that sorts first. Landmarks are chosen
from all units of the sample with ``shortest`` to ``longest`` characters; shorter units are no
evidence (a word of one or two letters is close to many harmless ones), longer ones are read in
windows. Scoring reads whole texts of all rows. A score depends on the text and the model alone:
distinct units are told apart by their characters, whatever a worker read before. Null and empty
texts score as a text without any suspect unit. Repeated rows score equally; an empty table gives
an empty result; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import arrow_map, ascii_words, checkpoint, text_groups

#: Characters of a unit; longer ones are read in windows of this length, half overlapping.
LONGEST = 24
#: Bits of a subsequence's number, damping of each skipped character, and the offsets of the second and third character.
BITS, DAMPING = 16, 0.6
STEPS = [(a, b) for a in range(1, 4) for b in range(1, 4) if a + b <= 5]
#: Weights by the number of skipped characters, as whole numbers: their sums are exact in any order.
WEIGHTS = np.array([round(1000 * DAMPING**k) for k in range(4)], float)
#: Kernel values below this count as 0 unless the settings say otherwise: low enough for words with two inserted characters or one replaced (test_disguised_insults).
FLOOR = 0.35
#: Words that a worker process remembers.
CACHE = 400_000

_MARKS = re.compile(r"[\W_]+")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Settings:
    """Sample rows of each class, landmarks of each kind, characters of a landmark, different sample texts that it must occur in, its least log-odds and log-likelihood ratio if toxic (the latter keeps out words that a few documents of one topic share), its highest log-odds if clean, the SVM's penalty and passes, and the kernel value below which a value counts as 0 (0: the exact kernel)."""

    sample: int = 6000
    landmarks: int = 96
    shortest: int = 3
    longest: int = LONGEST
    least_documents: int = 3
    least_evidence: float = 30.0
    clean_odds: float = 1.0
    least_odds: float = 2.5
    penalty: float = 1.0
    epochs: int = 20
    floor: float = FLOOR


def normal(word: str) -> str:
    low = word.lower()
    return low if low.isalnum() else _ENDS.sub("", low)


def windows(unit: str) -> list[str]:
    """The unit with marks of its start and end, in windows of bounded length; with inner marks, also without them."""
    found = []
    for u in (unit,) if unit.isalnum() else {unit: 0, _MARKS.sub("", unit): 0}:
        if len(u) <= LONGEST:
            found.append(f"\x02{u}\x03")
        else:
            step = LONGEST // 2
            found += [f"\x02{u[i : i + LONGEST]}\x03" for i in range(0, len(u) - step, step)]
    return found


def subsequences(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit, number and weight of every three-character subsequence of bounded span, one entry for each unit and number."""
    if not units:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    code = np.frombuffer("".join(units).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(units)) << (BITS + 2), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(code))  # characters from here to the unit's end
    packed = []
    for a, b in STEPS:
        at = (left > a + b).nonzero()[0]
        mixed = code[at]
        for step in (a, a + b):
            mixed = (mixed * np.uint32(0x9E3779B1)) ^ code[at + step]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        packed.append(owner[at] | (mixed.astype(np.int64) << 2) | (a + b - 2))
    # unit, number and skipped characters in one number each, so that plain sorting brings equal ones together
    entries = np.concatenate(packed)
    entries.sort()
    key = entries >> 2
    first = np.concatenate(([True], key[1:] != key[:-1])).nonzero()[0] if len(key) else np.empty(0, np.int64)
    weight = np.add.reduceat(WEIGHTS[entries & 3], first) if len(key) else np.empty(0)
    key = key[first]
    return key >> BITS, key & ((1 << BITS) - 1), weight


@dataclass
class Landmarks:
    """Landmark units and the kernel of other units with them; values below the floor count as 0."""

    units: list[str]
    floor: float = FLOOR
    row: np.ndarray = field(init=False)
    cuts: np.ndarray = field(init=False)
    marks: np.ndarray = field(init=False)
    weights: np.ndarray = field(init=False)
    highest: np.ndarray = field(init=False)

    def __post_init__(self):
        # for each subsequence of a landmark (row) the landmarks that have it and their normalised weights
        parts = [windows(u)[0] for u in self.units]
        who, which, weight = subsequences(parts)
        seen = np.unique(which)
        self.row = np.full(1 << BITS, -1, np.int32)
        self.row[seen] = np.arange(len(seen))
        dense = np.zeros((len(seen), len(parts)))
        np.add.at(dense, (self.row[which], who), weight)
        dense /= np.maximum(np.sqrt((dense**2).sum(axis=0)), 1e-12)
        row, self.marks = dense.nonzero()
        self.weights = dense[row, self.marks]
        self.cuts = np.searchsorted(row, np.arange(len(seen) + 1))
        self.highest = np.append(dense.max(axis=1) if self.units else np.empty(0), 0.0)  # the last one for row -1

    def kernel(self, units: list[str]) -> dict[int, np.ndarray]:
        """For the units (by place) with any kernel value above 0 that isn't below the floor: their values, smaller ones as 0."""
        parts, owner = [], []
        for k, u in enumerate(units):
            w = windows(u)
            parts += w
            owner += [k] * len(w)
        if not parts or not self.units:
            return {}
        who, which, weight = subsequences(parts)
        row = self.row[which]
        norms = np.maximum(np.bincount(who, weight**2, len(parts)), 1e-12)
        # each subsequence at its highest landmark weight: no kernel value of a part is above that sum
        bound = np.bincount(who, weight * self.highest[row], len(parts)) / np.sqrt(norms)
        near = (bound >= self.floor - 1e-9)[who] & (row >= 0)
        who, row, weight = who[near], row[near], weight[near]
        # a product of the parts' and the landmarks' sparse rows
        n = self.cuts[row + 1] - self.cuts[row]
        entry = np.repeat(np.arange(len(row)), n)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.cuts[row], n)
        wide = len(self.units)
        values = np.bincount(who[entry] * wide + self.marks[place], weight[entry] * self.weights[place], len(parts) * wide).reshape(-1, wide) / np.sqrt(norms)[:, None]
        values[values < self.floor] = 0
        found: dict[int, np.ndarray] = {}
        for p in values.any(axis=1).nonzero()[0].tolist():
            k, v = owner[p], values[p].astype(np.float32)
            found[k] = np.maximum(found[k], v) if k in found else v
        return found


#: A unit and its kernel with the landmarks.
Found = tuple[str, np.ndarray]


class Reader:
    """Finds, in a text's sentences, the units that come near a landmark; remembers words it has met."""

    def __init__(self, landmarks: Landmarks):
        self.landmarks = landmarks
        self.known: dict[str, Found | int | None] = {}
        self.old: dict[str, Found | int | None] = {}

    def learn(self, words: set[str]) -> None:
        # when half of the memory is new, what hasn't been met since the last time goes
        if len(self.known) > CACHE // 2:
            self.old, self.known = self.known, {}
        self.known.update((w, self.old[w]) for w in words if w in self.old and w not in self.known)
        new = [w for w in words if w not in self.known]
        for k in range(0, len(new), 10_000):
            part = new[k : k + 10_000]
            units: dict[str, int] = {}
            at = [units.setdefault(u, len(units)) if len(u := normal(w)) > 2 else -1 for w in part]
            near = self.landmarks.kernel(list(units))
            for w, i in zip(part, at):
                # 1: a single character, which may be part of a spelled-out unit
                self.known[w] = ((normal(w), near[i]) if i in near else None) if i >= 0 else 1 if len(w) == 1 and w.isalnum() else None

    def sentences(self, texts: list[str]) -> list[tuple[int, list[list[Found]]]]:
        """For each text its number of words, and the units with kernels of those of its sentences that have any."""
        lines = [[ascii_words(x) for x in t.split("\n")] for t in texts]
        self.learn(set().union(*(words for text in lines for words in text)))
        get = self.known.get
        out = []
        for text in lines:
            found: list[list[Found]] = []
            for words in text:
                hits = [(i, v) for i, v in enumerate(map(get, words)) if v is not None]
                if hits:
                    found += self._sentences(words, hits)
            out.append((sum(map(len, text)), found))
        return out

    def _sentences(self, words: list[str], hits: list[tuple[int, Found | int]]) -> list[list[Found]]:
        vectors = [(i, v) for i, v in hits if not isinstance(v, int)]
        singles = [i for i, v in hits if isinstance(v, int)]
        start = 0
        while start < len(singles):
            stop = start + 1
            while stop < len(singles) and singles[stop] == singles[stop - 1] + 1:
                stop += 1
            if stop - start > 2:
                spelled = "".join(words[i] for i in singles[start:stop]).lower()
                vectors += [(singles[start], (spelled, v)) for v in self.landmarks.kernel([spelled]).values()]
            start = stop
        if not vectors:
            return []
        vectors.sort(key=lambda x: x[0])
        # a sentence ends after a word with a full stop, question or exclamation mark
        found, last = [], None
        for i, v in vectors:
            if last is not None and not any(w[-1] in ".!?" for w in words[last:i]):
                found[-1].append(v)
            else:
                found.append([v])
            last = i
        return found


def pooled(sentence: list[Found]) -> np.ndarray:
    """A sentence's kernel: each landmark's closest unit."""
    return np.maximum.reduce([v for _, v in sentence])


@dataclass(frozen=True)
class Model:
    """Landmark units, the SVM's weight on each landmark kernel, its constant, the calibration's weights, and the kernel's floor."""

    units: list[str]
    weights: np.ndarray
    constant: float
    calibration: np.ndarray
    floor: float = FLOOR

    def evidence(self, n_words: int, sentences: list[list[Found]]) -> list[float]:
        """Worst sentence's decision; log of one more than the distinct units decided against; log of their share of the words; 1."""
        decide = lambda v: float(v @ self.weights) + self.constant
        units = {unit: decide(v) for unit, v in {unit: v for s in sentences for unit, v in s}.items()}
        worst = max([self.constant, *(decide(pooled(s)) if len(s) > 1 else units[s[0][0]] for s in sentences)])
        against = sum(d > 0 for d in units.values())
        return [worst, float(np.log1p(against)), float(np.log((against + 0.5) / (n_words + 50))), 1.0]

    def score(self, n_words: int, sentences: list[list[Found]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.evidence(n_words, sentences) @ self.calibration, -500, 500))))


#: The model where there is nothing to learn from: every score is 0.
NOTHING = Model([], np.zeros(0), 0.0, np.array([0.0, 0.0, 0.0, -500.0]))


@functools.lru_cache(maxsize=2)
def _reader(units: tuple[str, ...], floor: float) -> Reader:
    return Reader(Landmarks(list(units), floor))


def hash_share(n: Column, rows: Column) -> Column:
    """Upper bound of ``xxhash64`` under which about half as many again as n of so many hashes lie: a cut before the n lowest are taken."""
    share = F.least(F.lit(1.0), (1.5 * n + 100) / rows)
    return F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * float(1 << 64) - float(1 << 63)).cast("bigint"))


def sample_rows(df: DataFrame, labels: DataFrame, learn: Column, n: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text and label of at most n labelled rows of each class for which ``learn`` holds, in the order of a hash of the id.

    Labels other than 0 and 1 and null ids don't count; of an id with both labels 1 counts, of an
    id with several texts the one that sorts first.
    """
    marked = labels.where(F.col(f"`{label_col}`").isin(0, 1) & F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(f"`{label_col}`").alias("_label"))
    marked = marked.withColumnRenamed("_id", id_col).where(learn).withColumnRenamed(id_col, "_id").withColumn("_hash", F.xxhash64("_id"))
    sizes = {r._label: r.n for r in marked.groupBy("_label").agg(F.count("*").alias("n")).collect()}  # two rows
    # little more than n ids of each class are sorted, whatever the number of tasks; at most 2 n are broadcast
    picked = [
        marked.where((F.col("_label") == k) & (F.col("_hash") <= hash_share(F.lit(n), F.lit(sizes.get(k, 1))))).orderBy("_hash", "_id").limit(n)
        for k in (0, 1)
    ]
    texts = df.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    return found.select("text", F.col("_label").cast("int").alias("label"))


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows for which ``learn``, a condition on the id column, holds."""
    sample = checkpoint(sample_rows(df, labels, learn, settings.sample, id_col, text_col, label_col))
    classes = dict(sample.groupBy("label").count().collect())
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not clean:
        return NOTHING
    units = _unit_counts(sample, settings)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    # the log-likelihood ratio of the unit's counts against those that chance would give
    term = lambda n, rows: F.when(n > 0, n * F.log(n * (toxic + clean) / ((F.col("t") + F.col("c")) * rows))).otherwise(0.0)
    evidence = 2 * (term(F.col("t"), toxic) + term(F.col("c"), clean))
    bad = units.withColumns({"odds": odds, "evidence": evidence}).where(F.col("t") >= settings.least_documents)
    bad = bad.where((F.col("odds") >= settings.least_odds) & (F.col("evidence") >= settings.least_evidence))
    bad_units = [r.unit for r in bad.orderBy(F.desc("evidence"), "unit").limit(settings.landmarks).collect()]
    if not bad_units:
        return NOTHING
    # clean units that look most like those, among all of the sample
    fine = units.where(F.col("c") >= settings.least_documents).withColumn("odds", odds).where(F.col("odds") < settings.clean_odds)
    fine_units = [r.unit for r in _closeness(fine, bad_units, settings.floor).orderBy(F.desc("near"), "unit").limit(settings.landmarks).collect()]
    names = bad_units + fine_units
    marks = Landmarks(names, settings.floor)
    base = np.zeros((len(names), len(names)))
    for k, v in marks.kernel(names).items():
        base[k] = v
    values, vectors = np.linalg.eigh((base + base.T) / 2)
    good = values > 1e-3 * values.max()
    half = vectors[:, good] * values[good] ** -0.5  # kernels with the landmarks -> Nyström features

    rows = _training_rows(sample, names, len(bad_units), settings.floor)
    kernels, label = np.array([r.kernel for r in rows]).reshape(-1, len(names)), np.array([r.label for r in rows])
    weights, constant = support_vectors(kernels @ half, 2.0 * label - 1, settings.penalty, settings.epochs)
    weights = half @ weights
    model = Model(names, weights, constant, NOTHING.calibration, settings.floor)
    evidence = _evidence(sample, model)
    return replace(model, calibration=calibrate(np.array([r.evidence for r in evidence]), np.array([r.label for r in evidence])))


def _unit_counts(sample: DataFrame, settings: Settings) -> DataFrame:
    """unit, and the different toxic (t) and clean (c) sample texts that it occurs in: copies of a text count once."""

    def make():
        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                for k, text in enumerate(texts, start):
                    units = sorted({u for w in set(ascii_words(text)) if settings.shortest <= len(u := normal(w)) <= settings.longest})
                    yield {"unit": units, "label": [batch.column("label")[k].as_py()] * len(units)}

        return work

    rows = arrow_map(sample.dropDuplicates(["text", "label"]), {"text": "text", "label": "label"}, "unit string, label int", make)
    counts = rows.groupBy("unit").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    return checkpoint(counts.where(F.col("t") + F.col("c") >= settings.least_documents))


def _closeness(units: DataFrame, bad_units: list[str], floor: float) -> DataFrame:
    """unit and near, its highest kernel value with any of ``bad_units``, of the units that have one that counts."""

    def make():
        marks = Landmarks(bad_units, floor)

        def work(batch: pa.RecordBatch):
            names = batch.column("unit").to_pylist()
            near = marks.kernel(names)
            yield {"unit": [names[k] for k in near], "near": [float(v.max()) for v in near.values()]}

        return work

    return arrow_map(units, {"unit": "unit"}, "unit string, near double", make)


def _training_rows(sample: DataFrame, names: list[str], n_bad: int, floor: float) -> list:
    """label and kernel of the training sentences of each sample document: bounded by the sample."""

    def make():
        reader = Reader(Landmarks(names, floor))

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                out: list[tuple[int, np.ndarray]] = []
                for k, (_, found) in enumerate(reader.sentences(texts), start):
                    label = batch.column("label")[k].as_py()
                    closest = sorted(map(pooled, found), key=lambda v: -v[:n_bad].max())[: 1 if label else 2]
                    out += [(label, v) for v in closest or [np.zeros(len(names))]]
                yield dict(zip(("label", "kernel"), zip(*out)))

        return work

    return arrow_map(sample, {"text": "text", "label": "label"}, "label int, kernel array<double>", make).collect()


def _evidence(sample: DataFrame, model: Model) -> list:
    """label and evidence of each sample document."""

    def make():
        reader = Reader(Landmarks(model.units, model.floor))

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch):
                yield {"label": batch.column("label").slice(start, len(texts)), "evidence": [model.evidence(*s) for s in reader.sentences(texts)]}

        return work

    return arrow_map(sample, {"text": "text", "label": "label"}, "label int, evidence array<double>", make).collect()


def support_vectors(x: np.ndarray, y: np.ndarray, penalty: float, epochs: int) -> tuple[np.ndarray, float]:
    """Weights and constant of a linear SVM with hinge loss, by dual coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = {c: len(y) / 2 / max(1, (y == c).sum()) for c in (-1.0, 1.0)}
    top = np.array([penalty * share[c] for c in y])
    square = (x * x).sum(axis=1)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            slack = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def calibrate(x: np.ndarray, truth: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve from evidence to labels, with a small ridge, by damped Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = 1e-3 * np.eye(len(w))
    loss = lambda w: np.logaddexp(0, -(2 * truth - 1) * (x @ w)).sum() + 0.5 * w @ ridge @ w
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, x.T @ (p - truth) + ridge @ w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and score of each row, over its whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        model = shared.value
        reader = _reader(tuple(model.units), model.floor)

        def work(batch: pa.RecordBatch):
            for start, texts in text_groups(batch, "_text"):
                found = [model.score(*s) for s in reader.sentences(texts)]
                yield {c: batch.column(f"_keep{i}").slice(start, len(texts)) for i, c in enumerate(keep)} | {"score": found}

        return work

    return arrow_map(df, {f"_keep{i}": c for i, c in enumerate(keep)} | {"_text": text_col}, f"{kinds}, score double", make)
