"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

A random forest is grown over the statistics of labelled documents; every path from a root to a
node becomes a conjunctive rule; a lasso-penalised logistic regression weighs the rules and drops
most; the rest compile into one Spark column expression over the statistics.

Learning uses a bounded sample: at most ``sample`` labelled rows of each class, in the order of a
hash of the id, whole texts. Null and empty texts have zero statistics and are scored like any
other. Equal tables give equal models and scores, however their rows are ordered and dealt over
tasks. Repeated rows score equally; an empty table gives an empty result; without labelled rows of
both classes every score is the share of label 1, or 0.5 with none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ascii_words, checkpoint, free_name, measured
from framesift.llm.host_rules import repeated_words
from framesift.llm.toxicity import sample_rows

STATISTICS = [
    "n_words", "mean_word", "distinct_words", "repeat_words", "upper", "digits", "symbols", "stops",
    "exclaims", "pipes", "sentence_words", "duplicate_lines", "line_words", "longest_word", "top_word",
]

_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _STOPS = b"#*$%&|<>{}[]\\^~=_+@/", b".,;:?"


@dataclass(frozen=True)
class Settings:
    """Sample rows of each class, trees and their depth, lasso penalty and its iterations."""

    sample: int = 8000
    trees: int = 24
    depth: int = 3
    penalty: float = 1e-3
    iterations: int = 60


@dataclass(frozen=True)
class Model:
    """Weighted rules; a rule's conditions are (statistic, is above, threshold)."""

    rules: list[tuple[tuple[tuple[str, bool, float], ...], float]]
    constant: float


def text_statistics(text: str) -> tuple[float, ...]:
    words = ascii_words(text)
    n = len(words)
    if not n:
        return (0.0,) * len(STATISTICS)
    raw = text.encode()
    size = len(raw)
    share = lambda kinds: (size - len(raw.translate(None, kinds))) / size
    lines = [x for x in text.split("\n") if x.strip()]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    stops = text.count(".") + text.count("?") + text.count("!")
    return (
        float(n), sum(map(len, words)) / n, len(counts) / n, repeated_words(words) / n, share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_STOPS),
        share(b"!"), share(b"|"), n / (stops + 1), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), float(max(map(len, words))), max(counts.values()) / n,
    )


def statistics(text: Column) -> Column:
    """Struct of the statistics (double) of a text column, in one Arrow pass; null counts as empty."""
    return measured(text, STATISTICS, "double", text_statistics)


def paths(description: str) -> set[tuple[tuple[int, bool, float], ...]]:
    """Conditions from the root to every node of a tree, from its printed form; bounds of one statistic are merged."""
    found, trail = set(), []
    for line in description.split("\n"):
        if m := re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            del trail[len(m[1]) - 2 :]
            trail.append((int(m[2]), m[3] == ">", float(m[4])))
            tight: dict[tuple[int, bool], float] = {}
            for feature, above, threshold in trail:
                old = tight.get((feature, above), threshold)
                tight[feature, above] = max(old, threshold) if above else min(old, threshold)
            found.add(tuple(sorted((f, a, t) for (f, a), t in tight.items())))
    return found


def holds(rule: tuple[tuple[str, bool, float], ...], s: Column) -> Column:
    """The rule as a column expression over a struct of statistics."""
    out = F.lit(True)
    for name, above, threshold in rule:
        out = out & (s[name] > threshold if above else s[name] <= threshold)
    return out


def fit(df: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows for which ``learn``, a condition on the id column, holds."""
    # imported here, as workers that only measure texts do without
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sample = sample_rows(df, labels, learn, settings.sample, id_col, text_col, label_col)
    # the bounded sample dealt and sorted by its values: the forest draws by place, and sums of two parts
    # don't depend on which ends first, so equal tables give equal models whatever their files and tasks
    measures = sample.select("label", statistics(F.col("text")).alias("s"))
    rows = checkpoint(measures.repartition(2, "s").coalesce(2).sortWithinPartitions("s", "label"))
    classes = dict(rows.groupBy("label").count().collect())
    good, bad = classes.get(1, 0), classes.get(0, 0)
    if not good or not bad:
        from math import log

        return Model([], log((good + 1e-9) / (bad + 1e-9)) if good or bad else 0.0)
    label = F.col("label").cast("double").alias("label")
    vectors = rows.select(label, array_to_vector(F.array(*[F.col(f"s.{c}") for c in STATISTICS])).alias("features"))
    forest = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, subsamplingRate=0.5, seed=11, minInstancesPerNode=5).fit(vectors)
    named = sorted({tuple((STATISTICS[f], a, t) for f, a, t in p) for tree in forest.trees for p in paths(tree.toDebugString)})
    if not named:
        return Model([], 0.0)
    indicators = F.array(*[holds(r, F.col("s")).cast("double") for r in named])
    lasso = LogisticRegression(regParam=settings.penalty, elasticNetParam=1.0, maxIter=settings.iterations, standardization=False)
    fitted = lasso.fit(checkpoint(rows.select(label, array_to_vector(indicators).alias("features"))))
    weights = fitted.coefficients.toArray().tolist()
    return Model([(r, w) for r, w in zip(named, weights) if w], float(fitted.intercept))


def score(model: Model, s: Column) -> Column:
    """Probability of label 1 as an expression over a struct of statistics."""
    total = F.lit(model.constant)
    for rule, weight in model.rules:
        total = total + F.when(holds(rule, s), weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def with_score(df: DataFrame, model: Model, text_col: str = "text", name: str = "_score") -> DataFrame:
    """``df`` with the score in a column ``name``, which takes the place of one of that name; all its rows and other columns stay."""
    marks = free_name("_statistics", [*df.columns, name])
    marked = df.withColumn(marks, statistics(F.col(f"`{text_col}`")))
    return marked.withColumn(name, score(model, F.col(marks))).drop(marks)


def filter_documents(df: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score of at least ``threshold``, with its columns, whatever they are called. Null texts count as empty ones."""
    name = free_name("_score", df.columns)
    return with_score(df, model, text_col, name).where(F.col(name) >= threshold).drop(name)
