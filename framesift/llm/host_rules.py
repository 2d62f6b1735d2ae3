"""Quality rules judged by host: document statistics, host failure rates with a beta prior, verdicts.

Every document gets word, symbol and repetition statistics of its whole text. Base rules reject it
alone. Softer rules count as failures of its host; a host's failure rate is shrunk towards an
empirical beta prior fitted to all hosts, and a document that fails a soft rule stays only if its
host's shrunk rate is low. A document that fails no rule always stays.

Null and empty texts have no words and fail the base rules. Documents without a host share one
nameless host. Rows aren't deduplicated; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.common import ascii_words, checkpoint, measured, stored

_STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Base rules (min_words, max_repeat_pct), soft rules in percent, and the highest host rate that forgives a soft failure."""

    min_words: int = 50
    max_repeat_pct: int = 50
    soft_symbol_pct: int = 10
    soft_dup_line_pct: int = 50
    soft_repeat_pct: int = 40
    max_host_rate: float = 0.1
    broadcast_hosts: int = 10_000


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number)
    # numbers of pairs are made dense again so that a triple's key fits 64 bits
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1] if size > 1 << 20 else ids[:-1] * size + ids[1:]
    _, which, times = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(words), bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def text_statistics(text: str) -> tuple[int, ...]:
    words = ascii_words(text)
    n_symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x and ascii_words(x)] if "\n" in text else [text] if words else []
    return len(words), sum(map(len, words)), n_symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (bigint) of a text column."""
    return measured(text, _STATS, "bigint", text_statistics)


def base_failed(s: Column, limits: Limits) -> Column:
    return (s["n_words"] < limits.min_words) | (100 * s["n_repeat_words"] > limits.max_repeat_pct * s["n_words"])


def soft_failed(s: Column, limits: Limits) -> Column:
    return (
        (100 * s["n_symbols"] > limits.soft_symbol_pct * s["word_chars"])
        | (100 * s["n_dup_lines"] > limits.soft_dup_line_pct * s["n_lines"])
        | (100 * s["n_repeat_words"] > limits.soft_repeat_pct * s["n_words"])
    )


def host_rates(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    """_host, n, f and the shrunk failure rate of each host, null host included.

    Counts are pre-aggregated in the tasks. The beta prior is fitted by moments: with mu the
    overall rate and rho the correlation of failures within hosts beyond what chance gives, its
    parameters are mu (1 - rho) / rho and (1 - mu) (1 - rho) / rho. Five sums over the hosts, one
    row, are all that the driver sees.
    """
    hosts = checkpoint(rows.groupBy(host.alias("_host")).agg(F.count("*").alias("n"), F.sum(failed.cast("bigint")).alias("f")))
    n, f = F.col("n").cast("double"), F.col("f").cast("double")
    sums = hosts.agg(F.sum(n), F.sum(f), F.sum(n * n), F.count("*"), F.sum(f * f / n)).first()
    mu, strength = beta_prior(*(float(x or 0) for x in sums))
    return hosts.select("_host", "n", "f", ((f + mu * strength) / (n + strength)).alias("rate"))


def beta_prior(n: float, f: float, squares: float, hosts: float, q: float) -> tuple[float, float]:
    """Mean and strength (the sum of the parameters) of the beta prior, from the sums of n, f, n^2, 1 and f^2 / n over hosts."""
    mu = f / n if n else 0.0
    if not 0 < mu < 1:
        return mu, 1.0
    room = n - squares / n - (hosts - 1)
    rho = ((q - n * mu * mu) / (mu * (1 - mu)) - (hosts - 1)) / room if room > 0 else 0.0
    rho = min(0.999, max(1e-4, rho))
    return mu, (1 - rho) / rho


def judge(df: DataFrame, text_col: str = "text", host_col: str = "source", limits: Limits = Limits(), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` (None: all) with _stats, _base_failed and _kept added; every row stays.

    Texts are measured once: rows with their statistics are written in the shared folder, and both
    the hosts' rates and the verdicts are read from there. The host table is joined by broadcast
    where it has at most ``broadcast_hosts`` rows, else by shuffle with each host's rows dealt over
    salted parts.
    """
    columns = df.columns if keep is None else keep
    return _judged(df, text_col, host_col, limits, columns).select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("stats").alias("_stats"), F.col("base_failed").alias("_base_failed"), F.col("kept").alias("_kept"))


def _judged(df: DataFrame, text_col: str, host_col: str, limits: Limits, columns: list[str]) -> DataFrame:
    """row (the columns, in a struct, so that no name can clash), stats, base_failed and kept of every row."""
    host = F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")) if host_col in df.columns else F.lit("")
    marked = stored(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), host.alias("host"), statistics(F.col(f"`{text_col}`")).alias("stats")))
    stats = F.col("stats")
    rates = host_rates(marked, F.col("host"), base_failed(stats, limits) | soft_failed(stats, limits))
    hosts = checkpoint(rates.where(F.col("rate") > limits.max_host_rate).select(F.col("_host").alias("host"), F.lit(True).alias("strict")))
    if hosts.count() <= limits.broadcast_hosts:
        joined = marked.join(F.broadcast(hosts), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(31)))
        salt = F.pmod(F.xxhash64("stats", F.monotonically_increasing_id()), F.lit(32)).cast("int")
        joined = marked.withColumn("salt", salt).join(hosts.withColumn("salt", salts), ["host", "salt"], "left")
    base = base_failed(stats, limits)
    kept = ~base & ~(soft_failed(stats, limits) & F.coalesce("strict", F.lit(False)))
    return joined.select("row", "stats", base.alias("base_failed"), kept.alias("kept"))


def filter_documents(df: DataFrame, text_col: str = "text", host_col: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df`` that the rules keep, with its columns, whatever they are called."""
    return _judged(df, text_col, host_col, limits, df.columns).where("kept").select(*[F.col("row").getField(c).alias(c) for c in df.columns])
