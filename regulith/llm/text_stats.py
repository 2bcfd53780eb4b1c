"""Statistics of whole texts, from Arrow batches, and the ratios that learners use.

Words are runs of bytes other than space and 0x09 to 0x0D. A null text counts as
empty, and every statistic of an empty text is 0. Ratios with nothing below are 0.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, share

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_digits", "n_same_next")
SPACES, SYMBOLS, MARKS, LATER = b" \t\n\v\f\r", b"#*$%&|<>", b"!?", bytes(range(0x80, 0xC0))
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words that occurs twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    again = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + len(again)] |= again
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The statistics in NAMES."""
    words, size = text.split(), len(text)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    without = lambda gone: size - len(text.translate(None, gone))
    return (
        len(words), len(text.translate(None, SPACES + LATER)), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), len(set(words)), without(UPPER), without(MARKS), without(DIGITS), sum(map(eq, words, words[1:])),
    )


def _measure_batch(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(x) for x in as_bytes(texts)], np.int64).reshape(-1, len(NAMES))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(NAMES))


def measured(text: Column) -> Column:
    """struct of NAMES"""
    return F.arrow_udf(_measure_batch, "struct<" + ", ".join(f"{n}: long" for n in NAMES) + ">")(text)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


#: Ratio → the two statistics.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_rate": ("n_symbols", "n_words"),
    "dup_line_rate": ("n_dup_lines", "n_lines"),
    "repeat_rate": ("n_repeat_words", "n_words"),
    "distinct_rate": ("n_distinct", "n_words"),
    "upper_rate": ("n_upper", "word_chars"),
    "mark_rate": ("n_marks", "n_words"),
    "digit_rate": ("n_digits", "word_chars"),
    "same_next_rate": ("n_same_next", "n_words"),
}
FEATURES = (*RATIOS, "log_words")


def with_stats(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the statistics, and the ratios of each row."""
    return with_ratios(df.select(*keep, measured(F.col(text_col)).alias("s")).select(*keep, "s.*"))


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: _ratio(*v) for k, v in RATIOS.items()} | {"log_words": F.log10(F.col("n_words") + 1.0)})


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", bound: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (0 or 1) of about ``bound`` labelled rows, chosen by a hash of their ids; fewer if there are fewer.

    ``may_learn`` is a condition on the labels' id. Null ids and labels teach nothing; an id labelled
    twice alike counts once, with both labels twice, and so do copies of a text under one id. The bound is what
    makes it safe to send the chosen ids to all tasks; twice the bound, by a hash, is the most that comes back.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    known = known.where(may_learn) if may_learn is not None else known
    known = known.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).distinct()
    total = known.count()
    some = known.where(share(F.col("__id"), "label") < min(1.0, bound / max(total, 1)))
    rows = docs.select(F.col(id_col), F.col(text_col)).join(F.broadcast(some), F.col(id_col) == F.col("__id"))
    found = with_stats(rows, text_col, ("__id", "__label")).select("__id", "__label", *FEATURES).distinct()
    found = found.orderBy(F.xxhash64("__id", "__label", *FEATURES)).limit(2 * bound).toPandas().sort_values(["__id", "__label", *FEATURES])
    return found[list(FEATURES)].to_numpy(float), found["__label"].to_numpy(int)
