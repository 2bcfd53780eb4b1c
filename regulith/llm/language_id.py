"""Language identification with rank-order profiles of character n-grams.

A language's profile is its ``size`` most frequent n-grams (1 to 3 letters of
lower-cased words, word ends included as a mark), most frequent first. A text is
profiled the same way, over its whole length, and compared by out-of-place
distance: for each of its n-grams the difference between the two ranks, or
``size`` where the language lacks it.

Learning is bounded: about ``per_language`` documents of each language, chosen
by a hash of their ids and texts. Everything else covers all rows and whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0;
equal distances go to the language that comes first by code point; equal counts
of n-grams go by code point; with nothing to learn from, every text is ``und``.
Repeated rows give repeated results and other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_strings, fold, share

UND = "und"
END, BITS = 1, 21
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point → its lower-case letter or mark, 0 for everything else."""
    table = np.zeros(0x110000, np.int64)
    for point in range(len(table)):
        char = chr(point)
        if char.isalpha() or unicodedata.category(char)[0] == "M":
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def ngrams(x: np.ndarray, starts: int) -> np.ndarray:
    """Keys of the n-grams that begin at the first ``starts`` places of letters and single ENDs."""
    two = (x[:-1] << BITS) | x[1:]
    three = (two[:-1] << BITS) | x[2:]
    one = x[:starts]
    return np.concatenate([one[one != END], two[:starts], three[:starts][x[1:-1][:starts] != END]])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys of a whole text, ascending, and how often each occurs; long texts are counted block by block."""
    points = letter_table()[np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32)]
    if not points.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points[points == 0] = END
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != END) | (points[:-1] != END)
    x = points[keep]
    found = [np.unique(ngrams(x[at : at + BLOCK + 2], BLOCK), return_counts=True) for at in range(0, len(x), BLOCK)]
    if len(found) == 1:
        return found[0]
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in found])).astype(np.int64)


def top(keys: np.ndarray, times: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, equal counts by key."""
    if len(keys) > size:
        least = np.partition(times, len(times) - size)[len(times) - size]
        some = times >= least
        keys, times = keys[some], times[some]
    return keys[np.argsort(-times, kind="stable")[:size]]


class Profiles:
    def __init__(self, by_language: dict[str, list[int]], size: int):
        self.names, self.size = sorted(by_language), size
        self.keys = np.unique(np.array([k for v in by_language.values() for k in v], np.int64))
        self.rank = np.full((len(self.keys) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            own = np.array(by_language[name], np.int64)
            self.rank[np.searchsorted(self.keys, own), j] = np.arange(len(own))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language; None without a letter."""
        own = top(*counts(text), self.size)
        if not len(own) or not self.names:
            return None
        at = np.searchsorted(self.keys, own)
        at[(at >= len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != own)] = len(self.keys)
        ranks = self.rank[at]
        return np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0) / (self.size * len(own))

    def predict(self, text: str) -> tuple[str, float, float, list[float]]:
        """Language, score (1 less the distance as a share of the largest), lead over the next language, all distances."""
        found = self.distances(text) if any(map(str.isalpha, text)) else None
        if found is None:
            return UND, 0.0, 0.0, []
        best = int(found.argmin())
        rest = np.delete(found, best)
        return self.names[best], float(1 - found[best]), float(rest.min() - found[best]) if len(rest) else 1.0, found.tolist()


def count_udf(texts: pa.Array) -> pa.Array:
    """map<key, times> of each text."""
    out = [counts(x) for x in as_strings(texts)]
    ends = np.cumsum([0, *(len(k) for k, _ in out)])
    values = [pa.array(np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64)) for i in (0, 1)]
    return pa.MapArray.from_arrays(pa.array(ends, pa.int32()), *values)


def learn(docs: DataFrame, may_learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", size: int = 400, per_language: int = 2000) -> Profiles:
    """Profiles from rows where ``may_learn`` holds and a language is given.

    The n-grams of some ``per_language`` documents of each language are counted in Spark;
    what comes to the driver is ``size`` keys for each language.
    """
    rows = docs.where(may_learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    how_many = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # a row for each profile to come
    if not how_many:
        return Profiles({}, size)
    part = F.element_at(F.create_map(*(F.lit(x) for name, n in how_many.items() for x in (name, per_language / n))), F.col("l"))
    some = rows.where(share(F.concat_ws(" ", "i", F.xxhash64("t")), "language") < part).select("l", "t")
    some = some.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    counted = some.select("l", F.explode(F.arrow_udf(count_udf, "map<long, long>")("t")).alias("k", "n")).groupBy("l", "k").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "k"))).where(F.col("r") <= size)
    by_language: dict[str, list[int]] = {}
    for row in sorted(ranked.collect(), key=lambda x: (x.l, x.r)):
        by_language.setdefault(row.l, []).append(row.k)
    return Profiles(by_language, size)


def predicted(text: Column, profiles: Profiles) -> Column:
    """struct<lang_pred, score, lead, distances>"""

    @F.arrow_udf("struct<lang_pred: string, score: double, lead: double, distances: map<string, double>>")
    def predict(texts: pa.Array) -> pa.Array:
        out = [profiles.predict(x) for x in as_strings(texts)]
        return pa.array([{"lang_pred": n, "score": s, "lead": m, "distances": list(zip(profiles.names, d))} for n, s, m, d in out], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("lead", pa.float64()), ("distances", pa.map_(pa.string(), pa.float64()))]))

    return predict(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 4, held: int = 2, **how) -> DataFrame:
    """Per row: id, held_out, lang_pred, score, lead, distances; learnt from rows outside the held-out fold."""
    part = fold(F.col(id_col), parts)
    profiles = learn(docs, part != held, text_col, lang_col, id_col, **how)
    done = docs.select(F.col(id_col), F.coalesce(part == held, F.lit(False)).alias("held_out"), predicted(F.col(text_col), profiles).alias("p"))
    return done.select(id_col, "held_out", "p.lang_pred", "p.score", "p.lead", "p.distances")
