"""Language-model scoring with an Elias-Fano n-gram trie (order 3, or 2).

Tokens are the words of a text, A-Z lower-cased, and one end. The trie's first
level is the vocabulary: XXH64 hashes of the tokens as an Elias-Fano sequence, whose
places are the tokens' numbers, and running sums of their counts as another. The
second level holds what follows each token: monotone pointers to a token's range of
successors, the successors as one sequence (each is its number plus the last value of
the range before, so that the whole ascends), running sums of their counts, and
quantised log10 probabilities, packed. The third level holds in the same way what
follows each entry of the second. An n-gram is found by the pointers of its context
and a successor search relative to the context, level by level.

    p(w)        = (c(w) + 1) / (N + V + 1)
    p(w | v)    = (c(v, w) + mu_2 p(w)) / (c(v) + mu_2)
    p(w | u, v) = (c(u, v, w) + mu_3 p(w | v)) / (c(u, v) + mu_3)

where an end stands before the first word; the first token has this context of one
token, later ones have two. Probabilities of known n-grams are quantised to ``bits``
bits between a unit's extremes; those of others follow from the counts of the context.

The vocabulary is cut into shards by the first bits of a token's hash, as many as the
input has partitions (rounded to a power of 2). An n-gram belongs to the shard of its
first token and, in it, to the unit of its second token's number: a shard has a unit
for each ``unit_tokens`` tokens that it counts, so that a context which a third of all
tokens follow is dealt to a third of all units. Trigrams of a unit whose bigrams count more tokens than
that, as one common pair can, are cut again by their third token. Counts are summed in each batch before they
are moved, cover every training text, and nothing is pruned. Units are files in the
shared folder, which scoring maps into memory page by page as it looks things up; a
manifest names those of the tasks that ended well.

Defined results: a null, empty or blank text is one end token. Rows with a null id
are learnt from. Repeated rows count each time. With nothing to learn from, N and V
are 0. Two tokens with one 64-bit hash would count as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import elias_fano as ef
from .common import as_bytes, fold, scratch, written

LINE = b"\n"  # the end's token: no word holds a line break
END = xxhash.xxh64_intdigest(LINE)
BLOCK_TOKENS = 1 << 20


def token_blocks(texts: Iterable[bytes], most: int = BLOCK_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(distinct hashes ascending, each token's place among them, where each text ends) of runs of texts with some ``most`` tokens.

    A text of more tokens is a run of its own.
    """
    held, ends = [], []
    for text in texts:
        words = text.lower().split()
        if held and len(held) + len(words) > most:
            yield _block(held, ends)
            held, ends = [], []
        held += words
        held.append(LINE)
        ends.append(len(held))
    if held:
        yield _block(held, ends)


def _block(words: list[bytes], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy()
    new = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))  # where each different word comes first
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(words.__getitem__, new.tolist())), np.uint64, len(new))
    distinct, place = np.unique(hashes, return_inverse=True)
    return distinct, place[codes], np.array(ends)


class Grams:
    """Distinct bigrams and trigrams of a block, as places among its distinct tokens."""

    def __init__(self, distinct: np.ndarray, place: np.ndarray, ends: np.ndarray, order: int):
        size = len(distinct)
        end = int(np.searchsorted(distinct, np.uint64(END)))
        before = np.empty_like(place)
        before[1:], before[0] = place[:-1], end  # an end stands before each text
        pairs, self.pair, self.pair_times = np.unique(before * size + place, return_inverse=True, return_counts=True)
        self.before, self.after = np.divmod(pairs, size)
        if order == 2:
            return
        self.later = np.ones(len(place), bool)  # tokens with a context of two
        self.later[np.concatenate([[0], ends[:-1]])] = False
        at = np.flatnonzero(self.later)
        triples, self.triple, self.triple_times = np.unique(self.pair[at - 1] * size + place[at], return_inverse=True, return_counts=True)
        self.context, self.last = np.divmod(triples, size)  # the context's bigram, the token after it
        self.shorter = np.empty(len(triples), np.int64)  # the bigram that ends a trigram, the same wherever the trigram stands
        self.shorter[self.triple] = self.pair[at]


# Counting and building --------------------------------------------------------------------


BLOBS = "unit long, x binary, y binary, z binary, n binary, runs binary"


def _squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers in the narrowest type that holds them (ascending ones as steps), compressed."""
    values = values.astype(np.uint64)
    if ascending:
        values = np.diff(values, prepend=np.uint64(0))
    kind = np.min_scalar_type(int(values.max(initial=0)))
    data = values.astype(kind).tobytes()
    return b"%d %d " % (kind.itemsize, len(data)) + pa.compress(data, "zstd", asbytes=True)


def _spread(data: bytes, ascending: bool = False) -> np.ndarray:
    width, size, packed = data.split(b" ", 2)
    if size == b"0":
        return np.empty(0, np.uint64)
    values = np.frombuffer(pa.decompress(packed, int(size), "zstd", asbytes=True), f"<u{int(width)}").astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 6
    return pa.record_batch([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["unit", "x", "y", "z", "n", "runs"])


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and stop."""
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)
    return at, np.append(at[1:], len(values))


def _count_tokens(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for distinct, place, _ in token_blocks(as_bytes(batch.column(0))):
            count = np.bincount(place, minlength=len(distinct))
            yield _blobs([(s, _squeezed(distinct[a:b], True), b"", b"", _squeezed(count[a:b]), b"") for s, a, b in _cut(distinct, bits)])


def _cut(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of ascending hashes, for the shards that have any."""
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    for a, b in zip(*(x.tolist() for x in _runs(shard))):
        yield int(shard[a]), a, b


def _joined(column: pa.ChunkedArray, ascending: bool = False) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(_spread(x.as_py(), ascending) for x in column)])


def _build_vocabulary(table: pa.Table, folder: str, bits: int) -> pa.Table:
    shard = table["unit"][0].as_py()
    hashes, where = np.unique(_joined(table["x"], True), return_inverse=True)
    counts = np.bincount(where, _joined(table["n"]), len(hashes)).astype(np.int64)
    own = hashes & np.uint64((1 << (64 - bits)) - 1)
    sums = np.concatenate([[0], np.cumsum(counts)])
    uri = f"{folder}/{shard}-{uuid.uuid4().hex}"
    ef.save(uri, ef.named(ef.build(own, 1 << (64 - bits)), "token") | ef.named(ef.build(sums, int(sums[-1]) + 1), "sums"))
    return pa.table([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(hashes)], pa.int64()), pa.array([int(sums[-1])], pa.int64())], ["shard", "uri", "tokens", "total"])


@dataclass(frozen=True)
class Vocabulary:
    """``shards``: (shard, file, number of tokens, sum of their counts); ``bits``: how many of a hash name its shard."""

    shards: tuple[tuple[int, str, int, int], ...]
    bits: int
    unit_tokens: int

    @cached_property
    def distinct(self) -> int:
        return sum(s[2] for s in self.shards)

    @cached_property
    def total(self) -> int:
        return sum(s[3] for s in self.shards)

    @cached_property
    def starts(self) -> np.ndarray:
        """Number of the first token of each shard, and of all tokens."""
        sizes = np.zeros((1 << self.bits) + 1, np.int64)
        for shard, _, n, _ in self.shards:
            sizes[shard + 1] = n
        return np.cumsum(sizes)

    @cached_property
    def first_units(self) -> np.ndarray:
        """Number of the first unit of each shard, and of all units: one for each ``unit_tokens`` tokens."""
        units = np.ones(1 << self.bits, np.int64)
        for shard, _, _, n in self.shards:
            units[shard] = -(-n // self.unit_tokens)
        return np.concatenate([[0], np.cumsum(units)])

    def unit(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit of n-grams that begin with two tokens, by their numbers, and the first token's number within its shard."""
        shard = np.searchsorted(self.starts, first, side="right") - 1
        units = np.diff(self.first_units)[shard]
        return self.first_units[shard] + second * units // max(1, self.distinct), first - self.starts[shard]

    def shard_of(self, unit: int) -> int:
        return int(np.searchsorted(self.first_units, unit, side="right")) - 1

    def __len__(self) -> int:
        return self.distinct

    def share(self, counts: np.ndarray) -> np.ndarray:
        """p of tokens with these counts."""
        return (counts + 1) / (self.total + self.distinct + 1)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Counts of tokens by ascending number."""
        opened, out = opened_vocabulary(self), np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.starts, numbers, side="right") - 1
        for a, b in zip(*(x.tolist() for x in _runs(shard))):
            at = numbers[a:b] - self.starts[shard[a]]
            before, after = opened[int(shard[a])][1].both(at)
            out[a:b] = after - before
        return out

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of ascending hashes."""
        opened, starts = opened_vocabulary(self), self.starts
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for shard, a, b in _cut(hashes, self.bits):
            if shard not in opened:
                continue
            tokens, sums = opened[shard]
            at, known = tokens.successor(hashes[a:b] & np.uint64((1 << (64 - self.bits)) - 1))
            at = at[known]
            number[a:b][known] = starts[shard] + at
            before, after = sums.both(at)
            count[a:b][known] = (after - before).astype(np.int64)
        return number, count


@lru_cache(maxsize=1)
def opened_vocabulary(v: Vocabulary) -> dict[int, tuple[ef.Sequence, ef.Sequence]]:
    return {shard: tuple(ef.Sequence(ef.part(arrays, k)) for k in ("token", "sums")) for shard, uri, *_ in v.shards if (arrays := ef.load(uri))}


@dataclass(frozen=True)
class Parts:
    """Into how many parts the trigrams of a bigrams' unit are cut, by their third tokens: part k of unit u is unit u + k * ``units`` of the third level.

    ``several``: (unit, parts) of those of more than one, which common pairs make.
    """

    units: int
    several: tuple[tuple[int, int], ...] = ()

    def numbers(self) -> np.ndarray:
        out = np.ones(self.units, np.int64)
        for unit, n in self.several:
            out[unit] = n
        return out


def _count_grams(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, order: int, parts: Parts) -> Iterator[pa.RecordBatch]:
    """Bigrams, or trigrams, of each block, by unit: x and y are the first two tokens' numbers, once for each run of them, and z the third's."""
    cut = parts.numbers() if order > 2 else None
    for batch in batches:
        for distinct, place, ends in token_blocks(as_bytes(batch.column(0))):
            grams = Grams(distinct, place, ends, order)
            number, _ = vocabulary.lookup(distinct)
            pair = np.arange(len(grams.before)) if order == 2 else grams.context
            first, second, times = number[grams.before[pair]], number[grams.after[pair]], grams.pair_times if order == 2 else grams.triple_times
            unit, x = vocabulary.unit(first, second)
            if cut is not None:
                unit = unit + number[grams.last] % cut[unit] * parts.units
            by = np.argsort(unit, kind="stable")
            unit, x, y, times = unit[by], x[by], second[by], times[by]
            z = np.empty(0) if order == 2 else number[grams.last][by]
            rows = []
            for a, b in zip(*(k.tolist() for k in _runs(unit))):
                if order == 2:
                    rows.append((int(unit[a]), _squeezed(x[a:b], True), _squeezed(y[a:b]), b"", _squeezed(times[a:b]), b""))
                else:
                    at, stop = _runs(x[a:b] * len(vocabulary) + y[a:b])
                    rows.append((int(unit[a]), _squeezed(x[a:b][at], True), _squeezed(y[a:b][at]), _squeezed(z[a:b]), _squeezed(times[a:b]), _squeezed(stop - at)))
            yield _blobs(rows)


def _ranges(before: np.ndarray, after: np.ndarray, contexts: int) -> dict[str, np.ndarray]:
    """Pointers and successors of n-grams in order of (context, successor)."""
    last = np.concatenate([before[1:] != before[:-1], [True]])
    first = np.concatenate([[True], before[1:] != before[:-1]])
    # each range goes on from the last value of the range before
    step = np.where(last, after + 1, 0)
    carried = np.cumsum(step) - step
    values = after + 1 + carried[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    pointers = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=contexts))])
    return ef.named(ef.build(pointers, len(before) + 1), "pointers") | ef.named(ef.build(values, int(values[-1]) + 1), "next")


def _codes(log: np.ndarray, bits: int) -> dict[str, np.ndarray]:
    low, high = float(log.min()), float(log.max())
    step = (high - low) / ((1 << bits) - 1) or 1.0
    return {"codes": ef.pack(np.rint((log - low) / step).astype(np.uint64), bits), "range": np.array([low, step])}


def _saved(unit: int, arrays: dict[str, np.ndarray], folder: str, n: int, total: int) -> pa.Table:
    uri = f"{folder}/{unit}-{uuid.uuid4().hex}"
    ef.save(uri, arrays)
    return pa.table([pa.array([unit], pa.int64()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["unit", "uri", "grams", "total"])


MADE = "unit long, uri string, grams long, total long"


def _build_bigrams(table: pa.Table, folder: str, vocabulary: Vocabulary, mu: float, bits: int) -> pa.Table:
    unit = table["unit"][0].as_py()
    shard = vocabulary.shard_of(unit)
    x, y = _joined(table["x"], True), _joined(table["y"])
    keys, where = np.unique(x * np.uint64(len(vocabulary)) + y, return_inverse=True)
    times = np.bincount(where, _joined(table["n"]), len(keys)).astype(np.int64)
    before, after = (k.astype(np.int64) for k in np.divmod(keys, np.uint64(len(vocabulary))))
    follow, back = np.unique(after, return_inverse=True)
    counts = np.diff(opened_vocabulary(vocabulary)[shard][1].all().astype(np.int64))
    log = np.log10((times + mu * vocabulary.share(vocabulary.counts(follow))[back]) / (counts[before] + mu))
    sums = np.concatenate([[0], np.cumsum(times)])
    return _saved(unit, _ranges(before, after, len(counts)) | _codes(log, bits) | ef.named(ef.build(sums, int(sums[-1]) + 1), "sums"), folder, len(keys), int(sums[-1]))


def _build_trigrams(table: pa.Table, folder: str, model: Model, mu: float, bits: int) -> pa.Table:
    unit = table["unit"][0].as_py()
    vocabulary, level = model.vocabulary, opened_unit(model.files[0][unit % model.parts.units], model.bits)
    pairs, where = np.unique(_joined(table["x"], True) * np.uint64(len(vocabulary)) + _joined(table["y"]), return_inverse=True)
    where, z, n = np.repeat(where, _joined(table["runs"]).astype(np.int64)), _joined(table["z"]), _joined(table["n"])
    first, second = (k.astype(np.int64) for k in np.divmod(pairs, np.uint64(len(vocabulary))))
    entry, known = level.find(first, second)
    if not known.all():
        raise ValueError("a trigram's context isn't among the bigrams")
    keys, where = np.unique(entry[where].astype(np.uint64) * np.uint64(len(vocabulary)) + z, return_inverse=True)
    times = np.bincount(where, n, len(keys)).astype(np.int64)
    context, last = (k.astype(np.int64) for k in np.divmod(keys, np.uint64(len(vocabulary))))
    middle = np.zeros(level.entries, np.int64)
    middle[entry] = second
    shorter, back = np.unique(middle[context].astype(np.uint64) * np.uint64(len(vocabulary)) + last.astype(np.uint64), return_inverse=True)
    shorter = model.log_bigrams(model.bigrams(*(k.astype(np.int64) for k in np.divmod(shorter, np.uint64(len(vocabulary))))), len(shorter))[back]
    log = np.log10((times + mu * 10**shorter) / (level.count(context) + mu))
    return _saved(unit, _ranges(context, last, level.entries) | _codes(log, bits), folder, len(keys), int(times.sum()))


def _builder(model: Model, folder: str, mu: float, bits: int) -> Callable[[pa.Table], pa.Table]:
    """What builds a unit of the level that ``model`` doesn't have yet."""
    if not model.units:
        return lambda table: _build_bigrams(table, folder, model.vocabulary, mu, bits)
    return lambda table: _build_trigrams(table, folder, model, mu, bits)


class Level:
    """One unit's n-grams of one length: those of a context are the entries between two pointers."""

    def __init__(self, arrays: dict[str, np.ndarray], bits: int):
        self.pointers, self.next = (ef.Sequence(ef.part(arrays, k)) for k in ("pointers", "next"))
        self.sums = ef.Sequence(ef.part(arrays, "sums")) if "sums.shape" in arrays else None
        self.codes, (self.low, self.step), self.bits, self.entries = arrays["codes"], arrays["range"], bits, self.next.n

    def find(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each token after its context, and whether there is one. Runs of a context are looked up once."""
        at, end = _runs(context)
        begin, stop = (x.astype(np.int64) for x in self.pointers.both(context[at]))
        carried = np.where(begin > 0, self.next.access(np.maximum(begin - 1, 0)).astype(np.int64), 0) if len(begin) else begin
        carried, stop = (np.repeat(x, end - at) for x in (carried, stop))
        place, equal = self.next.successor((carried + token + 1).astype(np.uint64))
        return place, equal & (place < stop)

    def log(self, entry: np.ndarray) -> np.ndarray:
        return self.low + self.step * ef.unpack(self.codes, self.bits, entry).astype(float)

    def count(self, entry: np.ndarray) -> np.ndarray:
        before, after = self.sums.both(entry)
        return (after - before).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``units``: for bigrams, and for trigrams, (unit, file)."""

    vocabulary: Vocabulary
    units: tuple[tuple[tuple[int, str], ...], ...]
    mus: tuple[float, ...]
    bits: int
    parts: Parts

    @cached_property
    def cut(self) -> np.ndarray:
        return self.parts.numbers()

    @cached_property
    def files(self) -> list[dict[int, str]]:
        return [dict(u) for u in self.units]

    def _each_unit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(unit, places, first tokens' numbers in the shard) of pairs of known tokens."""
        known = np.flatnonzero((first >= 0) & (second >= 0))
        unit, x = self.vocabulary.unit(first[known], second[known])
        by = np.argsort(unit, kind="stable")
        unit, known, x = unit[by], known[by], x[by]
        for a, b in zip(*(k.tolist() for k in _runs(unit))):
            if int(unit[a]) in self.files[0]:
                yield int(unit[a]), known[a:b], x[a:b]

    def bigrams(self, before: np.ndarray, after: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(unit, places, entries) of the known ones of these bigrams of token numbers."""
        out = []
        for unit, rows, x in self._each_unit(before, after):
            entry, known = opened_unit(self.files[0][unit], self.bits).find(x, after[rows])
            out.append((unit, rows[known], entry[known]))
        return out

    def log_bigrams(self, found: list[tuple[int, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
        """log10 p of n bigrams; NaN where one isn't known."""
        out = np.full(n, np.nan)
        for unit, rows, entry in found:
            out[rows] = opened_unit(self.files[0][unit], self.bits).log(entry)
        return out

    def score(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """(n_tokens, n_known, base_score, score) arrays of runs of the texts."""
        v, order = self.vocabulary, len(self.units) + 1
        for distinct, place, ends in token_blocks(texts):
            number, count = v.lookup(distinct)
            first = np.concatenate([[0], ends[:-1]])
            unigram = np.log10(v.share(count))
            grams = Grams(distinct, place, ends, order)
            found = self.bigrams(number[grams.before], number[grams.after])
            log = self.log_bigrams(found, len(grams.before))
            log = np.where(np.isnan(log), np.log10(self.mus[0] / (count[grams.before] + self.mus[0])) + unigram[grams.after], log)
            score = log[grams.pair]
            if order > 2 and len(grams.context):
                score[grams.later] = self._log_trigrams(number, grams, log, found)[grams.triple]
            yield np.diff(ends, prepend=0), np.add.reduceat((count > 0)[place].astype(np.int64), first), np.add.reduceat(unigram[place], first), np.add.reduceat(score, first)

    def _log_trigrams(self, number: np.ndarray, grams: Grams, log: np.ndarray, found: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
        """log10 p of the distinct trigrams of a block, from the logs of its distinct bigrams and the entries of the known ones."""
        out, last = log[grams.shorter], number[grams.last]
        # trigrams are in the order of their contexts, so those of one context are a run
        ends = np.concatenate([[0], np.cumsum(np.bincount(grams.context, minlength=len(grams.before)))])
        for unit, pairs, entry in found:
            begin, size = ends[pairs], ends[pairs + 1] - ends[pairs]
            rows = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            if not len(rows):
                continue
            # the context is known: what follows it is found, or gets its share of the shorter context's
            level = opened_unit(self.files[0][unit], self.bits)
            out[rows] += np.repeat(np.log10(self.mus[1] / (level.count(entry) + self.mus[1])), size)
            token, entry = last[rows], np.repeat(entry, size)
            part = np.where(token >= 0, token % self.cut[unit], -1)
            for k in np.unique(part[part >= 0]).tolist():
                if unit + k * self.parts.units in self.files[1]:
                    longer, own = opened_unit(self.files[1][unit + k * self.parts.units], self.bits), np.flatnonzero(part == k)
                    place, known = longer.find(entry[own], token[own])
                    out[rows[own[known]]] = longer.log(place[known])
        return out


@lru_cache(maxsize=4096)
def opened_unit(uri: str, bits: int) -> Level:
    """A unit's file, mapped."""
    return Level(ef.load(uri), bits)


def train(texts: DataFrame, text_col: str = "text", mus: tuple[float, ...] = (300.0, 30.0), bits: int = 12, shard_bits: int | None = None, unit_tokens: int = 2_000_000) -> Model:
    """Count and build all levels over all rows of ``texts``; ``mus`` has a weight for each level after the first. ``shard_bits`` follows the number of input partitions unless given."""
    folder = scratch(texts.sparkSession, "ngrams")
    rows = texts.select(F.col(text_col).alias("text"))
    if shard_bits is None:
        shard_bits = max(2, (rows.rdd.getNumPartitions() // 2).bit_length())
    counted = rows.mapInArrow(partial(_count_tokens, bits=shard_bits), BLOBS)
    made = counted.groupBy("unit").applyInArrow(lambda table: _build_vocabulary(table, f"{folder}/tokens", shard_bits), "shard int, uri string, tokens long, total long")
    shards = sorted(written(made, f"{folder}/token-files").collect())  # one row a shard
    vocabulary = Vocabulary(tuple((r.shard, r.uri, r.tokens, r.total) for r in shards), shard_bits, unit_tokens)
    parts = Parts(int(vocabulary.first_units[-1]))
    model = Model(vocabulary, (), mus, bits, parts)
    for order, mu in enumerate(mus, 2):
        counted = rows.mapInArrow(partial(_count_grams, vocabulary=vocabulary, order=order, parts=parts), BLOBS)
        made = counted.groupBy("unit").applyInArrow(_builder(model, f"{folder}/{order}", mu, bits), MADE)
        units = sorted(written(made, f"{folder}/files-{order}").collect())  # one row a unit
        parts = Parts(parts.units, tuple((r.unit, -(-r.total // unit_tokens)) for r in units if r.total > unit_tokens)) if order == 2 else parts
        model = Model(vocabulary, (*model.units, tuple((r.unit, r.uri) for r in units)), mus, bits, parts)
    return model


def scored(text: Column, model: Model) -> Column:
    """struct<n_tokens, n_known, base_score, score>"""

    def batch(texts: pa.Array) -> pa.Array:
        runs = [pa.StructArray.from_arrays([pa.array(x) for x in run], ["n_tokens", "n_known", "base_score", "score"]) for run in model.score(as_bytes(texts))]
        kind = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_arrays(runs) if runs else pa.array([], kind)

    return F.arrow_udf(batch, "struct<n_tokens: long, n_known: long, base_score: double, score: double>")(text)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, held: int = 2, **how) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from all texts outside the held-out fold."""
    out = F.coalesce(fold(F.col(id_col), parts) == held, F.lit(False))
    model = train(docs.where(~out), text_col, **how)
    done = docs.select(F.col(id_col), out.alias("held_out"), scored(F.col(text_col), model).alias("s"))
    return done.select(id_col, "held_out", "s.n_tokens", "s.n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"), "s.base_score", "s.score")
