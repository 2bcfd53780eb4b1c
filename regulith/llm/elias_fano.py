"""Elias-Fano sequences and packed numbers in flat, memory-mapped files.

A sequence of n ascending numbers below u keeps the low bits of each, as many as
log2(u / n), packed; and the rest as gaps in unary in a bit vector, with the number
of ones, and that of zeros, before each of its 64-bit words, and the words of every HINT-th one and zero.
``access`` selects a one; ``successor`` selects the zero before a bucket of equal high bits, goes on to the
next one and searches the bucket's low bits.
All lookups take arrays and are vectorised.
"""

from __future__ import annotations

import json
import os
import tempfile

import numpy as np
import pyarrow.fs

_EACH_BYTE, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
HINT = 32
#: Byte, k → place of its k-th one.
_PLACES = np.array([([b for b in range(8) if byte >> b & 1] + [0] * 8)[:8] for byte in range(256)], np.int64)


def pack(values: np.ndarray, width: int, block: int = 1 << 16) -> np.ndarray:
    """Numbers of ``width`` bits one after another, in 64-bit words and one word more."""
    if width == 0:
        return np.zeros(1, np.uint64)
    shifts, out = np.arange(width, dtype=np.uint64), []
    for at in range(0, len(values), block):
        bits = (values[at : at + block, None].astype(np.uint64) >> shifts) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    data = np.concatenate(out) if out else np.empty(0, np.uint8)
    return np.concatenate([data, np.zeros(16 - len(data) % 8, np.uint8)]).view(np.uint64)


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * np.uint64(width)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    # a shift by 64 isn't defined, so the upper part is shifted by one and then by the rest
    upper = (words[word + 1] << np.uint64(1)) << (np.uint64(63) - shift)
    return ((words[word] >> shift) | upper) & np.uint64((1 << width) - 1)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word: the byte that holds it by sums of the bytes' counts, then its place in the byte."""
    sums = np.bitwise_count(word.view(np.uint8)).view(np.uint64) * _EACH_BYTE  # bytes: ones up to and in each byte
    k = k.astype(np.uint64)
    # a byte's top bit stays where no more than k ones end: no byte of the sums is above 64
    shift = np.bitwise_count(((k * _EACH_BYTE | _TOPS) - sums) & _TOPS).astype(np.uint64) << np.uint64(3)
    before = ((sums << np.uint64(8)) >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _PLACES[(word >> shift) & np.uint64(255), k - before]


def _trailing(words: np.ndarray) -> np.ndarray:
    """Zeros below the lowest one of each word that isn't 0."""
    return np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1)).astype(np.int64)


def _hints(before: np.ndarray) -> np.ndarray:
    """The word in which every HINT-th one (or zero) stands, given how many there are before each word."""
    return (np.searchsorted(before, np.arange(0, int(before[-1]), HINT), side="right") - 1).astype(np.int32 if len(before) < 1 << 31 else np.int64)


def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of the sequence; ``values`` ascend and are below ``universe``."""
    n = len(values)
    low = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64)
    size = n + (max(universe - 1, 0) >> low) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones
    return {"shape": np.array([n, low], np.int64), "low": pack(values & np.uint64((1 << low) - 1), low), "high": words, "ones": ones, "zeros": zeros, "one_words": _hints(ones), "zero_words": _hints(zeros)}


class Sequence:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["shape"])
        self.low, self.high, self.ones, self.zeros, self.one_words, self.zero_words = (arrays[k] for k in ("low", "high", "ones", "zeros", "one_words", "zero_words"))

    @staticmethod
    def _word(before: np.ndarray, hints: np.ndarray, k: np.ndarray, steps: int = 3) -> np.ndarray:
        """The word of each k-th: a few words on from the hint, or else searched for."""
        word = hints[k // HINT].astype(np.int64)
        for _ in range(steps):
            more = before[word + 1] <= k
            if not more.any():
                return word
            word += more
        far = np.flatnonzero(before[word + 1] <= k)
        word[far] = np.searchsorted(before, k[far], side="right") - 1
        return word

    def _one(self, k: np.ndarray) -> np.ndarray:
        word = self._word(self.ones, self.one_words, k)
        return word * 64 + _select_in_word(self.high[word], k - self.ones[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = self._word(self.zeros, self.zero_words, k)
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def _value(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((place - at).astype(np.uint64) << np.uint64(self.width)) | unpack(self.low, self.width, at)

    def access(self, at: np.ndarray) -> np.ndarray:
        return self._value(self._one(at), at)

    def both(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries ``at``, and those after them, which there have to be."""
        place = self._one(at)
        after = place + 1
        rest = self.high[after >> 6] >> (after & 63).astype(np.uint64)
        after += _trailing(rest)
        far = np.flatnonzero(rest == 0)
        after[far] = self._one(at[far] + 1)
        return self._value(place, at), self._value(after, at + 1)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))[: self.n]
        at = np.arange(self.n)
        return ((places - at).astype(np.uint64) << np.uint64(self.width)) | unpack(self.low, self.width, at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first entry not below each x (n if there is none), and whether it equals x. x is below 2**63 or of the universe's width."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        high, want = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        buckets = int(self.zeros[-1])
        over = high >= buckets
        high = np.where(over, 0, high)
        place = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) + 1, 0)  # of the bucket's first bit
        begin, rest = place - high, ~self.high[place >> 6] >> (place & 63).astype(np.uint64)
        end = begin + _trailing(rest)
        far = np.flatnonzero(rest == 0)  # ones up to the word's end
        end[far] = self._zero(high[far]) - high[far]
        end = np.minimum(np.where(over, self.n, end), self.n)
        begin = np.minimum(np.where(over, self.n, begin), end)
        low, top = begin.copy(), end.copy()
        open_ = np.flatnonzero(low < top)
        while len(open_):
            mid = (low[open_] + top[open_]) >> 1
            less = unpack(self.low, self.width, mid) < want[open_]
            low[open_] = np.where(less, mid + 1, low[open_])
            top[open_] = np.where(less, top[open_], mid)
            open_ = open_[low[open_] < top[open_]]
        inside = low < end
        equal = np.zeros(len(x), bool)
        equal[inside] = unpack(self.low, self.width, low[inside]) == want[inside]
        return low, equal


# Files -----------------------------------------------------------------------------------


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a line of JSON that says where each array lies, and the arrays, aligned to 64 bytes."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = [at, str(x.dtype), len(x)]
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with store.open_output_stream(path, compression=None) as out:
        out.write(head)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).view(np.uint8))
            out.write(b"\0" * (-x.nbytes % 64))


def load(uri: str) -> dict[str, np.ndarray]:
    """Memory-mapped arrays. A file that isn't on a mounted file system is copied first; the copy goes with the mapping."""
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    if store.type_name == "local":
        data = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as copy:
            with store.open_input_stream(path, compression=None) as source:
                while block := source.read(1 << 22):
                    copy.write(block)
            copy.flush()
            data = np.memmap(copy.name, np.uint8, "r")
    size = 0
    while data[size : size + 64][-1] != 10:
        size += 64
    size += 64
    places = json.loads(bytes(data[:size]))
    data = data.view(np.ndarray)  # as a plain array, whose parts keep the mapping
    return {name: data[size + at : size + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in places.items()}


def part(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) + 1 :]: v for k, v in arrays.items() if k.startswith(prefix + ".")}


def named(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}
