"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols start as single characters. An agenda (a heap) holds the adjacent pairs
whose joined text is a piece, ordered by piece score and then by position; the
best pair is merged, its new neighbours are pushed, and entries whose symbols
have changed meanwhile are skipped. What is left is looked up, or falls back to
byte pieces.

Symbols are numbers, and a table of pairs gives what two of them join to. Long chunks
of text have an agenda each, a heap of (rank of the joined piece, place). Short ones,
which nearly all are, go through theirs together: a row of a matrix is the agenda of
one chunk, with the rank of the pair at each place, and each step takes the best entry
of every row, merges there and puts in the two new neighbours.

A text is cut into chunks first, at places that no piece spans: before a run of
spaces, and round line breaks. No merge can cross such a cut, so chunks are
independent and a chunk's ids can be kept in a cache of limited size. Each chunk that
goes through the agenda, of any length, is checked against the sentencepiece library,
its ids and what they decode to, batch by batch.

Defined results: a null text counts as empty and gives just the begin and end
ids; repeated rows give repeated results; no limit on a text's length; other
columns are not looked at.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


MARK = "▁"
#: Chunks that a worker's cache holds between batches, and the longest that it keeps; rows of a matrix of agendas.
CACHE_ENTRIES, CACHE_CHARS, ROWS = 100_000, 48, 8192
#: Bytes of text that are encoded together, one text at least.
PART_BYTES = 1 << 20
NONE = np.int32(2**31 - 1)


def _fields(blob: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {5: 4, 1: 8}[key & 7]
            yield key >> 3, blob[at : at + size]
            at += size


class MergeCodec:
    """Encodes and decodes as the library does, for models that don't rewrite characters."""

    def __init__(self, model: bytes, check: bool = True):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        parts = dict(_fields(model))
        trainer, norm = dict(_fields(parts.get(2, b""))), dict(_fields(parts.get(3, b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type vocabulary")
        if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1):
            raise ValueError("only models with a space mark in front and no other normalisation are supported")
        if any(dict(_fields(piece)).get(3) == 4 for number, piece in _fields(model) if number == 1) or any(sp.is_unused(i) for i in range(sp.get_piece_size())):
            raise ValueError("vocabularies with user-defined or unused pieces are not supported")
        score, number, self.bytes_of, self.byte_id = {}, {}, [], [sp.unk_id()] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_control(i):
                self.bytes_of.append(None)
            elif sp.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            elif sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                score[piece], number[piece] = sp.get_score(i), i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.is_byte = frozenset(self.byte_id)
        self.control = frozenset(i for i in range(sp.get_piece_size()) if sp.is_control(i))
        self.marked = frozenset(i for p, i in number.items() if p[0] == MARK)
        self.begin, self.end = (array("I", [x]).tobytes() for x in (sp.bos_id(), sp.eos_id()))
        self._tabulate(score, number)
        apart = not any("\n" in p for p in number)
        whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in number)
        self.cut = re.compile("(?s).+" if whole else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if apart else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.joinable = apart and not whole
        self.word, self.line = (array("I", self.merge(x)).tobytes() for x in (MARK + "a", "\n"))
        self.cache: dict[str, bytes] = {}
        self.check = check

    def _tabulate(self, score: dict[str, float], number: dict[str, int]) -> None:
        """Symbols are the pieces by id, then the characters that are no piece, then one for all others."""
        self.symbol = {p: i for p, i in number.items() if len(p) == 1}
        first = own = len(self.bytes_of)
        for c in sorted({c for p in number for c in p} - set(self.symbol)):
            self.symbol[c], own = own, own + 1
        self.pieces, self.other = first, own
        self.width = own + 1
        symbol = self.symbol | number
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = [0] * first
        self.joined = {}
        for piece, i in number.items():
            self.rank[i] = ranks[score[piece]]
            for at in range(1, len(piece)):
                a, b = symbol.get(piece[:at]), symbol.get(piece[at:])
                if a is not None and b is not None:
                    self.joined[a * self.width + b] = i
        self.of_point = np.full(0x110000, self.other, np.int32)
        for c, i in self.symbol.items():
            self.of_point[ord(c)] = i
        keys = sorted(self.joined)
        self.pairs = np.array([*keys, 2**62], np.int64)
        self.pair_joins = np.array([*(self.joined[k] for k in keys), 0], np.int32)
        self.ranks = np.array(self.rank, np.int32)

    def merge(self, chunk: str) -> list[int]:
        """Ids of a chunk, from the agenda of its adjacent symbol pairs."""
        n, width, rank, join, other = len(chunk), self.width, self.rank, self.joined.get, self.other
        known = self.symbol.get
        symbols = [known(c, other) for c in chunk]
        agenda = [rank[m] * n + i for i in range(n - 1) if (m := join(symbols[i] * width + symbols[i + 1])) is not None]
        if agenda:
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heapq.heapify(agenda)
            while agenda:
                r, i = divmod(heapq.heappop(agenda), n)
                a, j = symbols[i], after[i]
                # an entry counts while its two symbols stand
                if a < 0 or j >= n or (m := join(a * width + symbols[j])) is None or rank[m] != r:
                    continue
                symbols[i], symbols[j] = m, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if (x := join(m * width + symbols[k])) is not None:
                        heapq.heappush(agenda, rank[x] * n + i)
                h = before[i]
                if h >= 0 and (x := join(symbols[h] * width + m)) is not None:
                    heapq.heappush(agenda, rank[x] * n + h)
        pieces, out = self.pieces, []
        for s, c in zip(symbols, chunk):
            if s >= pieces:
                out.extend(self.byte_id[b] for b in c.encode())
            elif s >= 0:
                out.append(s)
        return out

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs of symbols join to, and its rank (NONE if they don't)."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.pairs, key)
        joined = self.pair_joins[at]
        return joined, np.where(self.pairs[at] == key, self.ranks[joined], NONE)

    def merge_rows(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of chunks of like length, from the rows of a matrix of agendas."""
        n, most = len(chunks), max(map(len, chunks))
        size = np.fromiter(map(len, chunks), np.int64, n)
        points = np.frombuffer("".join(c.ljust(most, "\0") for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, most)
        place = np.arange(most)
        symbols = np.where(place < size[:, None], self.of_point[points], -1).astype(np.int32)
        after, before = np.tile(place + 1, (n, 1)), np.tile(place - 1, (n, 1))
        joined, rank = np.zeros((n, most), np.int32), np.full((n, most), NONE, np.int32)
        if most > 1:
            joined[:, :-1], found = self._lookup(symbols[:, :-1], symbols[:, 1:])
            rank[:, :-1] = np.where(place[1:] < size[:, None], found, NONE)
        live = np.arange(n)
        while len(live):
            agenda = rank[live]
            i = agenda.argmin(1)
            some = agenda[np.arange(len(live)), i] != NONE
            live, i = live[some], i[some]
            j, m = after[live, i], joined[live, i]
            symbols[live, i], symbols[live, j], rank[live, i], rank[live, j] = m, -1, NONE, NONE
            k, h = after[live, j], before[live, i]
            after[live, i] = k
            right, left = k < size[live], h >= 0
            at, to, of = live[right], i[right], k[right]
            before[at, of] = to
            joined[at, to], rank[at, to] = self._lookup(m[right], symbols[at, of])
            at, to = live[left], h[left]
            joined[at, to], rank[at, to] = self._lookup(symbols[at, to], m[left])
        left = symbols >= 0
        data = symbols[left].astype("<u4").tobytes()
        ends = (4 * np.cumsum(left.sum(1))).tolist()
        out = [data[a:b] for a, b in zip([0, *ends], ends)]
        for row in np.flatnonzero((symbols >= self.pieces).any(1)).tolist():  # some of it falls back to bytes
            out[row] = array("I", self.merge(chunks[row])).tobytes()
        return out

    def merged(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """Chunks with their packed ids, checked against the library."""
        out = [(c, array("I", self.merge(c)).tobytes()) for c in chunks if len(c) > CACHE_CHARS]
        short = sorted((c for c in chunks if len(c) <= CACHE_CHARS), key=len)
        for at in range(0, len(short), ROWS):
            part = short[at : at + ROWS]
            out += zip(part, self.merge_rows(part))
        if self.check:
            self.verify(out)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with begin and end ids."""
        cut = [self.cut(MARK + x.replace(" ", MARK)) if x else [] for x in texts]
        seen = set()
        for chunks in cut:
            seen.update(chunks)
        new = self.merged([c for c in seen if c not in self.cache])
        self.cache.update(new)
        out = [b"".join([self.begin, *map(self.cache.__getitem__, chunks), self.end]) for chunks in cut]
        for chunk, _ in new:
            if len(chunk) > CACHE_CHARS:
                del self.cache[chunk]
        if len(self.cache) > CACHE_ENTRIES:  # the first ones put in go; frequent ones come back
            for old in list(islice(self.cache, len(self.cache) - CACHE_ENTRIES // 2)):
                del self.cache[old]
        return out

    def verify(self, encoded: list[tuple[str, bytes]]) -> None:
        """Compare chunks' ids, and what they decode to, with what the library makes of them.

        As chunks are independent, many stand one after another in a text, behind a first word and, where
        they have no space mark in front, a line break.
        """
        group, size = [], 0
        for x in encoded:
            if self.joinable and x[0].strip(MARK):
                group.append(x)
                size += len(x[0])
                if size >= 4096:
                    self._agree(group)
                    group, size = [], 0
            elif x[0] != MARK:  # the library gives nothing for an empty text, which is what a lone mark is cut down to
                self._agree_alone(x)
        self._agree(group)

    def _agree(self, group: list[tuple[str, bytes]]) -> None:
        parts = [x if x[0][0] == MARK else ("\n" + x[0], self.line + x[1]) for x in group]
        text, ids = "a" + "".join(c for c, _ in parts).replace(MARK, " "), self.word + b"".join(i for _, i in parts)
        theirs = self.library.encode(text, num_threads=1)
        if array("I", theirs).tobytes() != ids or not self.library.decode(theirs) == self.decode(ids) == text:
            for x in group:
                self._agree_alone(x)
            raise ValueError("the library encodes or decodes chunks differently")

    def _agree_alone(self, encoded: tuple[str, bytes]) -> None:
        chunk, ids = encoded
        before = "" if chunk[0] == MARK else "\n"
        theirs = self.library.encode(chunk[1:].replace(MARK, " ") if not before else before + chunk.replace(MARK, " "), num_threads=1)
        theirs = theirs[2:] if before else theirs  # a space mark and the line break
        if array("I", theirs).tobytes() != ids or self.library.decode(theirs) != self.decode(ids):
            raise ValueError(f"the library encodes or decodes {chunk!r} differently")

    def decode(self, packed: bytes) -> str:
        """Text of the ids: one leading space, the mark that encoding put in front, goes."""
        ids = array("I", packed).tolist()
        ids = ids[next((k for k, i in enumerate(ids) if i not in self.control), len(ids)) :]
        while ids and ids[-1] in self.control:
            ids.pop()
        try:
            text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):  # control ids within, or bytes that are no character
            text = self._mended(ids)
        return text[1:] if ids and ids[0] in self.marked else text

    def _mended(self, ids: list[int]) -> str:
        """Each byte piece that is not part of a whole character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i in self.is_byte:
                run += self.bytes_of[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                run = run[size:]
            if i is not None and i not in self.control:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes, check: bool = True) -> MergeCodec:
    return MergeCodec(model, check)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """Per row of ``docs``: its id, ids (binary: little-endian unsigned 32-bit numbers, with begin and end) and decoded, their text again.

    ``model_path`` is read on the driver; a vocabulary has a fixed size, so its bytes travel with the tasks.
    A worker holds a part of a batch's texts, ids and decoded texts at a time.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, check)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), PART_BYTES):
                ids = own.encode_all([x or "" for x in part.to_pylist()])
                yield pa.record_batch([batch.column(0).slice(at, len(part)), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.string())], [id_col, "ids", "decoded"])
                at += len(part)

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of ids, and SHA-256 of the packed ids and of the decoded text."""
    return encoded.select(id_col, (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
