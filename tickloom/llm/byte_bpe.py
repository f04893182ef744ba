"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut at white space into chunks, and chunks by the tokenizer's pattern
into pieces; both cuts depend on nothing outside a chunk, so a batch's distinct
chunks are cut and its distinct pieces merged once.  Pieces are bucketed by length and
padded to matrices of token ids.  Each round finds, in every row, the leftmost
pair of minimum rank (hashed pair table), merges it, and closes the gap; rows
without a mergeable pair leave the matrix.  Very long pieces, for which a round
per merge is quadratic, are merged with a heap by the same rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import texts
from tickloom.llm.words import release, slices, split_buffers

# White space of Unicode, which is what \s means to the tokenizer.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_IS_BLANK = np.zeros(256, dtype=bool)
_IS_BLANK[list(b"\t\n\x0b\x0c\r ")] = True
# White space of more than one byte: the last three bytes of what stands before a chunk, if they are such a character.
_WIDE = {c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))}
MATRIX_PIECE = 512
MATRIX_CELLS = 1 << 18
SLICE_TEXT = 3 << 20
_MARKS = frozenset(".,;:!?")
_LOADED: dict[tuple[str, str], ByteBpe] = {}


class PairRanks:
    """Open-addressing table from a pair of ids to the id of their join (-1: none)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(left) * 2.5).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(int(self.mask) + 1, -1, dtype=np.int32)
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        self.probes = 1
        while len(left_over):
            free = self.keys[slot[left_over]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, one = np.unique(slot[left_over], return_index=True)
            chosen = np.zeros(len(left_over), dtype=bool)
            chosen[one] = True
            placed = left_over[free & chosen]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], joined[placed]
            left_over = left_over[~(free & chosen)]
            if len(left_over):
                taken = self.keys[slot[left_over]] != keys[left_over]
                move = left_over[taken]
                slot[move] = (slot[move] + np.uint64(1)) & self.mask
                self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = keys.ravel()
        slot = self._slot(flat)
        out = np.full(len(flat), -1, dtype=np.int32)
        open_ = np.arange(len(flat))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == flat[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
        return out.reshape(keys.shape)


def _chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of each chunk: of each text, and of each run of white space that begins with an ASCII one."""
    blank = _IS_BLANK[raw]
    starts = np.zeros(len(raw), dtype=bool)
    starts[1:] = blank[1:] & ~blank[:-1]
    # A wide white space before makes it the same run.
    for i in np.flatnonzero(starts[1:] & (raw[:-1] >= 0x80)) + 1:
        if raw[max(0, i - 2) : i].tobytes() in _WIDE or raw[max(0, i - 3) : i].tobytes() in _WIDE:
            starts[i] = False
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(starts)


def _bounds(sizes: Iterable[int], count: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(sizes, dtype=np.int64, count=count))])


def _strung(flat: np.ndarray, bounds: np.ndarray, codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``codes`` of ``flat`` one after the other, and where each of the ``groups`` of codes begins."""
    sizes = (bounds[1:] - bounds[:-1])[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(bounds[:-1][codes] - ends[:-1], sizes) + np.arange(int(ends[-1]))], ends[groups]


class ByteBpe:
    """Encoder and decoder for a rank file; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pattern = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]"))
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.single < 0).any():
            raise ValueError("the rank file lacks single bytes")
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        self.pairs = PairRanks(np.array(left), np.array(right), np.array(joined, dtype=np.int32))

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """Once for each Python worker."""
        if (path, pattern) not in _LOADED:
            with open(path, "rb") as lines:
                _LOADED[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)
        return _LOADED[path, pattern]

    @cached_property
    def pair_of(self) -> dict[tuple[int, int], int]:
        """The pair table as a dictionary, for the heap."""
        held = self.pairs.values >= 0
        keys = self.pairs.keys[held]
        left, right = (keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()
        return dict(zip(zip(left, right), self.pairs.values[held].tolist()))

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = np.array([whole], dtype=np.int32)
            elif len(piece) > MATRIX_PIECE:
                out[i] = np.array(self._by_heap(piece), dtype=np.int32)
            else:
                buckets.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in buckets.items():
            rows = max(1, MATRIX_CELLS // width)
            for a in range(0, len(members), rows):
                some = members[a : a + rows]
                for i, ids in zip(some, self._by_matrix([pieces[i] for i in some], width)):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        ids = self.single[raw]
        ids[np.arange(width) >= lengths[:, None]] = -1
        none = np.iinfo(np.int32).max

        def ranks_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = np.full(a.shape, none, dtype=np.int32)
            real = (a >= 0) & (b >= 0)
            got = self.pairs.find(a[real], b[real])
            found[real] = np.where(got < 0, none, got)
            return found

        done: list[np.ndarray] = [ids[0]] * len(pieces)
        index = np.arange(len(pieces))
        ranks = ranks_of(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), dtype=np.int32)
        while len(index):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(index), dtype=np.int64)
            best = ranks[np.arange(len(index)), at] if ranks.shape[1] else np.full(len(index), none)
            stop = best == none
            if stop.any():
                for i, row in zip(index[stop], ids[stop]):
                    done[i] = row[row >= 0]
                go = ~stop
                index, ids, ranks, at, best = index[go], ids[go], ranks[go], at[go], best[go]
                if not len(index):
                    break
            # Join at `at`, then close the gap of the ids and of the ranks of pairs.
            r, cells = np.arange(len(index)), np.arange(ids.shape[1] - 1)
            source = cells + (cells > at[:, None])
            ids[r, at] = best
            ids = np.take_along_axis(ids, source, axis=1)
            if ids.shape[1] == 1:
                ranks = np.zeros((len(index), 0), dtype=np.int32)
                continue
            ranks = np.take_along_axis(ranks, source[:, :-1], axis=1)
            right = at < ids.shape[1] - 1
            ranks[r[right], at[right]] = ranks_of(ids[r[right], at[right]], ids[r[right], at[right] + 1])
            has_left = at > 0
            ranks[r[has_left], at[has_left] - 1] = ranks_of(ids[r[has_left], at[has_left] - 1], ids[r[has_left], at[has_left]])
        return done

    def _by_heap(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (r := self.pair_of.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end); null is empty."""
        raw, offsets = split_buffers(column)
        starts = _chunk_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), np.zeros(len(offsets), dtype=np.int64)
        ends = np.append(starts, len(raw)).astype("<i8")
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(raw))).dictionary_encode()
        parts = list(map(self._pieces, chunks.dictionary.to_pylist()))
        pieces = pa.array(chain.from_iterable(parts), pa.large_string()).dictionary_encode()
        ids = self.encode_pieces([p.encode() for p in pieces.dictionary.to_pylist()])
        # Ids of pieces, of the pieces of chunks, of the chunks of texts.
        flat, bounds = np.concatenate(ids).astype("<u4"), _bounds(map(len, ids), len(ids))
        flat, bounds = _strung(flat, bounds, pieces.indices.to_numpy(), _bounds(map(len, parts), len(parts)))
        code = chunks.indices.to_numpy()
        flat, bounds = _strung(flat, bounds, code, np.arange(len(code) + 1))
        return flat, bounds[np.searchsorted(starts, offsets)]

    def encode_batch(self, batch: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, bounds = self.encode(pa.array(list(batch), pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]

    def _pieces(self, chunk: str) -> list[str]:
        """The pattern's matches; the two commonest forms, letters and letters with one mark, without it."""
        body = chunk[1:] if chunk[0] == " " else chunk
        if body.isalpha():
            return [chunk]
        if body[-1:] in _MARKS and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document its ids, encoded and decoded again.

    Null text is empty text: no ids.  Text of any length is encoded whole.  Rows
    that repeat each get their row; an empty table gives an empty result; a null
    doc_id stays null; columns other than doc_id and text are not read.
    ``ranks_path`` is a rank file on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bpe = ByteBpe.load(ranks_path, pattern)
        for batch in slices(batches, size=SLICE_TEXT):
            flat, bounds = bpe.encode(batch.column("text"))
            ids = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return texts(docs).mapInArrow(run, schema)


def decoded(ids: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, text as bytes) of a table (doc_id, ids array<int>); null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(ranks_path, pattern)
        for batch in batches:
            rows = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "bytes": pa.array(rows, pa.binary())})

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")
