"""Token ids of documents in wavelet-matrix files, one file per shard.

Shard file (little endian): ``WMX1``, then sections, each a 64-bit length and
that many bytes: header (tokens, documents, levels; 64-bit each), zstd of the
document ids, zstd of their null flags, zstd of the documents' token counts, and
per level, highest bit first: number of zeros, zstd of the bit plane, zstd of
the ones before each 512-bit block.  A level's plane holds that bit of the ids in
the order the higher bits have left them, zeros before ones.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import scratch, table, texts
from tickloom.llm.piece_counts import cut_at_space
from tickloom.llm.words import run_hashes, slices, split_buffers, word_starts

SHARD_TOKENS = 4_000_000
END_ID = 1
BLOCK = 512
CACHE_WORDS = 2_000_000
ENCODE_WORDS = 1_000
_IS_PLAIN, _IN_WORD = (np.zeros(256, dtype=bool) for _ in range(2))
_IS_PLAIN[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_IN_WORD[[i for i in range(256) if i not in b" \t\n\x0b\x0c\r"]] = True
# ASCII marks that neither begin a contraction nor bound a special token.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
# Words of these letters stay as they are composed, and each has one lower case.
_LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"
_LOADED: dict[str, WordTokenizer] = {}


class WaveletMatrix:
    """Succinct sequence of ids: access, rank, select and whole decoding from bit planes."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ones_before: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ones_before = n, zeros, planes, ones_before
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) if len(ids) else 0
        levels = max(1, top.bit_length())
        seq = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, before = [], [], []
        for shift in range(levels - 1, -1, -1):
            bit = seq & seq.dtype.type(1 << shift) != 0
            plane = np.packbits(bit)
            # Masks are slow on bits that look random; lists of places are not.
            low, high = seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))
            zeros.append(len(low))
            planes.append(plane)
            before.append(cls._directory(plane))
            seq = np.concatenate([low, high])
        return cls(len(ids), zeros, planes, before)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        padded = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), dtype=np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        first = block * BLOCK // 8
        inside = np.unpackbits(self.planes[level][first : -(-i // 8)])[: i - block * BLOCK]
        return int(self.ones_before[level][block]) + int(inside.sum())

    def _select(self, level: int, bit: int, k: int) -> int:
        before = self.ones_before[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before), dtype=np.int64) * BLOCK - before
        block = int(np.searchsorted(before, k, side="right")) - 1
        first = block * BLOCK // 8
        inside = np.unpackbits(self.planes[level][first : first + BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(inside == bit)[k - before[block]])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.levels):
            one_lo, one_hi = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + one_lo, self.zeros[level] + one_hi
            else:
                lo, hi = lo - one_lo, hi - one_hi
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of ``token`` before place ``i``."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``token``; -1 if there are fewer."""
        if token >> self.levels:
            return -1
        lo, hi = self._range(token, self.n)
        if not 0 <= k < hi - lo:
            return -1
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        seq = np.zeros(self.n, dtype=kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            up = np.empty(self.n, dtype=kind)
            up[np.flatnonzero(~bit)] = seq[: self.zeros[level]]
            up[np.flatnonzero(bit)] = seq[self.zeros[level] :] | kind(1 << (self.levels - 1 - level))
            seq = up
        return seq


def dump(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> bytes:
    """One shard file."""
    wm, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    named = np.array([x if x is not None else 0 for x in doc_ids], dtype="<i8")
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    parts = [
        np.array([wm.n, len(doc_ids), wm.levels], dtype="<u8").tobytes(), pack(named.tobytes()), pack(nulls.tobytes()),
        pack(counts.astype("<u8").tobytes()),
    ]
    for zeros, plane, before in zip(wm.zeros, wm.planes, wm.ones_before):
        parts += [np.array([zeros], dtype="<u8").tobytes(), pack(plane.tobytes()), pack(before.astype("<u4").tobytes())]
    return b"WMX1" + b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def load(content: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(sequence, document ids, token counts of the documents) of a shard file."""
    if content[:4] != b"WMX1":
        raise ValueError("not a wavelet-matrix shard")
    parts, at = [], 4
    while at < len(content):
        size = int.from_bytes(content[at : at + 8], "little")
        parts.append(content[at + 8 : at + 8 + size])
        at += 8 + size
    n, docs, levels = (int(x) for x in np.frombuffer(parts[0], dtype="<u8"))
    raw = zstandard.ZstdDecompressor().decompress
    named, nulls = np.frombuffer(raw(parts[1]), dtype="<i8"), np.frombuffer(raw(parts[2]), dtype=np.uint8)
    planes = [parts[4 + 3 * i : 7 + 3 * i] for i in range(levels)]
    wm = WaveletMatrix(
        n, [int(np.frombuffer(z, dtype="<u8")[0]) for z, _, _ in planes], [np.frombuffer(raw(p), dtype=np.uint8) for _, p, _ in planes],
        [np.frombuffer(raw(b), dtype="<u4") for _, _, b in planes],
    )
    ids = [None if null else int(x) for x, null in zip(named, nulls)]
    return wm, ids, np.frombuffer(raw(parts[3]), dtype="<u8").astype(np.int64)


class WordTokenizer:
    """A tokenizer file of the tokenizers library; words seen before are looked up.

    This rests on rules that ``piece_counts.cut_at_space`` reads from the file:
    pieces never cross white space, and lower case comes first, so words are
    looked up by a hash without case of A-Z, but for words that may be a special
    token; marks that end a word after an ASCII letter or digit, or a letter of
    ``_LETTERS``, are a piece of their own and looked up by themselves; a word of
    such letters is one pre-token, and where the file marks ends of words
    (``_word_ends``) many of them go to the model in one line.  With other rules,
    whole texts go to the library.  Of n distinct words in one worker's table
    about n^2 / 2^65 pairs share a hash and would get one word's ids: one in ten
    million for two million words.
    """

    def __init__(self, path: str):
        # One task has one core: threads of the library would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_word = cut_at_space(spec)
        self.model = self.tokenizer.model
        self.is_mark = np.zeros(256, dtype=bool)
        self.is_mark[[ord(c) for c in _MARKS if not any(c in t["content"] for t in spec["added_tokens"])]] = True
        self.word_ends = _word_ends(spec) if self.by_word else None
        if self.word_ends is not None:
            self.lines = Tokenizer(self.model)
            self.lines.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flat, self.ends = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        """Once for each Python worker."""
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _learn(self, keys: np.ndarray, words: pa.Array) -> np.ndarray:
        """Slots of new words."""
        one = pc.match_substring_regex(words, _LETTERS if self.word_ends is not None else "^[A-Za-z]+$").to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(one), np.flatnonzero(~one)
        parts = [self._plain(words.take(plain).to_pylist()), self._others(words.take(rest).to_pylist())]
        slots = np.empty(len(keys), dtype=np.int64)
        slots[np.concatenate([plain, rest])] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(keys))
        sizes = np.concatenate([n for _, n in parts])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, *(flat for flat, _ in parts)])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.slots = np.insert(self.keys, at, keys[order]), np.insert(self.slots, at, slots[order])
        return slots

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) of words that are one pre-token."""
        if self.word_ends is None:
            found = [[t.id for t in self.model.tokenize(word.lower())] for word in words]
            return np.fromiter(chain.from_iterable(found), dtype=np.uint32), np.fromiter(map(len, found), dtype=np.int64)
        parts = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))]
        for a in range(0, len(words), ENCODE_WORDS):
            some = words[a : a + ENCODE_WORDS]
            ids = np.array(self.lines.encode_batch_fast([" ".join(some).lower()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            sizes = np.diff(np.flatnonzero(self.word_ends[ids]), prepend=-1)
            # A model that lacks a letter can lose an end.
            parts.append((ids, sizes) if len(sizes) == len(some) else self._others(some))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each word) by all rules of the file."""
        parts = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))]
        for a in range(0, len(words), ENCODE_WORDS):
            some = words[a : a + ENCODE_WORDS]
            # One line for the library; a piece belongs to the word in which it begins.
            starts = np.cumsum([0, *(len(word) + 1 for word in some)])
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            parts.append((np.array(found.ids, dtype=np.uint32), np.diff(np.searchsorted([begin for begin, _ in found.offsets], starts))))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _mark_runs(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where marks that end a word begin."""
        mark, first = self.is_mark[raw], offsets[:-1][offsets[:-1] < offsets[1:]]
        begin, end = mark.copy(), mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[first] = mark[first]
        end[:-1] &= ~_IN_WORD[raw[1:]]
        stop = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[stop] = mark[stop]
        # The last run that begins before an end.
        begins = np.flatnonzero(begin)
        at = begins[np.searchsorted(begins, np.flatnonzero(end), side="right") - 1]
        at = at[~np.isin(at, first)]
        before = raw[at - 1]
        letter = (before >= 0x80) & (raw[at - 2] == 0xC3) & (before != 0x97) & (before != 0xB7)
        return at[_IS_PLAIN[before] | letter]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        if not self.by_word:
            whole = [e.ids for e in self.tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(whole), dtype=np.uint32), np.cumsum([0, *map(len, whole)])
        raw, offsets = split_buffers(column)
        starts = word_starts(raw, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        starts = np.sort(np.concatenate([starts, self._mark_runs(raw, offsets)]))
        keys = run_hashes(raw, starts)
        # Words with "<" keep their case.
        angled = np.unique(np.searchsorted(starts, np.flatnonzero(raw == ord("<")), side="right") - 1)
        for i in angled:
            keys[i] = np.uint64(hash_bytes(self._bytes(raw, starts, i)))
        coded = pa.array(keys).dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        # Places in ascending order are found faster.
        order = np.argsort(distinct)
        ranked = distinct[order]
        place = np.minimum(np.searchsorted(self.keys, ranked), max(0, len(self.keys) - 1))
        known = self.keys[place] == ranked if len(self.keys) else np.zeros(len(ranked), dtype=bool)
        slot_of = np.empty(len(distinct), dtype=np.int64)
        slot_of[order[known]] = self.slots[place[known]]
        new = order[~known]
        if len(new):
            first = np.empty(len(distinct), dtype=np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            slot_of[new] = self._learn(distinct[new], self._words(raw, starts, first[new]))
        slot = slot_of[at]
        begin, sizes = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(begin - before, sizes) + np.arange(int(sizes.sum()))]
        return ids, np.append(before, len(ids))[np.searchsorted(starts, offsets)]

    @staticmethod
    def _words(raw: np.ndarray, starts: np.ndarray, some: np.ndarray) -> pa.Array:
        """The runs ``some`` without their separators."""
        begin, end = starts[some], np.append(starts, len(raw))[some + 1]
        sizes = end - begin
        at = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        real = _IN_WORD[raw[at]]
        kept = np.add.reduceat(real, np.cumsum(sizes) - sizes, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(kept)])
        return pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(raw[at[real]].tobytes()))

    @staticmethod
    def _bytes(raw: np.ndarray, starts: np.ndarray, i: int) -> bytes:
        return raw[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(raw)].tobytes().rstrip(b" \t\n\x0b\x0c\r")


def _word_ends(spec: dict) -> np.ndarray | None:
    """Which ids end a pre-token of letters, where a file's rules let words of ``_LETTERS`` skip its normalizer once in lower case."""
    rules, model = spec.get("normalizer") or {}, spec["model"]
    kinds = {r["type"] for r in rules.get("normalizers", [rules])}
    suffix = model.get("end_of_word_suffix")
    if not suffix or not kinds >= {"Lowercase"} or kinds - {"NFC", "NFKC", "Lowercase", "Replace"}:
        return None
    if any(t["content"].isalpha() for t in spec["added_tokens"]):
        return None
    ends = np.zeros(max(model["vocab"].values()) + 1, dtype=bool)
    ends[[i for piece, i in model["vocab"].items() if piece.endswith(suffix)]] = True
    return ends


def hash_bytes(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Encode every text, append ``end_id``, write shard files in ascending doc_id order; one row per file.

    Documents are ranged by (doc_id, text hash), null doc_id first, and ordered by
    doc_id, then text.  A file closes at the first document end past
    ``shard_tokens``; a longer document lies in one file.  Files are written under
    another name and renamed, so a task that runs twice does no harm.
    """
    home, root = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    home.create_dir(root)
    place = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(place)
        words, part = WordTokenizer.load(tokenizer_path), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        names: list[int | None] = []
        n, seq = 0, 0
        for batch in slices(batches):
            ids, bounds = words.encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                held.append(np.append(ids[a:b], np.uint32(end_id)))
                names.append(doc_id)
                n += int(b - a) + 1
                if n >= shard_tokens:
                    yield _close(fs, base, part, seq, held, names)
                    held, names, n, seq = [], [], 0, seq + 1
        if held:
            yield _close(fs, base, part, seq, held, names)

    ranged = texts(docs).repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return table(ranged.mapInArrow(run, "file string, part long, seq long, documents long, tokens long"), "shards")


def _close(fs, base: str, part: int, seq: int, held: list[np.ndarray], names: list[int | None]) -> pa.RecordBatch:
    name, counts = f"shard-{part:08d}-{seq:06d}.wm", np.array([len(x) for x in held], dtype=np.int64)
    hidden = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(hidden) as out:
        out.write(dump(np.concatenate(held), names, counts))
    fs.move(hidden, f"{base}/{name}")
    return pa.RecordBatch.from_pydict({
        "file": [name], "part": pa.array([part], pa.int64()), "seq": pa.array([seq], pa.int64()),
        "documents": pa.array([len(names)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64()),
    })


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.wm").load(folder).select("path", "content")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                wm, names, counts = load(content.as_py())
                ids = wm.decode().astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_pydict({
                    "file": pa.array([path.as_py().rpartition("/")[2]] * len(names), pa.string()), "doc_id": pa.array(names, pa.int64()),
                    "offset": pa.array(ends - counts, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    docs = _files(spark, folder).mapInArrow(run, "file string, doc_id long, offset long, n_tokens long, ids_crc32 long")
    # One row per file, some millions of tokens each.
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("file", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    return docs.join(starts, "file").select(
        "doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", F.col("file").alias("shard")
    )


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """(shard, place) of every occurrence of a token, by select on each file alone.

    A token that no file holds, an empty folder, and documents without tokens but
    the end id give no rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                wm, _, _ = load(content.as_py())
                places = [wm.select(token, k) for k in range(wm.rank(token, wm.n))]
                name = path.as_py().rpartition("/")[2]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([name] * len(places), pa.string()), "place": pa.array(places, pa.int64())})

    return _files(spark, folder).mapInArrow(run, "shard string, place long")


def round_trip(docs: DataFrame, tokenizer_path: str, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files of all documents and return what they hold, read back.

    Null text is empty text, which is the end id alone.  A null doc_id comes
    first; rows that repeat are written as often as they occur, ties ordered by
    text.  An empty table writes no file and gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "wavelet")
    return read_shards(spark, folder, write_shards(docs, tokenizer_path, folder, shard_tokens))
