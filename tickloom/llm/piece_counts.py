"""Token counts of documents from the pieces of each distinct pre-token.

Texts are cut as the tokenizer cuts them, and the frequencies of pre-tokens in
documents go to a bucket of the pre-token.  There the pieces of each distinct
pre-token are counted once, joined to its frequencies, and summed by document.
No ids are made for a document.

Buckets are of one era, ``ERA_SLICES`` slices of each of ``ERA_TASKS`` tasks, so that
what comes together is bounded however large the table and its files are, and a
document has at most ``BUCKETS`` sums to add.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import texts
from tickloom.llm.postings import by_name, by_word, listed, places
from tickloom.llm.words import release, slices

LIMIT = 2048
SLICE_TEXT = 24 << 20
SLICE_DOCS = 1 << 16
# Text that is cut at a time: temporary arrays are some ten times as large.
CUT_TEXT = 6 << 20
ERA_TASKS, ERA_SLICES, BUCKETS = 16, 2, 32
# Stretches of text that are handed to the library at once.
TOGETHER = 1000
# Pre-tokens of these patterns never hold ASCII white space, and no match looks beyond it.
CUT_AT_SPACE = (
    "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
)
# Normalizers that change nothing across ASCII white space.
LOCAL_NORMALIZERS = ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents", "Replace")
_OTHER_SPACE = re.compile(r"[^\S ]")
# First letter of a key: a pre-token, or a stretch of text with a special string, which the tokenizer reads whole.
PRE, WHOLE = "p", "w"


class PreTokens:
    """The cuts of a tokenizer file of the tokenizers library, and its pieces for each."""

    def __init__(self, path: str):
        # One task has one core: threads of the library would only hold memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            self.spaced = cut_at_space(json.load(file))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    @functools.cache
    def load(path: str) -> PreTokens:
        """Once for each Python worker."""
        return PreTokens(path)

    def _whole(self, chunk: str) -> list[str]:
        if any(s in chunk for s in self.special):
            return [WHOLE + chunk]
        text = self.tokenizer.normalizer.normalize_str(chunk) if self.tokenizer.normalizer else chunk
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text) if self.tokenizer.pre_tokenizer else [(text, None)]
        return [PRE + word for word, _ in cut]

    def keys(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """Keys of the pre-tokens of stretches of text, in order, and how many each has."""
        out: list[str] = []
        sizes = np.zeros(len(chunks), dtype=np.int64)
        for a in range(0, len(chunks), TOGETHER):
            some = chunks[a : a + TOGETHER]
            line = " ".join(some)
            # Other white space would become a separator, or be one with it; so would an empty stretch.
            if self.spaced and all(some) and not _OTHER_SPACE.search(line) and not any(s in line for s in self.special):
                line = self.tokenizer.normalizer.normalize_str(line)
                lengths = np.array([len(x) for x in line.split(" ")])
                if len(lengths) == len(some):
                    cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(line)
                    starts = np.cumsum(lengths + 1) - (lengths + 1)
                    at = np.searchsorted(starts, [begin for _, (begin, _) in cut], side="right") - 1
                    sizes[a : a + len(some)] = np.bincount(at, minlength=len(some))
                    out += [PRE + word for word, _ in cut]
                    continue
            for i, chunk in enumerate(some):
                found = self._whole(chunk)
                sizes[a + i] = len(found)
                out += found
        return out, sizes

    def pieces(self, key: str) -> int:
        if key[0] == WHOLE:
            return len(self.tokenizer.encode(key[1:], add_special_tokens=False).ids)
        return len(self.tokenizer.model.tokenize(key[1:]))

    def split(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, key, document and frequency of each pair of a document and a key in one stretch, bytes of each document)."""
        column = column.fill_null("")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        lists = pc.ascii_split_whitespace(column) if self.spaced else pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1), pa.int32()), column)
        owners = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        chunks = pc.list_flatten(lists)
        real = pc.greater(pc.binary_length(chunks), 0)
        owners, chunks = owners[real.to_numpy(zero_copy_only=False)], chunks.filter(real).dictionary_encode()
        # Counted by chunk first, as a pair of chunk and document occurs more than once.
        n = max(1, len(column))
        pairs, times = np.unique(chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + owners, return_counts=True)
        keys, sizes_of = self.keys(chunks.dictionary.to_pylist())
        distinct = pa.array(keys, pa.string()).dictionary_encode()
        codes, first = distinct.indices.to_numpy(zero_copy_only=False), np.cumsum(sizes_of) - sizes_of
        chunk, owner = pairs // n, pairs % n
        some = sizes_of[chunk]
        words = codes[np.repeat(first[chunk] - (np.cumsum(some) - some), some) + np.arange(int(some.sum()))]
        return distinct.dictionary, words, np.repeat(owner, some), np.repeat(times, some), sizes


def cut_at_space(spec: dict) -> bool:
    """Whether texts may be cut at ASCII white space before the tokenizer's own steps, by its file."""

    def parts(step: dict | None, of: str) -> list[dict]:
        return [] if step is None else step[of] if step["type"] == "Sequence" else [step]

    rules = parts(spec.get("normalizer"), "normalizers")
    if any(r["type"] not in LOCAL_NORMALIZERS or r["type"] == "Replace" and (r["pattern"], r["content"]) != ({"Regex": "\\s+"}, " ") for r in rules):
        return False
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or len(t["content"].split()) != 1 for t in spec["added_tokens"]):
        return False
    cuts = parts(spec.get("pre_tokenizer"), "pretokenizers")
    return (
        len(cuts) > 0 and cuts[0]["type"] == "Split" and cuts[0]["pattern"].get("Regex") in CUT_AT_SPACE
        and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        and all(c["type"] == "ByteLevel" and not c["add_prefix_space"] and not c["use_regex"] for c in cuts[1:])
    )


def _frequencies(batches: Iterator[pa.RecordBatch], tokens: PreTokens) -> Iterator[pa.RecordBatch]:
    """Rows (word, tf, places of documents as 16-bit numbers) of each slice, and a row without word for each document."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in slices(batches, size=SLICE_TEXT, rows=SLICE_DOCS):
        distinct, words, owners, times, sizes = _split(batch, tokens)
        distinct, words = by_name(distinct, words)
        word, tf, ends, found = by_word(words, owners, batch.num_rows, times)
        yield _rows(len(word), part, seq, word=distinct.take(pa.array(word)), tf=pa.array(tf, pa.int32()), docs=places(ends, found))
        own = places(np.arange(batch.num_rows + 1), np.arange(batch.num_rows))
        yield _rows(batch.num_rows, part, seq, docs=own, doc_id=batch.column("doc_id"), size=pa.array(sizes, pa.int64()))
        seq += 1
        del distinct, words, owners, times, sizes, word, tf, ends, found, own
        release()


def _split(batch: pa.RecordBatch, tokens: PreTokens) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``PreTokens.split`` of a slice, a part of its text at a time."""
    keys, held, first = [], [], 0
    for part in slices(iter([batch]), size=CUT_TEXT):
        distinct, words, owners, times, sizes = tokens.split(part.column("text"))
        keys.append(distinct)
        held.append((words.astype(np.int32), (owners + first).astype(np.int32), times.astype(np.int32), sizes))
        first += part.num_rows
    if not keys:
        return tokens.split(batch.column("text"))
    every = pa.concat_arrays(keys).dictionary_encode()
    code, at, out = every.indices.to_numpy(), 0, []
    for distinct, (words, owners, times, sizes) in zip(keys, held):
        out.append((code[at + words], owners, times, sizes))
        at += len(distinct)
    return every.dictionary, *(np.concatenate(column) for column in zip(*out))


def _rows(n: int, part: int, seq: int, **columns: pa.Array) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "tf": pa.int32(), "docs": pa.binary(), "doc_id": pa.int64(), "size": pa.int64()}
    placed = {"slice": pa.array(np.full(n, part << 32 | seq)), "era": pa.array(np.full(n, _era(part, seq), np.int64))}
    return pa.RecordBatch.from_pydict(placed | {c: columns.get(c, pa.nulls(n, k)) for c, k in kinds.items()})


def _era(part: int, seq: int) -> int:
    return part // ERA_TASKS << 32 | seq // ERA_SLICES


def _summed(group: pa.Table, tokens: PreTokens) -> pa.Table:
    """Pieces of the documents of a group, from its words: (slice, place, n), and what it holds of the documents themselves."""
    is_doc = pc.is_null(group.column("word"))
    own, rows = group.filter(is_doc), group.filter(pc.invert(is_doc)).combine_chunks()
    parts = []
    if rows.num_rows:
        words = rows.column("word").combine_chunks().dictionary_encode()
        # Each distinct pre-token once.
        pieces = np.array([tokens.pieces(w) for w in words.dictionary.to_pylist()], dtype=np.int64)
        n = pieces[words.indices.to_numpy()] * rows.column("tf").to_numpy()
        names, code = np.unique(rows.column("slice").to_numpy(), return_inverse=True)
        del words, pieces
        # The words of a slice at a time.
        order = np.argsort(code, kind="stable")
        ends = np.searchsorted(code[order], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            mine = order[ends[k] : ends[k + 1]]
            row, place = listed(rows.column("docs").take(pa.array(mine)))
            # Whole numbers below 2^53 stay exact as weights.
            total = np.bincount(place, weights=n[mine][row])
            held = np.flatnonzero(total)
            parts.append(pa.table({"slice": np.full(len(held), name), "place": held.astype(np.int32), "n": total[held].astype(np.int64),
                                   "doc_id": pa.nulls(len(held), pa.int64()), "size": pa.nulls(len(held), pa.int64())}))
    if own.num_rows:
        parts.append(pa.table({"slice": own.column("slice"), "place": listed(own.column("docs"))[1].astype(np.int32), "n": np.zeros(own.num_rows, np.int64), "doc_id": own.column("doc_id"), "size": own.column("size")}))
    return pa.concat_tables(parts)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer_path`` is a .json file of the tokenizers library on every
    executor; truncation and padding of the file are off, special strings in a
    text count as the library reads them.  Where the file's rules do not allow
    cutting at white space, a text is read whole.  Null text is empty text: no
    tokens.  Texts of any length are read whole.  Rows that repeat each get their
    row; a null doc_id stays null; an empty table gives an empty result; columns
    other than doc_id and text are not read.  A document is known by its place in
    its task, so ``docs`` must come in the same order if a task runs again, as
    from files.
    """
    if not tokenizer_path.endswith(".json"):
        raise ValueError(f"{tokenizer_path} is no file of the tokenizers library")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frequencies(batches, PreTokens.load(tokenizer_path))

    def summed(group: pa.Table) -> pa.Table:
        # What earlier groups of this worker have left.
        release()
        return _summed(group, PreTokens.load(tokenizer_path))

    held = texts(docs).mapInArrow(cut, "slice long, era long, word string, tf int, docs binary, doc_id long, size long")
    bucket = F.pmod(F.xxhash64(F.coalesce("word", F.col("slice").cast("string"))), F.lit(BUCKETS)).cast("int")
    parts = held.withColumn("bucket", bucket).groupBy("era", "bucket").applyInArrow(summed, "slice long, place int, n long, doc_id long, size long")
    return parts.groupBy("slice", "place").agg(F.max("doc_id").alias("doc_id"), F.max("size").alias("n_bytes"), F.sum("n").alias("n_tokens")).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
