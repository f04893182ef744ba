"""Frequencies of words in documents, held by word: one row for a slice of documents, a word and a frequency.

A slice is some megabytes of text of one task.  Its row for a word lists the
slice's documents that hold the word so many times, as 16-bit places in the
slice, so a frequency costs two bytes and a common word one row, not one row for
each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import table, texts
from tickloom.llm.words import release, slices

SLICE_TEXT = 16 << 20
SLICE_DOCS = 4096
# Tasks whose slices share one copy of a word's row in a join.
ERA_TASKS = 64
SCHEMA = "slice long, era int, word string, tf int, docs binary, doc_id long, size long"
# (distinct words, word of each occurrence, document of each occurrence, a size of each document)
Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]


def by_word(words: np.ndarray, owners: np.ndarray, n_docs: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, frequency, first entry) of each row and the end, and the documents they list; an entry counts once, or ``times``."""
    pairs = words.astype(np.int64) * max(1, n_docs) + owners
    if times is None:
        pairs, tf = np.unique(pairs, return_counts=True)
    else:
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        tf = np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
        pairs = pairs[first]
    word, doc = pairs // max(1, n_docs), pairs % max(1, n_docs)
    order = np.lexsort((tf, word))  # stable: documents stay ascending
    word, doc, tf = word[order], doc[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (tf[1:] != tf[:-1])])) if len(word) else np.zeros(0, np.int64)
    return word[first], tf[first], np.append(first, len(word)), doc.astype(np.int32)


def by_name(distinct: pa.Array, words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in order, and the words in terms of it: neighbours share their beginnings, which files and shuffles press together."""
    order = pc.sort_indices(distinct).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return distinct.take(pa.array(order)), rank[words]


def places(ends: np.ndarray, listed: np.ndarray) -> pa.Array:
    """Lists of 16-bit places, one from each entry of ``ends`` to the next."""
    packed = pa.py_buffer(listed.astype("<u2").tobytes())
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype("<i4").tobytes()), packed])


def listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(list of each place, place) of ``places``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], dtype="<u2")[offsets[0] // 2 : offsets[-1] // 2].astype(np.int64)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // 2), flat


def postings(docs: DataFrame, split: Callable[[], Split], name: str) -> DataFrame:
    """Written table of the frequencies of all documents.

    Rows with a word: (slice, era, word, tf, docs), ``docs`` being places in the
    slice.  Rows without: one for each document, with its place in ``docs``, its
    doc_id and the size that ``split`` gives it.  ``split()`` is called once in
    each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, part, seq = split(), TaskContext.get().partitionId(), 0
        for batch in slices(batches, size=SLICE_TEXT, rows=SLICE_DOCS):
            n = batch.num_rows
            distinct, words, owners, sizes = cut(batch.column("text"))
            distinct, words = by_name(distinct, words)
            word, tf, ends, found = by_word(words, owners, n)
            for rows, columns in (
                (len(word), {"word": distinct.take(pa.array(word)), "tf": pa.array(tf, pa.int32()),
                             "docs": places(ends, found)}),
                (n, {"docs": places(np.arange(n + 1), np.arange(n)), "doc_id": batch.column("doc_id"), "size": pa.array(sizes, pa.int64())}),
            ):
                kinds = {"word": pa.string(), "tf": pa.int32(), "doc_id": pa.int64(), "size": pa.int64()}
                full = {c: columns.get(c, pa.nulls(rows, k)) for c, k in kinds.items()} | {"docs": columns["docs"]}
                full["slice"], full["era"] = pa.array(np.full(rows, part << 32 | seq)), pa.array(np.full(rows, part // ERA_TASKS, np.int32))
                yield pa.RecordBatch.from_pydict({c: full[c] for c in ("slice", "era", "word", "tf", "docs", "doc_id", "size")})
            seq += 1
            release()

    return table(texts(docs).mapInArrow(run, SCHEMA), name, "zstd")


def words_of(held: DataFrame) -> DataFrame:
    """(word, df, eras): distinct words, how many documents hold each, and where a join needs a copy of it."""
    return held.where("word IS NOT NULL").groupBy("word").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df"), F.collect_set("era").alias("eras"))


def with_words(held: DataFrame, words: DataFrame, *columns: str) -> DataFrame:
    """Frequencies joined with what ``words`` (word, eras, ``columns``) says of their word.

    The key is (word, era), so the commonest word brings together the slices of
    ``ERA_TASKS`` tasks, however many documents there are.
    """
    copies = words.select("word", F.explode("eras").alias("era"), *columns)
    return held.where("word IS NOT NULL").select("slice", "era", "word", "tf", "docs").join(copies, ["word", "era"])
