"""Ranked lexical search by hashed max-sketches.

A document's impact of each of its terms is folded into a sketch: coordinate
``hash(term) mod WIDTH`` holds the largest impact of the terms that fall there.
The sum of a query's coordinates is then never below the query's score.  A block
of queries is looked up in all sketches at once.  A first pass scores the few
documents of each slice with the highest bounds exactly; the k-th best of all
slices is a threshold for each query.  The second pass scores documents exactly
in descending order of the bound until it falls below the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import lower_ascii, table
from tickloom.llm.postings import listed, postings, with_words, words_of
from tickloom.llm.words import release, split_buffers

TOP = 10
WIDTH = 4096
# Text of the queries that are looked up at once.
QUERY_BLOCK = 2 << 20
FIRST_ROUND = 16
# Maximal runs of these are terms: all but ASCII characters that are neither letter nor digit.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_TERM_BYTES = np.full(256, ord(" "), dtype=np.uint8)
_TERM_BYTES[128:] = np.arange(128, 256)
for _first, _last, _to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
    _TERM_BYTES[ord(_first) : ord(_last) + 1] = np.arange(ord(_last) - ord(_first) + 1) + ord(_to)
INDEX = "slice long, doc_ids array<long>, terms array<string>, weights binary, m binary, starts binary, codes binary, tf binary, sketch binary"
# Impacts that the 8-bit levels of a sketch stand for: none, then each 7 % above the one before.  A weight is below
# 1000 * ln(2^63) and an impact below a million weights, which the highest level is above.
LEVELS = np.concatenate([[0], np.ceil(4096 * 1.07 ** np.arange(255))]).astype(np.int64)


def split_terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence, its text, terms of each text with repeats) of texts."""
    raw, offsets = split_buffers(column)
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_TERM_BYTES[raw].tobytes()))
    lists = pc.ascii_split_whitespace(plain)
    owners = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    found = pc.list_flatten(lists)
    real = pc.binary_length(found).to_numpy(zero_copy_only=False) > 0
    terms = found.filter(pa.array(real)).cast(pa.string()).dictionary_encode()
    owners = owners[real].astype(np.int64)
    return terms.dictionary, terms.indices.to_numpy(zero_copy_only=False), owners, np.bincount(owners, minlength=len(column)).astype(np.int64)


def coordinate(term: Column | str, width: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(width)).cast("int")


def _expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at ``starts`` and have ``sizes``."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _impact(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _index_slice(group: pa.Table, n_docs: int, n_terms: int, width: int) -> pa.RecordBatch:
    """Impacts by document and sketches of one slice."""
    is_doc = pc.is_null(group.column("word"))
    own, rows = group.filter(is_doc), group.filter(pc.invert(is_doc))
    _, place = listed(own.column("docs"))
    ids, sizes = np.empty(len(place), dtype=object), np.zeros(len(place), dtype=np.int64)
    ids[place], sizes[place] = own.column("a").to_pylist(), own.column("b").to_numpy()
    m = 10 + (90 * sizes * n_docs) // max(1, n_terms)
    rows = rows.sort_by("word")
    terms = rows.column("word").combine_chunks().dictionary_encode()
    row, doc = listed(rows.column("docs"))
    weight, tf, at = (rows.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "at"))
    order = np.argsort(doc, kind="stable")
    doc, row = doc[order], row[order]
    # Levels are rounded up, so that a bound stays one.
    level = np.searchsorted(LEVELS, _impact(weight[row], tf[row], m[doc])).astype(np.uint8)
    sketch = np.zeros(width * len(ids), dtype=np.uint8)
    np.maximum.at(sketch, at[row] * len(ids) + doc, level)
    codes = terms.indices.to_numpy(zero_copy_only=False)
    weights = np.zeros(len(terms.dictionary), dtype=np.int64)
    weights[codes] = weight
    packed = {
        "weights": weights, "m": m, "starts": np.searchsorted(doc, np.arange(len(ids) + 1)), "codes": codes.astype("<i4")[row],
        "tf": tf.astype("<i4")[row], "sketch": sketch,
    }
    return pa.RecordBatch.from_pydict({
        "slice": group.column("slice").slice(0, 1).combine_chunks(), "doc_ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
        "terms": pa.array([terms.dictionary.to_pylist()], pa.list_(pa.string())),
        **{c: pa.array([zstandard.compress(np.ascontiguousarray(v).tobytes(), 1)], pa.binary()) for c, v in packed.items()},
    })


def index(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row for a slice of documents (16 MB of text, 4,096 documents at most): frequencies by document, and sketches.

    Weights come from counts over all documents.  Null text has no terms; rows
    that repeat are documents of their own; a null doc_id stays null; an empty
    table has an empty index; columns other than doc_id and text are not read.
    """
    held = postings(docs, lambda: split_terms, "terms")
    counts = held.where("word IS NULL").agg(
        F.count_if(F.col("size") > 0).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("terms")
    ).first()
    n_docs, n_terms = counts["docs"], counts["terms"]
    rarity = F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)
    words = words_of(held).select("word", "eras", F.floor(1000 * F.log(rarity)).alias("weight"), coordinate("word", width).alias("at"))
    # Of a term its weight, frequency and coordinate; of a document (no word) its doc_id and size in their place.
    parts = with_words(held, words, "weight", "at").select(
        "slice", "word", "docs", F.col("weight").alias("a"), F.col("tf").cast("long").alias("b"), "at"
    ).unionByName(held.where("word IS NULL").select(
        "slice", "word", "docs", F.col("doc_id").alias("a"), F.col("size").alias("b"), F.lit(0).alias("at")
    ))

    def run(group: pa.Table) -> pa.Table:
        release()
        return pa.Table.from_batches([_index_slice(group, n_docs, n_terms, width)])

    return parts.groupBy("slice").applyInArrow(run, INDEX)


# (number, places of its terms among those of the block, their coordinates, score that a document must reach)
Query = tuple[int, np.ndarray, np.ndarray, int]


def _best(scores: np.ndarray, ids: list[int | None], docs: np.ndarray, top: int) -> np.ndarray:
    """Places of the ``top`` highest scores, equal ones by ascending doc_id, null last."""
    null = np.array([ids[d] is None for d in docs], dtype=bool)
    named = np.array([ids[d] or 0 for d in docs], dtype=np.int64)
    return np.lexsort((named, null, -scores))[:top]


def _search_slice(row: dict, words: pa.Array, queries: list[Query], width: int, top: int, first: bool) -> Iterator[tuple[int, int | None, int, int]]:
    """(query, doc_id, score, documents scored exactly) of the slice's best documents of each query; ``first``: of the highest bounds only."""
    ids, terms = row["doc_ids"].values.to_pylist(), row["terms"].values
    n = len(ids)
    kinds = {"weights": "<i8", "m": "<i8", "starts": "<i8", "codes": "<i4", "tf": "<i4", "sketch": "u1"}
    weights, m, starts, codes, tf, sketch = (np.frombuffer(zstandard.decompress(row[c].as_buffer()), dtype=k) for c, k in kinds.items())
    sketch = sketch.reshape(width, n)
    asked = np.zeros(len(terms), dtype=bool)
    # The slice's codes of all terms of the block at once; -1 where it lacks a term.
    codes_of = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy(zero_copy_only=False)
    for query, own, places, least in queries:
        bound = np.zeros(n, dtype=np.int64)
        for at in places:
            bound += LEVELS[sketch[at]]
        order = np.flatnonzero(bound >= max(1, least))
        order = order[np.argsort(-bound[order], kind="stable")]
        if first:
            order = order[:FIRST_ROUND]
        known = codes_of[own]
        asked[known[known >= 0]] = True
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        done, step = 0, FIRST_ROUND
        while done < len(order):
            # Equal scores go by doc_id, so a bound that equals the k-th score is looked at too.
            if len(scores) == top and scores.min() > bound[order[done]]:
                break
            some = order[done : done + step]
            sizes = starts[some + 1] - starts[some]
            entries = _expand(starts[some], sizes)
            owner = np.repeat(np.arange(len(some)), sizes)
            hit = np.flatnonzero(asked[codes[entries]])
            entries, owner = entries[hit], owner[hit]
            exact = np.zeros(len(some), dtype=np.int64)
            np.add.at(exact, owner, _impact(weights[codes[entries]], tf[entries].astype(np.int64), m[some[owner]]))
            docs, scores = np.concatenate([docs, some[exact > 0]]), np.concatenate([scores, exact[exact > 0]])
            best = _best(scores, ids, docs, top)
            docs, scores = docs[best], scores[best]
            done, step = done + len(some), min(2 * step, 512)
        asked[known[known >= 0]] = False
        for doc, score in zip(docs, scores):
            yield query, ids[doc], int(score), done


def _query_terms(items: DataFrame, width: int) -> DataFrame:
    """(item_id, terms, places, block): the distinct terms of all texts of an item."""
    found = items.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))).alias("term")).distinct()
    return found.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))


def search(index_: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH, block_text: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` documents with a score above 0, and rescored: the slice's documents scored exactly.

    Queries are taken to the slices in blocks of about ``block_text`` characters,
    one after the other, which also bounds what the driver holds; each slice gives
    its best documents of each query, and the best of those are ranked, equal
    scores by doc_id, null last.  Texts with
    one item_id (null too) are one query, which holds each term once.  A query
    without a term, or whose terms no document holds, has no row.
    """
    spark = items.sparkSession
    asked = table(_query_terms(items, width), "queries")
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.length(t)))).first()[0]
    if size is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, rescored long")
    blocks = int(size // block_text) + 1
    index_ = table(index_, "index", "zstd")
    numbered = asked.select("item_id", "terms", F.transform("terms", lambda t: coordinate(t, width)).alias("places"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))

    def found(block: int) -> DataFrame:
        some = numbered.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()

        def best(least: dict[int, int], first: bool) -> DataFrame:
            queries = [(k, r["terms"], r["places"], least.get(k, 0)) for k, r in enumerate(some)]
            rows = index_.mapInArrow(_finder(queries, width, top, first), "query int, doc_id long, score long, rescored long")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

        # One row for each query of the block.
        least = {r["query"]: r["score"] for r in best({}, True).where(F.col("rank") == top).collect()}
        ids = spark.createDataFrame([(k, r["item_id"]) for k, r in enumerate(some)], "query int, item_id long")
        return best(least, False).join(ids, "query").select("item_id", "rank", "doc_id", "score", "rescored")

    return reduce(DataFrame.unionByName, map(found, range(blocks)))


def _finder(asked: list[tuple], width: int, top: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array([t for _, terms, *_ in asked for t in terms], pa.string()).dictionary_encode()
        ends = np.cumsum([0, *(len(terms) for _, terms, *_ in asked)])
        own = words.indices.to_numpy(zero_copy_only=False)
        queries = [(k, own[a:b], np.array(places, dtype=np.int64), least) for (k, _, places, least), a, b in zip(asked, ends[:-1], ends[1:])]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                rows = list(_search_slice(row, words.dictionary, queries, width, top, first))
                release()
                yield pa.RecordBatch.from_pydict({
                    "query": pa.array([q for q, *_ in rows], pa.int32()), "doc_id": pa.array([d for _, d, *_ in rows], pa.int64()),
                    "score": pa.array([s for *_, s, _ in rows], pa.int64()), "rescored": pa.array([x for *_, x in rows], pa.int64()),
                })

    return run


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """Search of all ``docs`` (doc_id, text) for all ``items`` (item_id, text); see ``index`` and ``search``."""
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    return search(index(docs, width), named, top, width).drop("rescored")


# The definition itself: every document's score for every item, without sketches.
RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(terms) > 0)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
o AS (SELECT r, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM o GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10"""
