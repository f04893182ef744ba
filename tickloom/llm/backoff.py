"""Stupid-backoff language-model scores with counts over all documents.

Documents are dealt by hash to batches of a few megabytes.  A batch asks for the
corpus counts of its distinct n-grams: one sorted, packed request for each bucket of
n-gram hashes, with the batch's own counts, so a very frequent n-gram is one entry
per batch.  A bucket is one part of the count table: it adds the requests up and
answers each in the same order.  Answers meet their batch again, where scores are
summed per document.  Counts of words and pairs come first; longer n-grams are
asked for only where all shorter ones inside them reach the cutoff, as no others can.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import table, texts
from tickloom.llm.words import mix, word_hashes

ORDER = 3
BACKOFF = 0.4
CUTOFF = 2
BATCH_CHARS = 12_000_000
BUCKET_ENTRIES = 2_500_000
HASH_BITS = 56
_REQUEST = "batch long, n int, bucket long, packed binary"


def gram_hashes(hashes: np.ndarray, owner: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word; 0 where the text has fewer words before it."""
    out = [hashes >> np.uint64(64 - HASH_BITS)]
    run = hashes
    for n in range(2, order + 1):
        longer = np.zeros_like(hashes)
        if len(hashes) >= n:
            inside = owner[n - 1 :] == owner[: 1 - n]
            longer[n - 1 :] = np.where(inside, mix(run[n - 2 : -1] * np.uint64(0x2545F4914F6CDD1D) + hashes[n - 1 :] + np.uint64(n)), np.uint64(0))
        run = longer
        out.append(run >> np.uint64(64 - HASH_BITS))
    return out


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of sorted hashes, in the same order."""
    return ((values >> np.uint64(HASH_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct hashes as 5-byte steps (8 bytes if a step is larger), and their counts; high bytes and counts squeezed."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = 5 if len(steps) < 2 or int(steps[1:].max()) < 1 << 40 else 8
    raw = np.ascontiguousarray(steps[1:]).astype("<u8").view(np.uint8).reshape(-1, 8)
    high = _squeeze(np.ascontiguousarray(raw[:, 4:width]).tobytes())
    head = np.array([len(values), width, int(values[0]), len(high)], dtype="<u8").tobytes()
    return head + raw[:, :4].tobytes() + high + _pack_counts(counts)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers, or as 64-bit ones if one needs it."""
    kind = "<u4" if not len(counts) or int(counts.max()) < 1 << 32 else "<u8"
    return kind[2:].encode() + _squeeze(counts.astype(kind).tobytes())


def _unpack_counts(blob: bytes) -> np.ndarray:
    return np.frombuffer(_spread(blob[1:]), dtype="<u" + blob[:1].decode())


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, first, high = (int(x) for x in np.frombuffer(blob, dtype="<u8", count=4))
    end = 32 + (n - 1) * 4
    steps = np.zeros((n, 8), dtype=np.uint8)
    steps[1:, :4] = np.frombuffer(blob, dtype=np.uint8, count=(n - 1) * 4, offset=32).reshape(n - 1, 4)
    steps[1:, 4:width] = np.frombuffer(_spread(blob[end : end + high]), dtype=np.uint8).reshape(n - 1, width - 4)
    values = steps.view("<u8").ravel().astype(np.uint64)
    values[0] = first
    return np.cumsum(values, dtype=np.uint64), _unpack_counts(blob[end + high :])


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=5).compress(raw)


def _spread(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


class _Batch:
    """Texts of a batch in a fixed order, with the n-gram hashes of each word."""

    def __init__(self, rows: pa.Table, order: int):
        self.rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        hashes, self.bounds = word_hashes(self.rows.column("text"))
        self.owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        self.grams = gram_hashes(hashes, self.owner, order)
        self.counts: dict[int, np.ndarray] = {}

    def asked(self, n: int, cutoff: int) -> np.ndarray:
        """Words whose n-gram is asked for."""
        if n <= 2:
            return self.grams[n - 1] != 0
        shorter = self.counts[n - 1] >= cutoff
        return (self.grams[n - 1] != 0) & shorter & np.concatenate([[False], shorter[:-1]])

    def read(self, answers: pa.Table, orders: range, cutoff: int) -> None:
        """Counts of each word's n-gram from the answers; 0 where it was not asked for."""
        for n in orders:
            own = answers.filter(pc.equal(answers.column("n"), n)).sort_by("bucket").column("packed").to_pylist()
            total = [_unpack_counts(x) for x in own]
            asked = self.asked(n, cutoff)
            _, at = np.unique(self.grams[n - 1][asked], return_inverse=True)
            self.counts[n] = np.zeros(len(asked), dtype=np.int64)
            if total:
                self.counts[n][asked] = np.concatenate(total)[at]

    def requests(self, batch: int, orders: range, buckets: int, cutoff: int) -> pa.Table:
        out = {"batch": [], "n": [], "bucket": [], "packed": []}
        for n in orders:
            values, counts = np.unique(self.grams[n - 1][self.asked(n, cutoff)], return_counts=True)
            where = _bucket(values, buckets)
            cuts = np.flatnonzero(np.diff(where, prepend=np.uint64(buckets + 1)) != 0)
            for a, b in zip(cuts, np.append(cuts[1:], len(values))):
                for name, x in (("batch", batch), ("n", n), ("bucket", int(where[a])), ("packed", pack(values[a:b], counts[a:b]))):
                    out[name].append(x)
        kinds = {"batch": pa.int64(), "n": pa.int32(), "bucket": pa.int64(), "packed": pa.binary()}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})


def _answer(rows: pa.Table) -> pa.Table:
    """One part of the count table: add up the requests, answer each."""
    read = [unpack(x) for x in rows.column("packed").to_pylist()]
    _, at = np.unique(np.concatenate([v for v, _ in read]), return_inverse=True)
    sums = np.zeros(int(at.max()) + 1, dtype=np.int64)
    np.add.at(sums, at, np.concatenate([c for _, c in read]).astype(np.int64))
    total = sums[at]
    ends = np.cumsum([len(v) for v, _ in read])
    answers = [_pack_counts(total[e - len(v) : e]) for e, (v, _) in zip(ends, read)]
    return pa.table({"batch": rows.column("batch"), "n": rows.column("n"), "bucket": rows.column("bucket"), "packed": pa.array(answers, pa.binary())})


def scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, cutoff: int = CUTOFF, batch_chars: int = BATCH_CHARS, bucket_entries: int = BUCKET_ENTRIES,
) -> DataFrame:
    """Per document: doc_id, n_words, log_score (sum of log S over its words), mean_log_score, and how many words each order gave.

    S(w | context) = count(context w) / count(context) if the n-gram occurs
    ``cutoff`` times in the corpus, else ``backoff`` times S with a context one word
    shorter; a single word gives count(w) / all words.  Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; contexts do not cross documents.
    Null or empty text has 0 words, log_score 0 and no mean.  Rows that repeat
    count as often as they occur and each get their row; a null doc_id stays
    null; an empty table gives an empty result; other columns are not read.
    """
    docs = texts(docs)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    batches, buckets = max(1, -(-chars // batch_chars)), max(1, -(-chars // (5 * bucket_entries)))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("batch"))
    first, later = range(1, min(order, 2) + 1), range(3, order + 1)

    def ask(rows: pa.Table) -> pa.Table:
        return _Batch(rows, 2).requests(rows.column("batch")[0].as_py(), first, buckets, cutoff)

    answers = dealt.groupBy("batch").applyInArrow(ask, _REQUEST).groupBy("n", "bucket").applyInArrow(_answer, _REQUEST)
    for n in later:
        answers = answers.unionByName(_ask_more(dealt, answers, n, buckets, cutoff))

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = _Batch(rows, order)
        batch.read(found, range(1, order + 1), cutoff)
        value, used = _log_scores(batch, order, backoff, cutoff)
        size = len(batch.bounds) - 1
        columns = {"doc_id": batch.rows.column("doc_id"), "n_words": pa.array(np.diff(batch.bounds), pa.int64())}
        columns["known"] = pa.array(np.bincount(batch.owner, weights=value, minlength=size), pa.float64())
        for n in range(1, order + 1):
            columns[f"from_{n}"] = pa.array(np.bincount(batch.owner[used == n], minlength=size), pa.int64())
        return pa.table(columns)

    schema = "doc_id long, n_words long, known double, " + ", ".join(f"from_{n} long" for n in range(1, order + 1))
    out = table(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, schema), "scores")
    words = out.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"))
    log_score = F.col("known") - F.when(F.col("from_1") > 0, F.col("from_1") * F.log("words")).otherwise(F.lit(0.0))
    out = out.crossJoin(F.broadcast(words)).withColumn("log_score", log_score)  # one row
    return out.select(
        "doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
        *[f"from_{n}" for n in range(1, order + 1)],
    )


def _ask_more(dealt: DataFrame, answers: DataFrame, n: int, buckets: int, cutoff: int) -> DataFrame:
    def ask(rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = _Batch(rows, n)
        batch.read(found, range(1, n), cutoff)
        return batch.requests(rows.column("batch")[0].as_py(), range(n, n + 1), buckets, cutoff)

    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask, _REQUEST).groupBy("n", "bucket").applyInArrow(_answer, _REQUEST)


def _log_scores(batch: _Batch, order: int, backoff: float, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """(log S of each word, without -log(all words) where a single word gave it; the order that gave it)."""
    size = len(batch.owner)
    value, used = np.zeros(size), np.zeros(size, dtype=np.int64)
    for n in range(order, 0, -1):
        here = batch.counts[n]
        hit = (used == 0) & (batch.grams[n - 1] != 0) & ((here >= cutoff) if n > 1 else (here > 0))
        value[hit] = np.log(here[hit])
        if n > 1:
            before = np.concatenate([[0], batch.counts[n - 1][:-1]])
            value[hit] -= np.log(before[hit])
        # Shorter contexts cost a factor each; a word near the start of its text has fewer to lose.
        at = np.arange(size) - batch.bounds[:-1][batch.owner]
        value[hit] += np.log(backoff) * np.maximum(0, np.minimum(order, at[hit] + 1) - n)
        used[hit] = n
    return value, used
