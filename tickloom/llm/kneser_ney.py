"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

N-grams of all trusted documents that may be fitted are counted by grouped tables;
discounts come from their counts of counts; what each n-gram and each context
contributes is one entry (hash, value), in shards by hash.  Documents are dealt by
hash to batches of a few megabytes.  A batch asks each shard for its distinct words
and pairs, later for those trigrams whose pairs are known; a shard answers each
request in its order, and answers meet their batch again.  So a task holds one batch,
or one shard and the requests to it, never the model.  Thresholds are quantiles of the
perplexity of all other trusted documents by language.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.backoff import HASH_BITS, pack, unpack
from tickloom.llm.common import WORD, scratch, table, texts
from tickloom.llm.words import mix, release, slices, word_hashes

# A language's documents are ranked in so many parts first, so that no task ranks them all.
RANK_PARTS = 64
BROADCAST_ROWS = 2_000_000
SHARDS = 16
# Characters of a batch, and of all documents for each shard: bounds of what a task holds.
BATCH_CHARS = 6_000_000
SHARD_CHARS = 12_000_000
# Rows of the model that are packed at once.
PACK_ROWS = 1 << 20
QUANTILE = 0.99
MARGIN = 1.25
SEED = 29
START, END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
_REQUEST, _ANSWER = "batch long, shard long, packed binary", "batch long, shard long, n long, value0 binary, value1 binary, total1 binary"
_MODEL = "level int, slot int, shard long, packed binary, value binary, total binary"


def language_hash(names: list[str | None]) -> np.ndarray:
    """Of each language, by all its bytes; null is a language of its own."""
    out = [int.from_bytes(hashlib.blake2b(("\0" if x is None else "=" + x).encode(), digest_size=8).digest(), "little") for x in names]
    return np.array(out, dtype=np.uint64)


def padded(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(two words back, one back, word, text) for each word and the end of each text that has words."""
    counts = np.diff(bounds)
    full = np.flatnonzero(counts > 0)
    sizes = counts[full] + 3
    ends = np.cumsum(sizes)
    line = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    inside = np.ones(len(line), dtype=bool)
    for at, value in ((ends - sizes, START), (ends - sizes + 1, START), (ends - 1, END)):
        line[at], inside[at] = value, False
    line[inside] = hashes
    owner = np.repeat(full, sizes)
    real = np.ones(len(line), dtype=bool)
    real[ends - sizes], real[ends - sizes + 1] = False, False
    at = np.flatnonzero(real)
    return line[at - 2], line[at - 1], line[at], owner[at]


def keys(lang: np.ndarray, *words: np.ndarray, kind: int) -> np.ndarray:
    """Hash of (kind, language, words)."""
    out = mix(lang + np.uint64(kind))
    for w in words:
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + w)
    return out >> np.uint64(64 - HASH_BITS)


# Kinds of rows: discounted count of a trigram; weight left by its context, with its total; the same for pairs; probability of words.
TRI, TRI_LEFT, PAIR, PAIR_LEFT, WORD_P, UNSEEN = 1, 2, 3, 4, 5, 6
# Of each kind: words of its key, kind of its key, level (request that asks for it), slot (a key is an n-gram and a context).
PLACES = {TRI: ("uvw", TRI, 2, 0), TRI_LEFT: ("uv", PAIR, 1, 1), PAIR: ("uv", PAIR, 1, 0), PAIR_LEFT: ("u", WORD_P, 1, 1), WORD_P: ("u", WORD_P, 1, 0), UNSEEN: ("", UNSEEN, 1, 0)}


def roles(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """(__id, __lang, __place, __fit, __limit) of each trusted (quality = 1) document with words: may be fitted, sets the threshold.

    A hashed half of the ids is fitted and the others set thresholds.  Where all
    of a language fall in one half, the first by hash is fitted and the others
    set the threshold; a single document does both.
    """
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    mine = texts(docs, F.col("lang").cast("string").alias("__lang")).where(F.col("text").rlike(WORD)).select("doc_id", "__lang")
    held = mine.join(ids, mine["doc_id"] == ids["__id"]).select("__id", "__lang").distinct()
    half = F.pmod(F.xxhash64(F.lit(seed + 1), "__id"), F.lit(2)) == 0
    held = held.withColumns({"__half": half, "__place": F.struct(F.xxhash64(F.lit(seed), "__id").alias("hash"), F.col("__id").alias("id"))})
    per = held.groupBy(F.col("__lang").alias("__of")).agg(
        F.count("*").alias("__all"), F.sum(F.col("__half").cast("long")).alias("__halves"), F.min("__place").alias("__first")
    )
    met = held.join(F.broadcast(per), held["__lang"].eqNullSafe(per["__of"]))  # one row per language
    split = (F.col("__halves") > 0) & (F.col("__halves") < F.col("__all"))
    fit = F.when(split, F.col("__half")).otherwise(F.col("__place") == F.col("__first"))
    return met.withColumn("__fit", fit).select("__id", "__lang", "__place", "__fit", (~F.col("__fit") | (F.col("__all") == 1)).alias("__limit"))


def sample(docs: DataFrame, labels: DataFrame, n: int | None = None, seed: int = SEED, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, lang) of the trusted documents that may be fitted: all, or the first ``n`` by hash in each language."""
    known = roles(docs, labels, seed) if known is None else known
    fit = known.where("__fit").withColumn("__part", F.pmod(F.col("__place.hash"), F.lit(RANK_PARTS)))
    for group in (["__lang", "__part"], ["__lang"]) if n is not None else ():
        fit = fit.withColumn("__rank", F.row_number().over(Window.partitionBy(*group).orderBy("__place"))).where(F.col("__rank") <= n)
    some = table(fit.select("__id", "__lang"), "sample")
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    mine = texts(docs, F.col("lang").cast("string").alias("lang"))
    return mine.join(some, (mine["doc_id"] == some["__id"]) & mine["lang"].eqNullSafe(some["__lang"])).drop("__id", "__lang")


def trigram_counts(mine: DataFrame) -> DataFrame:
    """(lang, u, v, w, n) as 64-bit hashes, placed by (lang, u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang = language_hash(batch.column("lang").to_pylist())
            u, v, w, owner = padded(*word_hashes(batch.column("text")))
            rows = np.stack([lang[owner], u, v, w], axis=1)
            distinct, n = np.unique(rows, axis=0, return_counts=True) if len(rows) else (rows, np.zeros(0, np.int64))
            columns = [pa.array(np.ascontiguousarray(distinct[:, i]).view(np.int64)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["lang", "u", "v", "w", "n"])

    # Slices have few repeats left to add up before the shuffle; trigrams of a context then meet once for all steps.
    counted = mine.mapInArrow(run, "lang long, u long, v long, w long, n long").repartition("lang", "u", "v")
    return counted.groupBy("lang", "u", "v", "w").agg(F.sum("n").alias("n"))


def _discounts(counted: DataFrame) -> DataFrame:
    """Per language D1, D2, D3 from how many n-grams occur 1, 2, 3 and 4 times (Chen and Goodman)."""
    n = [F.sum((F.col("n") == i).cast("double")) for i in (1, 2, 3, 4)]
    by = counted.groupBy("lang").agg(*[x.alias(f"n{i + 1}") for i, x in enumerate(n)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))

    def d(i: int) -> Column:
        own = i - (i + 1) * y * F.col(f"n{i + 1}") / F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))
        # Small samples can lack a count: half a count of discount then.
        return F.coalesce(F.greatest(F.least(own, F.lit(i - 0.05)), F.lit(0.05)), F.lit(0.5)).alias(f"d{i}")

    return by.select(F.col("lang").alias("__lang"), d(1), d(2), d(3))


def _discounted(counted: DataFrame) -> DataFrame:
    """Add ``off``, what is taken off each count."""
    d = F.broadcast(_discounts(counted))  # one row per language of the sample
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    # Null-safe, though no language hash is null: a filter for nulls would make another shuffle of the same rows.
    return counted.join(d, counted["lang"].eqNullSafe(d["__lang"])).select(*counted.columns, F.least(off, F.col("n").cast("double")).alias("off"))


def _contexts(counted: DataFrame, context: list[str]) -> DataFrame:
    """(lang, context, total, left): total of the counts after a context, and the weight that discounts leave."""
    by = counted.groupBy("lang", *context).agg(F.sum("n").cast("double").alias("total"), F.sum("off").alias("off"))
    return by.withColumn("left", F.col("off") / F.col("total"))


def _vocabulary(word: DataFrame) -> DataFrame:
    """(lang, w, p, unseen): continuation probability of each word, and that of any other word."""
    words = _discounted(word)
    by = words.groupBy(F.col("lang").alias("__l")).agg(F.sum("n").alias("total"), F.sum("off").alias("off_total"), (F.count("*") + 1).alias("size"))
    met = words.join(F.broadcast(by), words["lang"].eqNullSafe(by["__l"]))  # one row per language
    unseen = F.col("off_total") / F.col("total") / F.col("size")
    return met.select("lang", "w", ((F.col("n") - F.col("off")) / F.col("total") + unseen).alias("p"), unseen.alias("unseen"))


def _rows(df: DataFrame, kind: int, value: str, *cols: str, total: str | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    named = [(F.col(c) if c else none).alias(n) for c, n in zip((*cols, "", "", "")[:3], "uvw")]
    of = (F.col(total) if total else F.lit(None).cast("double")).alias("total")
    return df.select(F.lit(kind).alias("kind"), "lang", *named, F.col(value).alias("value"), of)


def model(mine: DataFrame) -> DataFrame:
    """(kind, lang, u, v, w, value, total): every stored part of the model.

    Trigrams are counted in the placement of their context, pairs in that of
    their first word, so contexts are added up there; each n-gram keeps its
    discounted count and its context the total to divide by.
    """
    tri = trigram_counts(mine)
    # Every row counts and every word has p > 0; as all steps read n, they need the same columns and so share the shuffles.
    rows_of = F.count(F.when(F.col("n") > 0, True)).alias("n")
    pair = tri.repartition("lang", "v").groupBy("lang", "v", "w").agg(rows_of)
    words = _vocabulary(pair.groupBy("lang", "w").agg(rows_of))
    tris, pairs = (_discounted(x).withColumn("rest", F.col("n") - F.col("off")) for x in (tri, pair))
    unseen = words.groupBy("lang").agg(F.min(F.when(F.col("p") > 0, F.col("unseen"))).alias("unseen"))
    return (
        _rows(tris, TRI, "rest", "u", "v", "w").union(_rows(_contexts(tris, ["u", "v"]), TRI_LEFT, "left", "u", "v", total="total"))
        .union(_rows(pairs, PAIR, "rest", "v", "w")).union(_rows(_contexts(pairs, ["v"]), PAIR_LEFT, "left", "v", total="total"))
        .union(_rows(words, WORD_P, "p", "w")).union(_rows(unseen, UNSEEN, "unseen"))
    )


def _shard(values: np.ndarray, shards: int) -> np.ndarray:
    """Shard of sorted hashes, in the same order."""
    return (((values >> np.uint64(HASH_BITS - 32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _by_shard(values: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """Each shard and its part of sorted hashes."""
    where = _shard(values, shards)
    cuts = np.flatnonzero(np.diff(where, prepend=-1) != 0)
    for a, b in zip(cuts, np.append(cuts[1:], len(values))):
        yield int(where[a]), slice(int(a), int(b))


def _pack_keys(values: np.ndarray) -> bytes:
    return pack(values, np.zeros(len(values), dtype=np.int64))


def _squeezed(value: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(value.astype("<f8").tobytes())


def _spread(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype="<f8")


def _pack_found(value: np.ndarray) -> bytes:
    """Which entries have a value, and these values."""
    hit = ~np.isnan(value)
    return zstandard.ZstdCompressor(level=3).compress(np.packbits(hit).tobytes() + value[hit].astype("<f8").tobytes())


def _unpack_found(blob: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    bits = -(-n // 8)
    hit = np.unpackbits(np.frombuffer(raw[:bits], dtype=np.uint8), count=n).astype(bool)
    out = np.full(n, np.nan)
    out[hit] = np.frombuffer(raw[bits:], dtype="<f8")
    return out


def write_model(parts: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """Hash the rows and write them sorted and packed for each shard."""

    def hashed(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cols = {n: batch.column(n).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) for n in ("lang", "u", "v", "w")}
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        out, place = np.zeros(len(kind), dtype=np.uint64), np.zeros(len(kind), dtype=np.int64)
        for k, (used, of, level, slot) in PLACES.items():
            own = kind == k
            out[own] = keys(cols["lang"][own], *[cols[c][own] for c in used], kind=of)
            place[own] = 2 * level + slot
        return place, out, *(batch.column(c).to_numpy(zero_copy_only=False).astype("<f8") for c in ("value", "total"))

    def packed(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        place, key, value, total = (np.concatenate(x) for x in zip(*held))
        for p in np.unique(place):
            own = place == p
            order = np.argsort(key[own])
            ranked, values, totals = (x[own][order] for x in (key, value, total))
            rows = [(p // 2, p % 2, s, _pack_keys(ranked[at]), _squeezed(values[at]), _squeezed(totals[at]) if p % 2 else None) for s, at in _by_shard(ranked, shards)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["level", "slot", "shard", "packed", "value", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(hashed(batch))
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    parts.mapInArrow(run, _MODEL).write.option("compression", "zstd").parquet(folder)


class _Batch:
    """Documents of a batch with the words of each place, and what the model answered."""

    def __init__(self, rows: pa.Table):
        self.rows = rows
        self.lang = language_hash(rows.column("lang").to_pylist())
        hashes, self.bounds = word_hashes(rows.column("text"))
        self.u, self.v, self.w, self.owner = padded(hashes, self.bounds)
        self.by = self.lang[self.owner]

    def first(self) -> tuple[np.ndarray, ...]:
        """Keys of all words, pairs and languages, sorted; where each place's pair, its context, its word, the word before and its text's language are."""
        langs, of = np.unique(self.lang, return_inverse=True)
        start = np.full(len(langs), START)
        places = [
            keys(self.by, self.v, self.w, kind=PAIR), keys(langs, start, start, kind=PAIR),
            keys(self.by, self.w, kind=WORD_P), keys(langs, start, kind=WORD_P), keys(langs, kind=UNSEEN),
        ]
        asked, at = np.unique(np.concatenate(places), return_inverse=True)
        pair, first_pair, word, first_word, unseen = np.split(at, np.cumsum([len(x) for x in places])[:-1])
        # What precedes a place is what the place before has, or the start of its language's texts.
        begins = np.diff(self.owner, prepend=-1) != 0
        context, before = (np.where(begins, x[of[self.owner]], np.concatenate([y[:1], y[:-1]])) for x, y in ((first_pair, pair), (first_word, word)))
        return asked, pair, context, word, before, unseen[of]

    def read(self, found: pa.Table) -> None:
        """What is known of words, pairs (whole probability) and contexts (total, weight left), NaN where unknown."""
        asked, pair, context, word, before, unseen = self.first()
        value, left, total = (_read(found, asked, x) for x in ("value0", "value1", "total1"))
        self.left, self.total = _rounded(left[context]), total[context]
        self.word_left, self.pair = _rounded(left[before]), _rounded(value[pair] / total[before] + left[before] * value[word])
        self.word, self.unseen = _rounded(value[word]), _rounded(value[unseen])
        # Only a known pair in a known context can be a known trigram.
        self.known = np.flatnonzero(~np.isnan(self.pair) & ~np.isnan(self.left))
        k = self.known
        self.tri = keys(self.by[k], self.u[k], self.v[k], self.w[k], kind=TRI)

    def requests(self, asked: np.ndarray, shards: int) -> pa.Table:
        rows = [(s, _pack_keys(asked[at])) for s, at in _by_shard(asked, shards)]
        batch = [self.rows.column("batch")[0].as_py()] * len(rows)
        columns = [pa.array(batch, pa.int64()), pa.array([s for s, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())]
        return pa.table(columns, names=["batch", "shard", "packed"])

    def perplexity(self, found: pa.Table) -> np.ndarray:
        asked, at = np.unique(self.tri, return_inverse=True)
        share = np.zeros(len(self.owner))
        share[self.known] = np.nan_to_num(_rounded(_read(found, asked, "value0")[at] / self.total[self.known]))
        p = np.where(np.isnan(self.word), self.unseen[self.owner], self.word)
        p = np.where(np.isnan(self.pair), np.nan_to_num(self.word_left, nan=1.0) * p, self.pair)
        p = share + np.nan_to_num(self.left, nan=1.0) * p
        n = np.bincount(self.owner, minlength=len(self.lang))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.exp(-np.bincount(self.owner, weights=np.log(p), minlength=len(self.lang)) / n)


def _rounded(value: np.ndarray) -> np.ndarray:
    """Shares, weights and probabilities count to 32 bits."""
    return value.astype(np.float32).astype(np.float64)


def _read(found: pa.Table, asked: np.ndarray, name: str) -> np.ndarray:
    """Answers to the sorted keys ``asked``."""
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("shard", "n", name))))
    out = np.concatenate([np.zeros(0), *(_unpack_found(x, n) for _, n, x in rows)])
    if len(out) != len(asked):
        raise ValueError(f"{len(out)} answers to {len(asked)} requests of a batch")
    return out


def _answer(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """One shard: the values of each requested hash, in the order of the request."""
    names = {"value0": (0, "value"), "value1": (1, "value"), "total1": (1, "total")}
    held, slots = {}, stored.column("slot").to_numpy()
    for slot in (0, 1):
        own = stored.filter(pa.array(slots == slot))
        key = np.concatenate([np.zeros(0, np.uint64), *(unpack(x)[0] for x in own.column("packed").to_pylist())])
        order = np.argsort(key)
        for name, (of, column) in names.items():
            if of == slot:
                values = np.concatenate([np.zeros(0, "<f8"), *(_spread(x) for x in own.column(column).to_pylist())])
                held[name] = key[order], values[order]
    sizes, out = [], {name: [] for name in names}
    for blob in asked.column("packed"):
        wanted = unpack(blob.as_py())[0]
        sizes.append(len(wanted))
        for name, (key, value) in held.items():
            found = np.full(len(wanted), np.nan)
            if len(key):
                at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                hit = key[at] == wanted
                found[hit] = value[at[hit]]
            out[name].append(_pack_found(found))
    release()
    packed = {name: pa.array(x, pa.binary()) for name, x in out.items()}
    return pa.table({"batch": asked.column("batch"), "shard": asked.column("shard"), "n": pa.array(sizes, pa.int64())} | packed)


def perplexities(docs: DataFrame, folder: str, shards: int = SHARDS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, lang, n_words, perplexity); null perplexity for texts without words and languages without trusted text."""
    mine = texts(docs, F.col("lang").cast("string").alias("lang"))
    chars = mine.agg(F.sum(F.length("text"))).first()[0] or 0
    dealt = mine.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-chars // batch_chars)))))
    stored = docs.sparkSession.read.schema(_MODEL).parquet(folder)

    def ask(rows: pa.Table) -> pa.Table:
        batch = _Batch(rows)
        return batch.requests(batch.first()[0], shards)

    def ask_more(rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = _Batch(rows)
        batch.read(found)
        return batch.requests(np.unique(batch.tri), shards)

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        batch = _Batch(rows)
        level = np.array(found.column("level").to_pylist())
        batch.read(found.filter(pa.array(level == 1)))
        value = batch.perplexity(found.filter(pa.array(level == 2)))
        columns = [rows.column("doc_id"), rows.column("lang"), pa.array(np.diff(batch.bounds), pa.int64())]
        columns.append(pa.array(value, pa.float64(), mask=~np.isfinite(value)))
        release()
        return pa.table(columns, names=["doc_id", "lang", "n_words", "perplexity"])

    def answered(asked: DataFrame, level: int) -> DataFrame:
        of = stored.where(F.col("level") == level).drop("level")
        return asked.groupBy("shard").cogroup(of.groupBy("shard")).applyInArrow(_answer, _ANSWER)

    first = answered(dealt.groupBy("batch").applyInArrow(ask, _REQUEST), 1)
    later = answered(dealt.groupBy("batch").cogroup(first.groupBy("batch")).applyInArrow(ask_more, _REQUEST), 2)
    both = first.withColumn("level", F.lit(1)).union(later.withColumn("level", F.lit(2)))
    return dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(score, "doc_id long, lang string, n_words long, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, n: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, lang, n_words, perplexity, threshold, keep.

    Of the trusted documents one hashed half is fitted (of it at most ``n`` of
    each language, if given).  The threshold
    of a language is ``margin`` times the ``quantile`` of the perplexity of all
    its trusted documents in the half that is never fitted (see ``roles`` for
    languages with very few);
    ``keep`` is perplexity <= threshold.  Null or empty text has no
    perplexity and is not kept; a null language is one of its own; a language
    without trusted text has no threshold and is kept.  Rows that repeat each get
    their row, a null doc_id is never trusted, an empty table gives an empty
    result; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    folder = scratch(spark, "model")
    trusted = table(roles(docs, labels, seed), "roles")
    fitted = sample(docs, labels, n, seed, trusted)
    shards = max(1, -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // SHARD_CHARS))
    write_model(model(fitted), folder, shards)
    found = table(perplexities(docs, folder, shards), "perplexity")
    known = found.where("perplexity IS NOT NULL").join(
        trusted.where("__limit"), (F.col("doc_id") == F.col("__id")) & F.col("lang").eqNullSafe(F.col("__lang"))
    ).drop("__lang")
    limit = known.groupBy(F.col("lang").alias("__lang")).agg((margin * F.percentile_approx("perplexity", quantile, 10_000)).alias("threshold"))
    out = found.join(limit, found["lang"].eqNullSafe(limit["__lang"]), "left").drop("__lang")
    keep = F.when(F.col("n_words") == 0, F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.withColumn("keep", keep)
