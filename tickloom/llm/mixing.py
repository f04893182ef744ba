"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import WORD, table, texts

WEIGHTS = (5, 2, 1)
PERCENT = 150
LIMIT = 2
BLOCK = 128
# A source's quota is at least so many blocks; below BLOCK times as many words its blocks are shorter.
FEW = 64
SHARD_TOKENS = 2_000_000
SEED = 17


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size in words, null text 0."""
    return texts(docs, F.col("source").cast("string").alias("source")).select(
        "doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("mark")
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, percent: int = PERCENT, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``percent`` % of all sizes.  A target stops at ``limit`` times its source's
    size and what is over is shared out again by weight until none is above.
    Sources that stop are those with the least limit per weight, a prefix in that
    order, so the level that the others share comes from running sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight"), place.alias("place"))
    ratio = limit * F.col("source_size") / F.col("weight")
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    run = per.withColumn("ratio", ratio).select(
        "source", "source_size", "weight", "ratio", "place",
        (F.sum("source_size").over(everything) * percent / 100).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum(limit * F.col("source_size")).over(before), F.lit(0)).alias("stopped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("stopped_weight"),
    )
    level = (F.col("total") - F.col("stopped")) / (F.col("weights") - F.col("stopped_weight"))
    # Stopping a source raises the level as long as its limit is below it and lowers it after that: the highest is the one.
    share = F.max("level").over(everything) * F.col("weight")
    return run.withColumn("level", level).select(
        "source", "source_size", F.least(limit * F.col("source_size").cast("double"), share).alias("target")
    )


def apportion(claims: DataFrame, group: Sequence[str], claim: str, seats: Column, most: str, order: Sequence[Column]) -> DataFrame:
    """Add ``quota``: in each group ``seats`` seats go one by one to the highest claim / (2 * held + 1).

    Quotas lie between those of two divisors, one certainly too large and one
    certainly too small, and no further from those of the even divisor than all
    of these together miss ``seats`` (one more for rounding); only the quotients
    between them are written out and ranked, about two per claim.  ``most`` bounds a quota; seats that no row may
    take stay empty.  Ties go to the first row in ``order``.
    """
    whole = Window.partitionBy(*group)
    total, rows = F.sum(claim).over(whole), F.count("*").over(whole)
    with_bounds = claims.withColumns({"__seats": seats, "__total": total, "__rows": rows})

    def quota(n: Column) -> Column:
        per_seat = F.col(claim) * n / F.col("__total")
        return F.when((F.col("__total") > 0) & (n > 0), F.floor(per_seat + 0.5)).otherwise(F.lit(0)).cast("long")

    low = F.least(quota(F.col("__seats") - F.col("__rows")), F.col(most))
    # Where rows are capped, what they leave goes on to the others: those may take all the way up.
    high = F.least(quota(F.col("__seats") + F.col("__rows")) + F.col("__spare"), F.col(most))
    spare = F.sum(F.greatest(quota(F.col("__seats") + F.col("__rows")) - F.col(most), F.lit(0))).over(whole)
    with_bounds = with_bounds.withColumn("__spare", spare)
    with_bounds = with_bounds.withColumns({"__low": low, "__high": high, "__even": F.least(quota(F.col("__seats")), F.col(most))})
    over = F.sum("__even").over(whole) - F.col("__seats")
    with_bounds = with_bounds.withColumn("__over", over).withColumns({
        "__low": F.greatest(F.col("__low"), F.col("__even") - F.greatest(F.col("__over"), F.lit(0)) - 1),
        "__high": F.least(F.col("__high"), F.col("__even") + F.greatest(-F.col("__over"), F.lit(0)) + 1),
    })
    with_bounds = with_bounds.withColumn("__open", F.col("__seats") - F.sum("__low").over(whole))
    steps = F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1)).otherwise(F.array().cast("array<bigint>"))
    ranked = with_bounds.withColumn("__step", F.explode_outer(steps)).withColumn("__quotient", F.col(claim) / (2 * F.col("__step") + 1))
    best = Window.partitionBy(*group).orderBy(F.col("__quotient").desc_nulls_last(), *order, "__step")
    won = F.col("__step").isNotNull() & (F.row_number().over(best) <= F.col("__open"))
    keys = claims.columns
    return ranked.withColumn("__won", won.cast("long")).groupBy(*keys).agg((F.first("__low") + F.sum("__won")).alias("quota"))


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, percent: int = PERCENT, limit: int = LIMIT, block: int = BLOCK,
    shard_tokens: int = SHARD_TOKENS, seed: int = SEED,
) -> DataFrame:
    """What a mix takes of each document: doc_id, size, source_size, target, taken.

    A source's words are dealt by document to shards of about ``shard_tokens``
    words.  In a shard the documents lie in seeded order, ``limit`` times over;
    that line is cut into blocks of ``block`` words, the last one short.  Words are
    apportioned to sources by their targets, and a source's words, in blocks, to its
    shards by theirs.  Sources whose quota is under ``FEW`` blocks have shorter blocks.
    A shard's blocks are taken in seeded order, all of one pass before the next,
    so no word is taken more than ``limit`` times.

    Null text has size 0 and is never taken from; a null source is a source,
    last in order; a null doc_id is an ordinary document; rows that repeat are
    separate documents.  An empty table, or one without words, gives targets and
    takings of 0.  Columns other than doc_id, text and source are not read.  The
    order is a hash of row content and seed, so reruns agree.
    """
    sizes = table(sized(docs), "sizes")
    goal = table(targets(sizes, weights, percent, limit), "targets")
    named = goal.select(F.col("source").alias("__source"), "source_size", "target")
    shards_of = F.greatest(F.ceil(F.col("source_size") / shard_tokens), F.lit(1)).cast("int")
    lot = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "mark")
    # One row per source on the small side; the documents of a large source are a skewed side that is split.
    placed = sizes.join(named, sizes["source"].eqNullSafe(named["__source"])).drop("__source").select(
        "doc_id", "source", "size", "source_size", "target", lot.alias("lot"), F.pmod(lot, shards_of).cast("int").alias("shard"),
    )
    line = Window.partitionBy("source", "shard").orderBy("lot", F.col("doc_id").asc_nulls_last(), "size")
    placed = table(
        placed.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size")),
        "placed",
    )
    shard = placed.groupBy("source", "shard").agg(F.max("end").alias("words"), F.first("target").alias("target"))
    source = shard.groupBy("source").agg(F.first("target").alias("target"), (limit * F.sum("words")).alias("most"))
    all_words = F.round(F.sum("target").over(Window.partitionBy())).cast("long")
    by_source = apportion(source, [], "target", all_words, "most", [F.col("source").asc_nulls_last()])
    unit = F.greatest(F.least(F.floor(F.col("quota") / FEW), F.lit(block)), F.lit(1)).cast("long")
    by_source = by_source.select(F.col("source").alias("__source"), unit.alias("unit"), F.round(F.col("quota") / unit).cast("long").alias("source_blocks"))
    shard = shard.join(by_source, shard["source"].eqNullSafe(by_source["__source"])).drop("__source", "target")
    shard = shard.withColumn("blocks", F.ceil(limit * F.col("words") / F.col("unit")))
    by_shard = apportion(shard, ["source"], "words", F.col("source_blocks"), "blocks", [F.col("shard").asc()])
    by_shard = table(by_shard.select("source", "shard", "words", "unit", "blocks", F.col("quota")), "quotas")
    chosen = by_shard.where("quota > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    turn = F.floor(F.col("block") * F.col("unit") / F.col("words"))
    pick = Window.partitionBy("source", "shard").orderBy(turn, F.xxhash64(F.lit(seed), "source", "shard", "block"), "block")
    chosen = chosen.withColumn("at", F.row_number().over(pick)).where("at <= quota").select("source", "shard", "unit", "block")
    covered = _covered(placed, by_shard, chosen, limit)
    return covered.select("doc_id", "size", "source_size", "target", "taken")


def _covered(placed: DataFrame, by_shard: DataFrame, chosen: DataFrame, limit: int) -> DataFrame:
    """Words of each document under the chosen blocks, all passes: running counts of chosen blocks, looked up at its two ends."""
    key = ["source", "shard"]
    words = by_shard.select(F.col("source").alias("__source"), F.col("shard").alias("__shard"), "words", "unit")
    spans = placed.join(words, placed["source"].eqNullSafe(words["__source"]) & (placed["shard"] == words["__shard"])).drop("__source", "__shard")
    spans = spans.withColumn("row", F.monotonically_increasing_id())
    spans = table(spans, "spans")
    turns = F.explode(F.array(*[F.lit(i).cast("long") for i in range(limit)]))
    ends = spans.where("size > 0").withColumn("turn", turns)
    points = ends.select(
        *key, "unit", "row", F.explode(F.array(
            F.struct((F.col("turn") * F.col("words") + F.col("start")).alias("at"), F.lit(-1).alias("sign")),
            F.struct((F.col("turn") * F.col("words") + F.col("end")).alias("at"), F.lit(1).alias("sign")),
        )).alias("p"),
    ).select(*key, "unit", "row", F.col("p.at").alias("at"), F.col("p.sign").alias("sign"), F.lit(None).cast("long").alias("block"))
    marks = chosen.select(*key, "unit", F.lit(None).cast("long").alias("row"), (F.col("block") * F.col("unit")).alias("at"), F.lit(0).alias("sign"), "block")
    # A block counts for every later point; the last one begun may be cut short by the point.
    upto = Window.partitionBy(*key).orderBy("at", F.col("sign") != 0).rowsBetween(Window.unboundedPreceding, 0)
    both = points.unionByName(marks).select(
        "row", "sign", "at", "unit", F.count("block").over(upto).alias("begun"), F.last("block", ignorenulls=True).over(upto).alias("latest"),
    ).where("sign <> 0")
    inside = F.when(F.col("begun") == 0, F.lit(0)).otherwise(
        (F.col("begun") - 1) * F.col("unit") + F.least(F.col("at") - F.col("latest") * F.col("unit"), F.col("unit"))
    )
    per_row = both.groupBy(F.col("row").alias("__row")).agg(F.sum(F.col("sign") * inside).alias("taken"))
    return spans.join(per_row, spans["row"] == per_row["__row"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, whole, all columns kept.

    taken / size is rounded up or down by a seeded draw, so that sums keep to the
    targets in the mean: 0 to ``limit`` times.  Documents without words, null text
    too, stay once, as the mix has nothing to decide about them.  Rows that agree
    in doc_id and size, null doc_id too, are taken as often as the luckier of
    them.  A null source is one of its own; an empty table gives an empty result;
    columns may have any names.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), F.coalesce("doc_id", F.lit(-1)), "size"), F.lit(1_000_003)) / 1_000_003
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + draw)).otherwise(1)
    took = mix(docs, seed=seed, **options).groupBy(F.col("doc_id").alias("__doc"), F.col("size").alias("__size")).agg(
        F.max(times).cast("int").alias("__times")
    )
    took = took.select("__doc", "__size", F.explode(F.when(F.col("__times") > 0, F.sequence(F.lit(1), F.col("__times")))))
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD))
    met = docs.join(took, docs["doc_id"].eqNullSafe(took["__doc"]) & (size == took["__size"]))
    return met.select(*[docs[c] for c in docs.columns])
