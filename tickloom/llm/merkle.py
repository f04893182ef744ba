"""Document fingerprints: a Merkle tree over paragraphs and sections, in built-in functions.

Leaves are runs of ``LEAF`` characters of one paragraph (a line with its line
end, so a change never moves the leaves of another paragraph); paragraphs hash
their leaves, sections hash ``SECTION`` paragraphs, the root hashes the
sections.  Every character lies in one leaf: equal roots mean equal texts.

Text form: ``root/section:paragraph.leaves,paragraph.leaves/section:...`` with
the root in full and shortened hashes below, so two fingerprints can be walked
from the root down to the branches that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import table, texts

LEAF = 48
SECTION = 8
SHORT_LEAF, SHORT_NODE = 8, 12


def tree(text: Column, leaf: int = LEAF, section: int = SECTION) -> Column:
    """Sections of paragraphs of leaf hashes: array<array<array<string>>>; empty for an empty text.

    A lambda below uses its own argument only: an outer column would be computed anew for every element.
    """
    sections = F.regexp_extract_all(text, F.lit(f"(?:[^\n]*\n){{{section}}}|(?s:.+)"), F.lit(0))

    def leaves(paragraph: Column) -> Column:
        return F.transform(F.regexp_extract_all(paragraph, F.lit(f"(?s).{{1,{leaf}}}"), F.lit(0)), lambda x: F.sha2(x, 256))

    return F.transform(sections, lambda s: F.transform(F.regexp_extract_all(s, F.lit("[^\n]*\n|[^\n]+"), F.lit(0)), leaves))


def _hashes(nodes: Column) -> Column:
    """Of each section (paragraph): its paragraphs (leaves) as one string."""
    return F.transform(nodes, lambda n: F.sha2(F.array_join(n, ""), 256))


def _text_form(sections: Column) -> Column:
    def paragraph(leaves: Column) -> Column:
        own = F.substring(F.sha2(F.array_join(leaves, ""), 256), 1, SHORT_NODE)
        return F.concat(own, F.lit("."), F.array_join(F.transform(leaves, lambda x: F.substring(x, 1, SHORT_LEAF)), ""))

    def whole(s: Column) -> Column:
        node = F.sha2(F.array_join(_hashes(s), ""), 256)
        return F.concat(F.substring(node, 1, SHORT_NODE), F.lit(":"), F.array_join(F.transform(s, paragraph), ","))

    root = F.sha2(F.array_join(F.transform(sections, lambda s: F.sha2(F.array_join(_hashes(s), ""), 256)), ""), 256)
    return F.concat_ws("/", root, F.array_join(F.transform(sections, whole), "/"))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add column ``out``; other columns stay."""
    return df.withColumn("__tree", tree(F.col(text))).withColumn(out, _text_form(F.col("__tree"))).drop("__tree")


def root_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "/", 1)


def leaves_of(fingerprint: Column) -> Column:
    """Distinct shortened leaf hashes, from the text form alone."""
    runs = F.regexp_extract_all(fingerprint, F.lit("\\.([0-9a-f]+)"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(f".{{{SHORT_LEAF}}}"), F.lit(0)))))


def likeness(a: Column, b: Column, a_leaves: Column, b_leaves: Column) -> Column:
    """1 for equal roots, else the share of leaves in common (Dice), 0 to 1."""
    both = F.size(a_leaves) + F.size(b_leaves)
    common = F.size(F.array_intersect(a_leaves, b_leaves))
    return F.when(root_of(a) == root_of(b), F.lit(1.0)).when(both == 0, F.lit(0.0)).otherwise(2.0 * common / both)


def paragraphs_of(fingerprint: Column) -> Column:
    """Shortened paragraph hashes, in order."""
    return F.regexp_extract_all(fingerprint, F.lit(f"[:,]([0-9a-f]{{{SHORT_NODE}}})\\."), F.lit(1))


def first_change(a: Column, b: Column) -> Column:
    """Number (from 0) of the first paragraph in which ``a`` and ``b`` differ; null if the roots agree."""
    same = F.zip_with(paragraphs_of(a), paragraphs_of(b), lambda x, y: x.eqNullSafe(y))
    return F.when(root_of(a) != root_of(b), F.array_position(same, F.lit(False)) - 1)


def neighbours(docs: DataFrame, slices: int | None = None) -> tuple[DataFrame, bool]:
    """(each key with the key that follows it in descending doc_id, whether rows repeat).

    Keys are (doc_id, characters, hash of the text); null doc_id comes last, ties
    are ordered by the other two.  Rows are ranged by doc_id and each range is
    walked on its own; the key that follows a range is one row per range.
    """
    narrow = texts(docs).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("mark"))
    keys = table(narrow.groupBy("doc_id", "n_chars", "mark").agg(F.count("*").alias("n")), "keys")
    total, most = keys.agg(F.count("*"), F.max("n")).first()
    order = [F.col("doc_id").desc_nulls_last(), F.col("n_chars"), F.col("mark")]
    slices = slices or max(1, min(10_000, -(-total // 200_000)))
    ranged = table(keys.repartitionByRange(slices, *order).withColumn("slice", F.spark_partition_id()), "ranged")
    key = F.struct("doc_id", "n_chars", "mark")
    inner = ranged.select(
        "slice", key.alias("own"), F.lead(key).over(Window.partitionBy("slice").orderBy(*order)).alias("next"),
        F.row_number().over(Window.partitionBy("slice").orderBy(*order)).alias("at"),
    )
    first = inner.where("at = 1").select("slice", F.col("own").alias("head"))
    by_slice = Window.orderBy("slice")
    after = first.select(
        "slice", F.coalesce(F.lead("head").over(by_slice), F.first("head").over(by_slice.rowsBetween(Window.unboundedPreceding, 0))).alias("after")
    )
    return inner.join(F.broadcast(after), "slice").select("own", F.coalesce("next", "after").alias("next")), bool(most and most > 1)


def edit_report(docs: DataFrame, slices: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last floor(n/3) code points replaced by as many (or all) first
    ones of the next document in descending doc_id, after the last the first.
    Null text is empty.  Rows without doc_id come after all others.  Rows that
    repeat in doc_id and text count as one document in that order, and each gets
    its result.  One single document is its own next.  An empty table gives
    an empty result.  Columns other than doc_id and text are not read.
    """
    links, repeats = neighbours(docs, slices)
    links = table(
        links.select(
            F.col("own.doc_id").alias("k_id"), F.col("own.n_chars").alias("k_chars"), F.col("own.mark").alias("k_mark"), "next",
        ),
        "links",
    )
    before = links.select(
        F.col("next.doc_id").alias("k_id"), F.col("next.n_chars").alias("k_chars"), F.col("next.mark").alias("k_mark"),
        F.struct("k_id", "k_chars", "k_mark").alias("previous"),
    )
    links = table(links.join(before, _same(links, before)).select(links["*"], "previous"), "links")
    keyed = texts(docs).select(
        F.col("doc_id"), F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("mark"), "text"
    )
    met = keyed.join(
        links,
        keyed["doc_id"].eqNullSafe(links["k_id"]) & (keyed["n_chars"] == links["k_chars"]) & (keyed["mark"] == links["k_mark"]),
    ).select("doc_id", "n_chars", "mark", "text", "next", "previous")
    own = with_fingerprint(met.select("doc_id", "n_chars", "mark", "text"), "text", "fingerprint")
    heads = met.select(
        F.col("previous.k_id").alias("p_id"), F.col("previous.k_chars").alias("p_chars"), F.col("previous.k_mark").alias("p_mark"),
        F.substring("text", F.lit(1), F.floor(F.col("previous.k_chars") / 3).cast("int")).alias("head"), "text",
    )
    heads = with_fingerprint(heads, "text", "next_fingerprint").drop("text")
    if repeats:
        heads = heads.dropDuplicates(["p_id", "p_chars", "p_mark"])
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = own.join(
        heads, own["doc_id"].eqNullSafe(heads["p_id"]) & (own["n_chars"] == heads["p_chars"]) & (own["mark"] == heads["p_mark"])
    ).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.col("head")))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", "edited")
    both = with_fingerprint(both, "edited", "edited_fingerprint").drop("edited")
    both = both.withColumns({f"__{c}": leaves_of(F.col(f"{c}fingerprint")) for c in ("", "edited_", "next_")})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), F.col("__"), F.col("__edited_")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), F.col("__"), F.col("__next_")).alias("near_next"),
        first_change(F.col("fingerprint"), F.col("edited_fingerprint")).alias("first_change"),
        F.size(F.array_except(paragraphs_of(F.col("edited_fingerprint")), paragraphs_of(F.col("fingerprint")))).alias("new_paragraphs"),
    )


def _same(a: DataFrame, b: DataFrame):
    return a["k_id"].eqNullSafe(b["k_id"]) & (a["k_chars"] == b["k_chars"]) & (a["k_mark"] == b["k_mark"])
