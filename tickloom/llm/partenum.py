"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct ``WORDS``-word shingles.  Sets with
Jaccard similarity of at least ``percent``/100 differ in at most
k = (100 - percent) * (|A| + |B|) / (100 + percent) elements.  The shingle domain is cut by
hash into G first-level parts of ``PIECES`` second-level pieces each, with
G > k / (TOLERATED + 1), so in one first-level part at most ``TOLERATED`` pieces
differ.  Of its pieces, taken as disjoint pairs, one pair is then untouched: each
pair is a signature.  A signature record also carries a byte of every piece's
hash; two records whose first-level part agrees in fewer than PIECES - TOLERATED
bytes cannot be that part and are let go, which is the enumeration of all larger
piece subsets without writing them out.  G comes from a fixed grid of sizes, and
a set is written for each grid value that a partner of its size band can need.

Records are packed per bucket of signatures.  Equal sets are one node.  In each
signature group all members are tried against the lowest one (no pairs within a
group), exact set intersections decide, and components are formed.  Groups whose
members then lie in different components are taken again: there every pair across
components that can still reach the threshold is tried, so no component is cut.
Links are counted last: sets that reach the threshold lie in one component, so where
the known links of a component are not all its pairs, every pair in it is checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import table, texts
from tickloom.llm.components import components
from tickloom.llm.words import mix, release, slices, windows, word_hashes

WORDS = 5
PERCENT = 80
PIECES = 8
TOLERATED = 3
RECORDS_PER_BUCKET = 400_000
FLUSH_RECORDS = 600_000
BROADCAST_ROWS = 2_000_000
PROBE = 64
PART_ROWS = 100_000
HOT_GROUP = 20_000
# A component is cut into blocks of at most so many sets and shingles (about) to count its links; small ones share parts.
BLOCK_SETS = 1_000
BLOCK_SHINGLES = 500_000
# Shingles of at least one in so many pairs of sets are counted by matrix products, rarer ones pair by pair.
DENSE = 100
# The lowest bits of a signature hold the number of its grid value.
LEVEL_BITS = np.uint64(63)
# Of each pair of pieces, the pieces beside it; the pair's own need no byte, as the signature holds them.
_OTHERS = np.array([[p for p in range(PIECES) if p // 2 != pair] for pair in range(PIECES // 2)])
RECORD = np.dtype([("sig", "<u8"), ("node", "<i8"), ("marks", "<u8")])


def grid(least: int) -> int:
    """The smallest grid value of at least ``least``: 1, 2, 3, 5, 8, 12, 18, ... by half."""
    g = 1
    while g < least:
        g += max(1, g // 2)
    return g


def parts_for(a: int, b: int, percent: int = PERCENT) -> int:
    """First-level parts that sets of these sizes need."""
    return grid((100 - percent) * (a + b) // (100 + percent) // (TOLERATED + 1) + 1)


def levels(size: int, percent: int = PERCENT) -> list[int]:
    """All grid values a set of this size must be written for."""
    low, high = parts_for(size, -(-size * percent // 100), percent), parts_for(size, size * 100 // percent, percent)
    out = [low]
    while out[-1] < high:
        out.append(grid(out[-1] + 1))
    return out


def shingle_sets(column: pa.Array, words: int = WORDS, second: bool = False) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, from the word hash or a second one."""
    hashes, owner = windows(*word_hashes(column, second), words)
    cuts = np.searchsorted(owner, np.arange(len(column) + 1))
    return [np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(len(column))]


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit sum of the mixed elements of a set."""
    total = np.add.reduce(mix(shingles)) if len(shingles) else np.uint64(0)
    return int(np.array(total, dtype=np.uint64).view(np.int64))


def level_index(parts: int) -> int:
    i, g = 0, 1
    while g < parts:
        g, i = grid(g + 1), i + 1
    return i


def piece_marks(shingles: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each piece, its byte; parts x PIECES) of a set."""
    place = mix(shingles + np.uint64(parts))
    piece = ((place >> np.uint64(32)) * np.uint64(parts * PIECES) >> np.uint64(32)).astype(np.int64)
    sums = np.zeros(parts * PIECES, dtype=np.uint64)
    np.add.at(sums, piece, mix(place))
    sums = mix(sums + np.uint64(1))
    return sums, (sums >> np.uint64(56)).astype(np.uint8).reshape(parts, PIECES)


def records(shingles: np.ndarray, node: int, percent: int = PERCENT) -> list[np.ndarray]:
    """Signature records of one set, an array for each of its levels."""
    out = []
    for parts in levels(len(shingles), percent):
        sums, marks = piece_marks(shingles, parts)
        others = np.zeros((parts, PIECES // 2, PIECES), dtype=np.uint8)
        others[:, :, : PIECES - 2] = marks[:, _OTHERS]
        pairs = sums.reshape(-1, 2)
        at = np.arange(len(pairs), dtype=np.uint64) + np.uint64(parts << 32)
        rec = np.empty(len(pairs), dtype=RECORD)
        sig = mix(mix(pairs[:, 0]) * np.uint64(3) + pairs[:, 1] + mix(at))
        rec["sig"] = (sig & ~LEVEL_BITS) | np.uint64(level_index(parts))
        rec["node"] = node
        rec["marks"] = others.view("<u8").ravel()
        out.append(rec)
    return out


def _pack(rec: np.ndarray) -> bytes:
    """12 to 14 bytes a record: low half of the signature, other pieces' bytes, place of the node."""
    nodes, at = np.unique(rec["node"], return_inverse=True)
    marks = np.ascontiguousarray(rec["marks"]).view(np.uint8).reshape(-1, PIECES)[:, : PIECES - 2]
    low = (rec["sig"] & np.uint64(0xFFFFFFFF)).astype("<u4")
    at = at.astype("<u2" if len(nodes) <= 1 << 16 else "<u4")
    head = np.array([len(rec), len(nodes)], dtype="<i8").tobytes()
    return head + nodes.astype("<i8").tobytes() + low.tobytes() + marks.tobytes() + at.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n, m = (int(x) for x in np.frombuffer(blob, dtype="<i8", count=2))
    rec, at = np.empty(n, dtype=RECORD), 16 + 8 * m
    nodes = np.frombuffer(blob, dtype="<i8", count=m, offset=16)
    rec["sig"] = np.frombuffer(blob, dtype="<u4", count=n, offset=at)
    marks = np.zeros((n, PIECES), dtype=np.uint8)
    marks[:, : PIECES - 2] = np.frombuffer(blob, dtype=np.uint8, count=n * (PIECES - 2), offset=at + 4 * n).reshape(n, -1)
    rec["marks"] = marks.view("<u8").ravel()
    rec["node"] = nodes[np.frombuffer(blob, dtype="<u2" if m <= 1 << 16 else "<u4", count=n, offset=at + (4 + PIECES - 2) * n)]
    return rec


def _signer(buckets: int, words: int, percent: int):
    """Packed records per bucket and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count, seen = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            rec = np.concatenate(held)
            bucket = ((rec["sig"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rec, bucket = rec[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            for some in np.array_split(full, max(1, len(full) // 16)):
                packed = [_pack(rec[cuts[i] : cuts[i + 1]]) for i in some]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int64()), "packed": pa.array(packed, pa.binary())})

        for batch in slices(batches):
            for s in shingle_sets(batch.column("text"), words):
                node = node_of(s)
                if len(s) and node not in seen:
                    seen.add(node)
                    own = records(s, node, percent)
                    held += own
                    count += sum(map(len, own))
                if count >= FLUSH_RECORDS:
                    yield from flush()
                    held, count = [], 0
                    seen.clear()
        if held:
            yield from flush()

    return run


def _namer(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            # Nothing of the first word hash is in the witness, so words that share it are seen.
            witness = [node_of(s) for s in shingle_sets(batch.column("text"), words, second=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([node_of(s) for s in sets], witness, [len(s) for s in sets]))],
                names=["doc_id", "node", "witness", "n_shingles"],
            )

    return run


def alike(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Whether at least PIECES - TOLERATED pieces can agree, the two of the signature (zero bytes here) among them."""
    same = (np.ascontiguousarray(x ^ y).view(np.uint8).reshape(-1, PIECES) == 0).sum(axis=1)
    return same >= PIECES - TOLERATED


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a value starts a run, starts of runs, their lengths) of sorted values."""
    first = np.ones(len(values), dtype=bool)
    first[1:] = values[1:] != values[:-1]
    start = np.flatnonzero(first)
    return first, start, np.diff(np.append(start, len(values)))


def _group(key, pdf):
    """Tries of one bucket (kind 0: two nodes) and its groups of three and more (kind 1: signature, node, marks)."""
    import pandas as pd

    bucket, _, split = (int(x) for x in key)
    rec = np.concatenate([_unpack(x) for x in pdf["packed"]])
    rec = rec[np.lexsort((rec["node"], rec["sig"]))]
    new = np.ones(len(rec), dtype=bool)
    new[1:] = (rec["sig"][1:] != rec["sig"][:-1]) | (rec["node"][1:] != rec["node"][:-1])
    rec = rec[new]  # one record for each signature and node
    first, start, size = _runs(rec["sig"])
    # The node that meets others most often leads its groups: an original among its copies.
    shared = np.repeat(size > 1, size)
    known, times = np.unique(rec["node"][shared], return_counts=True)
    met = np.zeros(len(rec), dtype=np.int64)
    met[shared] = times[np.searchsorted(known, rec["node"][shared])]
    rec = rec[np.lexsort((rec["node"], -met, rec["sig"]))]
    lead = np.repeat(start, size)
    tried = ~first & alike(rec["marks"], rec["marks"][lead])
    ends = np.stack([rec["node"][lead][tried], rec["node"][tried]], axis=1)
    pairs = np.unique(np.sort(ends, axis=1), axis=0)
    # Of a bucket in several blocks every group goes on: its members elsewhere are not known here.
    rest = rec[np.repeat(size >= (1 if split > 1 else 3), size)]
    sig = (rest["sig"] + (np.uint64(bucket) << np.uint64(32))).view(np.int64)
    return pd.DataFrame({
        "kind": np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(rest), np.int32)]),
        "x": np.concatenate([pairs[:, 0], sig]), "y": np.concatenate([pairs[:, 1], rest["node"]]),
        "z": np.concatenate([np.zeros(len(pairs), np.int64), rest["marks"].view(np.int64)]),
    })


def _of_nodes(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first document of each wanted node (column ``node``): text and doc_id. Few are sent to all tasks, many are joined by shuffle."""
    named = table(nodes.groupBy("node").agg(F.min("doc_id").alias("rep")).join(wanted, "node").select("rep").distinct(), "named")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return docs.join(named, docs["doc_id"].eqNullSafe(named["rep"]), "left_semi").select("doc_id", "text")


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose sets reach the threshold."""
    pairs = table(pairs, "tries")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                names=["node", "shingles"],
            )

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    known = _of_nodes(docs, nodes, wanted).mapInArrow(sets, "node long, shingles array<long>").dropDuplicates(["node"])
    second = known.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
    first = known.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
    both = F.size(F.array_intersect("one", "two"))
    hit = 100 * both >= percent * (F.size("one") + F.size("two") - both)
    return table(pairs.join(second, "b").join(first, "a").where(hit).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, records_per_bucket: int = RECORDS_PER_BUCKET) -> DataFrame:
    """Per document its set size, its links to other sets and its component.

    ``component_id`` is the smallest doc_id reachable by links, its own included.
    Documents with equal sets are linked.  Null or empty text and text of blanks
    is an empty set, linked with nothing, and keeps its own doc_id; fewer than
    ``words`` words make one shingle of all of them.  A null doc_id is passed
    over by the minimum unless all are null.  Rows that repeat each get their
    row; an empty table gives an empty result; other columns are not read.
    ``n_links``: all different sets that reach the threshold with this one.
    """
    docs = texts(docs)
    nodes, links, found = _joined(docs, words, percent, records_per_bucket)
    return _report(nodes, _degrees(docs, nodes, links, found, words, percent), found)


def _joined(docs: DataFrame, words: int, percent: int, records_per_bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: the set of each row; links: enough pairs of nodes for the components; found: the component of each linked node)."""
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(8, -(-int(size * 0.08) // records_per_bucket))
    nodes = table(docs.mapInArrow(_namer(words), "doc_id long, node long, witness long, n_shingles long"), "nodes")
    clash = nodes.groupBy("node").agg(F.min("witness").alias("l"), F.max("witness").alias("h")).where("l <> h")
    if not clash.isEmpty():
        raise ValueError("two different shingle sets share a 64-bit node hash")
    packed = docs.mapInArrow(_signer(buckets, words, percent), "bucket long, packed binary")
    ways = _ways(docs, buckets, words, percent, records_per_bucket)
    dealt = packed.join(ways, packed["bucket"] == ways["hot"], "left").withColumn("split", F.coalesce("ways", F.lit(1)))
    dealt = dealt.select("bucket", F.pmod(F.xxhash64("packed"), F.col("split")).cast("int").alias("block"), "split", "packed")
    met = table(dealt.groupBy("bucket", "block", "split").applyInPandas(_group, "kind int, x long, y long, z long"), "met")
    tries = met.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    links = _linked(docs, nodes, tries, words, percent)
    found = table(components(links), "components")
    more = _across(docs, nodes, met.where("kind = 1"), found, words, percent).join(tries, ["a", "b"], "left_anti")
    again = _linked(docs, nodes, more, words, percent)
    if not again.isEmpty():
        links = links.union(again)
        found = table(components(links), "components")
    return nodes, links, found


def _ways(docs: DataFrame, buckets: int, words: int, percent: int, records_per_bucket: int) -> DataFrame:
    """(hot, ways): buckets with a signature that very many sets share, and into how many blocks to deal them.

    Read off one document in ``PROBE``; a wrong guess costs time or memory, no link.
    """
    probe = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PROBE)) == 0).mapInArrow(_signer(buckets, words, percent), "bucket long, packed binary")
    weight = probe.groupBy("bucket").agg(F.sum(F.length("packed")).alias("bytes"))
    ways = F.ceil(F.col("bytes") * PROBE / 20 / (8 * records_per_bucket)).cast("int")
    hot = table(weight.select(F.col("bucket").alias("hot"), ways.alias("ways")).where("ways > 1"), "hot")
    return F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot


def _across(docs: DataFrame, nodes: DataFrame, groups: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Distinct pairs of a signature group in different components that can reach the threshold.

    Beyond the bytes of their group, the bytes of all pieces are compared: of 8 G
    pieces at most k may differ.  Groups are dealt to parts, and the bytes of a set go
    once to each part that has it.  A group above ``HOT_GROUP`` is cut into blocks,
    and each two blocks meet in a part of their own.
    """
    member = groups.select(F.col("x").alias("sig"), F.col("y").alias("node"), F.col("z").alias("marks"))
    member = member.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = member.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members")).where("low <> high")
    member = table(member.join(mixed.select("sig", "members"), "sig"), "mixed")
    level = F.col("sig").bitwiseAND(F.lit(int(LEVEL_BITS)))
    # A set has one or two grid values: parts of one grid value each, so its bytes go to few of them. At most 64 rows here.
    sizes = {r["level"]: r["count"] for r in member.groupBy(level.alias("level")).count().collect()}
    parts = F.element_at(F.create_map(*[F.lit(x) for k, n in (sizes or {0: 1}).items() for x in (k, -(-n // PART_ROWS))]), level)
    part = level * 1_000_000 + F.pmod(F.xxhash64("sig"), parts)
    blocks = F.ceil(F.col("members") / HOT_GROUP).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    dealt = member.withColumn("own", own).select(
        "sig", "node", "label", "marks", "own", level.alias("level"), part.alias("part"), F.explode(meets).alias("m")
    ).select("sig", "node", "label", "marks", "own", "level", "part", "m.i", "m.j")

    def all_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for s in shingle_sets(batch.column("text"), words):
                node = node_of(s)
                rows += [(node, level_index(g), len(s), piece_marks(s, g)[1].tobytes()) for g in levels(len(s), percent)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=["node", "level", "n", "all_marks"]
            )

    vectors = _of_nodes(docs, nodes, member.select("node").distinct()).mapInArrow(all_marks, "node long, level long, n long, all_marks binary")
    vectors = vectors.dropDuplicates(["node", "level"])
    sent = dealt.select("part", "i", "j", "node", "level").distinct().join(vectors, ["node", "level"])
    sent = sent.select(*[F.col(c).alias(c) for c in sent.columns])  # columns of its own, for the cogroup
    keys = ["part", "i", "j"]
    pairs = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(_possible(percent), "a long, b long")
    return pairs.distinct()


def _possible(percent: int):
    def run(key, members, sent):
        import pandas as pd

        i, j = int(key[1]), int(key[2])
        at = {k: r for r, k in enumerate(zip(sent["node"], sent["level"]))}
        size, marks = sent["n"].to_numpy(dtype=np.int64), sent["all_marks"].tolist()
        out = [np.zeros((0, 2), dtype=np.int64)]
        for _, group in members.groupby("sig", sort=False):
            node, label, own = (group[c].to_numpy() for c in ("node", "label", "own"))
            where = np.array([at[k] for k in zip(node, group["level"])])
            near = group["marks"].to_numpy(dtype=np.int64)
            whole = np.frombuffer(b"".join(marks[r] for r in where), dtype=np.uint8).reshape(len(group), -1)
            n = size[where]
            for x in range(len(group) - 1):
                rest = np.arange(x + 1, len(group))
                ok = label[rest] != label[x]
                if i != j:
                    ok &= own[rest] != own[x]
                rest = rest[ok]
                rest = rest[alike((near[rest] ^ near[x]).view(np.uint64), np.uint64(0))] if len(rest) else rest
                if len(rest):
                    most = (100 - percent) * (n[rest] + n[x]) // (100 + percent)
                    rest = rest[(whole[rest] != whole[x]).sum(axis=1) <= most]
                if len(rest):
                    out.append(np.stack([np.minimum(node[rest], node[x]), np.maximum(node[rest], node[x])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def shared_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each set on the left with each on the right."""
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    known, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at = [at[: len(rows[0])], at[len(rows[0]) :]]
    n = [np.bincount(x, minlength=len(known)) for x in at]
    meets = n[0] * n[1]
    dense = np.flatnonzero(meets * DENSE >= len(left) * len(right))
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    column = np.full(len(known), -1)
    column[dense] = np.arange(len(dense))
    own = [column[x] for x in at]
    for first in range(0, len(dense), 2048):
        cells = []
        for side, r, c in zip((left, right), rows, own):
            here = (c >= first) & (c < first + 2048)
            m = np.zeros((len(side), min(2048, len(dense) - first)), dtype=np.float32)
            m[r[here], c[here] - first] = 1
            cells.append(m)
        out += np.rint(cells[0] @ cells[1].T).astype(np.int64).ravel()
    order = np.argsort(at[1], kind="stable")
    begin = np.cumsum(n[1]) - n[1]
    rare = np.flatnonzero((own[0] < 0) & (meets[at[0]] > 0))
    times = n[1][at[0][rare]]
    ends = np.cumsum(times)
    a = 0
    while a < len(rare):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + 4_000_000)))
        t = times[a:b]
        beside = np.repeat(begin[at[0][rare[a:b]]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
        out += np.bincount(np.repeat(rows[0][rare[a:b]], t) * len(right) + rows[1][order[beside]], minlength=len(out))
        a = b
    return out.reshape(len(left), len(right))


def _degrees(docs: DataFrame, nodes: DataFrame, links: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, n_links) of every linked node, counted over all pairs of sets that reach the threshold.

    A component whose known links are all its pairs is done.  The others are cut
    into blocks, each two blocks meet in one task, and a task gives a count for
    each of its nodes: no pair is a row, and each pair is in one task only.
    """
    sized = found.join(nodes.select("node", "n_shingles").distinct(), "node")
    held = links.join(found, links["a"] == found["node"]).groupBy("label").agg(F.count("*").alias("held"))
    per = sized.groupBy("label").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("shingles")).join(held, "label")
    per = table(per.withColumn("whole", 2 * F.col("held") == F.col("members") * (F.col("members") - 1)), "sizes")
    done = found.join(per.where("whole"), "label").select("node", (F.col("members") - 1).alias("n_links"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    per = per.where("NOT whole").withColumn("blocks", blocks)
    small = per.where("blocks = 1").agg(F.sum("shingles")).first()[0] or 0
    part = F.when(F.col("blocks") > 1, F.col("label")).otherwise(F.pmod(F.xxhash64("label"), F.lit(-(-small // BLOCK_SHINGLES) or 1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    member = found.join(per.select("label", "blocks"), "label").withColumns({"own": own, "part": part, "large": F.col("blocks") > 1})
    member = table(member, "members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            all_sets = shingle_sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([node_of(s) for s in all_sets], pa.int64()), pa.array([s.tobytes() for s in all_sets], pa.binary())], names=["node", "shingles"],
            )

    known = _of_nodes(docs, nodes, member.select("node")).mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"])
    dealt = member.join(known, "node").select("node", "label", "shingles", "own", "large", "part", F.explode(meets).alias("m"))
    dealt = dealt.select("node", "label", "shingles", "own", "large", "part", "m.i", "m.j")
    counted = dealt.groupBy("large", "part", "i", "j").applyInPandas(_counter(percent), "node long, n_links long")
    return done.union(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")))


def _counter(percent: int):
    def run(key, pdf):
        import pandas as pd

        i, j = int(key[2]), int(key[3])
        out = []
        for _, group in pdf.groupby("label", sort=False):
            node, own = group["node"].to_numpy(), group["own"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
            sides = [np.flatnonzero(own == k) for k in ((i,) if i == j else (i, j))]
            if not all(len(x) for x in sides):
                continue
            one, two = sides[0], sides[-1]
            left, right = [sets[x] for x in one], [sets[x] for x in two]
            both = shared_sizes(left, right)
            all_of = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right]) - both
            hit = 100 * both >= percent * all_of
            if i == j:
                np.fill_diagonal(hit, False)
                out.append((node[one], hit.sum(axis=1)))
            else:
                out += [(node[one], hit.sum(axis=1)), (node[two], hit.sum(axis=0))]
        columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1)]
        return pd.DataFrame({"node": columns[0], "n_links": columns[1]})

    return run


def _report(nodes: DataFrame, degree: DataFrame, found: DataFrame) -> DataFrame:
    classes = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(found, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(lowest, "label").select("node", "component_id", "n_links")
    named = nodes.withColumn("key", F.when(F.col("n_shingles") > 0, F.col("node")))
    # A class with very many equal documents is a skewed side of this join, which adaptive execution splits.
    out = named.join(classes.withColumnRenamed("node", "key"), "key", "left")
    return out.select(
        "doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("node").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each component exactly one row of ``docs``, all columns kept: the one with the smallest doc_id (null last).

    Rows that agree in doc_id are ordered by a hash of their text, and of rows that agree in both
    one stays.  Rows without words, null text too, stay.  Texts of any length are
    compared whole; an empty table gives an empty result; columns may have any names.
    """
    plain = texts(docs)
    _, _, found = _joined(plain, words, percent, RECORDS_PER_BUCKET)
    # The set of a text is known by its hash: rows are told apart by (doc_id, text hash), not by doc_id alone.
    named = table(plain.select("doc_id", "text", _mark(F.col("text")).alias("mark")).mapInArrow(_marker(words), "doc_id long, mark string, node long"), "marks")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    labelled = named.join(found, "node", "left").withColumn("label", F.coalesce("label", "node")).withColumn("first", first)
    keep = labelled.groupBy("label").agg(F.min("first").alias("keep"))
    fate = labelled.join(keep, "label").groupBy("doc_id", "mark").agg(
        F.max(F.col("first") == F.col("keep")).alias("__kept"), F.count("*").alias("__rows")
    )
    fate = table(fate.select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), "__kept", "__rows"), "fate")
    mark = _mark(F.coalesce(docs["text"], F.lit("")))
    gone = fate.where("NOT __kept")
    stay = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__d"]) & (mark == gone["__m"]), "left_anti")
    # Rows that agree in doc_id and text: only where there are any.
    repeated = fate.where("__kept AND __rows > 1").select("__d", "__m")
    if repeated.isEmpty():
        return stay
    packed = stay.select(F.struct("*").alias("r"))
    packed = packed.withColumns({"__a": F.col("r.doc_id"), "__b": _mark(F.coalesce(F.col("r.text"), F.lit("")))})
    match = F.col("__a").eqNullSafe(F.col("__d")) & (F.col("__b") == F.col("__m"))
    one = packed.join(repeated, match, "left_semi").groupBy("__a", "__b").agg(F.first("r").alias("r"))
    return packed.join(repeated, match, "left_anti").select("r.*").unionByName(one.select("r.*"))


def _mark(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _marker(words: int):
    """The set of each row that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), words)
            full = np.array([len(s) > 0 for s in sets], dtype=bool)
            nodes = pa.array([node_of(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), nodes], names=["doc_id", "mark", "node"]).filter(pa.array(full))

    return run
