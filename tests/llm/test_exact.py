"""Operators with an exact answer against brute force."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from odd_inputs import empty, odd  # noqa: F401
from tickloom.llm import backoff, byte_bpe, exact_dedup, licenses, merkle, mixing, partenum, queries, wavelet
from tickloom.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(odd):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in odd.select("doc_id", "text", "source").collect()]


def key(x):
    return tuple((v is None, 0 if v is None else v) for v in x)


def test_exact_dedup(odd, empty):
    groups = defaultdict(list)
    for d, t, _ in plain(odd):
        groups[re.sub("[\x20\x09-\x0d]", "", t)].append((d, len(t)))
    want = []
    for t, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        want += [(d, keep, len(members), hashlib.sha256(t.encode()).hexdigest()) for d, _ in members]
    got = exact_dedup.resolve(odd, fan_in=2).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=key) == sorted(want, key=key)
    assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.resolve(empty).count() == 0 and exact_dedup.kept_documents(empty).count() == 0


def sets_of(odd):
    out = []
    for d, t, _ in plain(odd):
        w = WORD.findall(t.translate(LOWER))
        out.append((d, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


@pytest.mark.parametrize("records", [partenum.RECORDS_PER_BUCKET, 50])
def test_jaccard_components(odd, empty, records, monkeypatch):
    monkeypatch.setattr(partenum, "PROBE", 1)
    if records == 50:  # several blocks for buckets and for groups
        monkeypatch.setattr(partenum, "HOT_GROUP", 6)
        monkeypatch.setattr(partenum, "PART_ROWS", 500)
    sets = sets_of(odd)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        members[find(i)].append(d)
    least = {c: min((d for d in ds if d is not None), default=None) for c, ds in members.items()}
    want = [(d, len(s), least[find(i)] if s else d) for i, (d, s) in enumerate(sets)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(odd, records_per_bucket=records).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    if records > 50:
        assert partenum.jaccard_components(empty).count() == 0
        kept = partenum.one_of_each(odd)
        assert kept.columns == odd.columns and kept.where("doc_id IN (0, 5, 6, 8)").count() == 4 and kept.where("doc_id IN (1, 3, 4)").count() == 0


@pytest.mark.parametrize("sets_a_block", [partenum.BLOCK_SETS, 7])
def test_jaccard_counts_every_link(spark, odd, sets_a_block, monkeypatch):
    """n_links: all other sets that reach the threshold, also those that the components do not need."""
    monkeypatch.setattr(partenum, "BLOCK_SETS", sets_a_block)
    rng = np.random.default_rng(11)
    base = [f"v{i}" for i in range(90)]
    rows = [(1000 + k, " ".join([*base[: 70 + k % 13], *(f"r{int(x)}" for x in rng.integers(0, 9, k % 7))])) for k in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    from pyspark.sql import functions as F

    sets = [(d, frozenset(s)) for d, s in sets_of(docs.withColumn("source", F.lit(None)))]
    different = {s for _, s in sets if s}
    degree = {s: sum(1 for t in different if t != s and 100 * len(s & t) >= 80 * len(s | t)) for s in different}
    got = [(r["doc_id"], r["n_shingles"], r["n_links"]) for r in partenum.jaccard_components(docs).collect()]
    assert sorted(got, key=key) == sorted(((d, len(s), degree.get(s, 0)) for d, s in sets), key=key)
    assert max(degree.values()) > 20


def test_one_row_of_each_component(spark):
    """Rows are told apart by doc_id and text: linked and unlinked rows without doc_id, a repeated doc_id, repeated rows."""
    a, b, c, d = ([f"{x}{i}" for i in range(60)] for x in "abcd")
    near = lambda x, k: " ".join(x[: 60 - k])
    rows = [
        (1, near(a, 0)), (None, near(a, 1)), (None, "alone without an id here"), (None, near(b, 0)), (None, near(b, 1)), (None, near(b, 2)),
        (2, near(c, 0)), (9, near(c, 1)), (9, near(d, 0)), (20, near(d, 1)), (30, "the same row more than once"), (30, "the same row more than once"),
        (None, "one two three four five six"), (None, "one two three four five six"), (40, ""), (40, None), (None, None), (None, " "),
    ]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    kept = partenum.one_of_each(docs)
    got = sorted(r["place"] for r in kept.collect())
    assert kept.columns == docs.columns and len(got) == len(set(got))
    groups = [{0}, {2}, {3, 4, 5}, {6}, {8}, {10, 11}, {12, 13}]
    assert set(got) - set().union(*groups) == {14, 15, 16, 17} and all(len(g & set(got)) == 1 for g in groups)


def test_exact_dedup_repeated_null_text(spark):
    """Rows that agree in doc_id and null text: one stays, with all its columns."""
    docs = spark.createDataFrame([(3, None, "a"), (3, None, "a"), (4, "", "b")], "doc_id long, text string, source string")
    assert [tuple(r) for r in exact_dedup.kept_documents(docs).collect()] == [(3, None, "a")]


def test_shared_sizes(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, n, n // 2 + 1)).astype(np.uint64) for n in rng.integers(1, 9_000, 40)]
    want = [[len(np.intersect1d(a, b)) for b in sets[25:]] for a in sets[:25]]
    for dense in (0, 3, 100, 10**9):
        monkeypatch.setattr(partenum, "DENSE", dense)
        assert partenum.shared_sizes(sets[:25], sets[25:]).tolist() == want


def test_grid_covers_every_pair():
    for a in range(1, 400):
        for b in range(a, a * 100 // 80 + 1):
            parts = partenum.parts_for(a, b)
            assert parts in partenum.levels(a) and parts in partenum.levels(b)
            assert parts * (partenum.TOLERATED + 1) > (a + b) * 20 // 180


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 1), (5, 5), (20, 10), (10, 30), (30, 40)] + [(100, 100 + i) for i in range(1, 50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: got[n] for n in (1, 2, 3, 8, 9, 10, 20, 30, 40, 149)} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 10, 20: 10, 30: 10, 40: 10, 149: 100}


def test_merkle(odd, empty):
    rows = sorted({(d, t) for d, t, _ in plain(odd)}, key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1])))
    got = {(r["doc_id"], r["edited_sha256"]): r for r in merkle.edit_report(odd, slices=3).collect()}
    prints = defaultdict(set)
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        if sum(x[0] == d for x in rows) > 1:
            continue  # ties in doc_id are ordered by a hash
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        if sum(x[0] == n for n, f in rows if f == following for x in rows) <= 1:
            r = got[(d, hashlib.sha256(edited.encode()).hexdigest())]
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(t)
            assert (r["fingerprint"] == r["edited_fingerprint"]) == (edited == t)
            prints[t].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({min(p) for p in prints.values()}) == len(prints)
    assert merkle.edit_report(odd).count() == odd.count() and merkle.edit_report(empty).count() == 0


def test_merkle_locates_edits(spark):
    from pyspark.sql import functions as F

    lines = [f"line {i} " + "word " * 30 + "\n" for i in range(40)]
    other = lines[:17] + ["changed\n"] + lines[18:]
    df = spark.createDataFrame([("".join(lines), "".join(other))], "a string, b string")
    df = merkle.with_fingerprint(merkle.with_fingerprint(df, "a", "fa"), "b", "fb")
    r = df.select(
        merkle.first_change(F.col("fa"), F.col("fb")).alias("at"),
        merkle.likeness(F.col("fa"), F.col("fb"), merkle.leaves_of(F.col("fa")), merkle.leaves_of(F.col("fb"))).alias("near"),
    ).first()
    assert r["at"] == 17 and 0.9 < r["near"] < 1


def test_licenses(odd, empty):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for d, t, _ in plain(odd):
        w = split.findall(t.translate(LOWER))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want.append((d, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    got = licenses.scan(odd).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan(empty).count() == 0


def test_license_templates_found(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    text = filler + "This program: you can REDISTRIBUTE it and/or modify it under the terms of the GNU General Public License " + filler
    docs = spark.createDataFrame([(1, text), (2, filler), (3, "the terms of the")], "doc_id long, text string")
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = {}
    for d, t in ((1, text), (2, filler), (3, "the terms of the")):
        w = split.findall(t.translate(LOWER))
        blocks = [set(w[i : i + licenses.BLOCK]) for i in range(0, len(w), licenses.STEP)]
        shares = [(label, max(len(b & set(p.split())) / len(set(p.split())) for b in blocks)) for label, p in licenses.TEMPLATES]
        found = [(label, x) for label, x in shares if x >= licenses.CONTAINMENT]
        want[d] = (",".join(sorted({label for label, _ in found})), max((x for _, x in found), default=0.0))
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(docs).collect()} == want
    assert "gpl" in want[1][0].split(",")


def seats(claims, n, caps):
    held = [0] * len(claims)
    for _ in range(n):
        open_ = [i for i in range(len(claims)) if held[i] < caps[i]]
        if not open_:
            break
        held[max(open_, key=lambda i: (claims[i] / (2 * held[i] + 1), -i))] += 1
    return held


@pytest.mark.parametrize("claims, n, caps", [
    ([50, 30, 20, 7], 10, [99] * 4), ([50, 30, 20, 7], 25, [8, 99, 99, 1]), ([5.0, 5.0, 5.0], 4, [9] * 3), ([0, 3], 2, [5, 5]), ([1000, 1], 7, [3, 9]),
])
def test_apportionment(spark, claims, n, caps):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, float(c), m) for i, (c, m) in enumerate(zip(claims, caps))], "id long, claim double, most long")
    got = {r["id"]: r["quota"] for r in mixing.apportion(df, [], "claim", F.lit(n).cast("long"), "most", [F.col("id").asc()]).collect()}
    assert [got[i] for i in range(len(claims))] == seats(claims, n, caps)


def test_mix(odd, empty):
    rows = plain(odd)
    totals = Counter()
    for _, t, s in rows:
        totals[s] += len(WORD.findall(t))
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, left, total = {}, set(order), 1.5 * sum(totals.values())
    while left:
        level = (total - sum(goal.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * totals[s]]
        if not over:
            goal.update({s: level * weight[s] for s in left})
            break
        for s in over:
            goal[s] = 2 * totals[s]
            left.discard(s)
    got = mixing.mix(odd, block=8, shard_tokens=5_000).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted(
        (d, len(WORD.findall(t))) for d, t, _ in rows if d is not None
    )
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    targets = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert targets == {(totals[s], round(float(goal[s]), 6)) for s in order}
    assert abs(sum(r["taken"] for r in got) - total) < 0.05 * total
    again = mixing.mix(odd.repartition(3), block=8, shard_tokens=5_000).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, again), key=key)
    kept = mixing.mixed_documents(odd, block=8)
    assert kept.columns == odd.columns and kept.where("text IS NULL OR trim(text) = ''").count() >= 3
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_small_sources(spark):
    """Sources of less than a block, beside large ones, with the default block."""
    rows = [(i, f"w{i} " * (3 + i % 60), f"tail{i // 2:03}") for i in range(160)] + [(1000 + i, "x " * 900, "big" if i % 2 else "other") for i in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    source_of = {d: s for d, _, s in rows}
    taken, goal = Counter(), {}
    for r in got.collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
        goal[source_of[r["doc_id"]]] = r["target"]
    assert len(goal) == 82
    for s, t in goal.items():
        assert abs(taken[s] - t) <= max(1, t / mixing.FEW + 1), (s, taken[s], t)


def test_wavelet_sequence():
    rng = np.random.default_rng(3)
    for ids in (np.zeros(0, int), np.array([5]), rng.integers(0, 50, 5000), rng.integers(0, 70_000, 3000)):
        wm, names, counts = wavelet.load(wavelet.dump(ids.astype(np.uint32), [None, 4], np.array([0, len(ids)])))
        assert wm.decode().tolist() == ids.tolist() and names == [None, 4] and counts.tolist() == [0, len(ids)]
        for i in rng.integers(0, max(1, len(ids)), 30) if len(ids) else ():
            token, at = int(ids[i]), np.flatnonzero(ids == ids[i])
            assert wm.access(int(i)) == token and wm.rank(token, int(i)) == (at < i).sum() and wm.select(token, len(at) - 1) == at[-1]
        assert wm.rank(1 << 20, wm.n) == 0 and wm.select(1 << 20, 0) == -1


def test_wavelet_round_trip(odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    known = Tokenizer.from_file(path)
    start, want = 0, []
    for d, t, _ in sorted(plain(odd), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*known.encode(t, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = wavelet.round_trip(odd, path, str(tmp_path / "wm"), shard_tokens=700).collect()
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    spark = odd.sparkSession
    assert wavelet.occurrences(spark, str(tmp_path / "wm"), 1).count() == len(want)
    assert wavelet.round_trip(empty, path, str(tmp_path / "none")).count() == 0


def test_byte_bpe(odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t, _ in plain(odd):
        ids = np.array(known.encode_ordinary(t), dtype="<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = byte_bpe.encoded(odd, path, public_tokenizers.PATTERN, with_ids=True)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(want, key=key)
    texts = [bytes(r["bytes"]).decode() for r in byte_bpe.decoded(got, path, public_tokenizers.PATTERN).collect()]
    assert sorted(texts) == sorted(t for _, t, _ in plain(odd))
    assert byte_bpe.encoded(empty, path, public_tokenizers.PATTERN).count() == 0
    bpe = byte_bpe.ByteBpe.load(path, public_tokenizers.PATTERN)
    odd_texts = ["a" * 700 + " " + "ab" * 900, "  b", "a  b\n\n c ", "½²٣ x१", "\r\n\t x", "<|endoftext|>", "0123456789" * 80]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_batch(odd_texts)] == [known.encode_ordinary(t) for t in odd_texts]


def test_backoff(odd, empty):
    words = [WORD.findall(t.translate(LOWER)) for _, t, _ in plain(odd)]
    counts = [Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1)) for n in range(4)]
    total, want = sum(map(len, words)), []
    for (d, _, _), w in zip(plain(odd), words):
        score = 0.0
        for i in range(len(w)):
            n = min(3, i + 1)
            while n > 1 and counts[n][tuple(w[i - n + 1 : i + 1])] < 2:
                n, score = n - 1, score + math.log(0.4)
            gram = tuple(w[i - n + 1 : i + 1])
            score += math.log(counts[n][gram] / (counts[n - 1][gram[:-1]] if n > 1 else total))
        want.append((d, len(w), round(score, 4)))
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 4)) for r in backoff.scores(odd, batch_chars=20_000, bucket_entries=3_000).collect()]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-3)
    assert backoff.scores(empty).count() == 0


def test_backoff_query_counts_single_occurrences(spark, tmp_path):
    """The registered query: an n-gram that occurs once has its own score."""
    texts = ["a b c d", "a b x y z", "only once here", "b c", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [(t or "").split() for t in texts]
    counts = [Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1)) for n in range(4)]
    total = sum(map(len, words))
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_stupid_backoff"](spark, str(tmp_path)).collect()}
    for d, w in enumerate(words):
        score = sum(
            math.log(counts[n][tuple(w[i - n + 1 : i + 1])] / (counts[n - 1][tuple(w[i - n + 1 : i])] if n > 1 else total))
            for i, n in ((i, min(3, i + 1)) for i in range(len(w)))
        )
        assert got[d]["log_score"] == pytest.approx(score, abs=1e-9) and got[d]["from_3"] == max(0, len(w) - 2)
