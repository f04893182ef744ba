"""Token counts, ranked search and whitening against the libraries and brute force; words whose hashes used to clash."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from odd_inputs import empty, odd  # noqa: F401
from tickloom.llm import backoff, byte_bpe, kneser_ney, max_sketch, partenum, piece_counts, postings, wavelet, whitening
from tickloom.llm.words import word_hashes

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SPECIAL = [
    (900, "x<|endoftext|>y <|startoftext|>"), (901, "É é don't I'M ab'll 12,3 ...!? a b\u0085c\x1cd ﬁ İ"), (902, "A" * 3000 + " " + "ab" * 900),
    (903, "<|ENDOFTEXT|> < |endoftext|>"), (904, "\x00\x01 word\x7f"),
]


def key(x):
    return tuple((v is None, 0 if v is None else v) for v in x)


def with_special(spark, odd):
    return odd.unionByName(spark.createDataFrame(SPECIAL, "doc_id long, text string"), allowMissingColumns=True)


@pytest.mark.parametrize("slice_text", [piece_counts.SLICE_TEXT, 2000])
def test_piece_counts_equal_the_library(spark, odd, empty, slice_text, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(piece_counts, "SLICE_TEXT", slice_text)
    monkeypatch.setattr(piece_counts, "ERA_TASKS", 2 if slice_text == 2000 else piece_counts.ERA_TASKS)
    docs = with_special(spark, odd)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    counted = [len(e.ids) for e in Tokenizer.from_file(WORD_FILE).encode_batch([t for _, t in rows], add_special_tokens=False)]
    want = [(d, len(t.encode()), n, n > 50) for (d, t), n in zip(rows, counted)]
    got = piece_counts.token_counts(docs, WORD_FILE, limit=50)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert piece_counts.token_counts(empty, WORD_FILE).count() == 0


def test_piece_counts_of_a_tokenizer_that_joins_over_spaces(spark, odd):
    """Pieces of this file begin with their space, so texts are read whole."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd.where("length(text) < 4000").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counted = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t for _, t in rows], add_special_tokens=False)]
    got = piece_counts.token_counts(docs, path).select("doc_id", "n_tokens")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((d, n) for (d, _), n in zip(rows, counted)), key=key)
    assert not piece_counts.PreTokens.load(path).spaced and piece_counts.PreTokens.load(WORD_FILE).spaced
    with pytest.raises(ValueError):
        piece_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def brute_search(docs, items, top):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, query in asked.items():
        scored = []
        for d, c in terms:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in query if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("width, slice_docs, block", [(max_sketch.WIDTH, postings.SLICE_DOCS, max_sketch.QUERY_BLOCK), (32, 7, 40)])
def test_search_equals_brute_force(spark, odd, width, slice_docs, block, monkeypatch):
    """Also with sketches so narrow that terms share coordinates, many slices, and several blocks of queries."""
    monkeypatch.setattr(postings, "SLICE_DOCS", slice_docs)
    monkeypatch.setattr(max_sketch, "FIRST_ROUND", 16 if slice_docs > 7 else 2)
    docs = with_special(spark, odd)
    items = spark.createDataFrame(
        [(1, "w1 w2 W3 w3, w4"), (2, "one two three"), (3, None), (4, "nothing of it"), (None, "Repeat me"), (5, "w7"), (5, "w8 w7"), (6, "漢字 don don't é"), (7, " ".join(f"w{i}" for i in range(0, 400, 3)))],
        "item_id long, text string",
    )
    want = brute_search([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()], 10)
    found = max_sketch.search(max_sketch.index(docs, width), items, width=width, block_text=block)
    assert sorted((tuple(r)[:4] for r in found.collect()), key=key) == sorted(want, key=key)


def test_search_of_empty_tables(odd, empty, spark):
    items = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert max_sketch.ranked(empty, items).count() == 0 and max_sketch.ranked(odd, items.limit(0)).count() == 0
    assert max_sketch.ranked(empty, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def whitened_by_numpy(vectors, k):
    x = np.unique(np.array(vectors, dtype=np.int64), axis=0)
    n, total = len(x), x.sum(axis=0)
    y = x - total / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, total, values, axes, values / np.trace(y.T @ y / n)


def test_whitening_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((150, 12)) * np.linspace(0.4, 2, 12)).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist(), 2) for i in range(60)]
    odd_rows = [(2000, None, 0), (2001, [], 0), (2002, [1.0] * 11, 0), (2003, [float("nan")] + [0.0] * 11, 0), (2004, [None] + [0.0] * 11, 0), (2005, [float("inf")] * 12, 0), (None, base[1].tolist(), 5)]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("vector", "length", "component", "n")}).repartition(5)
    got = whitening.whiten(df).toPandas()
    whole = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v, _ in rows} | {None: np.floor(256 * base[1].astype(np.float64)).astype(np.int64)}
    n, total, values, axes, explained = whitened_by_numpy(list(whole.values()), 4)
    assert len(got) == 4 * len(whole) and set(got["n"]) == {n} and n == 150
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-10
    for c in range(4):
        own = got[got["component"] == c + 1]
        assert own["explained"].to_numpy() == pytest.approx(np.full(len(own), explained[c]), rel=1e-10)
        x = np.array([whole[None if np.isnan(i) else int(i)] for i in own["vec_id"]])
        assert own["deviation"].tolist() == ((n * x - total) ** 2).sum(axis=1).tolist()
        want = (x - total / n) @ axes[:, c] / np.sqrt(values[c])
        sign = np.sign(want @ own["whitened"].to_numpy())
        assert own["whitened"].to_numpy() == pytest.approx(sign * want, abs=1e-8)


def test_whitening_of_small_and_flat_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    line = whitening.whiten(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [0.0, 1.0])], schema)).collect()
    assert sorted((r["vec_id"], r["component"], abs(r["whitened"]) if r["whitened"] is not None else None, r["explained"]) for r in line) == [
        (i, c, 1.0 if c == 1 else None, 1.0 if c == 1 else 0.0) for i in (1, 2, 3) for c in (1, 2)
    ]
    far = whitening.whiten(spark.createDataFrame([(1, [3e38]), (2, [-3e38])], schema)).collect()
    assert [r["deviation"] for r in far] == [None, None] and all(r["whitened"] is not None for r in far)


@pytest.mark.parametrize("length, rows", [(40, 500), (200, 300), (5, 1000)])
def test_jacobi_davidson(length, rows):
    """Close, repeated and zero eigenvalues; fewer rows than entries."""
    rng = np.random.default_rng(length)
    for scale in (np.ones(length), np.linspace(1, 2, length), 10.0 ** -np.arange(length) if length < 20 else np.r_[np.ones(length - 3) * 3, np.zeros(3)]):
        x = rng.standard_normal((rows, length)) * scale
        v = x.T @ x / rows
        values, axes, _ = whitening.leading(lambda b, v=v: v @ b, length, 4)
        want = np.linalg.eigvalsh(v)[::-1][:4]
        assert values == pytest.approx(want, abs=1e-12 * want[0])
        assert np.abs(axes.T @ axes - np.eye(4)).max() < 1e-12 and np.linalg.norm(v @ axes - axes * values) < 1e-12 * want[0]


def mirrored(n):
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("length", [64, 1024, 4096])
def test_mirrored_words_are_told_apart(spark, length):
    """Two letters in the Thue-Morse order and its mirror, whose sums of values times powers agree."""
    a, b = mirrored(length)
    for second in (False, True):
        hashes, _ = word_hashes(pa.array([a, b, a.upper() + "\n"]), second)
        assert hashes[0] != hashes[1] and hashes[0] == hashes[2]
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_components(docs).collect()}
    assert found == {1: 1, 2: 2, 3: 1}
    if length == 1024:
        words = wavelet.WordTokenizer.load(WORD_FILE)
        ids, bounds = words.encode(pa.array([a, b]))
        want = [e.ids for e in words.tokenizer.encode_batch([a, b], add_special_tokens=False)]
        assert [ids[bounds[k] : bounds[k + 1]].tolist() for k in range(2)] == want and want[0] != want[1]


def test_word_tokenizer_takes_whole_texts_where_pieces_join_over_spaces():
    words = wavelet.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two  three", "", None, "don't <|endoftext|>"]
    ids, bounds = words.encode(pa.array(texts))
    want = [e.ids for e in words.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert not words.by_word and [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want


def test_marks_at_word_ends_are_looked_up_alone():
    """A word with several marks costs the library one word and one run of marks, not a word for each pair; ids stay the library's."""
    words = wavelet.WordTokenizer(WORD_FILE)
    plain, marks = ["abc", "Éçou", "straße", "x9", "ÿ"], ["", "$$$", ".%%%", "!!", ","]
    texts = [a + m for a in plain for m in marks] + ["can't.", "é×!", "3÷?", "a<|endoftext|>!!", "a|>$$", "İ.", "e\u0301.", "...", "a" * 99 + "!" * 99, "", None]
    for column in (pa.array([*texts, " ".join(t or "" for t in texts)]), pa.array(texts).slice(3)):
        ids, bounds = words.encode(column)
        want = [e.ids for e in words.tokenizer.encode_batch([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    words.clear()
    words.encode(pa.array([a + m for a in plain for m in marks]))
    assert len(words.keys) == len(plain) + len(marks) - 1


def test_chunks_end_at_ascii_space_only():
    """White space of more than one byte before an ASCII one is the same run."""
    import tiktoken

    bpe = byte_bpe.ByteBpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    texts = ["x  y", "　 a", "a ", " lead  ", "a\t\n b\r\nc \x85 d\x85 e", "é   b", "", None, "\x1c a\x1cb \x1c", "x" * 3000 + " " + "ab" * 900]
    ids, bounds = bpe.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [own.encode_ordinary(t or "") for t in texts]


def test_language_names_are_hashed_whole():
    names = ["x" * 64 + "a", "x" * 64 + "b", "", None, "=", "\0"]
    assert len(set(kneser_ney.language_hash(names).tolist())) == len(names)


def test_counts_above_32_bits():
    values = np.array([5, 2**50], dtype=np.uint64)
    rows = pa.table({"batch": [0, 1], "n": pa.array([1, 1], pa.int32()), "bucket": [0, 0], "packed": [backoff.pack(values, np.array([3_000_000_000, 7]))] * 2})
    for blob in backoff._answer(rows).column("packed").to_pylist():
        assert backoff._unpack_counts(blob).tolist() == [6_000_000_000, 14]
