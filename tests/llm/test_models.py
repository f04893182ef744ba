"""Trained models: held-out accuracy, a brute-force model, odd inputs; the pipeline's stages."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from odd_inputs import empty, labels, odd  # noqa: F401
from tickloom.llm import kneser_ney, toxicity
from tickloom.llm.common import documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table(spark):
    return documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark):
    """On the largest of the small tables: the smaller ones label two dozen toxic documents in four languages."""
    from pyspark.sql import functions as F

    docs, labels = documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = toxicity.scored(docs, toxicity.train(docs, labels.where(half))).join(labels.where(~half).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    hits = Counter((bool(r["y"]), r["toxic"]) for r in found)
    assert hits[True, True] >= 0.8 * (hits[True, True] + hits[True, False]) and hits[False, True] <= 0.02 * len(found)


def test_toxicity_odd(odd, empty, labels):
    chain = toxicity.train(odd, labels)
    assert toxicity.scored(odd, chain).count() == odd.count() and toxicity.scored(empty, chain).count() == 0
    none = toxicity.train(empty, labels.where("toxic = 9"))
    assert toxicity.scored(odd, none).where("toxic").count() == 0
    kept = toxicity.clean_documents(odd, labels.where("toxic = 0"))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_linear_fit():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=30)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(2000)]
    y = (np.array([truth[r].sum() for r in rows]) + rng.logistic(size=2000) > 0).astype(float)
    ids, starts = np.concatenate(rows), np.arange(0, 12_001, 6)
    w, b, _ = toxicity.fit_linear(ids, starts, np.zeros((2000, 0)), y, np.ones(2000), 30)
    assert np.corrcoef(w, truth)[0, 1] > 0.95


def brute_model(texts):
    """Modified Kneser-Ney probability of a trigram, from the definition."""
    lines = [["<s>", "<s>", *t.lower().split(), "</s>"] for t in texts if t.split()]
    tri = Counter(tuple(x[i - 2 : i + 1]) for x in lines for i in range(2, len(x)))
    pair = Counter((v, w) for _, v, w in tri)
    word = Counter(w for _, w in pair)

    def discounts(c):
        n = [sum(1 for x in c.values() if x == i) for i in range(5)]
        y = n[1] / max(1, n[1] + 2 * n[2])
        return [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 for i in (1, 2, 3)]

    ds = [discounts(c) for c in (word, pair, tri)]
    tables = []
    for c, d in zip((word, pair, tri), ds):
        total, left = Counter(), defaultdict(float)
        for g, n in c.items():
            ctx = g[:-1] if isinstance(g, tuple) else ()
            total[ctx] += n
            left[ctx] += min(n, d[min(n, 3) - 1])
        tables.append((c, d, total, left))

    def p(gram):
        if not gram:
            return 1 / (len(word) + 1)
        c, d, total, left = tables[len(gram) - 1]
        g, ctx = (gram if len(gram) > 1 else gram[0]), gram[:-1]
        if ctx not in total:
            return p(gram[1:])
        n = c.get(g, 0)
        return (n - min(n, d[min(n, 3) - 1]) if n else 0) / total[ctx] + left[ctx] / total[ctx] * p(gram[1:])

    return p


def test_kneser_ney_against_definition(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{int(x)}" for x in rng.geometric(0.15, 40)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en", i) for i, t in enumerate([*texts, "t1 t2 never seen t3", "", None])], "doc_id long, text string, lang string, extra int")
    folder = f"file://{tmp_path}/model"
    kneser_ney.write_model(kneser_ney.model(docs.where("doc_id < 30")), folder, 4)
    got = {r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(docs, folder, 4).collect()}
    p = brute_model(texts)
    for i, t in [*enumerate(texts), (30, "t1 t2 never seen t3")]:
        line = ["<s>", "<s>", *t.split(), "</s>"]
        logs = [math.log(p(tuple(line[k - 2 : k + 1]))) for k in range(2, len(line))]
        assert got[i] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-4)
    assert got[31] is None and got[32] is None


def test_quality_held_out(table):
    docs, labels = table
    found = kneser_ney.classify(docs, labels).join(labels, "doc_id").collect()
    keep = Counter((r["quality"], r["keep"]) for r in found)
    assert keep[1, True] >= 0.97 * (keep[1, True] + keep[1, False]) and keep[0, False] >= 0.8 * (keep[0, True] + keep[0, False])


def test_quality_odd(odd, empty, labels):
    found = kneser_ney.classify(odd, labels)
    assert found.count() == odd.count() and found.where("keep IS NULL").count() == 0
    assert kneser_ney.classify(empty, labels).count() == 0
    assert kneser_ney.classify(odd, labels.where("quality = 9")).where("NOT keep AND n_words > 0").count() == 0


def test_quality_rare_languages(spark):
    """Each language with trusted text has a model and a threshold, however small its share; the sample is bounded in each."""
    rng = np.random.default_rng(8)
    langs = ["en"] * 150 + ["fi"] * 3 + ["xx"] + [None] * 2
    rows = [(i, " ".join(f"{x}{int(k)}" for k in rng.geometric(0.2, 30)), x) for i, x in enumerate(langs)] + [(900, "some words", "none"), (901, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in [*range(len(langs)), 901]], "doc_id long, quality int")
    taken = Counter(r["lang"] for r in kneser_ney.sample(docs, labels, 4).collect())
    assert taken["en"] == 4 and set(taken) == {"en", "fi", "xx", None}
    found = kneser_ney.classify(docs, labels, n=4).collect()
    for r in found:
        known = r["lang"] in ("en", "fi", "xx", None)
        assert (r["threshold"] is not None) == known and (r["perplexity"] is not None) == known


def test_quality_fits_all_trusted(spark):
    """Without a bound given, each trusted document of the fitted half is in the model, however many a language has."""
    docs = spark.range(11_000).selectExpr("id AS doc_id", "concat('w', id, ' w', id % 7) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    fit = kneser_ney.roles(docs, labels).where("__fit").count()
    assert fit > 5_000 and kneser_ney.sample(docs, labels).count() == fit


def test_perplexity_by_batches(spark, tmp_path):
    """Batches and shards of any size give the same perplexities."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"t{int(x)}" for x in rng.geometric(0.1, 25)), ("en", "fi", None, "zz")[i % 4]) for i in range(48)]
    docs = spark.createDataFrame([*rows, (48, "", "en"), (49, None, None)], "doc_id long, text string, lang string")
    found = []
    for shards, chars in ((1, 10**6), (7, 300)):
        folder = f"file://{tmp_path}/model{shards}"
        kneser_ney.write_model(kneser_ney.model(docs.where("doc_id < 24 AND NOT lang <=> 'zz'")), folder, shards)
        found.append({r["doc_id"]: r["perplexity"] for r in kneser_ney.perplexities(docs, folder, shards, chars).collect()})
    one, many = found
    assert len(one) == len(many) == 50
    for i, value in one.items():
        assert (value is None) == (i % 4 == 3 or i >= 48)
        assert many[i] == (None if value is None else pytest.approx(value, rel=1e-6))


def test_pipeline_stages(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "byte_bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "/root/testdata/sf0.001").cache()
        assert after.columns == docs.columns
        if name != "mix_sources":
            assert 0 < after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert out.count() == before.count() and set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
