"""Queries without SQL against slow and plain versions of what they promise."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meterflow.llm import catalog, decontaminate, quality, shared, toxicity
from meterflow.llm.textbatch import TextBatch, large
from pyspark.sql import functions as F


def test_op8_shard(spark, data):
    """Every column of the contract on whole documents; equal texts share a shard, but for those whose copies weigh much."""
    sf = f"{data}/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') AS text FROM '{sf}/documents.parquet'").fetchall()
    got = catalog.QUERIES["op8_shard"](spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(i for i, _ in rows) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows}
    assert all((a, b) == want[i] for i, a, b in zip(got["doc_id"], got["size"], got["text_crc32"]))
    assert set(got["shard"]) == set(range(16)) and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    sizes, total = got.groupby("shard")["size"].sum(), got["size"].sum()
    most = max(got["size"].max(), total / 256)
    assert (sizes - total / 16).abs().max() <= 0.05 * total / 16 + most
    texts = got.merge(got.groupby("text_crc32")["size"].sum().rename("all"), on="text_crc32")
    light = texts[texts["all"] * 256 <= total]
    assert (light.groupby("text_crc32")["shard"].nunique() == 1).all()


def slow_score(trees, x):
    """A tree walked node by node."""
    out = []
    for row in x:
        z = trees.base
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
            k = 0
            for _ in range(quality.DEPTH):
                k = 2 * k + (2 if row[feature[k]] > cut[k] else 1)
            z += value[k]
        out.append(1 / (1 + np.exp(-z)))
    return np.array(out)


def best_split(x, y, p):
    """The gain of the best first cut, tried at every bin's edge."""
    g, h, best = y - p, np.full(len(y), p * (1 - p)), -1.0
    for j in range(x.shape[1]):
        for edge in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS)[1:-1])):
            left = x[:, j] <= edge
            if min(left.sum(), (~left).sum()) >= quality.LEAST_LEAF:
                side = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.PENALTY)
                best = max(best, side(left) + side(~left) - g.sum() ** 2 / (h.sum() + quality.PENALTY))
    return best


def test_trees_against_a_slow_version():
    rng = np.random.RandomState(3)
    x = np.round(rng.standard_normal((300, 6)), 1)
    y = ((x[:, 2] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    y[rng.rand(300) < 0.1] = 1.0
    trees = quality.Trees(x, y)
    assert np.allclose(trees.score(x), slow_score(trees, x)) and ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.9
    p = y.mean()
    j, cut = trees.feature[0][0], trees.cut[0][0]
    left = x[:, j] <= cut
    g, h = y - p, np.full(len(y), p * (1 - p))
    side = lambda m: g[m].sum() ** 2 / (h[m].sum() + quality.PENALTY)
    assert np.isclose(side(left) + side(~left) - g.sum() ** 2 / (h.sum() + quality.PENALTY), best_split(x, y, p))


def test_quality_statistics_of_texts_alone_and_in_batches():
    """A text's statistics don't depend on what else is in its batch; repeated rows score equally, very long texts are read whole."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "bee", "sea!", "Dee", "x1", "é"]) for _ in range(rng.randint(0, 80))) + rng.choice(["", "\n", "\nline"]) for _ in range(30)] + ["", "  ", "word " * 300_000]
    texts += texts[:5]
    whole = quality.statistics(TextBatch(large(pa.array(texts, pa.large_string()))))
    for i, t in enumerate(texts):
        alone = quality.statistics(TextBatch(large(pa.array([t], pa.large_string()))))[0]
        assert np.allclose(whole[i], alone)
    assert (whole[:5] == whole[-5:]).all()


def test_sample_is_bounded(spark):
    """A labelled doc_id that many rows share is learned from once."""
    docs = spark.range(500).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).unionByName(spark.createDataFrame([(8, None), (9, "x")], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 0), (9, None)], "doc_id long, quality int")
    assert sorted(r["doc_id"] for r in quality.labelled_sample(docs, labels, "quality", 100).collect()) == [7, 8]


def readings(model, token):
    """Cost and text of every reading of a token."""
    for some in itertools.product(*toxicity.lattice(token)):
        a = b = 0
        cost, text = 0.0, ""
        for c, extra in some:
            cost += extra
            if c:
                k = toxicity.LETTERS.find(c) + 1
                cost += model.cost[a, b, k]
                a, b = (b, k) if k else (0, 0)
                text += c
        yield cost + model.cost[a, b, 0], text


WORDS = ["idiot", "stupi*", "mor*", "loser", "ill*", "büf*"]


def a_model(seed=1):
    rng = np.random.RandomState(seed)
    return toxicity.Model(rng.randint(1, 500, (toxicity.N,) * 3).astype(float), WORDS, np.ones(len(WORDS)), 0.0)


def odd_tokens(rng, n, most):
    some = [*"idotstupmrle", *"1105$@!|+.-_é0íß*", "​"]
    for _ in range(n):
        word = list(rng.choice(["idiot", "stupid", "moron", "loser", "ill", "stone", "sitting"]))[:most]
        for _ in range(rng.randint(0, 3)):
            word.insert(rng.randrange(len(word) + 1), rng.choice(some))
        yield "".join(word)[:most]


def test_viterbi_finds_the_cheapest_reading():
    model, rng = a_model(), random.Random(5)
    for token in ["1d10t", "i d", "a\nb", "!!", "ii-i", "$.$", *odd_tokens(rng, 150, 6)]:
        found = model._viterbi(token)
        every = list(readings(model, token))
        least = min(c for c, _ in every)
        assert any(t == found and c <= least + 1e-9 for c, t in every)


def test_gate_drops_no_reading():
    """Where the gate says no, no reading whatever, cheap or not, begins a word with a learned one."""
    model, rng = a_model(), random.Random(6)
    closed = 0
    for token in odd_tokens(rng, 400, 6):
        if not model._open(token):
            closed += 1
            assert not any(model.features(w) for _, text in readings(model, token) for w in text.split(" "))
    assert closed > 50


def test_hidden_words_with_and_without_the_gate(monkeypatch):
    rng = random.Random(7)
    tokens = [t.encode() for t in odd_tokens(rng, 2000, 30)]
    with_gate = [a_model().hidden(t) for t in tokens]
    monkeypatch.setattr(toxicity.Model, "_open", lambda self, token: True)
    assert with_gate == [a_model().hidden(t) for t in tokens] and sum(map(bool, with_gate)) > 100


def test_toxic_documents_are_found(spark, data):
    """Recall on held-out rows, beside their share of false alarms."""
    sf = f"{data}/sf0.1"
    labels = duckdb.sql(f"SELECT doc_id, toxic AS y FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL").df()
    m = catalog.QUERIES["op6_toxicity"](spark, sf).toPandas().merge(labels, on="doc_id")
    held = m[m.held_out]
    assert held[held.y == 1].predicted.mean() > 0.7 and held[held.y == 0].predicted.mean() < 0.02
    assert (m.predicted == (m.score >= 0.7)).all()


ROWS = [(1, None, "a"), (2, "", "b"), (None, "good quiet prose of the river and the stone in the evening light " * 3, "c"), (3, "x" * 200_000, "d"), (3, "x" * 200_000, "e"), (4, "good quiet prose of the river", None), (4, "another text under the same id", "f")]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_tables(spark, data, empty):
    """Null ids and texts, empty and long texts, repeated rows, clashing names, and no rows at all: every stage ends, keeps the columns and makes up no row."""
    import corpus_pipeline

    docs = spark.createDataFrame([] if empty else ROWS, "doc_id long, text string, `items` string").withColumns({"lang": F.lit("en"), "a.b": F.lit(1), "gid": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"{data}/sf0.001")
        n = out.count()
        if name != "packing":
            assert out.columns == docs.columns and n <= (0 if empty else len(ROWS))
        else:
            assert n >= (0 if empty else len(ROWS)) and (not empty or n == 0)
        if name == "near_duplicates" and not empty:
            assert sorted(map(str, (r["doc_id"] for r in out.collect()))) == ["1", "2", "3", "4", "4", "None"]
        if name in ("repeats", "benchmark") and not empty:
            assert n == len(ROWS)


def test_benchmark_stage_against_a_slow_version(spark, data):
    import corpus_pipeline

    sf = f"{data}/sf0.001"
    items = [w for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall() if (w := words(t))]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in corpus_pipeline.without_benchmark(spark, docs, sf).collect()}
    windows = {}
    for w in items:
        for k in range(max(len(w) - 9, 1)):
            windows.setdefault(min(len(w), 10), set()).add(tuple(w[k : k + 10]))
    assert before.keys() == after.keys()
    for i, text in before.items():
        w, hit = words(text), set()
        for k, some in windows.items():
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in some:
                    hit.update(range(j, j + k))
        assert words(after[i]) == [x for j, x in enumerate(w) if j not in hit] and (hit or after[i] == text)


def words(text):
    batch = TextBatch(large(pa.array([text or ""], pa.large_string())))
    batch.words(decontaminate.WORD)
    return [decontaminate._normal(batch, k, 1) for k in range(len(batch.ws))]


def test_quality_stage_keeps_what_the_query_keeps(spark, data):
    import corpus_pipeline

    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = sorted(r[0] for r in corpus_pipeline.good_quality(spark, docs, sf).select("doc_id").collect())
    assert kept == sorted(r["doc_id"] for r in catalog.QUERIES["op4_quality"](spark, sf).where("predicted = 1").collect()) and 0 < len(kept) < docs.count()


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda k, d: d)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("c", (), {"getCheckpointDir": staticmethod(lambda: type("o", (), {"isEmpty": staticmethod(lambda: True)}))}))

    with pytest.raises(ValueError):
        shared.shared_dir(Cluster)
