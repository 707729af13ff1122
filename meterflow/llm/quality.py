"""Operator 4, quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Statistics are computed for whole texts, in numpy over Arrow batches. Trees are trained on the statistics of a bounded
sample of labelled rows (``MOST_ROWS``, those of least hash of doc_id), by histograms of 64 bins and log loss,
and kept as flat arrays that a batch of documents walks level by level. Only statistics are inputs.

Defined cases: a null or empty text has all statistics zero and gets a score as any other; rows whose label is null, or whose
doc_id is null, aren't learned from; without both labels every score is the share of label 1, or 0.5 without any;
repeated rows get equal scores; of rows that share a labelled doc_id one is learned from; texts may be of any length; other columns are
kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted
from .textbatch import LOWER, SPACE, TextBatch, large, mixed, pieces, powers

MOST_ROWS = 20_000
BINS, TREES, DEPTH, RATE, LEAST_LEAF, PENALTY = 64, 80, 4, 0.15, 15, 1.0

_kinds = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "blank": (0x20, 9), "line": (10,), "above": range(0x80, 256), "stop": b".", "comma": b",", "cry": b"!", "ask": b"?", "hash": b"#", "dollar": b"$", "per": b"%", "and": b"&", "star": b"*", "bar": b"|", "bracket": b"<>[]{}()", "slash": b"/\\", "quote": b"\"'", "colon": b":;", "at": b"@", "dash": b"-_=+~"}
_of = np.full(256, len(_kinds), np.int64)
for _i, _bytes in enumerate(_kinds.values()):
    _of[list(_bytes)] = _i
NAMES = ["log_bytes", *(f"share_{k}" for k in _kinds), "log_words", "word_bytes", "word_spread", "distinct_words", "commonest_word", "repeated_triples", "log_lines", "line_bytes", "distinct_lines", "words_upper", "words_ending_odd", "entropy"]


def _rows(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n)


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct hashes of each document, and the count of its commonest."""
    key = np.sort(mixed(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) & np.uint64((1 << 44) - 1) | doc.astype(np.uint64) << np.uint64(44))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    of = (key[at] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(at, len(key))))
    return np.bincount(of, minlength=n)[:n].astype(float), most


def statistics(batch: TextBatch) -> np.ndarray:
    """A row of statistics for each text, in the order of NAMES."""
    n, size = batch.n, np.maximum(batch.size, 1).astype(float)
    doc_of_byte = np.repeat(np.arange(n), batch.size + 1)
    counts = np.bincount(doc_of_byte * (len(_kinds) + 1) + _of[batch.buf], minlength=n * (len(_kinds) + 1)).reshape(n, -1).astype(float)
    counts[:, list(_kinds).index("blank")] -= 1  # the one after each text
    share = counts[:, :-1] / size[:, None]
    p = np.maximum(counts, 0) / size[:, None]
    entropy = -(p * np.log2(np.maximum(p, 1e-9))).sum(1)
    batch.words(~SPACE)
    words = np.maximum(batch.n_words, 1).astype(float)
    length = (batch.we - batch.ws).astype(float)
    mean = _rows(length, batch.doc, n) / words
    spread = np.sqrt(np.maximum(_rows(length**2, batch.doc, n) / words - mean**2, 0))
    h = batch.word_hashes()
    distinct, most = _distinct(h, batch.doc, n)
    three = np.flatnonzero(batch.doc[2:] == batch.doc[:-2]) if len(h) > 2 else np.zeros(0, np.int64)
    triple = h[three] * np.uint64(3) + h[three + 1] * np.uint64(5) + h[three + 2] * np.uint64(7) if len(three) else np.zeros(0, np.uint64)
    of3 = batch.doc[three]
    n3 = np.maximum(np.bincount(of3, minlength=n), 1).astype(float)
    repeated = 1 - np.where(np.bincount(of3, minlength=n) > 0, _distinct(triple, of3, n)[0] / n3, 1)
    first, last = batch.buf[batch.ws], batch.buf[batch.we - 1]
    upper = (first != LOWER[first]) & (last != LOWER[last])
    odd = np.isin(last, np.frombuffer(b"!#$%&*|", np.uint8))
    up, down = powers(len(batch.buf) + 1)
    sums = np.zeros(len(batch.buf) + 1, np.uint64)
    np.cumsum((batch.buf.astype(np.uint64) + np.uint64(7)) * up[:-1], out=sums[1:])
    ends = np.union1d(np.flatnonzero(batch.buf == 10), batch.end)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    doc_of_line = doc_of_byte[np.minimum(ends, max(len(doc_of_byte) - 1, 0))] if len(ends) else ends
    lines = np.bincount(doc_of_line, minlength=n).astype(float)
    distinct_lines, _ = _distinct(mixed((sums[ends] - sums[starts]) * down[starts]), doc_of_line, n)
    one = np.maximum(lines, 1)
    out = np.column_stack([np.log1p(batch.size), share, np.log1p(batch.n_words), mean, spread, distinct / words, most / words, repeated, np.log(one), size / one, distinct_lines / one, _rows(upper * 1.0, batch.doc, n) / words, _rows(odd * 1.0, batch.doc, n) / words, entropy])
    out[batch.size == 0] = 0
    return out


class Trees:
    """Boosted trees as arrays over (tree, node): feature, cut (go right if above), and value; children of k are 2k + 1, 2k + 2."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = x.shape
        rate = float(y.mean()) if n else 0.5
        self.base = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        size = 2 ** (DEPTH + 1) - 1
        self.feature, self.cut, self.value = np.zeros((0, size), np.int64), np.zeros((0, size)), np.zeros((0, size))
        if n < 2 or rate in (0.0, 1.0):
            return
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
        bins = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
        flat = bins + np.arange(m) * BINS
        score, made = np.full(n, self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
            node = np.zeros(n, np.int64)
            for depth in range(DEPTH + 1):
                base = 2**depth - 1
                here = node - base
                for k in range(2**depth):
                    at = np.flatnonzero(here == k)
                    if not len(at):
                        continue
                    total_g, total_h = g[at].sum(), h[at].sum()
                    value[base + k] = RATE * total_g / (total_h + PENALTY)
                    if depth == DEPTH or len(at) < 2 * LEAST_LEAF:
                        continue
                    index = flat[at].ravel()
                    gs, hs, ns = (np.cumsum(np.bincount(index, w, m * BINS).reshape(m, BINS), 1) for w in (np.repeat(g[at], m), np.repeat(h[at], m), None))
                    gain = gs**2 / (hs + PENALTY) + (total_g - gs) ** 2 / (total_h - hs + PENALTY) - total_g**2 / (total_h + PENALTY)
                    gain[(ns < LEAST_LEAF) | (len(at) - ns < LEAST_LEAF)] = -1
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        feature[base + k], cut[base + k] = j, edges[j][b]
                down = np.where(x[np.arange(n), feature[node]] > cut[node], 2, 1)
                if depth < DEPTH:
                    node = np.where(np.isfinite(cut[node]), 2 * node + down, node + 0)
                    stay = ~(node >= 2 ** (depth + 1) - 1)
                    # a leaf that isn't split further: its left child carries its value
                    for leaf in np.unique(node[stay]):
                        value[2 * leaf + 1] = value[leaf]
                    node = np.where(stay, 2 * node + 1, node)
            score += value[node]
            made.append((feature, cut, value))
        self.feature, self.cut, self.value = (np.array(c) for c in zip(*made))

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + np.where(x[rows, feature[node]] > cut[node], 2, 1)
            out += value[node]
        return 1 / (1 + np.exp(-out))


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most_rows`` labelled rows: those whose doc_id has the least hashes."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded: most_rows
    # of rows that share a doc_id one is learned from, so that the sample is bounded as well
    return rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Trees:
    sample = labelled_sample(docs, labels, "quality", most_rows)
    table = _with_label(sample).toPandas().sort_values("doc_id")
    x = np.array(table["x"].to_list(), float).reshape(len(table), len(NAMES))
    return Trees(x, table["label"].to_numpy(float))


def _with_label(sample: DataFrame) -> DataFrame:
    def run(batches):
        for whole in batches:
            texts = large(whole.column("text"))
            for a, b in pieces(texts):
                x = statistics(TextBatch(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([whole.column("doc_id").slice(a, b - a), whole.column("label").slice(a, b - a), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    return sample.mapInArrow(run, "doc_id long, label int, x array<double>")


def with_quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with quality_score (0 to 1); other columns are kept."""
    held = docs.sparkSession.sparkContext.broadcast(trees)
    keep = [c for c in docs.columns if c != "quality_score"]

    def run(batches):
        for whole in batches:
            texts = large(whole.column("text"))
            scores = [held.value.score(statistics(TextBatch(texts.slice(a, b - a)))) for a, b in pieces(texts)]
            yield pa.RecordBatch.from_arrays([*[whole.column(c) for c in keep], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keep, "quality_score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name != "quality_score"]
    return docs.select(*quoted(keep)).mapInArrow(run, StructType([*fields, StructField("quality_score", DoubleType())]))


FOLDS, LEAST_SCORE = 5, 0.3


def query_trees(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Trees:
    """Trees learned from the rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), FOLDS) != 0)
    return train(docs, labels)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_quality(docs, query_trees(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= LEAST_SCORE).cast("int").alias("predicted"))
