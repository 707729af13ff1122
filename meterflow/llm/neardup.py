"""Operator 7, MinHash near-dedup with SetSketch registers.

A document's set is its distinct shingles of five blank-separated words (A-Z lower-cased). Each of ``BANDS * ROWS``
registers holds a truncated minimum of exponentially distributed values, spaced as powers of ``SPACING``; bands of
register values meet in a bucket. Equal sets are joined first and stand for one. Links are confirmed on full sets:

1. every set is compared with one leader, the smallest set of most of its buckets; components of confirmed links are labels;
2. where labels still share a bucket, registers are compared, block by block, but those of the bucket's largest label only
   with others, so that the work of a large group of copies grows with its size; members of different
   labels that agree in half of them form clusters. Within a cluster, by the same rule, pairs of different
   labels are estimated jointly by likelihood, and those that may reach the threshold are confirmed on full sets.
   Blocks are arrays in tasks: what they give is a row per member, never a pair, and no link that a bucket shows is given up.

A pair at the threshold itself is missed by all bands with
probability 2e-6. Components are contracted on Spark; each round is a table in the shared folder.

Defined cases: a document with fewer than five words has the sequence of its words as its one shingle; one without
words, or a null text, has an empty set, links with nothing and is kept; repeated rows link; a null doc_id has a null component
and is not kept; rows of one doc_id with different texts are one node where the doc_id stands for several sets; texts may be of any length;
other columns don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import block_pairs, components, least_labels, materialize, pairs_within, runs, scratch
from .textbatch import SPACE, STEP, TextBatch, large, mixed, pieces, shingles

WORDS, BANDS, ROWS = 5, 24, 3
SPACING, SCALE, TOP = 1.002, 20.0, 65534
REGISTERS = BANDS * ROWS
_seeds = np.random.RandomState(77).randint(1, 2**62, REGISTERS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_salts = np.random.RandomState(78).randint(0, 2**62, BANDS, dtype=np.int64).astype(np.uint64)
#: A pair whose jointly estimated similarity is below this is not confirmed: five standard errors below the threshold.
LEAST_ESTIMATE = 0.5
#: Members of a block, in a bucket (registers only) and in a cluster (with texts).
BUCKET_BLOCK, CLUSTER_BLOCK = 512, 256
#: Rows of a bucket or cluster up to which its pairs are listed, many of them at once; rows of a task, without texts and with them.
SMALL, BUCKET_ROWS, CLUSTER_ROWS = 64, 20_000, 1_000


def shingle_sets(batch: TextBatch) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    batch.words(~SPACE)
    hashes = batch.word_hashes()
    long = shingles(hashes, WORDS)
    out = []
    for a, n in zip(batch.first.tolist(), batch.n_words.tolist()):
        if n >= WORDS:
            s = np.sort(long[a : a + n - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(shingles(hashes[a : a + n], n) * STEP + np.uint64(n) if n else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of non-empty sets, a row each: floor(1 - log of the smallest exponential value), cut to 0 .. TOP + 1."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        least[:, i] = np.minimum.reduceat(flat * _seeds[i], at)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / SCALE
    return np.clip(np.floor(1 - np.log(x) / np.log(SPACING)), 0, TOP + 1).astype(np.uint16)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(_salts, (len(regs), BANDS)).copy()
    for j in range(ROWS):
        h = mixed(h * STEP + regs[:, j::ROWS].astype(np.uint64))
    return h


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sets from how many registers are greater, less and equal, given the sets' sizes."""
    greater, less = (a > b).sum(1), (a < b).sum(1)
    equal = REGISTERS - greater - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)[:, None]

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING), 1e-12, 1)

    more, fewer = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    score = greater[:, None] * np.log(more) + less[:, None] * np.log(fewer) + equal[:, None] * np.log(np.clip(1 - more - fewer, 1e-12, 1))
    return grid[np.arange(len(grid)), score.argmax(1)]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(mixed(s + STEP)).astype(np.int64)), int(np.bitwise_xor.reduce(mixed(s * STEP)).astype(np.int64))


SKETCH = "doc_id long, n long, d1 long, d2 long, bands array<long>, regs binary"


def _sketch(batches):
    for whole in batches:
        texts, ids = large(whole.column("text")), whole.column("doc_id")
        for a, b in pieces(texts):
            sets = shingle_sets(TextBatch(texts.slice(a, b - a)))
            full = [s for s in sets if len(s)]
            regs = registers(full) if full else np.zeros((0, REGISTERS), np.uint16)
            bands, at = band_hashes(regs).view(np.int64), iter(range(len(full)))
            rows = [(next(at), *_digest(s)) if len(s) else None for s in sets]
            offsets = np.cumsum([0] + [BANDS if r else 0 for r in rows]).astype(np.int32)
            cols = [
                ids.slice(a, b - a),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([r[1] if r else 0 for r in rows], pa.int64()),
                pa.array([r[2] if r else 0 for r in rows], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))),
                pa.array([regs[r[0]].tobytes() if r else b"" for r in rows], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "d1", "d2", "bands", "regs"])


def _confirm(per_cent: int):
    """Pairs of texts whose sets meet the threshold; a leader's set is kept while its rows last."""

    def run(batches):
        last: tuple = (None, None)
        for whole in batches:
            a, b, ta, tb = (whole.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = np.zeros(len(a), bool)
            leaders, texts, others = b.to_numpy(zero_copy_only=False), large(ta), large(tb)
            for x, y in pieces(texts):
                for i, s in zip(range(x, y), shingle_sets(TextBatch(texts.slice(x, y - x)))):
                    if last[0] != leaders[i]:
                        last = (leaders[i], shingle_sets(TextBatch(others.slice(i, 1)))[0])
                    t = last[1]
                    both = len(s) and len(t) and int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    keep[i] = both > 0 and 100 * both >= per_cent * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep))

    return run


#: Registers of REGISTERS in which a pair must agree to be looked at: a pair at the threshold agrees in 54, five standard errors above.
LEAST_EQUAL = REGISTERS // 2


def _likely(regs: np.ndarray, comp: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of rows have different labels and agree in enough registers."""
    apart = np.flatnonzero(comp[u] != comp[v])
    keep = np.zeros(len(u), bool)
    keep[apart] = (regs[u[apart]] == regs[v[apart]]).sum(1) >= LEAST_EQUAL
    return keep


def _pairs(keys: list[np.ndarray], i: np.ndarray, j: np.ndarray, side: np.ndarray, comp: np.ndarray, regs: np.ndarray):
    """Pairs of rows of a task, sorted by key, i and j, that share a pair of blocks, have different labels and agree in enough registers."""
    start, end = runs(*keys, i, j)
    small = (i[start] == j[start]) & (end - start <= SMALL)
    for u, v in pairs_within(start[small], end[small], 1 << 16):
        likely = _likely(regs, comp, u, v)
        yield u[likely], v[likely]
    for a, b in zip(start[~small].tolist(), end[~small].tolist()):
        x, y = a + np.flatnonzero(side[a:b] == i[a]), a + np.flatnonzero(side[a:b] == j[a])
        for part in np.array_split(x, -(-len(x) // 128)) if len(x) else ():
            equal = sum((regs[part, k][:, None] == regs[y, k][None]).astype(np.uint8) for k in range(REGISTERS))
            apart = comp[part][:, None] != comp[y][None]
            if i[a] == j[a]:
                apart &= part[:, None] < y[None]
            p, q = np.nonzero((equal >= LEAST_EQUAL) & apart)
            yield part[p], y[q]


def _registers_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _alike(key, table):
    """Of the pairs of blocks of a task, (a, b): each member and the least one of its cluster, by registers that agree."""
    table = table.sort_by([(c, "ascending") for c in ("h", "i", "j", "rep")])
    h, i, j, side, rep, comp = (table.column(c).to_numpy() for c in ("h", "i", "j", "side", "rep", "comp"))
    pairs = [np.zeros((2, 0), np.int64), *(np.stack(p) for p in _pairs([h], i, j, side, comp, _registers_of(table)))]
    low = rep[least_labels(len(rep), *np.concatenate(pairs, 1))]
    return pa.table({"a": rep[low < rep], "b": low[low < rep]})


def _confirm_block(per_cent: int):
    """Of the pairs of blocks of a task, (a, b): each member and the least one that it is linked with, through members of the blocks."""

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in ("cluster", "i", "j", "rep")])
        cluster, i, j, side, rep, comp = (table.column(c).to_numpy() for c in ("cluster", "i", "j", "side", "rep", "comp"))
        regs, texts = _registers_of(table), large(table.column("text"))
        sets = [s for a, b in pieces(texts) for s in shingle_sets(TextBatch(texts.slice(a, b - a)))]
        size = np.array([len(s) for s in sets])
        pairs = [np.zeros((2, 0), np.int64)]
        for u, v in _pairs([cluster], i, j, side, comp, regs):
            near = 100 * np.minimum(size[u], size[v]) >= per_cent * np.maximum(size[u], size[v])
            u, v = u[near], v[near]
            for at in range(0, len(u), 1 << 14):
                p, q = u[at : at + (1 << 14)], v[at : at + (1 << 14)]
                open_ = joint_estimate(regs[p], regs[q], size[p].astype(float), size[q].astype(float)) >= LEAST_ESTIMATE
                p, q = p[open_], q[open_]
                cut = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
                for a, b in zip(cut, [*cut[1:], len(p)]):
                    m, other = int(p[a]), q[a:b]
                    for some in np.array_split(other, -(-int(size[other].sum()) // (1 << 20))):
                        flat = np.concatenate([sets[k] for k in some.tolist()])
                        hit = sets[m][np.minimum(np.searchsorted(sets[m], flat), size[m] - 1)] == flat
                        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(np.append(0, size[some][:-1])))
                        linked = some[100 * both >= per_cent * (size[m] + size[some] - both)]
                        pairs.append(np.stack((np.full(len(linked), m), linked)))
        low = rep[least_labels(len(rep), *np.concatenate(pairs, 1))]
        return pa.table({"a": rep[low < rep], "b": low[low < rep]})

    return run


def largest_labels(labelled: DataFrame, key: str) -> DataFrame:
    """Keys with several labels (``comp``), and the one of most members."""
    sizes = labelled.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(key).agg(F.count(F.lit(1)).alias("labels"), F.max_by("comp", F.struct("n", "comp")).alias("largest")).where("labels > 1").drop("labels")


def near_duplicates(docs: DataFrame, per_cent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialize(docs.mapInArrow(_sketch, SKETCH), "sketches")
    sets = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    sets = materialize(sets, "sets")
    with scratch(docs.sparkSession) as keep:
        bands = sets.select("rep", F.explode("bands").alias("h"))
        full = bands.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("leader")).where("c > 1").drop("c")
        links = materialize(bands.join(full, "h").select("h", "rep", "leader"), "buckets")
        first = links.where("rep <> leader").groupBy("rep", "leader").agg(F.count(F.lit(1)).alias("c")).groupBy("rep").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("b"))
        edges = materialize(first.select(F.col("rep").alias("a"), "b"), "pairs")
        near = sets.select("rep", "d1", "d2", "n").join(links.select("rep").distinct(), "rep")
        texts = docs.join(near.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "d1", "d2").mapInArrow(_true_to_set, "doc_id long, text string")
        texts = materialize(texts, "near")
        confirmed = materialize(_confirmed(edges, texts, per_cent), "links")
        label = components(confirmed, "first").select(F.col("node").alias("rep"), F.col("component").alias("_label"))
        confirmed = label.select(F.col("rep").alias("a"), F.col("_label").alias("b"))
        labelled = links.select("h", "rep").join(label, "rep", "left").select("h", "rep", F.coalesce("_label", "rep").alias("comp"))
        several = largest_labels(labelled, "h")
        known = sets.select("rep", "regs")
        open_rows = labelled.join(several, "h").join(known, "rep")
        pairs = block_pairs(open_rows, ["h"], "rep", BUCKET_BLOCK, F.col("comp") == F.col("largest"), BUCKET_ROWS)
        alike = materialize(pairs.groupBy("task").applyInArrow(_alike, "a long, b long").distinct(), "alike")
        if alike.limit(1).count():
            clusters = components(alike, "clusters").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
            members = clusters.join(known, "rep").join(label, "rep", "left").withColumn("comp", F.coalesce("_label", "rep")).drop("_label")
            members = members.join(largest_labels(members, "cluster"), "cluster")
            loaded = block_pairs(members, ["cluster"], "rep", CLUSTER_BLOCK, F.col("comp") == F.col("largest"), CLUSTER_ROWS).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
            confirmed = confirmed.union(materialize(loaded.groupBy("task").applyInArrow(_confirm_block(per_cent), "a long, b long"), "links"))
        comps = components(confirmed, "near")
        keep(comps)
    of_rep = sets.select("d1", "d2", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("component"))
    out = sketches.select("doc_id", "n", "d1", "d2").join(of_rep, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _true_to_set(batches):
    """Of rows with a doc_id, those whose text has the set that the doc_id stands for."""
    for whole in batches:
        texts = large(whole.column("text"))
        d1, d2 = (whole.column(c).to_pylist() for c in ("d1", "d2"))
        for a, b in pieces(texts):
            sets = shingle_sets(TextBatch(texts.slice(a, b - a)))
            keep = [len(s) > 0 and _digest(s) == (d1[i], d2[i]) for i, s in zip(range(a, b), sets)]
            yield pa.RecordBatch.from_arrays([whole.column("doc_id"), texts.cast(pa.string())], names=["doc_id", "text"]).slice(a, b - a).filter(pa.array(keep))


def _confirmed(edges: DataFrame, texts: DataFrame, per_cent: int) -> DataFrame:
    one = edges.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    return two.mapInArrow(_confirm(per_cent), "a long, b long").distinct()


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p:p + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
