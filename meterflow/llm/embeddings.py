"""Operator 10, embedding near-dedup by lattice hashing.

Each table projects a vector at random to blocks of eight dimensions and decodes each block to its nearest point of the E8 lattice; the
blocks' points together are a cell. Neighbouring cells are probed: those in which blocks take the nearest point of
the other coset, cheapest first. Vectors that share a cell of a table are compared by cosine in double precision.

More rows need finer cells: the number of blocks follows from the largest label's number of different vectors, so that
a vector meets about ``MOST_CHANCE`` vectors in a cell that aren't like it, at any size. The number of tables follows from the
blocks and the threshold: simulated pairs of exactly the threshold's cosine must meet in some table with a chance of ``RECALL``.
Cells, and so comparisons, grow with a power of about 1.11 of the rows.

Equal vectors of a label stand for one, with their number. A cell's vectors are dealt to
blocks of bounded size and every pair of blocks is compared in one task, small cells many to a task; a pair that several cells hold counts in the first of
them. A task returns a row per vector (its links, and the smallest vector of its part of the block), never pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing and are kept; vectors of different length are not compared; repeated rows link; a null vec_id has a null
component; other columns don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import block_pairs, components, least_labels, materialize, pairs_within, runs, scratch
from .textbatch import STEP, mixed

#: Width of projections, most probes of a table, chance vectors in a cell, recall at the threshold, rows of a task's block.
SCALE, MOST_PROBES, MOST_CHANCE, RECALL, BLOCK = 0.5, 8, 4, 0.97, 1024
#: Rows of a cell up to which its pairs are listed, many cells at once; larger ones are multiplied as matrices.
SMALL = 64
#: Chance that two vectors at a right angle share a cell of one block, probes included, at this scale.
CHANCE = 0.0135


def decode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest points of E8, times two: of either coset (integers with even sum; the same plus a half), the nearer first, and by how much it is nearer (squared)."""

    def even(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        if len(odd):
            d = y[odd] - r[odd]
            k = np.abs(d).argmax(1)
            r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    a, b = even(x), even(x - 0.5) + 0.5
    more = ((x - b) ** 2).sum(1) - ((x - a) ** 2).sum(1)
    swap = more < 0
    near, far = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b)
    return (2 * near).astype(np.int64), (2 * far).astype(np.int64), np.abs(more)


def probes(projected: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Cell hashes of one table: the nearest cell and its neighbours, a column each. ``base`` tells labels and tables apart."""
    points, costs = [], []
    for k in range(0, projected.shape[1], 8):
        *both, more = decode(projected[:, k : k + 8])
        costs.append(more)
        hashes = []
        for point in both:
            h = np.full(len(point), np.uint64(k + 1))
            for j in range(8):
                h = mixed(h * STEP + point[:, j].astype(np.uint64))
            hashes.append(h)
        points.append(np.stack(hashes, 1))
    blocks = len(points)
    choices = np.arange(1 << blocks)[:, None] >> np.arange(blocks) & 1
    cheapest = np.argsort(np.stack(costs, 1) @ choices.T, 1, kind="stable")[:, : min(1 << blocks, MOST_PROBES)]
    out = np.broadcast_to(base[:, None], cheapest.shape).copy()
    for k in range(blocks):
        out = mixed(out * STEP + np.take_along_axis(points[k], choices[cheapest, k], 1))
    return out


def cells(vectors: np.ndarray, label: np.ndarray, tables: int, blocks: int, scale: float = SCALE) -> np.ndarray:
    """Cell hashes of unit vectors, table by table."""
    d = vectors.shape[1]
    out = []
    for t in range(tables):
        project = np.random.RandomState([t, d]).standard_normal((d, 8 * blocks)) * scale
        out.append(probes(vectors @ project, mixed(label.astype(np.uint64) * STEP + np.uint64(t * 65536 + d))))
    return np.concatenate(out, 1).view(np.int64)


def blocks_for(rows: int) -> int:
    """Blocks of a cell, so that among ``rows`` unlike vectors a probe of a vector meets ``MOST_CHANCE`` at most."""
    blocks = 1
    while rows * CHANCE**blocks > MOST_CHANCE:
        blocks += 1
    return blocks


def tables_for(blocks: int, threshold: float, recall: float = RECALL) -> int:
    """Tables by which a pair at the threshold shares a cell with a chance of ``recall``, from 20,000 simulated pairs in one table."""
    rng, none = np.random.RandomState(1), np.zeros(20_000, np.uint64)
    x = rng.standard_normal((20_000, 8 * blocks))
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * rng.standard_normal(x.shape)
    a, b = probes(x * SCALE, none), probes(y * SCALE, none)
    share = (a[:, :, None] == b[:, None, :]).any((1, 2)).mean()
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(share, 1e-4), 1 - 1e-9)))))


def _matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hash(tables: int, blocks: int):
    def run(batches):
        for batch in batches:
            vectors, sizes = batch.column("embedding"), batch.column("dim").to_numpy()
            label = batch.column("label").to_numpy()
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                found = cells(_unit(_matrix(vectors.take(pa.array(at)))), label[at], tables, blocks)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("rep").take(pa.array(at)), lists], names=["rep", "cells"])

    return run


def _first_shared(a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """For each pair of rows of cells the least cell that both have in the first table in which they share one."""
    out, open_, width = np.zeros(len(a), np.int64), np.arange(len(a)), a.shape[1] // tables
    for k in range(0, a.shape[1], width):
        x, y = a[open_, k : k + width], b[open_, k : k + width]
        least = np.where((x[:, :, None] == y[:, None, :]).any(2), x, np.iinfo(np.int64).max).min(1)
        met = least < np.iinfo(np.int64).max
        out[open_[met]] = least[met]
        open_ = open_[~met]
        if not len(open_):
            break
    return out


def _compare(threshold: float, tables: int):
    """Links of the pairs of blocks of a task: sums of the other side's numbers, and a smaller vector reachable."""

    def one_size(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cell", "i", "j", "rep")])
        cell, i, j, side, rep, count = (table.column(c).to_numpy() for c in ("cell", "i", "j", "side", "rep", "count"))
        all_cells = _matrix_of_ints(table.column("cells"))
        unit = _unit(_matrix(table.column("embedding").combine_chunks()))
        links, pairs = np.zeros(len(rep), np.int64), [np.zeros((2, 0), np.int64)]

        def add(p: np.ndarray, q: np.ndarray) -> None:
            for b in range(0, len(p), 1 << 16):
                u, v = p[b : b + (1 << 16)], q[b : b + (1 << 16)]
                own = _first_shared(all_cells[u], all_cells[v], tables) == cell[u]
                np.add.at(links, u[own], count[v[own]])
                np.add.at(links, v[own], count[u[own]])
                pairs.append(np.stack((u, v)))

        start, end = runs(cell, i, j)
        small = (i[start] == j[start]) & (end - start <= SMALL)
        for u, v in pairs_within(start[small], end[small]):
            linked = np.einsum("ij,ij->i", unit[u], unit[v]) >= threshold
            add(u[linked], v[linked])
        for a, b in zip(start[~small].tolist(), end[~small].tolist()):
            x, y = a + np.flatnonzero(side[a:b] == i[a]), a + np.flatnonzero(side[a:b] == j[a])
            for k in range(0, len(x), 256):
                p, q = np.nonzero(unit[x[k : k + 256]] @ unit[y].T >= threshold)
                p, q = x[k : k + 256][p], y[q]
                keep = p < q if i[a] == j[a] else p != q
                add(p[keep], q[keep])
        root = rep[least_labels(len(rep), *np.concatenate(pairs, 1))]
        some = np.flatnonzero((links > 0) | (root < rep))
        return pa.table({"rep": rep[some], "links": links[some], "low": root[some]})

    def run(key, table):
        dim = table.column("dim").to_numpy()
        return pa.concat_tables([one_size(table.filter(pa.array(dim == d))) for d in np.unique(dim)])

    return run


def _matrix_of_ints(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def near_embeddings(vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, blocks: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``; ``blocks`` and ``tables`` as the rows and the threshold ask, if not given."""
    sound = "label IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(embedding, x -> x <> 0)"
    doubles = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", doubles.alias("embedding"), F.col("label").cast("long").alias("label")).withColumn("sound", F.coalesce(F.expr(sound), F.lit(False)))
    rows = rows.withColumns({"d1": F.when(F.col("sound"), F.xxhash64("label", "embedding")), "d2": F.when(F.col("sound"), F.xxhash64(F.lit(7), "embedding", "label"))})
    same = rows.where("sound AND vec_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    same = materialize(same.withColumn("dim", F.size("embedding")), "vectors")
    blocks = blocks or blocks_for(same.groupBy("label").count().agg(F.max("count")).first()[0] or 1)
    tables = tables or tables_for(blocks, threshold)
    with scratch(vectors.sparkSession) as keep:
        hashed = materialize(same.select("rep", "embedding", "label", "dim").mapInArrow(_hash(tables, blocks), "rep long, cells array<long>"), "cells")
        flat = hashed.select("rep", F.explode(F.array_distinct("cells")).alias("cell"))
        full = flat.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        tasks = block_pairs(materialize(flat.join(full, "cell").select("cell", "rep"), "shared"), ["cell"], "rep", block)
        loaded = tasks.join(same.select("rep", "count", "embedding", "dim"), "rep").join(hashed, "rep")
        found = materialize(loaded.groupBy("task").applyInArrow(_compare(threshold, tables), "rep long, links long, low long"), "links")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        comps = components(found.where("low < rep").select(F.col("rep").alias("a"), F.col("low").alias("b")), "vectors").withColumnRenamed("node", "rep")
        keep(found, comps)
    known = same.select("d1", "d2", "rep", "count").join(links, "rep", "left").join(comps, "rep", "left").select("d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "d1", "d2").join(known, ["d1", "d2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.vec_id)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, c AS component_id, e.vec_id = c AS kept
FROM embeddings e JOIN (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id) m ON m.vec_id = e.vec_id
"""
