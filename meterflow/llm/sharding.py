"""Operator 8, sharding: k-d tree leaves cut at distributed weighted medians.

Every document has a weight (UTF-8 bytes of its text plus 1) and metadata dimensions. A node is cut along its widest
dimension (relative to that dimension's whole range) at the weighted median, until there are as many leaves as shards
or each leaf holds the target bytes. A median is found by refining a histogram of 60-bit keys, 12 bits a pass: each
pass is one grouped sum, of which the bin that holds the median is picked on Spark. What reaches the driver is a row per node, whatever the number of rows;
small tables of a row per node tell the rows where they go.

The key of a row is its dimension's value (30 bits) followed by a hash of its text (30 bits), so equal texts share a
shard; texts whose copies together weigh more than a sixteenth of a leaf are spread by doc_id instead, or
no cut could be even. Defined cases: a null text weighs 1; null or NaN dimensions count as the lowest value; repeated rows are
all placed; texts may be of any length; other columns are kept, whatever their names, but for one
named shard, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import gapless_rank, materialize, quoted

BITS, PASSES = 12, 5


class _Names:
    """Names of this module's own columns, none of which begins as a column of the input does."""

    def __init__(self, docs: DataFrame):
        prefix = "_kd"
        while any(c.lower().startswith(prefix) for c in docs.columns):
            prefix += "_"
        self.weight, self.copies, self.node, self.dim, self.cut, self.hot = (f"{prefix}{n}" for n in ("weight", "copies", "node", "dim", "cut", "hot"))
        self.prefix = prefix

    def value(self, i: int) -> str:
        return f"{self.prefix}d{i}"

    def key(self, i: int) -> str:
        return f"{self.prefix}k{i}"


def _table(rows: DataFrame, names: _Names, values: dict[int, tuple[int, int]]) -> DataFrame:
    """A row per node: its dimension and a key. Nodes are as many as leaves at most, 24 bytes each."""
    schema = f"{names.node} long, {names.dim} int, {names.cut} long"
    return F.broadcast(rows.sparkSession.createDataFrame([(n, d, k) for n, (d, k) in values.items()], schema))


def _key_of(names: _Names, dims: int) -> Column:
    return F.get(F.array(*[F.col(names.key(i)) for i in range(dims)]), F.col(names.dim))


def _medians(rows: DataFrame, names: _Names, dims: int, nodes: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node (dimension, share of weight wanted on the left) the 60-bit key at which to cut: left is below it.

    A pass sums 4096 bins a node and picks the one that holds the median, all on Spark; a row per node comes to the driver."""
    prefix, want = dict.fromkeys(nodes, 0), {}
    whole = Window.partitionBy("node")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(PASSES):
        shift = BITS * (PASSES - 1 - k)
        placed = rows.join(_table(rows, names, {n: (d, prefix[n]) for n, (d, _) in nodes.items()}), names.node).select(F.col(names.node).alias("node"), F.col(names.cut).alias("at"), F.shiftright(_key_of(names, dims), shift).alias("bin"), F.col(names.weight).alias("w"))
        sums = placed.where(F.shiftright("bin", BITS) == F.col("at")).groupBy("node", "bin").agg(F.sum("w").alias("w"))
        sums = sums.withColumns({"upto": F.sum("w").over(upto), "total": F.sum("w").over(whole), "last": F.max("bin").over(whole)})
        share = F.col("total") if k == 0 else F.lit(1.0)
        goal = _table_of_goals(rows, {n: want.get(n, nodes[n][1]) for n in nodes})
        picked = sums.join(goal, "node").where((F.col("upto") > F.col("goal") * share) | (F.col("bin") == F.col("last")))
        found = picked.groupBy("node").agg(F.min(F.struct("bin", "w", "upto", "total")).alias("x")).select("node", "x.*").collect()
        for r in found:
            n = r["node"]
            if k == 0:
                want[n] = nodes[n][1] * r["total"]
            want[n] -= r["upto"] - r["w"]
            prefix[n] = r["bin"] + int(k == PASSES - 1 and want[n] > r["w"] / 2)
    return prefix


def _table_of_goals(rows: DataFrame, goals: dict[int, float]) -> DataFrame:
    return F.broadcast(rows.sparkSession.createDataFrame([(n, float(g)) for n, g in goals.items()], "node long, goal double"))


def kd_shards(docs: DataFrame, dims: dict[str, Column], weight: Column, copies: Column, spread: Column, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``docs`` with column shard (0 to the number of shards - 1), as a table in the shared folder. Give ``shards`` or ``target_bytes``."""
    names, d = _Names(docs), range(len(dims))
    w = names.weight
    rows = docs.withColumns({w: weight, names.copies: copies, **{names.value(i): F.coalesce(F.nanvl(c.cast("double"), F.lit(None)), F.lit(float("-inf"))) for i, c in enumerate(dims.values())}})
    finite = [F.when(F.abs(F.col(names.value(i))) != float("inf"), F.col(names.value(i))) for i in d]
    whole = rows.agg(F.sum(w).alias("w"), *[f(finite[i]).alias(f"{f.__name__}{i}") for i in d for f in (F.min, F.max)]).first()
    total = whole["w"] or 0
    leaves = shards or max(1, -(-total // target_bytes))
    hot = rows.groupBy(names.copies).agg(F.sum(w).alias("w")).where(F.col("w") * (16 * leaves) > total).select(names.copies, F.lit(True).alias(names.hot))
    rows = rows.join(F.broadcast(hot), names.copies, "left")  # at most 16 rows a leaf
    tie = F.pmod(F.when(F.col(names.hot), F.xxhash64(spread)).otherwise(F.xxhash64(names.copies)), F.lit(1 << 30))
    for i in d:
        low, high = whole[f"min{i}"], whole[f"max{i}"]
        scaled = F.lit(0.0) if low is None or high == low else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(names.value(i)) - low) / (high - low)))
        rows = rows.withColumn(names.key(i), F.shiftleft(F.floor(scaled * ((1 << 30) - 1)).cast("long"), 30) + tie)
    rows = materialize(rows.drop(names.copies, names.hot, *[names.value(i) for i in d]), "shards")
    rows = rows.withColumn(names.node, F.lit(1).cast("long"))
    sizes, at, done = {1: leaves}, {1: 0}, {}
    while True:
        for k in [k for k, n in sizes.items() if n == 1]:
            done[k] = at[k]
            del sizes[k]
        if not sizes:
            break
        wide = rows.groupBy(names.node).agg(*[f(F.shiftright(names.key(i), 30)).alias(f"{f.__name__}{i}") for i in d for f in (F.min, F.max)]).collect()  # a row per node
        width = {r[names.node]: max(d, key=lambda i: (r[f"max{i}"] - r[f"min{i}"], -i)) for r in wide}
        plan = {k: (width.get(k, 0), (n // 2) / n) for k, n in sizes.items()}
        cuts = _medians(rows, names, len(dims), plan)
        split = rows.join(_table(rows, names, {k: (plan[k][0], cuts[k]) for k in sizes}), names.node, "left")
        rows = split.withColumn(names.node, F.when(F.col(names.cut).isNull(), F.col(names.node)).when(_key_of(names, len(dims)) < F.col(names.cut), F.col(names.node) * 2).otherwise(F.col(names.node) * 2 + 1)).drop(names.dim, names.cut)
        for k, n in [*sizes.items()]:
            sizes |= {2 * k: n // 2, 2 * k + 1: n - n // 2}
            at |= {2 * k: at[k], 2 * k + 1: at[k] + n // 2}
            del sizes[k]
    shard = F.broadcast(rows.sparkSession.createDataFrame([*done.items()], f"{names.node} long, shard int"))
    kept = [c for c in docs.columns if c != "shard"]
    return rows.drop("shard").join(shard, names.node).select(*quoted(kept), "shard")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    meta = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.length(text).alias("chars"), F.xxhash64(text).alias("digest"))
    dims = {"log_bytes": F.log2("size"), "bytes_per_char": F.col("size") / (F.col("chars") + 1)}
    placed = kd_shards(meta, dims, F.col("size"), F.col("digest"), F.col("doc_id"), shards=16).select("doc_id", "size", "text_crc32", "shard")
    ranked = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot", placed.count())
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
