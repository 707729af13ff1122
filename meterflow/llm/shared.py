"""Helpers that several operators use: shared tables, gapless ranks, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names of columns that ``df`` doesn't have in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name += "_"
        taken.add(f"_{name}")
        out.append(f"_{name}")
    return out


def quoted(columns: list[str]) -> list[Column]:
    """Columns of these names, whatever is in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary
    one; a cluster has none that all can read, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meterflow-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The table outlives a lost executor; it is removed with the folder, or at the end of a :func:`scratch` that it was made in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made[-1:]:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_made: list[list[str]] = []


def _delete(spark: SparkSession, paths) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _tables_of(df: DataFrame) -> set[str]:
    return {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in df.inputFiles()}


@contextmanager
def scratch(spark: SparkSession):
    """Tables made within are deleted at its end, but for those that frames given to the function it yields still read."""
    kept: set[str] = set()

    def keep(*frames: DataFrame) -> None:
        for df in frames:
            kept.update(_tables_of(df))

    _made.append([])
    try:
        yield keep
    finally:
        made = _made.pop()
        _delete(spark, [path for path in made if path.rsplit("/", 1)[1] not in kept])


def remove_tables(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, {f.rsplit("/", 1)[0] for f in df.inputFiles()})


def gapless_rank(df: DataFrame, keys: list[str], salt_of: list[str], out: str, rows: int, per_task: int = 20_000) -> DataFrame:
    """Number the rows of each key 0, 1, 2, … without gathering a key in one task.

    Rows of a key are dealt to salts by a hash of ``salt_of``; a small table of counts per key and salt gives each
    salt its first number. ``rows`` is the row count, which sets the number of salts; rows with equal
    ``salt_of`` share a salt and are told apart by their order there."""
    salts = max(16, -(-rows // per_task))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*salt_of)
    ranked = salted.withColumn("_r", F.row_number().over(within) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_s")]
    joined = ranked.join(first, on=[c for c in on][0] if len(on) == 1 else _all(on), how="inner")
    return joined.withColumn(out, F.col("_first") + F.col("_r")).drop("_salt", "_s", "_r", "_first", *[f"_k_{k}" for k in keys])


def block_pairs(df: DataFrame, keys: list[str], member: str, block: int, settled: Column | None = None, task_rows: int = 20_000) -> DataFrame:
    """``df`` with (``side``, ``i``, ``j``, ``task``): the members of each key are dealt to blocks of about ``block`` rows, and a row is there
    once for each pair i <= j that its own block, ``side``, is part of. All pairs of members meet in some (key, i, j), but for
    those of which both are ``settled``: their blocks are paired with other blocks only. Each (key, i, j) lies in one ``task``, a group
    for Spark of about ``task_rows`` rows: small ones share a task, and those of a large key lie in many.

    The sizes of keys are written as a table, and a job adds them up."""
    is_settled, open_blocks, settled_blocks, other = fresh_names(df, "is_settled", "open_blocks", "settled_blocks", "other")
    flagged = df.withColumn(is_settled, settled if settled is not None else F.lit(False))
    number = lambda flag: F.sum(F.when(F.col(is_settled) == flag, 1).otherwise(0))
    sizes = materialize(flagged.groupBy(*keys).agg(number(False).alias("free"), number(True).alias("held")), "sizes")
    n_open, n_held = (F.ceil(F.col(c) / block).cast("int") for c in ("free", "held"))
    rows = sizes.agg(F.sum(F.col("free") * (n_open + n_held) + F.col("held") * n_open)).first()[0] or 0
    counts = sizes.select(*keys, n_open.alias(open_blocks), n_held.alias(settled_blocks))
    hashed, n_open, n_held = F.xxhash64(member), F.col(open_blocks), F.col(settled_blocks)
    dealt = flagged.join(counts, keys).withColumn("side", F.when(F.col(is_settled), n_open + F.pmod(hashed, F.greatest(n_held, F.lit(1)))).otherwise(F.pmod(hashed, F.greatest(n_open, F.lit(1)))).cast("int"))
    last = F.when(F.col(is_settled), n_open - 1).otherwise(n_open + n_held - 1)
    paired = dealt.where(last >= 0).withColumn(other, F.explode(F.sequence(F.lit(0), last)))
    out = paired.withColumns({"i": F.least("side", other), "j": F.greatest("side", other)}).drop(other, open_blocks, settled_blocks, is_settled)
    return out.withColumn("task", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(max(1, rows // task_rows))))


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal rows of sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], n)


def pairs_within(start: np.ndarray, end: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs u < v of rows of the same run, about ``most`` at a time (those of one row at least)."""
    size = end - start
    row = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    partners = np.repeat(end, size) - row - 1
    total = np.cumsum(partners)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        n = partners[at:to]
        u = np.repeat(row[at:to], n)
        if len(u):
            yield u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def least_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n points the least point reachable by the pairs (p, q)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def components(edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, component)``, component the smallest node reachable.

    Alternates large-star and small-star contraction, each a grouped minimum; each round's table is written to the
    shared folder, so the plan stays short and a lost executor costs one round. Nodes without edges do not appear."""
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")

    def state_of(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = state_of(now)
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are dealt anew, so that each join is one of two shuffles, of which Spark splits a hub's partition
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).repartition("a")
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2.repartition("a"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b")))
        nxt = materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
        state = state_of(nxt)
        remove_tables(now)
        now = nxt
        if seen == state:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
