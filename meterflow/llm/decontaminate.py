"""Operator 1, benchmark decontamination: test windows are a broadcast hash set that document windows are looked up in.

Words are runs of letters, digits and bytes above 0x7F, A-Z lower-cased. A window is ``n`` consecutive words of a test
item, or the whole of a shorter item. Hashes find candidates; each is confirmed word by word.

Defined cases: a null or empty text has no words; an item without words has no window; items with equal texts are all
reported; a null item_id is reported as "null"; columns of documents are kept, those that clash with a result's name are replaced.
texts of documents may be of any length. A slice of items holds at most ``slice_bytes`` of text and is broadcast as sorted hashes, places in the
items' normalised text and that text: about 40 bytes a window, of which there is at most one a word. However large the test set is, one slice is held at a time:
each further slice is a pass over a table in the shared folder.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, quoted
from .textbatch import LOWER, TextBatch, large, pieces, shingles

WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
SPAN = "array<struct<start:int,end:int>>"
RESULT = ["n_words", "hit_words", "hit_bytes", "items"]


def _normal(batch: TextBatch, i: int, k: int) -> bytes:
    return b" ".join(LOWER[batch.buf[s:e]].tobytes() for s, e in zip(batch.ws[i : i + k], batch.we[i : i + k]))


class Windows:
    """Hash set of one slice of items, in arrays. For each window length k: sorted hashes; for each of them its windows, as first word and item, from ``cut`` on."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.items = [i for i, _ in items]
        batch = TextBatch(large(pa.array([t or "" for _, t in items], pa.large_string())))
        batch.words(WORD)
        hashes = batch.word_hashes()
        # words in lower case with one blank between them, so that a window is a range of bytes
        size = batch.we - batch.ws + 1
        self.start = np.cumsum(size) - size
        self.end = self.start + size - 1
        take = np.repeat(batch.ws - self.start, size) + np.arange(int(size.sum()))
        text = LOWER[batch.buf[np.minimum(take, len(batch.buf) - 1)]] if len(take) else np.zeros(0, np.uint8)
        text[self.end] = 0x20
        self.text = text.tobytes()
        self.start, self.end = self.start.astype(np.int32), self.end.astype(np.int32)
        self.by_length = {}
        lengths = np.minimum(batch.n_words, n)
        for k in sorted({int(x) for x in lengths if x}):
            of = np.flatnonzero(lengths == k)
            count = batch.n_words[of] - k + 1
            first = np.repeat(batch.first[of] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            h = shingles(hashes, k)[first]
            order = np.argsort(h, kind="stable")
            h, first, item = h[order], first[order].astype(np.int32), np.repeat(of, count)[order].astype(np.int32)
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[k] = (h[new], seen, np.append(new, len(h)), first, item)

    def hits(self, batch: TextBatch, hashes: np.ndarray):
        """(first word, length, items) of each confirmed occurrence."""
        for k, (keys, seen, cut, first, item) in self.by_length.items():
            h = shingles(hashes, k)
            at = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            at = at[batch.doc[at] == batch.doc[at + k - 1]]
            where = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[where] == h[at]
            for i, w in zip(at[ok].tolist(), where[ok].tolist()):
                words = _normal(batch, i, k)
                same = range(int(cut[w]), int(cut[w + 1]))
                items = {self.items[item[x]] for x in same if self.text[self.start[first[x]] : self.end[first[x] + k - 1]] == words}
                if items:
                    yield i, k, items


def _slices(benchmark: DataFrame, slice_bytes: int):
    """Items as lists of (id, text), each list at most ``slice_bytes`` of text (one item at least)."""
    now, size = [], 0
    for item, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").orderBy("item_id", "text").toLocalIterator():
        n = len((text or "").encode())
        if now and size + n > slice_bytes:
            yield now
            now, size = [], 0
        now.append((item, text))
        size += n
    yield now


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, slice_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with n_words long, hit_words (maximal runs of hit words), hit_bytes (the same as UTF-8 byte ranges) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    out = docs.select(quoted([c for c in docs.columns if c not in RESULT]))
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_words": F.expr(f"cast(array() as {SPAN})"), "hit_bytes": F.expr(f"cast(array() as {SPAN})"), "items": F.expr("cast(array() as array<string>)")})
    for k, items in enumerate(_slices(benchmark, slice_bytes)):
        held = spark.sparkContext.broadcast(Windows(items, n))
        out = (materialize(out, "hits") if k else out).mapInArrow(_scanner(held, out.columns), out.schema)
    return out


def _runs(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, those that touch joined."""
    out: list[list[int]] = []
    for a, b in sorted(marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scanner(held, columns):
    def scan(batches):
        for whole in batches:
            texts = large(whole.column("text"))
            for a, b in pieces(texts):
                part = whole.slice(a, b - a)
                batch = TextBatch(texts.slice(a, b - a))
                batch.words(WORD)
                hashes = batch.word_hashes()
                marks, items = defaultdict(list), defaultdict(set)
                for i, k, names in held.value.hits(batch, hashes):
                    d = int(batch.doc[i])
                    marks[d].append((i - int(batch.first[d]), i - int(batch.first[d]) + k))
                    items[d].update(names)
                hit_words, hit_items, hit_bytes = (part.column(c).to_pylist() for c in ("hit_words", "items", "hit_bytes"))
                for d, found in marks.items():
                    runs = _runs(found + [(x["start"], x["end"]) for x in hit_words[d]])
                    hit_words[d] = [{"start": x, "end": y} for x, y in runs]
                    first, base = int(batch.first[d]), int(batch.start[d])
                    hit_bytes[d] = [{"start": int(batch.ws[first + x]) - base, "end": int(batch.we[first + y - 1]) - base} for x, y in runs]
                    hit_items[d] = sorted({*hit_items[d], *items[d]})
                new = {"n_words": pa.array(batch.n_words, pa.int64())} | {c: pa.array(v, part.schema.field(c).type) for c, v in (("hit_words", hit_words), ("hit_bytes", hit_bytes), ("items", hit_items))}
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns], names=columns)

    return scan


def remove_spans(found: DataFrame) -> DataFrame:
    """Texts of :func:`find_hits` without their hit byte ranges, n_chars made to fit; documents without hits stay as they are."""
    data = F.encode("text", "utf-8")
    kept = F.aggregate(
        "hit_bytes",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("kept")),
        lambda s, x: F.struct(x["end"].alias("at"), F.concat(s["kept"], F.decode(F.substring(data, s["at"] + 1, x["start"] - s["at"]), "utf-8")).alias("kept")),
        lambda s: F.concat(s["kept"], F.decode(F.substring(data, s["at"] + 1, F.length(data)), "utf-8")),
    )
    hit = F.size("hit_bytes") > 0
    out = found.withColumn("text", F.when(hit, kept).otherwise(F.col("text")))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.drop("n_words", "hit_words", "hit_bytes", "items")


def drop_documents(found: DataFrame, most_share: float = 0.0) -> DataFrame:
    """Documents of :func:`find_hits` whose share of hit words is ``most_share`` at most."""
    hit = F.aggregate("hit_words", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return found.where(hit <= most_share * F.col("n_words")).drop("n_words", "hit_words", "hit_bytes", "items")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS s
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, p, dw.k, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
