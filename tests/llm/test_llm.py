"""Operators of the training-data pipeline against brute force, on small tables with odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from meterflow.llm import catalog, decontaminate, embeddings, licences, neardup, packing, quality, repeats, sharding, suffixarray, toxicity, urlfilter
from meterflow.llm.shared import components, gapless_rank
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "the of and river stone light über naïve house 42 cat.dog runs over hill moss quiet grey while seven".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    texts = [*base, None, "", " \n\t", "x", base[3], base[3], base[5] + " tail", "a" * 4000, "ab " * 900, prose(rng, 6000), base[7].upper(), "<|startoftext|> is text", "Σίσυφος İstanbul  x"]
    for i in range(20):
        w = base[9].split() * 3
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w))
    return [(i * 7 % 1009, t, "en", "s", None if t is None else len(t), "e") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([*rows, rows[4]], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]


def test_decontamination(spark, docs, empty, rows):
    items = [(1, " ".join(rows[9][1].split()[:30])), (2, "the of"), (3, None), (4, "..."), (10, rows[12][1]), (None, rows[12][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add("null" if item is None else str(item))
    for slice_bytes in (8 << 20, 50):
        found = decontaminate.find_hits(docs, bench, slice_bytes=slice_bytes)
        for r in found.collect():
            w, hit, names = words(r["text"]), set(), set()
            for k in {len(x) for x in windows}:
                for i in range(len(w) - k + 1):
                    if tuple(w[i : i + k]) in windows:
                        hit.update(range(i, i + k))
                        names |= windows[tuple(w[i : i + k])]
            assert (r["n_words"], sum(x["end"] - x["start"] for x in r["hit_words"]), r["items"]) == (len(w), len(hit), sorted(names))
    clean = decontaminate.remove_spans(found)
    assert clean.columns == docs.columns and decontaminate.find_hits(clean, bench).where("size(items) > 0 AND n_words > 60").count() <= 1
    before, after = ({(r["doc_id"], r["text"]) for r in d.collect()} for d in (found.where("size(items) = 0"), clean))
    assert before <= after
    assert decontaminate.drop_documents(found).count() == found.where("size(items) = 0").count()
    assert decontaminate.find_hits(empty, bench).count() == 0
    assert decontaminate.find_hits(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def brute_repeats(rows, width=50):
    data = sorted((i, (t or "").encode()) for i, t, *_ in rows)
    seen, out = {}, {}
    for i, b in data:
        for k in range(len(b) - width + 1):
            seen.setdefault(b[k : k + width], i)
    for i, b in data:
        cover = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] < i:
                cover[k : k + width] = b"\1" * width
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("how", [{}, {"group_bytes": 900}, {"most_segments": 1, "group_bytes": 3000}])
def test_repeats(docs, empty, rows, how):
    want = brute_repeats(rows)
    got = repeats.remove_repeats(docs, keep_text=False, **how).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).decode()) == want[r["doc_id"]]
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_keep_columns(docs, rows):
    got = repeats.remove_repeats(docs, carry=("lang", "extra")).collect()
    assert {r["extra"] for r in got} == {"e"} and all(r["text"] == (t or "") for r in got for i, t, *_ in rows if i == r["doc_id"] and r["n_removed"] == 0)


def test_null_ids_come_last(spark):
    text = prose(random.Random(1), 60)
    d = spark.createDataFrame([(None, text), (5, text), (5, text), (9, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(d).collect()}
    assert got[5] == 0 and got[9] == got[None] == len(text.encode())


def test_hot_ids_are_dealt(spark, monkeypatch):
    """A third of the bytes under one doc_id, and as many under null: several groups of one range; long texts are hashed in parts."""
    monkeypatch.setattr(repeats, "PART_BYTES", 400)
    rng = random.Random(12)
    own = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(own)] + [(17, own[rng.randrange(40)] + str(i)) for i in range(40)] + [(None, own[rng.randrange(40)] + str(i)) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    first, groups = repeats.group_ranges(d, 2000, 60_000)
    assert groups.max() > 3
    want = Counter()
    for i, t in rows:
        data, k = t.encode(), (1 << 62) if i is None else i
        seen = {o.encode()[j : j + 50] for x, o in rows if ((1 << 62) if x is None else x) < k for j in range(len(o.encode()) - 49)}
        cover = bytearray(len(data))
        for j in range(len(data) - 49):
            if data[j : j + 50] in seen:
                cover[j : j + 50] = b"\1" * 50
        want[i, bytes(x for x, c in zip(data, cover) if not c).decode("utf-8", "ignore")] += 1
    got = repeats.remove_repeats(d, group_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == want


def test_clashing_hashes(spark, monkeypatch):
    """Were the first hash of a segment of two bits, the second would still tell segments apart."""
    rng = random.Random(2)
    core = "ranshqsvopgbmhqbain"
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(30)) + core + "".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(300)] + [(900, core), (901, "")]
    kept = repeats.Segments._of

    def narrow(*a):
        *rest, content, check = kept(*a)
        return *rest, content & np.uint64(3), check

    monkeypatch.setattr(repeats.Segments, "_of", staticmethod(narrow))
    table = pa.table({"doc_id": pa.array([r[0] for r in rows]), "text": [r[1] for r in rows], "range": [0] * len(rows)})
    seg = repeats.Segments(table, 64, np.zeros(0, np.uint64))
    assert len(set(seg.content.tolist())) == 4 and seg.is_owner.all()
    monkeypatch.undo()
    assert all(r["n_removed"] == 0 for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=4000).collect())


def test_repeats_with_clashing_columns(spark, rows):
    d = spark.createDataFrame([(i, t, "a", "b", "c") for i, t, *_ in rows], "doc_id long, text string, gid string, `a.b` string, n_bytes string")
    got = repeats.remove_repeats(d, carry=("gid", "a.b", "n_bytes"))
    assert got.columns == ["doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept", "gid", "a.b"]
    assert {tuple(r)[6:] for r in got.collect()} == {("a", "b")}


@pytest.mark.parametrize("seed", range(30))
def test_suffix_arrays(seed):
    rng = np.random.RandomState(seed)
    segments = [bytes(rng.randint(97, 97 + rng.randint(1, 4), rng.randint(0, 30)).astype(np.uint8)) for _ in range(rng.randint(1, 8))]
    size = np.array([len(s) for s in segments])
    start = np.cumsum(size + 1) - size - 1
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 1
    text[start + size] = 0
    letters, seen = [], 0
    for x in text.tolist():
        letters.append(x + 1000 if x else seen)
        seen += x == 0
    want = sorted(range(len(letters)), key=lambda i: letters[i:])
    order = suffixarray.suffix_array(text)
    assert order.tolist() == want
    prefix = suffixarray.common_prefixes(text, order)
    for a, b in zip(want, want[1:]):
        k = 0
        while a + k < len(letters) and b + k < len(letters) and letters[a + k] == letters[b + k]:
            k += 1
        assert prefix[b] == k


def test_urls(spark):
    urls = [("http://a.example.com/en/7x", "allow", "example.com/en/7"), ("HTTPS://A.COM/en/", "block", "com/en/"), ("x://net/de/8", "allow", "net/de/"), ("x://example.net/de/81", "block", "example.net/de/8"), ("x://notexample.net/de/8?q", "allow", "net/de/")]
    urls += [(None, "allow", None), ("nonsense", "allow", None), ("x://com", "allow", None), ("x://org/es", "allow", None), ("x://b.ORG/es/#f", "block", "org/es/"), ("x://a.com:80/en/", "allow", None), ("x://?/en/", "allow", None)]
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in urlfilter.judge_urls(df, urlfilter.RULES).collect()}
    assert got == {i: (v, r) for i, (_, v, r) in enumerate(urls)}
    assert urlfilter.judge_urls(df.limit(0), urlfilter.RULES).count() == 0
    assert urlfilter.Trie([("allow", "", "")]).find("any", "/x") == ("allow", "", 0, 0)
    few = urlfilter.judge_urls(df.withColumnRenamed("url", "u.r").withColumn("_judged", F.lit(1)), urlfilter.RULES, url="u.r", slice_bytes=20)
    assert few.columns == ["page_id", "u.r", "_judged", "host", "path", "rule", "verdict"] and {r["page_id"]: (r["verdict"], r["rule"]) for r in few.collect()} == got


def test_packing(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t, *_ in rows}
    cut = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).cache()
    got = packing.pack(cut).toPandas()
    for r in got.itertuples():
        x = ids[r.doc_id]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes())
    assert got.length.sum() == sum(len(ids[i]) for (i,) in docs.select("doc_id").collect())
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all() and got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.groupby("sequence_id").length.sum().sort_values().iloc[1:].min() > 1900
    assert packing.pack(packing.token_pieces(empty, public_tokenizers.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_patterns(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randint(1, 60) for _ in range(300))
    left = Counter(counts)
    for chosen, times in packing.patterns(dict(counts), 64):
        assert sum(s * k for s, k in chosen.items()) <= 64
        for s, k in chosen.items():
            left[s] -= k * times
    assert not any(left.values())
    sizes = {7: 2, 11: 1, 30: 1}
    best = max((a * 7 + b * 11 + 30 for a in range(3) for b in range(2) if a * 7 + b * 11 + 30 <= 50))
    assert sum(s * k for s, k in packing.fill(sizes, 50).items()) == best


def test_shards(docs, empty):
    text = F.coalesce("text", F.lit(""))
    meta = docs.select("doc_id", "text", (F.octet_length(text) + 1).cast("long").alias("size"), F.xxhash64(text).alias("digest"))
    for n in (5, 16):
        got = sharding.kd_shards(meta, {"log": F.log2("size"), "null": F.lit(None)}, F.col("size"), F.col("digest"), F.col("doc_id"), shards=n).toPandas()
        assert len(got) == docs.count() and set(got.shard) <= set(range(n))
    by_text = got.groupby("digest").agg(shards=("shard", "nunique"), size=("size", "sum"))
    assert (by_text[by_text["size"] * 16 * 16 <= got["size"].sum()].shards == 1).all()
    even = sharding.kd_shards(meta.where("size < 600"), {"log": F.log2("size")}, F.col("size"), F.col("digest"), F.col("doc_id"), shards=4).toPandas().groupby("shard")["size"].sum()
    assert even.max() - even.min() < 1300
    assert sharding.kd_shards(meta.limit(0), {"log": F.log2("size")}, F.col("size"), F.col("digest"), F.col("doc_id"), shards=4).count() == 0
    by_bytes = sharding.kd_shards(meta.where("size < 600"), {"log": F.log2("size")}, F.col("size"), F.col("digest"), F.col("doc_id"), target_bytes=4000)
    assert by_bytes.groupBy("shard").agg(F.sum("size").alias("b")).where("b > 5200").count() == 0


def test_hot_copies_are_spread(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("digest"), F.lit(10).cast("long").alias("size"))
    got = sharding.kd_shards(d, {"one": F.lit(1.0)}, F.col("size"), F.col("digest"), F.col("doc_id"), shards=8).groupBy("shard").count().toPandas()["count"]
    assert len(got) == 8 and got.max() <= 52 and got.min() >= 48


def test_ranks(spark):
    d = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") % 50).alias("v"))
    got = gapless_rank(d, ["k"], ["v"], "r", 1000, per_task=20).toPandas()
    assert all(sorted(g.r) == list(range(len(g))) for _, g in got.groupby("k"))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}


def brute_near(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in range(50):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}


def test_near_duplicates(docs, empty, rows):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == brute_near(rows)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_loose_group(spark, monkeypatch):
    """A large group of copies of which many pairs lie just below the threshold; blocks are made small."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 8])):
            w[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 20)
    monkeypatch.setattr(neardup, "CLUSTER_BLOCK", 20)
    want = brute_near(rows)
    assert len({c for _, c, _ in want.values()}) > 3
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_register_estimates():
    rng = np.random.RandomState(4)
    for share in (0.3, 0.6, 0.9):
        union = rng.randint(0, 2**62, 600).astype(np.uint64)
        n = int(600 * share)
        a, b = np.concatenate((union[:n], union[n : n + (600 - n) // 2])), np.concatenate((union[:n], union[n + (600 - n) // 2 :]))
        regs = neardup.registers([a, b, union])
        assert (neardup.registers([union])[0] == np.minimum(regs[0], regs[1])).all() or (regs[2] == np.maximum(regs[0], regs[1])).all()
        est = neardup.joint_estimate(regs[:1], regs[1:2], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - share) < 0.2


def test_licences(spark, empty):
    mit, bsd = (next(t for name, t in licences.KNOWN if name == n and len(t) > 500) for n in ("MIT", "BSD-3-Clause"))
    wrapped = re.sub(r"(.{1,60})(?: |$)", r"\1\n", mit.replace("\n\n", "@@")).replace("@@", "\n\n")
    rows = [
        (1, "MIT licence!"), (2, "Some text.\nAll rights reserved.\nReleased  under the MIT Licence\nall RIGHTS reserved"), (3, None), (4, ""), (4, "...\n!!!"),
        (5, "Copyright (c) 2020 X\nALL RIGHTS RESERVED"), (5, "All rights reserved."), (6, f"Copyright (c) 2020 Someone\n\n{mit.upper()}\n"), (7, "MIT Licence\n\n(c) 1999 A\n\n" + wrapped), (8, bsd),
        (9, "A file.\n\nThis work is licensed under\nthe GNU General Public\nLicense, version 3.\n\nMore text."), (10, mit + " more"), (11, "x " * 200_000 + "\nAll rights reserved."),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"licences": F.lit("clash"), "_k1": F.lit("mine"), "a.b": F.lit("dot")})
    out = licences.scan_licences(d, licences.known_digests(spark))
    assert out.columns == ["doc_id", "text", "_k1", "a.b", *licences.RESULT]
    got = sorted((r["doc_id"], r["text_licence"] or "", r["n_licence_lines"], r["n_licence_paragraphs"], r["licences"]) for r in out.collect())
    assert got == [
        (1, "", 0, 0, ""), (2, "", 3, 0, "All-Rights-Reserved,MIT"), (3, "", 0, 0, ""), (4, "", 0, 0, ""), (4, "", 0, 0, ""), (5, "All-Rights-Reserved", 1, 0, "All-Rights-Reserved"), (5, "All-Rights-Reserved", 1, 0, "All-Rights-Reserved"),
        (6, "MIT", 0, 0, ""), (7, "MIT", 0, 0, ""), (8, "BSD-3-Clause", 0, 0, ""), (9, "", 0, 1, "GPL-3.0"), (10, "", 0, 0, ""), (11, "", 1, 0, "All-Rights-Reserved"),
    ]
    assert licences.scan_licences(empty, licences.known_digests(spark)).count() == 0
    assert licences.scan_licences(d, licences.known_digests(spark).limit(0)).where("n_licence_lines > 0 OR text_licence IS NOT NULL").count() == 0
    assert licences.known_digests(spark, [("X", "..."), ("Y", None)]).count() == 0


def test_many_known_licences(spark, tmp_path):
    """No number of known texts is too many; a folder of texts is a source of them."""
    (tmp_path / "Own-1.0.txt").write_text("My own licence:\ndo what is right.")
    folder = licences.known_folder(spark, str(tmp_path))
    many = spark.range(30_000).select(F.concat(F.lit("L"), "id").alias("licence"), F.concat(F.lit("term "), "id").alias("text"))
    d = spark.createDataFrame([(1, "term 29999"), (2, "my OWN license - do what is right"), (3, "a\nterm 7")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text_licence"], r["licences"]) for r in licences.scan_licences(d, licences.known_digests(spark, many.unionByName(folder))).collect()}
    assert got == {1: ("L29999", "L29999"), 2: ("Own-1.0", "Own-1.0"), 3: (None, "L7")}


def test_licence_queries_agree_on_texts(spark, tmp_path):
    """The SQL finds the same on documents that are licences, which the driver's tables don't hold."""
    rows = [(i, t if i % 3 else f"(c) 2001 X\n{t.upper()}") for i, (_, t) in enumerate(licences.KNOWN)] + [(900, None), (901, "All rights\nreserved.")]
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.sql(licences.ORACLE_SQL).df()
    got = licences.op9_licences(spark, str(tmp_path)).toPandas()[list(want.columns)]
    frames = [f.map(lambda x: "" if x is None or x != x else str(x)).sort_values("doc_id", ignore_index=True) for f in (got, want)]
    pd.testing.assert_frame_equal(*frames)
    assert (got[got.doc_id < 900].text_licence.notna()).all()


def test_embeddings(spark):
    rng = np.random.RandomState(6)
    x = rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(100 + i, (x[i % 5] + 0.3 * rng.standard_normal(16) * np.linalg.norm(x[i % 5]) / 4).tolist(), i % 5 % 2) for i in range(60)]
    rows += [(300, x[0].tolist(), 0), (301, (2 * x[0]).tolist(), 0), (302, x[0].tolist(), None), (303, None, 0), (304, [0.0] * 16, 0), (305, [None] + [1.0] * 15, 0), (306, [float("nan")] * 16, 0), (307, [], 0), (308, [1.0] * 3, 0), (309, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = {i: (np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j, (w, m) in ok.items() if j != i and i in ok and m == ok[i][1] and len(w) == len(ok[i][0]) and w @ ok[i][0] / np.linalg.norm(w) / np.linalg.norm(ok[i][0]) >= 0.93} for i, _, _ in rows}
    comp = {i: i for i in links}
    for _ in range(40):
        for i in links:
            for j in links[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    for block in (1024, 7):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_embeddings(df, block=block).collect()}
        found = sum(n for n, _, _ in got.values())
        assert found >= 0.97 * sum(map(len, links.values())) and all(got[i][0] <= len(links[i]) for i in links)
        if found == sum(map(len, links.values())):
            assert got == {i: (len(links[i]), comp[i], comp[i] == i) for i in links}
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.RandomState(1)
    near, far, more = embeddings.decode(rng.standard_normal((500, 8)) * 2)
    assert (more >= 0).all()
    for p in (near, far):
        assert ((p % 2 == p[:, :1] % 2).all(1)).all() and (p.sum(1) % 4 == 0).all()


def held_out(spark, data, name, label):
    con = duckdb.connect()
    labels = con.sql(f"SELECT doc_id, {label} AS y FROM '{data}/sf0.01/labels.parquet'").df()
    return catalog.QUERIES[name](spark, f"{data}/sf0.01").toPandas().merge(labels, on="doc_id")


def test_quality_held_out(spark, data):
    m = held_out(spark, data, "op4_quality", "quality")
    assert set(m.held_out == (m.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0)) == {True}
    assert (m[m.held_out].predicted == m[m.held_out].y).mean() > 0.93 and m.score.between(0, 1).all() and (m.predicted == (m.score >= 0.3)).all()


def test_toxicity_held_out(spark, data):
    m = held_out(spark, data, "op6_toxicity", "toxic")
    assert set(m.held_out == (m.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3) == 1)) == {True}
    assert m[m.y == 0].predicted.mean() < 0.02 and m.score.between(0, 1).all()


def test_models_on_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(7, 1, 1), (14, 1, 1), (None, 0, 0), (21, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        trees, model = quality.train(docs, labels), toxicity.train(docs, labels)
        assert quality.with_quality(docs, trees).where("quality_score BETWEEN 0 AND 1").count() == docs.count()
        assert toxicity.with_toxicity(docs, model).where("toxicity_score BETWEEN 0 AND 1").count() == docs.count()
        assert quality.with_quality(empty, trees).count() == 0 and toxicity.with_toxicity(empty, model).count() == 0


def test_disguised_words():
    counts = np.ones((toxicity.N,) * 3)
    model = toxicity.Model(counts, ["idiot", "stupid", "moron", "loser"], np.ones(4), 0.0)
    disguised = {"1d10t": "idiot", "i.d.i.o.t": "idiot", "idiooot": "idiot", "$tup1d": "stupid", "m0r0n": "moron", "l0$er": "loser", "st-u-pid": "stupid"}
    assert {k: " ".join(model.restore(k)) for k in disguised} == disguised


def test_disguised_documents(spark):
    rng = random.Random(1)
    plain = [prose(rng, 40) for _ in range(120)]
    rows = [(i, t + (" you idiot" if i % 4 == 0 else "")) for i, t in enumerate(plain)]
    more = [(900, "what an 1d10t he is"), (901, "what an i d i o t he is"), (902, "IDIOOOT!"), (903, "what a stone it is"), (904, None), (905, "")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity_score"] for r in toxicity.with_toxicity(docs, toxicity.train(docs, labels)).collect()}
    assert min(got[i] for i in (900, 901, 902)) > 0.7 > 0.3 > max(got[i] for i in (903, 904, 905))


TABLES = ["documents", "benchmark", "pages", "embeddings", "labels"]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/sf0.001/{t}.parquet'")
    frames = [f[sorted(f.columns)].map(str).sort_values(sorted(f.columns), ignore_index=True) for f in (catalog.QUERIES[name](spark, f"{data}/sf0.001").toPandas(), con.sql(catalog.ORACLE_SQL[name]).df())]
    frames = [f.replace({"nan": "None", "<NA>": "None"}) for f in frames]
    pd.testing.assert_frame_equal(*frames)


def test_repeats_of_the_small_table(spark, data):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{data}/sf0.001/documents.parquet'").fetchall()
    got = catalog.QUERIES["op2_remove_repeats"](spark, f"{data}/sf0.001").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == brute_repeats(rows)


def test_pipeline(spark, data, tmp_path):
    import corpus_pipeline

    sf = f"{data}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("items", F.lit("mine"))
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        got = {r[0] for r in out.select("doc_id").collect()}
        assert got <= ids and (i < 2 or got == ids)
        if name == "near_duplicates":
            assert got == {k for k, (_, _, kept) in brute_near([tuple(r) for r in docs.select("doc_id", "text").collect()]).items() if kept}
        if name == "repeats":
            want = brute_repeats([tuple(r) for r in docs.select("doc_id", "text").collect()])
            assert all(abs(len((r["text"] or "").encode()) - (want[r["doc_id"]][0] - want[r["doc_id"]][1])) <= 6 * max(1, want[r["doc_id"]][2]) for r in out.collect())
        docs, ids = out, got
    assert Path(corpus_pipeline.__file__).exists() and os.path.exists(tmp_path / "packing")
