"""Packing against the tokenizer itself."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from meterflow.llm import catalog, packing
from meterflow.llm.textbatch import TextBatch, large, pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Characters and strings that lower-casing, composition, splitting and special tokens treat in their own ways.
ODD = [*"abcsStTmMdDrReEvVlL'''  \t\n.,!?-_#&$0123456789<|>/\"()", *"’\xa0ÉéßẞñÀ×÷İıΣςǆ中文٣½²ªºµ́​ \x00\x1c\x85ﬁKÅ"]
ODD += ["T̈", "\U0001f642", "\U0001f469‍\U0001f4bb", "'s", "'re", "'ll", "'ve", "don't", "we'll", "<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>"]


def token_ids(texts, ids, most=1 << 20):
    texts = large(pa.array(texts, pa.large_string()))
    return [x.tolist() for a, b in pieces(texts, most) for x in ids.of(TextBatch(texts.slice(a, b - a)))]


def test_small_cache(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) + rng.choice(["", ",", "'s", "7"]) for _ in range(300)) for _ in range(12)]
    want = token_ids(texts, packing.Ids(PATH))
    assert want == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "MOST_CACHED", 40)
    monkeypatch.setattr(packing, "PLACES", 64)
    small = packing.Ids(PATH)
    assert [token_ids([t], small)[0] for t in texts] == want


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_odd_texts(seed):
    """Whatever a text is made of, its ids are the tokenizer's own."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "'", "'s", "''s", "'s's", " 's", "x's", "x'S", "'l", "'r", "'v", "'re", "é'sé"]
    assert token_ids(texts, packing.Ids(PATH), 20_000) == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_op5_pack(spark, data):
    """The query itself on whole documents: pieces, ids and places."""
    sf, tokenizer = f"{data}/sf0.001", Tokenizer.from_file(PATH)
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    got = catalog.QUERIES["op5_pack"](spark, sf).toPandas().sort_values(["doc_id", "start"])
    assert set(got.doc_id) == set(ids)
    for i, g in got.groupby("doc_id"):
        assert (g.start == g.length.cumsum() - g.length).all() and g.length.sum() == len(ids[i]) and (g.doc_tokens == len(ids[i])).all()
        assert [zlib.crc32(ids[i][a : a + n].tobytes()) for a, n in zip(g.start, g.length)] == g.ids_crc32.tolist()
    got = got.sort_values(["sequence_id", "offset"])
    sizes = got.groupby("sequence_id").length
    assert (sizes.cumsum() - got.length == got.offset).all() and sizes.sum().max() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_ties_and_other_columns(spark):
    """Repeated rows are packed each on its own, and columns of the input that bear names of the result don't matter."""
    rows = [(7, "the light of the river", "x", 3)] * 5 + [(None, None, "y", 4), (7, "", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    got = packing.pack(packing.token_pieces(docs, PATH).cache()).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == 7 and got.sequence_id.nunique() == 1 and got.offset.tolist() == (got.length.cumsum() - got.length).tolist()
    assert sorted(got.length) == [1, 1, 6, 6, 6, 6, 6]
