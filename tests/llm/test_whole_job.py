"""Cases in which operators once did less than the whole job."""

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from meterflow.llm import repeats, toxicity

#: Different strings of 50 bytes around one least string, whose hashes share their upper 32 bits.
ALIKE = [
    ("neebahufruufisvranshqsvopgbmhqbainkaeznvdeqboeszyc", "msuppnmpukxdeouranshqsvopgbmhqbainkwyzurtsrtuvabtt"),
    ("mmnmxqwtgzcohayranshqsvopgbmhqbainkznkeghuupohxjtf", "cenzgidirissfytranshqsvopgbmhqbainkdjcellqwzxehmrr"),
    ("jsnvlpfcqheghuuranshqsvopgbmhqbainkfliubjofmixkgtd", "cntsvgnsguqdisgranshqsvopgbmhqbainkaccmjlvwnxssqan"),
]


@pytest.mark.parametrize("apart", [1, 1000])
def test_segments_of_like_hashes_stay(spark, apart):
    """In one group (doc_ids side by side) and in several."""
    rows = [(i * apart, text) for i, text in enumerate(t for pair in ALIKE for t in pair)]
    rows += [(90_000 + i, "") for i in range(3)] + [(99_999, ALIKE[0][0])]
    for most in (1, 1 << 20):
        got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=most).select("doc_id", "n_removed").collect()
        assert {r[0]: r[1] for r in got if r[1]} == {99_999: 50}


def test_copies_take_no_places(spark):
    """An insult in few documents is learned beside a toxic document that was copied often."""
    names = ["".join("bcdfghjklmnpqrstvwxz"[n // 20**k % 20] for k in range(3)) for n in range(2000)]
    rare = " ".join(w + "ota" for w in names[:100])
    rows = [(1, rare)] * 200 + [(1, f"{names[i]} {names[i + 20]} idiot") for i in range(200, 209)] + [(0, " ".join(names[i : i + 30])) for i in range(300, 1500)]
    assert "idiot" in toxicity.telling_words(spark.createDataFrame(rows, "label int, text string"), 40)


def insults(spark, texts):
    """What each text's score says of it: the set of learned words, whose weights are powers of two."""
    words = ["idiot", "stupid", "moron", "loser"]
    model = toxicity.Model(np.ones((toxicity.N,) * 3), words, 0.5 * 2.0 ** np.arange(4), -4.0)
    got = toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    sums = {r["doc_id"]: round(2 * (np.log(r["toxicity_score"] / (1 - r["toxicity_score"])) + 4)) for r in got}
    return [{w for k, w in enumerate(words) if sums[i] >> k & 1} for i in range(len(texts))]


def test_disguises_at_any_place(spark):
    some = {"idiot": ["ídíót", "ÍDIÓT", "id\u200biot", "idi\u00adot", "1diot", "id1ot", "idi07", "idio7", "1d107", "iiddiioott", "iidiot", "idiott", "*idi*ot*"], "loser": ["£oser", "l0ser", "lose\u200br", "looser", "lo-ser", "10s3r."], "moron": ["morroon", "möron", "mor0n", "m.oron,"]}
    texts = [f"what {x} there" for v in some.values() for x in v] + ["a book of 1984, i.e. a sheet", "455 10 07"]
    assert insults(spark, texts) == [{k} for k, v in some.items() for _ in v] + [set(), set()]


def test_long_tokens_and_runs(spark):
    texts = ["1d10t_st-u-p1d_m0r0n", "l0$er_" * 100 + "1d10t", "m0r0n." * 60 + "l0$er", "b c d " * 100 + "an i d i o t"]
    got = insults(spark, texts)
    assert got == [{"idiot", "stupid", "moron"}, {"loser", "idiot"}, {"moron", "loser"}, {"idiot"}]


def test_spaced_words_in_a_row(spark):
    some = {"a s t u p i d man": {"stupid"}, "y o u i d i o t": {"idiot"}, "i d i o t s t u p i d": {"idiot", "stupid"}, "i d i o t  m o r o n": {"idiot", "moron"}, "5 i d i o t": {"idiot"}, "an i d i o t.": {"idiot"}, "í d í ó t": {"idiot"}, "a b c d e": set()}
    assert insults(spark, list(some)) == list(some.values())


def answers(rows, group=40, shards=4):
    """Codes for all segments of texts by doc_id, in groups as remove_repeats sends them."""
    import zlib

    sent = []
    for g in range(0, len(rows), group):
        some = rows[g : g + group]
        table = pa.table({"doc_id": [i for i, _ in some], "text": [t for _, t in some], "range": [g // group] * len(some)})
        sent.append(repeats._send(shards, SimpleNamespace(value=np.zeros(0, np.uint64)))((pa.scalar(g // group),), table))
    sent = pa.concat_tables(sent)
    codes = [repeats._answer(4000)((pa.scalar(s),), sent.filter(pc.equal(sent["shard"], s))) for s in range(shards)]
    return np.concatenate([np.frombuffer(zlib.decompress(c), np.uint8) for t in codes for c in t.column("codes").to_pylist()])


def test_segments_of_one_phrase_are_not_sent():
    """A phrase of 30 bytes in 400 documents, in other words each time: its segments share no string, so their bytes go nowhere."""
    r = random.Random(5)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrase = letters(30)
    rows = [(i, letters(60) + phrase + letters(60)) for i in range(400)]
    assert (answers(rows) >= 2).sum() < 20
    # where 50 bytes are shared, segments are sent, however the string lies around its least hash
    shared = [letters(50) for _ in range(300)]
    found = answers([(2 * i + k, letters(60) + s + letters(60)) for i, s in enumerate(shared) for k in (0, 1)])
    assert (found >= 2).sum() >= 2 * len(shared)


@pytest.mark.parametrize("how", [{}, {"group_bytes": 700}, {"group_bytes": 1500, "most_segments": 1}, {"group_bytes": 1500, "shard_entries": 20, "most_segments": 3}])
def test_strings_just_long_enough(spark, how):
    """Shared strings of 45 to 55 bytes around common phrases, some at an edge of a text, and longer runs over several segments."""
    r = random.Random(8)
    letters = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    phrases, texts = [letters(25) for _ in range(4)], []
    pool = [letters(a) + r.choice(phrases) + letters(30 - a) for a in range(31) for _ in range(2)]
    for _ in range(160):
        cut = [(p := r.choice(pool))[r.randrange(0, 8) : len(p) - r.randrange(0, 8)] for _ in range(r.randrange(0, 4))]
        texts.append(letters(r.choice((0, 0, 3, 40))) + letters(r.randrange(0, 30)).join(cut) + letters(r.choice((0, 0, 2, 60))))
    texts += [texts[k][5:] + texts[k + 1] for k in range(0, 40, 2)]
    rows = list(enumerate(texts))
    data = [(i, t.encode()) for i, t in rows]
    seen, want = {}, {}
    for i, b in data:
        for j in range(len(b) - 49):
            seen.setdefault(b[j : j + 50], i)
    for i, b in data:
        gone = {x for j in range(len(b) - 49) if seen[b[j : j + 50]] < i for x in range(j, j + 50)}
        want[i] = (len(gone), sum(x - 1 not in gone for x in gone), hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in gone)).hexdigest())
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=False, **how).collect()
    assert sum(n for n, *_ in want.values()) > 3000 and {x["doc_id"]: (x["n_removed"], x["n_spans"], bytes(x["kept"]).decode()) for x in got} == want
