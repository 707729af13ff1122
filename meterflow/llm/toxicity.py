"""Operator 6, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Characters of the whole corpus are counted as trigrams (counts, bounded by the alphabet, are all that leaves the
executors). Words that tell toxic from other documents are learned from labelled rows outside the held-out fold.
Tokens with a letter and with anything that may disguise — a sign at any place, accents, a doubled letter — and letters
spaced out become lattices of what each sign may stand for; tokens without a letter are numbers or punctuation; a Viterbi search finds the likeliest reading under the character model, to which the learned words
were added. A document's score is a logistic regression on which learned words its restored text holds.

Only ``MOST_ROWS`` labelled rows (of least hash of doc_id, one a doc_id) are learned from, and ``MOST_WORDS`` words of 3 to 30 letters, or beginnings of 3 to 9, that tell
most; everything else covers all rows and whole texts of any length. Other columns are kept, whatever their names. Defined cases: a null or empty text scores the intercept; labels that are null aren't learned from; without both
labels every score is the share of label 1, or 0.5 without any; repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .quality import labelled_sample, remainder
from .shared import quoted
from .textbatch import LOWER, SPACE, TextBatch, large, pieces

MOST_ROWS, MOST_WORDS, LEAST_DOCS, LEAST_ODDS = 20_000, 1_500, 8, 3.0
#: Beginnings of words are learned as well as whole words, since words are inflected: their least and most letters.
LEAST_STEM, MOST_STEM = 3, 9
#: Letters of the model: 0 stands for what is between words.
LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = len(LETTERS) + 1
CODE = np.zeros(256, np.int64)
CODE[0x61:0x7B] = CODE[0x41:0x5B] = np.arange(1, N)
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "á": "a", "à": "a", "â": "a", "é": "e", "è": "e", "ê": "e", "í": "i", "ì": "i", "ó": "o", "ò": "o", "ö": "o", "ü": "u", "ú": "u", "ñ": "n", "ç": "c"}
#: Signs that may stand between letters without a meaning.
BETWEEN = set(".-_*~'`,^/\\:;|+=​­")
SIGN_COST, DROP_COST, REPEAT_COST, PLAIN_DROP_COST, EDGE_COST, BREAK_COST, GAP_COST = 0.7, 0.5, 0.3, 9.0, 2.0, 1.5, 0.5
#: Signs that at a token's edge may be punctuation.
EDGE = {c for c in SIGNS if not c.isalnum()}
WORD = np.zeros(256, bool)
WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
_letter = np.zeros(256, bool)
_letter[0x41:0x5B] = _letter[0x61:0x7B] = True
_sign = np.zeros(256, bool)
_sign[[ord(c) for c in {*SIGNS, *BETWEEN} if c < "\x80"]] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>-_*~`^/\\|+="]] = True
#: Longer tokens are decoded each time, so that memory is bounded.
MOST_KEPT = 160
#: Tokens with more characters that may be dropped are decoded without a look at the gate.
MOST_GATED = 6


def _classes() -> dict[str, str]:
    """Letters that a common sign may stand for share a class, named by its first letter."""
    of = {c: c for c in LETTERS}
    for several in SIGNS.values():
        low = min(of[c] for c in several)
        merged = {of[c] for c in several}
        of = {c: low if k in merged else k for c, k in of.items()}
    return of


CLASS = _classes()
#: For the gate: a letter is its class, a sign the capital of its class, since it may also be dropped; whatever else is a dash.
_GATE = {ord(c): k for c, k in CLASS.items()} | {ord(c): CLASS[several[0]].upper() for c, several in SIGNS.items()}


class _Gated(dict):
    def __missing__(self, c: int) -> str:
        return "-"


_GATED = _Gated(_GATE)


def gate(words: list[str]) -> re.Pattern:
    """Finds, in a token written in classes, places at which some reading may begin with a learned word or beginning.

    What it doesn't find in a token no reading holds: letters are read as they are or dropped as repetitions, signs are read or dropped,
    and a word of a reading begins where the token does or behind a character that isn't a letter."""
    trie: dict = {}
    for w in words:
        node = trie
        for k, _ in itertools.groupby(CLASS.get(c, "-") for c in w.rstrip("*")):
            node = node.setdefault(k, {})
        node[""] = {}

    def text(node: dict) -> str:
        if "" in node or not node:
            return ""
        return "(?:" + "|".join(f"[{k}{k.upper()}][{k}A-Z-]*{text(v)}" if k != "-" else f"-[A-Z-]*{text(v)}" for k, v in sorted(node.items())) + ")"

    return re.compile("(?:^|(?<=[A-Z-]))" + text(trie)) if trie else re.compile("(?!)")


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character of a token what it may stand for, with a cost: a letter, nothing, or a break between words."""
    out, last, core = [], "", [i for i, ch in enumerate(token) if ch.isalnum()]
    for i, ch in enumerate(token):
        reads: list[tuple[str, float]] = []
        if ch in " \n":  # between letters that stand alone: one blank, or a wider gap
            reads = [("", 0.0), (" ", GAP_COST)] if ch == " " else [("", GAP_COST), (" ", 0.0)]
        if ch in SIGNS:
            reads += [(c, SIGN_COST) for c in SIGNS[ch]]
        if ch in LETTERS:
            reads.append((ch, 0.0))
        if ch in " \n":
            ch = last
        elif ch in BETWEEN or ch == last:
            reads.append(("", REPEAT_COST if ch == last else DROP_COST))
            if ch in BETWEEN:
                reads.append((" ", BREAK_COST))
        elif ch in EDGE and not (core and core[0] < i < core[-1]):
            reads += [("", EDGE_COST), (" ", EDGE_COST)]
        elif ch in SIGNS:
            reads += [("", PLAIN_DROP_COST), (" ", PLAIN_DROP_COST)]
        elif ch not in LETTERS:
            reads += [("", PLAIN_DROP_COST / 3), (" ", PLAIN_DROP_COST / 4)]
        out.append(reads or [(" ", 1.0)])
        last = ch
    return out


class Model:
    """Trigram costs of the character model, and the learned words with their weights."""

    def __init__(self, counts: np.ndarray, words: list[str], weights: np.ndarray, base: float):
        boosted = counts.astype(float)
        whole = sorted({w.rstrip("*") for w in words})
        share = max(boosted.sum(), 1.0) / max(len(whole), 1)
        for w in whole:
            codes = [0, 0, *(CODE[ord(c)] if ord(c) < 256 else 0 for c in w), 0]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                boosted[a, b, c] += share
        smooth = boosted + 0.05 * N * boosted.sum(0, keepdims=True) / max(boosted.sum(), 1) + 0.01
        self.cost = -np.log(smooth / smooth.sum(2, keepdims=True))
        self.words, self.weights, self.base = words, weights, base
        self.index = {w: i for i, w in enumerate(words)}
        self.gate = gate(words)
        self.memory: dict[str, list[str]] = {}
        self.hits: dict[bytes, tuple[int, ...]] = {}

    def features(self, word: str) -> list[int]:
        """Learned words that a word is or begins with."""
        some = [word, *(word[:n] + "*" for n in range(LEAST_STEM, min(MOST_STEM, len(word)) + 1))]
        return [self.index[w] for w in some if w in self.index]

    def hidden(self, raw: bytes) -> tuple[int, ...]:
        """Learned words in the likeliest reading of a token that holds a sign or a doubled letter, and a letter."""
        found = self.hits.get(raw)
        if found is None:
            token, found = raw.decode("utf-8", "replace").lower(), ()
            if self._open(token) and any(c.isalpha() for c in token) and any(c in SIGNS or c in BETWEEN or c in " \n" or c == d for c, d in zip(token, token[1:] + "\0")):
                found = tuple({i for w in self._viterbi(token).split() for i in self.features(w)})
            if len(self.hits) > 200_000:
                self.hits.clear()
            if len(raw) <= MOST_KEPT:
                self.hits[raw] = found
        return found

    def _open(self, token: str) -> bool:
        """Whether a reading of the token may hold a learned word. Letters spaced out, and tokens of many signs, always may."""
        if " " in token or "\n" in token:
            return True
        read = token.translate(_GATED)
        return sum(c < "a" for c in read) > MOST_GATED or self.gate.search(read) is not None

    def restore(self, token: str) -> list[str]:
        """Words of the likeliest reading of a token."""
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            found = self.memory[token] = [w for w in self._viterbi(token).split(" ") if w]
        return found

    def _viterbi(self, token: str) -> str:
        # a state holds its cost and a chain of letters back to the beginning, so that long tokens cost in proportion
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for reads in lattice(token):
            now: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, text) in states.items():
                for c, extra in reads:
                    if c == "":
                        key, new, out = (a, b), cost + extra, text
                    else:
                        k = LETTERS.find(c) + 1
                        key, new, out = (b, k) if k else (0, 0), cost + extra + self.cost[a, b, k], (text, c)
                    if key not in now or new < now[key][0]:
                        now[key] = (new, out)
            states = now
        text, out = min(((cost + self.cost[a, b, 0], text) for (a, b), (cost, text) in states.items()), key=lambda x: x[0])[1], []
        while text:
            text, c = text
            out.append(c)
        return "".join(reversed(out))


def _suspects(batch: TextBatch) -> list[tuple[int, bytes]]:
    """(text, token) of tokens that may be disguised; letters that stand alone in a row are one token."""
    batch.words(~SPACE)
    ws, we, doc = batch.ws, batch.we, batch.doc
    if not len(ws):
        return []
    buf = LOWER[batch.buf]
    raw = buf.tobytes()
    letter, sign = _letter[buf], _sign[buf]
    marked = sign | (buf >= 0x80)
    marked[1:] |= (buf[1:] == buf[:-1]) & letter[1:]
    at = np.flatnonzero(np.logical_or.reduceat(letter | (buf >= 0x80), ws) & np.logical_or.reduceat(marked, ws))
    out = [(d, raw[i:j]) for d, i, j in zip(doc[at].tolist(), ws[at].tolist(), we[at].tolist())]
    # a letter that stands alone may have punctuation beside it
    starts = (buf < 0x80) | (buf >= 0xC0)
    signs, marks = starts & ~_mark[buf], np.add.reduceat(starts, ws)
    single = (np.add.reduceat(signs, ws) == 1) & (marks <= 3) | (marks == 1) & sign[ws]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], single.astype(np.int8), [0]))))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        for d, run in itertools.groupby(range(a, b), key=lambda i: doc[i]):
            run = list(run)
            if len(run) >= 3:
                gaps = [b"", *(b" " if ws[j] - we[i] == 1 else b"\n" for i, j in zip(run, run[1:]))]
                out.append((int(d), b"".join(gap + raw[ws[i] : we[i]] for gap, i in zip(gaps, run))))
    return out


class Lookup:
    """Which learned words a batch of texts holds, as pairs (text, word). Whole words and beginnings of the same bytes share a hash."""

    def __init__(self, model: Model):
        self.model = model
        self.by_size: dict[int | None, tuple] = {}
        groups: dict[int | None, list[int]] = {}
        for i, w in enumerate(model.words):
            groups.setdefault(len(w[:-1].encode()) if w[-1] == "*" else None, []).append(i)
        for size, ids in groups.items():
            batch = TextBatch(large(pa.array([model.words[i].rstrip("*") for i in ids], pa.large_string())))
            batch.words(WORD)
            h = batch.word_hashes()[batch.first]
            order = np.argsort(h)
            seen = np.zeros(1 << 16, bool)
            seen[(h >> np.uint64(48)).astype(np.int64)] = True
            self.by_size[size] = (h[order], np.array(ids)[order], seen)

    def of(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        if not self.model.words:
            return none, none
        batch.words(WORD)
        docs, words, whole = [none], [none], batch.we
        for size, (keys, ids, seen) in self.by_size.items():
            some = np.arange(len(whole)) if size is None else np.flatnonzero(whole - batch.ws >= size)
            batch.we = whole if size is None else np.minimum(batch.ws + size, whole)
            h = batch.word_hashes()[some]
            at = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
            where = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            ok = keys[where] == h[at]
            docs.append(batch.doc[some[at[ok]]])
            words.append(ids[where[ok]])
        batch.we = whole
        more = [(d, i) for d, token in _suspects(batch) for i in self.model.hidden(token)]
        if more:
            docs.append(np.array([d for d, _ in more]))
            words.append(np.array([i for _, i in more]))
        pair = np.unique(np.concatenate(docs).astype(np.int64) * len(self.model.words) + np.concatenate(words))
        return pair // len(self.model.words), pair % len(self.model.words)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigrams of all texts: N**3 sums at most, whatever the number of rows."""

    def run(batches):
        total = np.zeros(N**3, np.int64)
        for whole in batches:
            texts = large(whole.column("text"))
            for a, b in pieces(texts):
                c = CODE[TextBatch(texts.slice(a, b - a)).buf]
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3) if len(c) > 2 else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["k", "n"])

    out = np.zeros(N**3, np.int64)
    for k, n in docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out.reshape(N, N, N)


def telling_words(sample: DataFrame, most_words: int) -> list[str]:
    """Words of plain letters, and their beginnings (with a star), whose share among documents of label 1 exceeds that of the others by odds of e**LEAST_ODDS."""
    total = sample.agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("one"), F.count(F.lit(1)).alias("all")).first()
    one, other = total["one"] or 0, (total["all"] or 0) - (total["one"] or 0)
    plain = F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z\\x{80}-\\x{10FFFF}]+", " "), " ")
    once = F.filter(F.array_distinct(plain), lambda w: F.length(w).between(3, 30))
    stems = F.flatten(F.transform("once", lambda w: F.transform(F.sequence(F.lit(LEAST_STEM), F.greatest(F.lit(LEAST_STEM), F.least(F.lit(MOST_STEM), F.length(w)))), lambda n: F.concat(F.substring(w, F.lit(1), n), F.lit("*")))))
    # Copies, rows with the same set of words, count singly for the odds, but once for a word's rank.
    sets = sample.select("label", F.array_sort(once).alias("once")).groupBy("label", "once").agg(F.count(F.lit(1)).alias("copies"))
    words = sets.select("label", "copies", F.explode(F.array_distinct(F.concat("once", stems))).alias("word"))
    toxic = F.col("label") == 1
    words = words.groupBy("word").agg(F.sum(F.when(toxic, F.col("copies")).otherwise(0)).alias("a"), F.sum("copies").alias("n"), F.sum(F.when(toxic, 1).otherwise(0)).alias("sets"))
    odds = F.log((F.col("a") + 0.5) / (one + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (other + 1.0))
    found = words.where((F.col("a") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).orderBy((odds * F.sqrt("sets")).desc(), "word").limit(most_words)
    return [r["word"] for r in found.select("word").collect()]


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_words: int = MOST_WORDS) -> Model:
    """The model, learned from ``labels(doc_id, toxic)`` and all texts of ``docs``."""
    sample = labelled_sample(docs, labels, "toxic", most_rows).persist()
    words = telling_words(sample, most_words)
    counts = character_counts(docs)
    model = Model(counts, words, np.zeros(len(words)), 0.0)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        look = Lookup(held.value)
        for whole in batches:
            texts, label = large(whole.column("text")), whole.column("label")
            for a, b in pieces(texts):
                doc, word = look.of(TextBatch(texts.slice(a, b - a)))
                lists = [[] for _ in range(b - a)]
                for d, w in zip(doc.tolist(), word.tolist()):
                    lists[d].append(w)
                yield pa.RecordBatch.from_arrays([label.slice(a, b - a), pa.array(lists, pa.list_(pa.int32()))], names=["label", "words"])

    rows = sample.select("text", "label").mapInArrow(run, "label int, words array<int>").groupBy("label", "words").agg(F.count(F.lit(1)).alias("n")).orderBy("label", "words").toPandas()  # most_rows at most
    sample.unpersist()
    y, n = rows["label"].to_numpy(float), rows["n"].to_numpy(float)
    if not len(rows) or len(set(y)) < 2:
        rate = float((y * n).sum() / n.sum()) if len(rows) else 0.5
        model.base = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        return model
    x = np.zeros((len(rows), len(words)), np.float32)
    for i, found in enumerate(rows["words"]):
        x[i, list(found)] = 1
    one, seen, all_one = x.T @ (n * y), x.T @ n, (n * y).sum()
    odds = np.log((one + 0.5) / (all_one + 1)) - np.log((seen - one + 0.5) / (n.sum() - all_one + 1))
    # Words are chosen one by one: the one that tells most toxic documents, weighed by its odds; a document counts less
    # with each chosen word that it holds, so what merely stands beside insults, in copies of few documents, adds little.
    # Of words that tell alike the whole and longer ones go first.
    # Documents with the same words, as copies are, count little more than one.
    chosen, open_, own = [], (1 + np.log(n)) * y, odds
    odds = odds * np.array([(1.3 if w[-1] != "*" else 1.0) * (1 + 0.02 * len(w)) for w in words])
    while len(chosen) < len(words):
        more = x.T @ open_
        k = int((more * odds).argmax())
        if odds[k] <= 0 or more[k] < LEAST_DOCS / 2:
            break
        chosen.append(k)
        open_ = open_ * (1 - 0.6 * x[:, k])
        odds = np.where(np.arange(len(words)) == k, -1, odds)
    x, w, base = x[:, chosen], np.maximum(0, own[chosen]), float(np.log(all_one / (n.sum() - all_one)))
    prior, scale = w.copy(), 0.3 / (seen[chosen] * 0.1 + 0.5)
    for _ in range(400):  # ascent with a small ridge towards a word's own odds, weights not below zero
        p = 1 / (1 + np.exp(-(x @ w + base)))
        g = n * (y - p)
        w = np.maximum(0, w + scale * (x.T @ g - 0.2 * (w - prior)))
        base += 0.5 * g.sum() / (n.sum() * 0.1)
    return Model(counts, [words[k] for k in chosen], w, base)


def with_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity_score (0 to 1); other columns are kept."""
    model.memory.clear()
    model.hits.clear()
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "toxicity_score"]

    def run(batches):
        look = Lookup(held.value)
        for whole in batches:
            texts, scores = large(whole.column("text")), []
            for a, b in pieces(texts):
                doc, word = look.of(TextBatch(texts.slice(a, b - a)))
                z = np.full(b - a, held.value.base)
                np.add.at(z, doc, held.value.weights[word])
                scores.append(1 / (1 + np.exp(-z)))
            yield pa.RecordBatch.from_arrays([*[whole.column(c) for c in keep], pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*keep, "toxicity_score"])

    fields = [f for f in docs.schema.fields if f.name != "toxicity_score"]
    return docs.select(*quoted(keep)).mapInArrow(run, StructType([*fields, StructField("toxicity_score", DoubleType())]))


FOLDS, HELD_OUT, LEAST_SCORE = 3, 1, 0.7


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    scored = with_toxicity(docs, train(docs, labels))
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= LEAST_SCORE).cast("int").alias("predicted"))
