"""Operator 5, packing: documents' token ids into windows of 2048 by minimum bin slack.

Documents are tokenised once; whole windows are cut from their front, and one remainder is left of each. Remainders
are known by their length alone, of which there are at most 2047, so a histogram (bounded by the window, not by the
rows) goes to the driver. There a bitset subset-sum dynamic programme picks, again and again, the multiset of lengths
that fills a window closest to its capacity; backtracking gives the count of each length, and the pattern is used as
often as the counts last. Each pattern exhausts a length, so there are at most 2047 patterns. Rows get a rank
within their length, and the pattern's ranges of ranks say where each row goes.

Defined cases: a null or empty text is one id, the end mark; repeated rows are all packed, each on its own, in an order that doesn't matter; texts may be of any length; other columns don't matter, whatever their names; an empty table gives no rows; a text
that spells a special token is tokenised as the tokenizer itself does.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import gapless_rank, materialize
from .textbatch import BYTE, LOWER, SPACE, TextBatch, large, mixed, pieces, powers

WINDOW, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words whose ids a worker keeps; when there are more, the half that was met more often stays.
MOST_CACHED = 300_000
#: Words that go to the tokenizer at once, whose encodings are much larger than their ids.
MOST_ENCODED = 2_000
#: Places of the table that finds a word by its hash; a word has two.
PLACES = 1 << 20
#: What a byte is part of: a blank, a letter, a digit, another ASCII character, any other character.
BLANK, LETTER, DIGIT, OTHER, ODD = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[SPACE], KIND[0x30:0x3A], KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x80:] = BLANK, DIGIT, LETTER, LETTER, ODD
#: First byte of the letters from U+00C0 to U+00FF, and second bytes of the two that are signs.
LATIN, LATIN_SIGNS = 0xC3, (0x97, 0xB7)


class Ids:
    """Token ids of texts, word by word. Words are found and looked up for a whole batch at once, by their hashes.

    The tokenizer lower-cases, drops blanks, and splits what is between them into runs of letters, single digits, runs of other signs, and
    a few endings behind an apostrophe. Chunks of ASCII and of Latin letters up to U+00FF are split here by the same
    rule; a chunk with any other character is one unit, whose ids the tokenizer gives. A worker keeps the ids of units that it has met."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.is_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.is_end[ends] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys, self.entry = np.zeros(PLACES, np.uint64), np.full(PLACES, -1, np.int32)
        self.flat, self.used, self.entries = np.zeros(1 << 20, np.uint16 if len(self.is_end) < 1 << 16 else np.uint32), 0, 0
        self.hash, self.at, self.n, self.met = np.zeros(1 << 16, np.uint64), *(np.zeros(1 << 16, np.int32) for _ in range(3))

    @staticmethod
    def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h & np.uint64(PLACES - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(PLACES - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        one, two = self._places(h)
        found = np.where(self.keys[one] == h, self.entry[one], -1)
        rest = np.flatnonzero(found < 0)
        found[rest] = np.where(self.keys[two[rest]] == h[rest], self.entry[two[rest]], -1)
        return found

    def _place(self, h: np.ndarray, entries: np.ndarray) -> None:
        """Put entries into the table; where both places are taken one entry gives way, and is learned again if it is met."""
        for last, k in ((False, 0), (False, 1), (True, 0)):
            places = self._places(h)[k]
            free = np.flatnonzero((self.entry[places] < 0) | last)
            self.keys[places[free]], self.entry[places[free]] = h[free], entries[free]
            out = self.keys[places] != h
            h, entries = h[out], entries[out]

    def _add(self, h: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Entries whose ids lie one after the other in ``ids``, each up to its end."""
        i, m = self.entries, len(h)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while i + m > len(self.at):
            self.hash, self.at, self.n, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.hash, self.at, self.n, self.met))
        self.flat[self.used : self.used + len(ids)] = ids
        starts = np.append(0, ends[:-1]) if m else ends
        self.hash[i : i + m], self.at[i : i + m], self.n[i : i + m], self.met[i : i + m] = h, self.used + starts, ends - starts, 0
        self.used, self.entries = self.used + len(ids), i + m
        self._place(h, np.arange(i, i + m, dtype=np.int32))

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(self.met[: self.entries], kind="stable")[self.entries // 2 :])
        h, size = self.hash[keep], self.n[keep].astype(np.int64)
        ids, ends = self._gather(keep), np.cumsum(size)
        self.entry[:], self.keys[:], self.used, self.entries = -1, 0, 0, 0
        self._add(h, ids, ends)

    def _gather(self, entries: np.ndarray) -> np.ndarray:
        n = self.n[entries].astype(np.int64)
        return self.flat[np.repeat(self.at[entries] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def _learn(self, h: np.ndarray, units: list[bytes], whole: np.ndarray) -> None:
        """Words, each of which the tokenizer splits no further, go to it in one text; ``whole`` chunks one by one."""
        alone = np.flatnonzero(whole).tolist()
        words = np.flatnonzero(~whole)
        for some in (words[i : i + MOST_ENCODED] for i in range(0, len(words), MOST_ENCODED)):
            text = b" ".join([units[i] for i in some.tolist()]).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._add(h[some], ids, ends)
            else:
                alone += some.tolist()
        for some in (alone[i : i + MOST_ENCODED] for i in range(0, len(alone), MOST_ENCODED)):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i].decode("utf-8", "replace") for i in some], add_special_tokens=False)]
            self._add(h[some], np.array([x for e in found for x in e], np.uint32), np.cumsum([len(e) for e in found]))

    @staticmethod
    def _units(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, ends, whole) of units; ``whole`` are chunks that aren't split, all others are in lower case."""
        buf, kind = LOWER[batch.buf], KIND[batch.buf]
        latin = np.flatnonzero(buf[:-1] == LATIN)
        second = buf[latin + 1]
        buf[latin[(second <= 0x9E) & (second != LATIN_SIGNS[0])] + 1] += 0x20
        latin = latin[(second != LATIN_SIGNS[0]) & (second != LATIN_SIGNS[1])]
        kind[latin] = kind[latin + 1] = LETTER
        edge = np.ones(len(buf), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        # endings behind an apostrophe that stands alone
        p = np.flatnonzero((buf[:-1] == 0x27) & edge[:-1] & (kind[1:] == LETTER))
        a, b = buf[p + 1], buf[np.minimum(p + 2, len(buf) - 1)]
        size = np.where(np.isin(a, list(b"stmd")), 1, np.where((np.isin(a, list(b"rv")) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)), 2, 0))
        p, size = p[size > 0], size[size > 0]
        edge[p + 1] = False
        edge[p + 1 + size] = True
        solid = kind != BLANK
        in_odd = np.zeros(len(buf), bool)
        if (kind == ODD).any():
            begin = solid.copy()
            begin[1:] &= ~solid[:-1]
            at = np.flatnonzero(begin)
            in_odd[at[0] :] = np.repeat(np.logical_or.reduceat(kind == ODD, at), np.diff(np.append(at, len(buf))))
            edge &= ~(in_odd & solid & ~begin)
            buf[in_odd] = batch.buf[in_odd]
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(buf))
        some = solid[start]
        start, end = start[some], end[some]
        return buf, start, end, in_odd[start]

    def _exact(self, text: bytes) -> np.ndarray:
        """Ids of a text that spells a special token, from the tokenizer, chunk by chunk."""
        chunks = [c.decode() for c in text.split()]
        out = [np.array(e.ids, np.uint32) for i in range(0, len(chunks), MOST_ENCODED) for e in self.tokenizer.encode_batch_fast(chunks[i : i + MOST_ENCODED], add_special_tokens=False)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def of(self, batch: TextBatch) -> list[np.ndarray]:
        """Ids of each text; what isn't known of them is learned at once."""
        if self.entries > MOST_CACHED:
            self._shrink()
        buf, start, end, whole = self._units(batch) if len(batch.buf) else (batch.buf, *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool))
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * up[:-1], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * down[start])
        found = self._find(h)
        gap = np.flatnonzero(found < 0)
        if len(gap):
            new, first = np.unique(h[gap], return_index=True)
            i, raw = gap[first], buf.tobytes()
            base = self.entries
            units = [raw[a:b] for a, b in zip(start[i].tolist(), end[i].tolist())]
            self._learn(new, units, whole[i])
            # entries just learned, whether or not they have kept their place
            learned = self.hash[base : self.entries]
            order = np.argsort(learned)
            found[gap] = base + order[np.searchsorted(learned[order], h[gap])]
        self.met[: self.entries] += np.bincount(found, minlength=self.entries).astype(np.int32)
        ids = self._gather(found)
        cut = np.append(0, np.cumsum(self.n[found]))[np.searchsorted(start, np.append(batch.start, len(buf)))].tolist()
        out = [ids[a:b] for a, b in zip(cut[:-1], cut[1:])]
        raw = batch.buf.tobytes()
        if any(t in raw for t in self.special):
            for k in range(batch.n):
                if any(t in raw[batch.start[k] : batch.end[k]] for t in self.special):
                    out[k] = self._exact(batch.bytes(k))
        return out


_ids: dict[tuple[str, str], Ids] = {}


def _worker_ids(path: str, call: str) -> Ids:
    """A worker keeps what it has learned from one task of a call to the next, and nothing from other calls."""
    if (path, call) not in _ids:
        _ids.clear()
        pa.default_memory_pool().release_unused()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ids[path, call] = Ids(path)
    return _ids[path, call]


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: whole windows from the front, then the remainder."""
    call = uuid.uuid4().hex

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _worker_ids(path, call)
        for whole in batches:
            doc_ids, texts = whole.column("doc_id").to_pylist(), large(whole.column("text"))
            out: list[list] = [[] for _ in range(5)]
            for a, b in pieces(texts, 1 << 20):
                batch = TextBatch(texts.slice(a, b - a))
                for doc, found in zip(doc_ids[a:b], ids_of.of(batch)):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        for column, v in zip(out, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(cut, PIECES)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, with the largest one left in it, whose sum is closest to ``capacity``."""
    largest = max(counts)
    room, items = capacity - largest, []
    for size in sorted(counts, reverse=True):
        left, k = min(counts[size] - (size == largest), room // size), 1
        while left > 0:
            k = min(k, left)
            items.append((size, k))
            left -= k
            k *= 2
    mask, reached, sums = (1 << (room + 1)) - 1, [], 1
    for size, k in items:
        reached.append(sums)
        sums |= (sums << (size * k)) & mask
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {largest: 1}
    for (size, k), before in zip(reversed(items[: len(reached)]), reversed(reached)):
        if not before >> at & 1:
            at -= size * k
            chosen[size] = chosen.get(size, 0) + k
    return chosen


def patterns(counts: dict[int, int], capacity: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths with their counts, times used), until all are placed: minimum bin slack, a pattern used while it lasts."""
    left, out = {s: n for s, n in counts.items() if n}, []
    while left:
        chosen = fill(left, capacity)
        times = min(left[s] // k for s, k in chosen.items())
        out.append((chosen, times))
        for s, k in chosen.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut`` is read several times, so hand in a table."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``window`` rows
    ranges, used, sequence = [], dict.fromkeys(counts, 0), 0
    for chosen, times in patterns(counts, window):
        offset = 0
        for size, k in sorted(chosen.items(), reverse=True):
            ranges.append((size, used[size], used[size] + k * times, k, sequence, offset))
            used[size] += k * times
            offset += size * k
        sequence += times
    fields = ("_length", "_from", "_to", "_each", "_sequence", "_offset")
    schema = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    plan = F.broadcast(spark.createDataFrame(ranges, schema))  # at most 63 lengths in each of 2047 patterns
    ranked = gapless_rank(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank", sum(counts.values()))
    placed = ranked.join(plan, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    return placed.withColumns({"sequence_id": F.col("_sequence") + F.floor(nth / F.col("_each")), "offset": F.col("_offset") + F.pmod(nth, F.col("_each")) * F.col("length")}).drop("_rank", *fields)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(materialize(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))
