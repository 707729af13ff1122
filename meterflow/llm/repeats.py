"""Operator 2, suffix-array dedup: bytes covered by a 50-byte string that also starts in a document of smaller doc_id go.

A suffix array of everything in one place can't be spread, so strings are dealt to shards by what they hold:

* Documents lie in groups by ranges of doc_id, cut where their bytes add up to a group's. Within a text, consecutive
  50-byte strings with the same least 20-byte hash form a segment; equal strings always meet under equal least hashes.
* Groups send (least hash, segment hash, 16 bits each for what lies left and right of the least hash) to shards, once a group.
  A shard answers, for each: nothing (it can't share a string with another document), seen (a smaller range has the whole
  segment), or wanted (it may share strings with others). Only wanted segments are sent as bytes, once a group.
* A string of 50 bytes holds its least 20 with 15 bytes before or with 15 bytes after them, so segments that share one agree in the
  20-byte hash 15 bytes to the left or to the right, as far as they reach. Most segments that only share a phrase don't.
* A shard sorts the suffixes of its segments by induced sorting, computes permuted common prefixes, and finds the
  smallest owner of each 50-byte string. Ranges go back to the groups, which cut them out of the texts.

Skew: a doc_id (or null) with more bytes than a group holds is dealt to several groups of one range, which don't see each
other's bytes. A least hash that many different segments share would gather them in one shard: such hashes are looked for in a sample
of ``SAMPLE_BYTES`` of text; their segments are dealt by their own hashes and sent as single 50-byte strings, each string
once a group. The sample decides where things meet, never what is found: results are the same without it. Groups and
shards grow with the root of the input up to a bound, so that rows between them stay as few as the blocks of a shuffle.

Bytes are judged on the input. Hashes choose what is compared, but for "seen", which rests on 96 bits of two independent hashes of
the segment besides 30 of its least hash: among 10**13 segments the odds of one clash are about 10**-12.

Defined cases: a null text is empty; texts below 50 bytes lose nothing; texts have at most 2**31 bytes, as in Spark; rows of one
doc_id don't remove each other's bytes; rows with a null doc_id count as the largest; repeated rows get equal results; a carried
column that bears a name of the result gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, remove_tables, runs
from .suffixarray import repeated
from .textbatch import BYTE, STEP, TextBatch, large, mixed, offsets, pieces, powers

WIDTH, LEAST = 50, 20
#: Bytes by which a string reaches beyond its least part on one side or the other.
BESIDE = (WIDTH - LEAST) // 2
#: Bytes of text in a group and entries in a shard, for small and for large inputs; bytes that are sorted at once.
GROUP_BYTES, SHARD_ENTRIES, SORT_BYTES = (6 << 20, 32 << 20), (1_000_000, 3_000_000), 3 << 18
#: Input at which a group and a shard begin to grow.
SMALL_BYTES = 850 << 20
#: Different segments of one least hash beyond which they are sent as single strings; bytes of text in which such hashes are looked for.
MOST_SEGMENTS, SAMPLE_BYTES = 4_000, 16 << 20
#: A longer text is hashed in parts; bytes of text that are hashed at once, so that arrays stay in a core's cache.
PART_BYTES, PIECE_BYTES = 2 << 20, 1 << 17
LAST = (1 << 63) - 1
#: Byte values of a second hash.
OTHER = mixed(BYTE * STEP)


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(parts, row, first byte): texts longer than ``PART_BYTES`` in parts, in which each string of ``WIDTH`` bytes is there once."""
    size = np.diff(offsets(texts))
    if not len(size) or size.max() <= PART_BYTES:
        return texts, np.arange(len(size)), np.zeros(len(size), np.int64)
    out, row, first = [], [], []
    for i, n in enumerate(size.tolist()):
        whole = texts[i].as_buffer().to_pybytes() if n else b""
        for a in range(0, max(n - WIDTH + 1, 1), PART_BYTES - WIDTH):
            out.append(whole[a : a + PART_BYTES - 1])
            row.append(i)
            first.append(a)
    return pa.array(out, pa.large_binary()), np.array(row), np.array(first)


def in_order(ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Rows of a group by doc_id and text, however they came."""
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].as_buffer().to_pybytes() if texts[i].as_buffer() else b"")), np.int64)


def _short(h: np.ndarray) -> np.ndarray:
    """1 to 65535 from a hash; 0 stands for a segment that doesn't reach so far."""
    return (h % np.uint64(65535)).astype("<u2") + np.uint16(1)


#: No segments: row, first byte, size, least hash, short hashes left and right of it, two hashes of the whole.
NONE = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) + (np.zeros(0, "<u2"),) * 2 + (np.zeros(0, np.uint64),) * 2


def _each(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, … of each range of ``size``, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Segments:
    """Segments of a group's texts. ``rows``: order of the group's rows by doc_id and text; segments name a row by it."""

    def __init__(self, table: pa.Table, shards: int, hot: np.ndarray):
        ids = table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False)
        texts = large(table.column("text"))
        self.rows = in_order(ids, texts)
        self.ids, self.texts = ids[self.rows], texts.take(pa.array(self.rows))
        parts, of, base = _parts(self.texts)
        found = [self._of(parts.slice(a, b - a), of[a:b], base[a:b]) for a, b in pieces(parts, PIECE_BYTES)] or [NONE]
        row, start, size, least, left, right, content, check = (np.concatenate(x) for x in zip(*found))
        is_hot = np.isin(least, hot) if len(hot) else np.zeros(len(least), bool)
        shard = (np.where(is_hot, mixed(content * STEP), least >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        lead = (least & np.uint64(0x3FFFFFFF)).astype(np.uint32)
        # entries of equal content and different check may lie mixed: they are wanted then, and told apart by their bytes
        order = np.lexsort((content, shard << 32 | lead))  # stable: equal ones stay in order of row and start
        self.row, self.start, self.size, self.shard, self.lead, self.left, self.right, self.content, self.check, self.hot = (x[order] for x in (row, start, size, shard, lead, left, right, content, check, is_hot))
        self.by_least = least[order].view(np.int64)
        #: Entries: runs of equal shard, lead and content; the first occurrence is in the smallest document.
        start_of = np.ones(len(order), bool)
        start_of[1:] = (self.shard[1:] != self.shard[:-1]) | (self.lead[1:] != self.lead[:-1])
        new = start_of.copy()
        new[1:] |= (self.content[1:] != self.content[:-1]) | (self.check[1:] != self.check[:-1])
        self.entry = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        doc = self.ids[self.row]
        self.owner = doc[self.entry]
        self.is_owner = doc == self.owner[self.of] if len(order) else new
        # whether documents of the group share a least hash
        at = np.flatnonzero(start_of)
        several = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at) if len(at) else np.zeros(0, bool)
        self.several = several[(np.cumsum(start_of) - 1)[self.entry]] if len(at) else several

    @staticmethod
    def _of(parts: pa.Array, rows: np.ndarray, base: np.ndarray):
        batch = TextBatch(parts)
        buf = batch.buf
        n = len(buf) - LEAST + 1
        if n < WIDTH - LEAST + 1:
            return NONE
        up, down = powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(BYTE[buf] * up[:-1], out=sums[1:])
        h = mixed((sums[LEAST:] - sums[:-LEAST]) * down[:n])
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)  # pieces have fewer than 2**24 bytes
        reach, want = 1, WIDTH - LEAST + 1
        while 2 * reach <= want:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < want:
            least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        long = np.flatnonzero(batch.size >= WIDTH)
        if not len(long):
            return NONE
        first, stop = batch.start[long], batch.end[long] - WIDTH + 1  # string positions of each text
        inside = np.zeros(len(at) + 1, np.int8)
        inside[first] += 1
        inside[stop] -= 1
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        new[first] = True
        new &= np.cumsum(inside[:-1]).astype(bool)
        s = np.flatnonzero(new)
        doc = np.searchsorted(first, s, "right") - 1
        e = np.minimum(np.append(s[1:], stop[-1]), stop[doc]) + WIDTH - 1
        content = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * STEP)
        np.cumsum(OTHER[buf] * up[:-1], out=sums[1:])
        check = mixed((sums[e] - sums[s]) * down[s]) >> np.uint64(32)
        part, p = long[doc], at[s]
        left = np.where(p - BESIDE >= s, _short(h[np.maximum(p - BESIDE, 0)]), np.uint16(0))
        right = np.where(p + BESIDE + LEAST <= e, _short(h[np.minimum(p + BESIDE, n - 1)]), np.uint16(0))
        return rows[part], base[part] + s - first[doc], e - s, h[p], left, right, content, check

    def buffer(self) -> np.ndarray:
        data = self.texts.buffers()[2]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def lies(self, i: np.ndarray) -> np.ndarray:
        """First bytes of segments in :meth:`buffer`."""
        return offsets(self.texts)[self.row[i]] + self.start[i]

    def by_shard(self):
        cut = np.flatnonzero(np.diff(self.shard[self.entry])) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(self.entry)]):
            if b > a:
                yield int(self.shard[self.entry[a]]), a, b


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(np.frombuffer(data, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _send(shards: int, hot: Broadcast):
    def run(key, table):
        seg = Segments(table, shards, hot.value)
        gid, order, rows = key[0].as_py(), table.column("range")[0].as_py(), []
        for s, a, b in seg.by_shard():
            at = seg.entry[a:b]
            flags = seg.several[a:b].astype(np.uint32) | seg.hot[at].astype(np.uint32) << np.uint32(1)
            rows.append((s, gid, order, _pack(seg.lead[at] << np.uint32(2) | flags, seg.content[at], seg.check[at].astype("<u4"), seg.left[at], seg.right[at])))
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("shard", "gid", "range", "entries"), zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

    return run


def _several(key: np.ndarray) -> np.ndarray:
    """Whether a key is there more than once."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    out = np.empty(len(key), bool)
    out[order] = ~(new & np.append(new[1:], True)[: len(key)])
    return out


def _answer(most_segments: int):
    """Codes for a shard's entries: 0 nothing, 1 seen in a smaller range, 2 wanted, 3 wanted as single strings."""

    def run(key, table):
        rows = sorted(zip(table.column("range").to_pylist(), table.column("gid").to_pylist(), table.column("entries").to_pylist()))
        each, *others = zip(*(_unpack(e, "<u4", "<u8", "<u4", "<u2", "<u2") for *_, e in rows))
        sent, content, check, left, right = (np.concatenate(x) for x in (each, *others))
        place = np.repeat(np.array([r for r, *_ in rows]), [len(e) for e in each])
        order = np.lexsort((place, content, sent >> np.uint32(2)))
        flags, lead, content, check, place = sent[order] & np.uint32(3), sent[order] >> np.uint32(2), content[order], check[order], place[order]
        new = np.ones(len(lead), bool)
        new[1:] = lead[1:] != lead[:-1]
        first = new.copy()
        first[1:] |= (content[1:] != content[:-1]) | (check[1:] != check[:-1])
        again = place > place[np.flatnonzero(first)][np.cumsum(first) - 1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        hot = np.logical_or.reduceat(flags & np.uint32(2) > 0, at)
        shared = hot | np.logical_or.reduceat(flags & np.uint32(1) > 0, at) | (np.minimum.reduceat(place, at) < np.maximum.reduceat(place, at))
        different = np.add.reduceat(first.astype(np.int64), at)
        # different segments that agree with another one beside the least hash; those of a hot one are in several shards
        one = np.flatnonzero(first)
        some = np.flatnonzero((shared & ~hot & (different >= 2))[group[one]])
        linked = np.zeros(len(one), bool)
        for side in (left, right):
            beside = side[order[one[some]]]
            linked[some] |= _several(group[one[some]] << 16 | beside) & (beside > 0)
        kind = np.where(hot[group], 3, np.where(linked[np.cumsum(first) - 1], np.where(different > most_segments, 3, 2)[group], 0))
        answer = np.empty(len(lead), np.uint8)
        answer[order] = np.where(shared[group], np.where(again, 1, kind), 0)
        cut = np.cumsum([0] + [len(e) for e in each])
        packed = [zlib.compress(answer[a:b].tobytes(), 1) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"gid": pa.array([r[1] for r in rows], pa.int64()), "shard": pa.array([key[0].as_py()] * len(rows), pa.int64()), "codes": pa.array(packed, pa.binary())})

    return run


def _strings(seg: Segments, buffer: np.ndarray, entries: np.ndarray, own: np.ndarray, shards: int):
    """Single strings of entries, once for equal bytes and owner: (shard, least hash, owner, place, size), then (number, row) and first byte of all places where they lie."""
    first = seg.entry[entries]
    n = seg.size[first] - WIDTH + 1
    of, shift = np.repeat(np.arange(len(entries)), n), _each(np.zeros(len(n), np.int64), n)
    place, owner = seg.lies(first)[of] + shift, seg.owner[entries][of]
    wide = np.concatenate((buffer[place[:, None] + np.arange(WIDTH)], owner.astype("<i8").view(np.uint8).reshape(-1, 8)), 1)
    _, at, number = np.unique(np.ascontiguousarray(wide).view(f"V{WIDTH + 8}").ravel(), return_index=True, return_inverse=True)
    hashes = np.array([int.from_bytes(hashlib.blake2b(wide[i, :WIDTH], digest_size=8).digest(), "little") for i in at.tolist()], np.uint64)
    sent = ((hashes % np.uint64(shards)).astype(np.int64), np.uint64(1 << 40) | hashes >> np.uint64(32), owner[at], place[at], np.full(len(at), WIDTH))
    # the segments of each entry that its owner has, for each of its strings
    mine = np.flatnonzero(own)
    low, high = np.searchsorted(mine, first), np.searchsorted(mine, np.append(seg.entry[1:], len(own))[entries])
    copies = (high - low)[of]
    where, k = mine[_each(low[of], copies)], np.repeat(np.arange(len(of)), copies)
    by = np.argsort(number[k], kind="stable")
    return sent, (number[k][by], seg.row[where][by]), (seg.start[where] + shift[k])[by]


def _ask(shards: int, hot: Broadcast):
    """A group's own table (its ranges that go, and where its wanted segments lie), which is passed on to it, and the bytes of wanted segments by shard."""

    def run(key, left, right):
        gid = key[0].as_py()
        if not left.num_rows:
            return pa.table({"shard": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "own": pa.array([], pa.bool_()), "load": pa.array([], pa.binary())})
        seg = Segments(left, shards, hot.value)
        codes = dict(zip(right.column("shard").to_pylist(), right.column("codes").to_pylist()))
        answer = np.zeros(len(seg.entry), np.uint8)
        for s, a, b in seg.by_shard():
            answer[a:b] = np.frombuffer(zlib.decompress(codes[s]), np.uint8)
        gone = np.flatnonzero((answer[seg.of] == 1) | ~seg.is_owner) if len(seg.of) else np.zeros(0, np.int64)
        gone = gone[np.argsort(seg.row[gone] << 32 | seg.start[gone])]
        row, start, end = seg.row[gone], seg.start[gone], (seg.start + seg.size)[gone]
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] > end[:-1]))[: len(gone)])  # ends are in order as starts are
        row, start, end = row[new], start[new], end[np.append(new[1:], len(gone))[: len(new)] - 1]
        buffer, whole, own = seg.buffer(), np.flatnonzero(answer == 2), seg.is_owner & (answer[seg.of] >= 2)
        first = seg.entry[whole]
        # wanted segments, and the first of single strings that are equal in bytes and owner: shard, least hash, owner, place in the buffer, size
        parts, lies_of, lies_at = _strings(seg, buffer, np.flatnonzero(answer == 3), own, shards)
        sent = [np.concatenate(x) for x in zip((seg.shard[first], seg.lead[first].astype(np.uint64), seg.owner[whole], seg.lies(first), seg.size[first]), parts)]
        mine = np.flatnonzero(own & (answer[seg.of] == 2))
        times = np.concatenate((np.add.reduceat(own.astype(np.int64), seg.entry)[whole] if len(whole) else whole, np.bincount(lies_of[0], minlength=len(parts[0]))))
        lies = np.concatenate((seg.row[mine], lies_of[1])), np.concatenate((seg.start[mine], lies_at))
        out = [(gid % shards, gid, True, zlib.compress(_pack(*(x.astype("<i4") for x in (row, start, end, times, *lies))), 1))]
        order = np.argsort(sent[0], kind="stable")
        shard, lead, owner, place, size = (x[order] for x in sent)
        for a, b in zip(*runs(shard)):
            text = buffer[_each(place[a:b], size[a:b])]
            out.append((int(shard[a]), gid, False, zlib.compress(_pack(lead[a:b].astype("<u8"), owner[a:b].astype("<i8"), size[a:b].astype("<i4"), order[a:b].astype("<i4"), text), 1)))
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("shard", "gid", "own", "load"), zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.binary()))})

    return run


def _sort(key, table):
    """Ranges found in a shard by suffix arrays over its wanted segments, back to their groups; groups' own tables pass."""
    gids, own, loads = (table.column(c).to_pylist() for c in ("gid", "own", "load"))
    out = [(g, True, x) for g, o, x in zip(gids, own, loads) if o]
    lead, owner, data, back, number = [], [], [], [], []
    for g, o, x in zip(gids, own, loads):
        if not o:
            a, b, size, k, text = _unpack(zlib.decompress(x), "<u8", "<i8", "<i4", "<i4", "u1")
            cut = np.cumsum(np.append(0, size))
            whole = text.tobytes()
            lead.append(a)
            owner.append(b)
            back += [g] * len(a)
            data += [whole[i:j] for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())]
            number += k.tolist()
    if data:
        lead, owner = np.concatenate(lead), np.concatenate(owner)
        order = np.argsort(lead, kind="stable")
        size = np.cumsum(np.array([len(x) + 1 for x in data])[order])
        new = np.flatnonzero(np.append(True, lead[order][1:] != lead[order][:-1]))
        found: dict[int, list] = {}
        a = 0
        while a < len(order):
            base = size[a - 1] if a else 0
            k = int(np.searchsorted(size, base + SORT_BYTES))
            b = int(new[np.searchsorted(new, k, "right") - 1]) if k < len(order) else len(order)
            if b <= a:
                b = int(new[np.searchsorted(new, a, "right")]) if np.searchsorted(new, a, "right") < len(new) else len(order)
            some = order[a:b]
            for i, ranges in zip(some.tolist(), repeated([data[i] for i in some.tolist()], owner[some], WIDTH)):
                found.setdefault(back[i], []).extend((number[i], x, y) for x, y in ranges)
            a = b
        out += [(g, False, _pack(*(np.array(c, "<i4") for c in zip(*f)))) for g, f in found.items() if f]
    return pa.table({c: pa.array(v, t) for c, v, t in zip(("gid", "own", "ranges"), zip(*out) if out else ((),) * 3, (pa.int64(), pa.bool_(), pa.binary()))})


def _ranges(own: list[bool], loads: list[bytes]) -> list[np.ndarray]:
    """(row, first byte, end) of what goes of a group, by row and first byte."""
    row, start, end, times, at_row, at = _unpack(zlib.decompress(next(x for o, x in zip(own, loads) if o)), *("<i4",) * 6)
    replies = [np.concatenate(x) for x in zip(*(_unpack(x, *("<i4",) * 3) for o, x in zip(own, loads) if not o))]
    if replies:
        number, x, y = replies
        n = times[number].astype(np.int64)
        lies = _each((np.cumsum(times, dtype=np.int64) - times)[number], n)
        row, start, end = np.concatenate((row, at_row[lies])), np.concatenate((start, at[lies] + np.repeat(x, n))), np.concatenate((end, at[lies] + np.repeat(y, n)))
    by = np.lexsort((start, row))
    return [row[by], start[by], end[by]]


RESULT = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType()))])


def _cut(keep_text: bool, carried: list[str]):
    def run(key, left, right):
        seg_ids = left.column("doc_id").combine_chunks()
        texts = large(left.column("text"))
        order = in_order(seg_ids.fill_null(LAST).to_numpy(zero_copy_only=False), texts).tolist()
        out: list[list] = [[] for _ in range(6)]
        row, start, end = _ranges(right.column("own").to_pylist(), right.column("ranges").to_pylist()) if order else [np.zeros(0, np.int32)] * 3
        cut = np.searchsorted(row, np.arange(len(order) + 1))
        for k, i in enumerate(order):
            data = texts[i].as_buffer().to_pybytes() if texts[i].as_buffer() else b""
            at, removed, spans, kept = 0, 0, 0, []
            s, e = start[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]]
            if len(s):
                e = np.maximum.accumulate(e)
                new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                for a, b in zip(s[new].tolist(), e[np.append(new[1:] - 1, len(e) - 1)].tolist()):
                    kept.append(data[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            kept.append(data[at:])
            rest = b"".join(kept)
            for column, v in zip(out, (seg_ids[i].as_py(), rest.decode("utf-8", "ignore") if keep_text else None, len(data), removed, spans, rest if not keep_text else None)):
                column.append(v)
        if not keep_text:
            out[5] = [hashlib.sha256(x).hexdigest().encode() for x in out[5]]
        result = {c: pa.array(v, t) for c, v, t in zip(RESULT.names, out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))}
        return pa.table(result | {c: left.column(c).take(pa.array(order, pa.int64())) for c in carried})

    return run


def group_ranges(docs: DataFrame, group_bytes: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(first doc_id of each range, groups that it is dealt to): ranges of about ``group_bytes``; a doc_id with more is a range of its own.

    Two numbers for each ``group_bytes`` of text come to the driver."""
    sizes = docs.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("id")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("b"))
    spread = materialize(sizes.repartitionByRange(max(1, -(-total // (16 * group_bytes))), "id").select("id", "b", F.spark_partition_id().alias("p")), "sizes")
    before = F.coalesce(F.sum("b").over(Window.partitionBy("p").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = spread.withColumn("k", F.floor(before / group_bytes)).groupBy("p", "k").agg(F.min("id").alias("id")).select("id", F.lit(1).cast("long").alias("n"))
    heavy = spread.where(F.col("b") > group_bytes).select("id", F.ceil(F.col("b") / group_bytes).alias("n"))
    rows = starts.unionByName(heavy).collect()
    remove_tables(spread)
    several = {r["id"]: r["n"] for r in rows if r["n"] > 1}
    bounds = sorted({r["id"] for r in rows} | {i + 1 for i in several if i < LAST})
    return np.array(bounds, np.int64), np.array([several.get(i, 1) for i in bounds], np.int64)


def hot_leads(docs: DataFrame, total: int, most_segments: int, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Least hashes that, by a sample of documents, more than ``most_segments`` different segments share."""
    share = min(1.0, sample_bytes / max(total, 1))
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def segments(batches):
        for batch in batches:
            seg = Segments(pa.Table.from_batches([batch]), 1, np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(seg.by_least), pa.array(seg.content.view(np.int64))], names=["least", "content"])

    counts = some.select("doc_id", "text").mapInArrow(segments, "least long, content long").distinct().groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    return np.array([r["least"] for r in counts.where(F.col("n") > max(8, most_segments * share)).select("least").collect()], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, keep_text: bool = True, carry: tuple[str, ...] = (), group_bytes: int | None = None, shard_entries: int | None = None, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, text (what is left, if ``keep_text``: bytes that a cut
    took from a letter are left out), n_bytes, n_removed, n_spans, kept (SHA-256 of what is left, without ``keep_text``), and columns to ``carry`` along.

    Jobs: three small ones choose groups and look for hot hashes; the result itself is lazy."""
    carry = tuple(c for c in carry if c not in RESULT.names)
    carried = [f"_{i}" for i in range(len(carry))]
    docs = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, carried)])
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("b")).first()["b"] or 0
    more = max(1.0, total / SMALL_BYTES) ** 0.5
    group_bytes = group_bytes or max(1, min(int(GROUP_BYTES[0] * more), GROUP_BYTES[1], -(-total // 48)))
    shards = max(-(-total // (14 * (shard_entries or min(int(SHARD_ENTRIES[0] * more), SHARD_ENTRIES[1])))), 16)
    context = docs.sparkSession.sparkContext
    ranges = context.broadcast(group_ranges(docs, group_bytes, total))
    hot = context.broadcast(hot_leads(docs, total, most_segments))

    @F.pandas_udf("struct<gid long, range long>")
    def group_of(ids: pd.Series, salt: pd.Series) -> pd.DataFrame:
        first, groups = ranges.value
        at = np.maximum(np.searchsorted(first, ids.to_numpy(np.int64), "right") - 1, 0)
        return pd.DataFrame({"gid": (np.cumsum(groups) - groups)[at] + salt.to_numpy(np.int64) % groups[at], "range": at})

    salt = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    grouped = docs.withColumn("_group", group_of(F.coalesce("doc_id", F.lit(LAST)), salt)).select("_group.gid", "_group.range", "doc_id", "text", *carried)
    entries = grouped.groupBy("gid").applyInArrow(_send(shards, hot), "shard long, gid long, range long, entries binary")
    answers = entries.groupBy("shard").applyInArrow(_answer(most_segments), "gid long, shard long, codes binary")
    asked = grouped.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(_ask(shards, hot), "shard long, gid long, own boolean, load binary")
    found = asked.groupBy("shard").applyInArrow(_sort, "gid long, own boolean, ranges binary")
    types = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([*RESULT.fields, *(T.StructField(n, types[n]) for n in carried)])
    out = grouped.groupBy("gid").cogroup(found.groupBy("gid")).applyInArrow(_cut(keep_text, carried), schema)
    return out.select(*RESULT.names, *[F.col(n).alias(c) for c, n in zip(carry, carried)])


def op2_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))
