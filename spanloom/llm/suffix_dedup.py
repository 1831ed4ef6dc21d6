r"""Suffix dedup of byte strings with a run-length index.

Removed is every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller id, or same document and
earlier start).  Documents are dealt to buckets.  The 100-byte windows of a text are assigned to their minimizer (leftmost smallest
hash of K bytes), and consecutive windows with one minimizer form a *piece* of at most 2 * LENGTH - K bytes.  Equal windows
have equal minimizers, so all windows that may be equal meet at one target:

1. buckets ask which minimizers occur more than once (one bit comes back for each);
2. pieces with such a minimizer go to its target.  There the distinct pieces, in order of their first occurrence, are
   put into run-length indexes (run-compressed Burrows-Wheeler transform, sampled run ends), and their matching statistics are streamed: a
   match of LENGTH bytes or more leads to a row, its class of rows with the same LENGTH bytes, and the place where those start
   first.  One bit for each window, "starts earlier", goes back;
3. buckets turn bits into removed bytes.

A piece that a third of all documents share is indexed once.  Texts are worked through a megabyte at a time, an index
holds about INDEX_BYTES (or the distinct pieces of one minimizer, if these are more).

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; null ids come before all others; rows with the same
id are ordered by bucket and text, equal rows follow each other, so one of them keeps its bytes; extra columns, whatever their names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .rounds import Asked, Powers, ask, between, bucketed, mixed, replies, sums_of, texts_of
from .run_index import RunIndex

LENGTH = 100
K = 24
INDEX_BYTES = 1 << 19
#: Window starts that are worked through together: their numbers stay in the processor's cache.
_SEGMENT = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = Powers(0x9E3779B97F4A7C17)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start of each piece, and the hash of its minimizer."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a in range(0, len(data), _SEGMENT):
        part = data[a : a + _SEGMENT + length - 1]
        if len(part) < length:
            continue
        sums = sums_of(_TABLE[part], _BYTES)
        h = between(sums, np.arange(len(part) - k + 1), np.arange(k, len(part) + 1), _BYTES)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        span, reach = length - k + 1, 1
        while 2 * reach <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: reach - span], low[span - reach :])
        at = (low & _PLACE).astype(np.int64)  # of each window start in the segment
        # windows inside one text
        inside = np.zeros(len(at) + 1, np.int64)
        first = np.clip(offsets[:-1] - a, 0, len(at))
        stop = np.clip(offsets[1:] - a - length + 1, first, len(at))
        np.add.at(inside, first, 1)
        np.add.at(inside, stop, -1)
        windows = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        if not len(windows):
            continue
        own = at[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)
        starts = np.zeros(len(at) + 1, bool)
        starts[np.clip(offsets - a, 0, len(at))] = True
        new |= starts[windows]
        begin = np.flatnonzero(new)
        end = np.r_[begin[1:], len(windows)] - 1
        # minimizers are small hashes: mixed again, they fill all targets alike
        out.append((windows[begin] + a, windows[end] + a, mixed(h[own[begin]])))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class _Bucket:
    """The pieces of a bucket whose minimizers occur more than once, in order of target."""

    def __init__(self, rows: pa.Table, length: int):
        # a fixed order of the rows, the same in every round
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.rows, self.length = rows, length
        self.blocks, first_doc = [], 0
        for data, offsets in texts_of(rows):
            self.blocks.append((data, offsets, first_doc, *pieces(data, offsets, length)))
            first_doc += len(offsets) - 1
        self.keys = np.concatenate([np.zeros(0, np.uint64), *(b[5] for b in self.blocks)])

    def shared(self, told: pa.Table, asked_targets: int, targets: int):
        hit = Asked(self.keys, None, asked_targets).answer(told, 0)
        at, chosen = 0, []
        for n, (_, offsets, first_doc, begin, end, key) in enumerate(self.blocks):
            own = np.flatnonzero(hit[at : at + len(key)])
            at += len(key)
            text = np.searchsorted(offsets, begin[own], "right") - 1
            chosen.append(np.stack([np.full(len(own), n), begin[own], end[own] - begin[own] + self.length, text + first_doc, begin[own] - offsets[text]]))
        place = np.concatenate([np.zeros((5, 0), np.int64), *chosen], axis=1)
        keys = self.keys[hit]
        order = np.argsort(keys, kind="stable")
        cuts = (np.arange(1, targets, dtype=object) * (1 << 64) // targets).astype(np.uint64)
        edges = np.r_[0, np.searchsorted(keys[order], cuts), len(keys)].astype(np.int64)
        return keys[order], place[:, order], edges


_SENT = "target int, bucket int, round int, keys binary, docs binary, rows binary, starts binary, sizes binary, texts binary"


def earlier_windows(texts: list[bytes], keys: np.ndarray, length: int) -> list[np.ndarray]:
    """For each distinct piece, in order of first occurrence: does each of its windows start in an earlier piece?"""
    out: list = [np.zeros(len(t) - length + 1, bool) for t in texts]
    order = np.argsort(keys, kind="stable")
    # windows of one piece differ from each other, since their common minimizer stands elsewhere in each: a piece that has its key alone repeats nothing
    alone = np.r_[True, keys[order][1:] != keys[order][:-1], True]
    order = order[~(alone[:-1] & alone[1:])] if len(order) else order
    sizes = np.asarray([len(t) for t in texts], np.int64)[order]
    ends = np.flatnonzero(np.r_[keys[order][1:] != keys[order][:-1], True]) + 1 if len(order) else []
    begin, total = 0, np.r_[0, np.cumsum(sizes)]
    for i, stop in enumerate(ends):
        if total[stop] - total[begin] < INDEX_BYTES and i + 1 < len(ends):
            continue
        which = np.sort(order[begin:stop])  # back in order of first occurrence
        begin = stop
        strings = [texts[w] for w in which]
        index = RunIndex(strings, length)
        flags = [np.zeros(len(s) - length + 1, bool) for s in strings]
        flat = np.zeros(int(sum(len(f) for f in flags)), bool)
        base = np.cumsum([0, *(len(f) for f in flags)])
        for at, lanes, n, row, _ in index.matching_statistics(strings):
            long = n >= length
            if long.any():
                first = index.first_place[index.class_of(row[long])]
                flat[base[lanes[long]] + at[long]] = first < index.starts[lanes[long]] + at[long]
        for k, w in enumerate(which):
            out[w] = flat[base[k] : base[k + 1]]
    return out


def _judge(length: int):
    def judge(rows: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

        keys, docs, row, start, size = joined("keys", "<u8"), joined("docs", "<i8"), joined("rows", "<i4"), joined("starts", "<i8"), joined("sizes", "<u4").astype(np.int64)
        count = np.asarray([len(b) // 8 for b in rows.column("keys").to_pylist()])
        bucket = np.repeat(np.asarray(rows.column("bucket").to_pylist()), count)
        raw = b"".join(rows.column("texts").to_pylist())
        edge = np.r_[0, np.cumsum(size)].tolist()
        known: dict[bytes, int] = {}
        opening = []
        for i in np.lexsort((start, row, bucket, docs)).tolist():
            if known.setdefault(raw[edge[i] : edge[i + 1]], len(known)) == len(opening):
                opening.append(i)
        flags = earlier_windows(list(known), keys[np.asarray(opening, np.int64)] if opening else keys, length)
        base = np.r_[0, np.cumsum(size - length + 1)]
        every = np.ones(int(base[-1]), bool)  # what stands in a piece seen before starts earlier
        for i, own in zip(opening, flags, strict=True):
            every[base[i] : base[i + 1]] = own
        edges = base[np.r_[0, np.cumsum(count)]].tolist()
        bits = [np.packbits(every[x:y]).tobytes() for x, y in zip(edges, edges[1:], strict=False)]
        return pa.table([rows.column("bucket"), rows.column("target"), rows.column("round"), pa.array(bits, pa.binary())], names=["bucket", "target", "round", "bits"])

    return judge


def repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans: start and end of removed bytes) of each row."""
    dealt, few = bucketed(docs, id_col, text_col)
    targets = 2 * few

    def minimizers(rows: pa.Table):
        return _Bucket(rows, length).keys, None

    def send(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        b = _Bucket(rows, length)
        keys, (block, begin, size, row, start), edges = b.shared(told, few, targets)
        least = np.iinfo(np.int64).min
        ids = np.asarray([least if x is None else x for x in b.rows.column("doc_id").to_pylist()], np.int64)
        raw = [x[0].tobytes() for x in b.blocks]
        full = [t for t in range(targets) if edges[t] < edges[t + 1]]
        cols: list[list[bytes]] = [[], [], [], [], [], []]
        for t in full:
            s = slice(edges[t], edges[t + 1])
            texts = b"".join([raw[x][y : y + z] for x, y, z in zip(block[s].tolist(), begin[s].tolist(), size[s].tolist(), strict=True)])
            for c, v in zip(cols, (keys[s].astype("<u8").tobytes(), ids[row[s]].astype("<i8").tobytes(), row[s].astype("<i4").tobytes(), start[s].astype("<i8").tobytes(), size[s].astype("<u4").tobytes(), texts), strict=True):
                c.append(v)
        k = len(full)
        return pa.table([pa.array(full, pa.int32()), pa.array([key[0].as_py()] * k, pa.int32()), pa.array([1] * k, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["target", "bucket", "round", "keys", "docs", "rows", "starts", "sizes", "texts"])

    def remove(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        b = _Bucket(rows, length)
        _, (block, begin, size, _, _), edges = b.shared(told, few, targets)
        windows = size - length + 1
        repeated = np.zeros(int(windows.sum()), bool)
        base = np.r_[0, np.cumsum(windows)]
        for t, r, bits in zip(told.column("target").to_pylist(), told.column("round").to_pylist(), told.column("bits").to_pylist(), strict=True):
            if r == 1:
                x, y = base[edges[t]], base[edges[t + 1]]
                repeated[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
        first_byte = np.cumsum([0, *(len(x[0]) for x in b.blocks)])
        starts = np.zeros(int(first_byte[-1]), bool)
        starts[(np.repeat(begin + first_byte[block] - base[:-1], windows) + np.arange(len(repeated)))[repeated]] = True
        ids, out, doc = b.rows.column("doc_id").to_pylist(), [], 0
        for n, (data, offsets, *_) in enumerate(b.blocks):
            # a byte is gone if one of the last ``length`` windows that start up to it is repeated
            cover = np.cumsum(starts[first_byte[n] : first_byte[n + 1]], dtype=np.int32)
            gone = np.r_[cover[:length], cover[length:] - cover[:-length]] > 0
            for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = gone[x:y]
                kept, spans, n_gone = data[x:y], [], int(own.sum())
                if n_gone:
                    turns = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                    spans = turns.reshape(-1, 2).tolist()
                    kept = kept[~own]
                out.append((ids[doc], y - x, n_gone, len(spans), hashlib.sha256(kept.tobytes()).hexdigest(), spans))
                doc += 1
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))][: 5 + with_spans]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"][: 5 + with_spans])

    told = replies(ask(dealt, minimizers, few, 0, True), True)
    sent = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(send, _SENT)
    told = told.union(sent.groupBy("target").applyInArrow(_judge(length), "bucket int, target int, round int, bits binary"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<array<long>>" * with_spans
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(remove, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(common.table(spark, sf_dir, "documents"))
