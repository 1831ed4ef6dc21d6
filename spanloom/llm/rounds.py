"""Ask-and-reply rounds over bucketed texts: which of my hashes occur anywhere else?

Texts are dealt once to buckets (an exchange that every round reuses).  A round's *ask* gives for each bucket its distinct
keys, packed by target range; the *reply* for a target counts every key over all buckets and answers with one
bit a key, in the order asked.  So a key that a third of all rows share is one entry of each bucket, texts are
never joined with keys row by row, and no list of keys or links leaves the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASKED = "target int, bucket int, round int, keys binary, many binary"
REPLIED = "bucket int, target int, round int, bits binary"
_WIDTH = 12  # bytes of a key: 64 and 32 bits


def bucketed(docs: DataFrame, id_col: str, text_col: str, per_part: int = 2) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text) dealt by a hash of id and text, and the number of targets to ask; both grow with the input's size."""
    n = common.text_parts(docs.select(id_col, text_col))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(n * per_part)).cast("int").alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return d.repartition(n, "bucket"), max(1, n // 2)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            room = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(room, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def sums_of(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of value[i] * base**i, one longer than the values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.to(len(values))[0], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, stop: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the values from start to stop (not included), wherever they stand."""
    return mixed((sums[stop] - sums[start]) * powers.to(len(sums))[1][start])


def _packed(h1: np.ndarray, h2: np.ndarray) -> bytes:
    out = np.empty((len(h1), _WIDTH), np.uint8)
    out[:, :8] = h1.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[:, 8:] = h2.astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes()


class Asked:
    """The distinct keys of a bucket by target, in one fixed order."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray | None, targets: int):
        h2 = np.zeros(len(h1), np.uint32) if h2 is None else h2.astype(np.uint32)
        order = np.argsort(h1, kind="stable")
        h1, h2 = h1[order], h2[order]
        clash = len(h1) and bool(((h1[1:] == h1[:-1]) & (h2[1:] != h2[:-1])).any())
        if clash:
            again = np.lexsort((h2, h1))
            order, h1, h2 = order[again], h1[again], h2[again]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        at = np.flatnonzero(new)
        self.which = np.empty(len(h1), np.int64)  # place of each key among the distinct ones
        self.which[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[at], h2[at]
        self.many = np.diff(np.r_[at, len(h1)]) > 1
        # ranges of h1: the sorted keys of a target follow each other
        self.edges = np.searchsorted(self.h1, (np.arange(1, targets, dtype=object) * (1 << 64) // targets).astype(np.uint64)) if targets > 1 else np.zeros(0, np.int64)
        self.edges = np.r_[0, self.edges, len(self.h1)].astype(np.int64)

    def rows(self, bucket: int, number: int, short: bool) -> pa.RecordBatch:
        full = [t for t in range(len(self.edges) - 1) if self.edges[t] < self.edges[t + 1]]
        keys, many = [], []
        for t in full:
            a, b = self.edges[t], self.edges[t + 1]
            # keys that are only candidates travel without their last bytes
            keys.append(self.h1[a:b].astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if short else _packed(self.h1[a:b], self.h2[a:b]))
            many.append(np.packbits(self.many[a:b]).tobytes())
        k = len(full)
        return pa.record_batch([pa.array(full, pa.int32()), pa.array([bucket] * k, pa.int32()), pa.array([number] * k, pa.int32()), pa.array(keys, pa.binary()), pa.array(many, pa.binary())], names=["target", "bucket", "round", "keys", "many"])

    def answer(self, replies: pa.Table, number: int) -> np.ndarray:
        """For each key asked (not only the distinct ones): does it occur elsewhere or more than once?"""
        found = np.zeros(len(self.h1), bool)
        for t, r, bits in zip(replies.column("target").to_pylist(), replies.column("round").to_pylist(), replies.column("bits").to_pylist(), strict=True):
            if r == number:
                a, b = self.edges[t], self.edges[t + 1]
                found[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        return found[self.which]


def replies(asked: DataFrame, short: bool) -> DataFrame:
    """One row of bits for each row asked."""
    width = 6 if short else _WIDTH

    def reply(rows: pa.Table) -> pa.Table:
        blobs = rows.column("keys").to_pylist()
        sizes = np.asarray([len(b) // width for b in blobs])
        raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(rows.column("many").to_pylist(), sizes, strict=True)]).astype(bool)
        if short:
            h1, h2 = np.zeros((len(raw), 8), np.uint8), None
            h1[:, 2:] = raw
            h1 = h1.view(">u8").ravel().astype(np.uint64)
            order = np.argsort(h1)
            same = h1[order][1:] == h1[order][:-1]
        else:
            h1, h2 = np.ascontiguousarray(raw[:, :8]).view("<u8").ravel(), np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
            order = np.argsort(h1)
            if ((h1[order][1:] == h1[order][:-1]) & (h2[order][1:] != h2[order][:-1])).any():
                order = np.lexsort((h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(raw), bool)
        hit[1:] |= same
        hit[:-1] |= same
        found = np.empty(len(raw), bool)
        found[order] = hit
        found |= many
        ends = np.cumsum(sizes)
        bits = [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.table([rows.column("bucket"), rows.column("target"), rows.column("round"), pa.array(bits, pa.binary())], names=["bucket", "target", "round", "bits"])

    return asked.groupBy("target").applyInArrow(reply, REPLIED)


def texts_of(table: pa.Table) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of the texts of a bucket, in blocks of about a megabyte; a text is never split."""
    for chunk in table.column("text").chunks:
        if not len(chunk):
            continue
        if pa.types.is_string(chunk.type):
            chunk = chunk.cast(pa.large_string())
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2], np.uint8) if chunk.buffers()[2] is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), "right")) - 1)
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def ask(dealt: DataFrame, keys: Callable[[pa.Table], tuple[np.ndarray, np.ndarray | None]], targets: int, number: int, short: bool) -> DataFrame:
    """First round: keys of the texts alone."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Asked(*keys(rows), targets).rows(key[0].as_py(), number, short)])

    return dealt.groupBy("bucket").applyInArrow(run, ASKED)
