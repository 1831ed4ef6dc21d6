r"""Substring dedup by difference-cover anchors.

A window of ``WINDOW`` consecutive words is removed from every place if its word sequence starts in more than one
place.  Let D be a difference cover modulo P: for any two positions i and j there is a shift s < P with
i + s and j + s both in D modulo P.  So two equal windows hold, at the same shift, equal *anchors* of WINDOW - P + 1
words at cover positions of their documents.  Only anchors at cover positions are hashed (|D| / P of all
positions); anchors that occur more than once mark the windows around them as candidates, and candidate windows
are compared as a whole (96 bits of two independent hashes: among 10**13 windows a false match is expected 6e-4 times).

Defined cases: null text has no words; documents with fewer words than a window lose nothing; a repeated row is
another place, so all of it is removed if it has a window (there is no order between equal places, so no ties); empty tables give no rows; other
columns, whatever their names, are ignored; a bucket
works through its texts a megabyte at a time, and one text of any length is one block.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .rounds import Asked, Powers, ask, between, bucketed, mixed, replies, sums_of, texts_of

WINDOW = 35
PERIOD = 21
#: A perfect difference set modulo 21: every difference occurs once.
COVER = (0, 1, 4, 14, 16)

_BYTES = Powers(0x9E3779B97F4A7C17)
_WORDS = Powers(0xD1342543DE82EF97)
_MORE = Powers(0xDA942042E4DD58B7)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _TABLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the number of words before each text (and in all)."""
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = _IS_SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:] = blank[:-1]
    first[offsets] = True
    starts = np.flatnonzero(first & ~blank)
    last = np.ones(len(data), bool)
    last[:-1] = blank[1:-1]
    inner = offsets[(offsets > 0)] - 1
    last[inner] = True
    stops = np.flatnonzero(last & ~blank[:-1]) + 1
    return between(sums_of(table[data], _BYTES), starts, stops, _BYTES), np.searchsorted(starts, offsets)


def _places(words_before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` words inside one text, as place among all words and place in the text."""
    n = np.diff(words_before)
    fits = np.maximum(n - size + 1, 0)
    own = np.arange(fits.sum()) - np.repeat(np.cumsum(fits) - fits, fits)
    return own + np.repeat(words_before[:-1], fits), own


class _Block:
    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, period: int, cover: tuple[int, ...]):
        self.words, self.before = word_hashes(data, offsets)
        self.sums = sums_of(self.words, _WORDS)
        self.size = window - period + 1
        at, own = _places(self.before, self.size)
        self.anchors = at[np.isin(np.arange(period), cover)[own % period]]
        self.window, self.period = window, period

    def anchor_keys(self) -> np.ndarray:
        return between(self.sums, self.anchors, self.anchors + self.size, _WORDS)

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor hit at a shift below the period."""
        near = np.zeros(len(self.words) + 2, np.int64)
        np.add.at(near, np.maximum(self.anchors[hit] - self.period + 1, 0), 1)
        np.add.at(near, self.anchors[hit] + 1, -1)
        at, _ = _places(self.before, self.window)
        return at[np.cumsum(near)[at] > 0]

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        more = sums_of(mixed(self.words ^ np.uint64(0xA5A5A5A55A5A5A5A)), _MORE)
        return between(self.sums, at, at + self.window, _WORDS), between(more, at, at + self.window, _MORE) >> np.uint64(32)


def _joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def repeated_words(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, with ``with_text``) of each row."""
    dealt, targets = bucketed(docs, id_col, text_col)

    def blocks(rows: pa.Table) -> list[_Block]:
        return [_Block(data, offsets, window, period, cover) for data, offsets in texts_of(rows)]

    def anchors(rows: pa.Table):
        return _joined([b.anchor_keys() for b in blocks(rows)]), None

    def windows_asked(rows: pa.Table, told: pa.Table):
        all_blocks = blocks(rows)
        keys = [b.anchor_keys() for b in all_blocks]
        hit = Asked(_joined(keys), None, targets).answer(told, 0)
        at, candidates, whole = 0, [], []
        for b, k in zip(all_blocks, keys, strict=True):
            candidates.append(b.candidates(hit[at : at + len(k)]))
            whole.append(b.window_keys(candidates[-1]))
            at += len(k)
        return all_blocks, candidates, Asked(_joined([h for h, _ in whole]), _joined([h for _, h in whole]), targets)

    def second(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        *_, asked = windows_asked(rows, told)
        return pa.Table.from_batches([asked.rows(key[0].as_py(), 1, False)])

    def third(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        all_blocks, candidates, asked = windows_asked(rows, told)
        repeated = asked.answer(told, 1)
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text")
        out, at, doc = [], 0, 0
        for b, c in zip(all_blocks, candidates, strict=True):
            bad = c[repeated[at : at + len(c)]]
            at += len(c)
            cover_at = np.zeros(len(b.words) + window + 1, np.int64)
            cover_at[bad] += 1
            cover_at[bad + window] -= 1
            gone = np.cumsum(cover_at)[: len(b.words)] > 0
            for x, y in zip(b.before[:-1].tolist(), b.before[1:].tolist(), strict=True):
                words = texts[doc].as_py().encode().split()
                n_gone = int(gone[x:y].sum())
                kept = b" ".join(compress(words, (~gone[x:y]).tolist()) if n_gone else words)
                out.append((ids[doc], y - x, n_gone, hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                doc += 1
        return _rows(out, with_text)

    told = replies(ask(dealt, anchors, targets, 0, True), True)
    asked = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(second, "target int, bucket int, round int, keys binary, many binary")
    told = told.union(replies(asked, False))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(third, schema)


def _rows(out: list[tuple], with_text: bool) -> pa.Table:
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    table = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())]
    return pa.table(table + [pa.array(cols[4], pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(common.table(spark, sf_dir, "documents"))
