"""Token-ID / binary output: canonical length-limited Huffman shards.

Pipeline: range-partition documents by id, encode every whole text with the tokenizers library,
count ids globally, derive one canonical length-limited Huffman code (package-merge), and write
shards whose independent blocks start at recorded bit offsets.  Reading a shard decodes all of
its blocks in lock step with one lookup table.

Defined cases: null text is the empty text; an empty text is just the end id; documents with equal
ids follow each other in text order, null ids come first; an empty table gives no shard and no row;
a text of any length is one document, its codes may span many blocks.  The tokenizer's file must be at the same path on every machine.  Other columns, whatever their names, are ignored.

Shard layout (little-endian): magic ``SLH1`` | u32 header bytes | JSON header | doc ids (i64) |
null-id flags (u8) | ids per document (u32) | bit offset of each block (u64) | code bits.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"SLH1"
BLOCK = 128
MAX_BITS = 20
_SIZE_BITS = 5
SHARD_IDS = 1 << 19
COUNTS = -1
#: Common characters: printable ASCII and letters and signs of Latin-1, with line feeds.
_PLAIN = re.compile(r"[\n -~¡-©«-±´-¸»¿-ÿ]*")
#: A comma or full stop that is behind neither letter nor digit: it may belong to a longer run of signs.
_ODD = re.compile(r"[.,](?<![0-9A-Za-zÀ-ÖØ-öø-ÿ][.,])")
#: A space and a line feed as byte-level tokenizers write them.
_SPACE_BYTE, _FEED_BYTE = "\u0120", "\u010a"
#: Marks of chunks: line feed, behind nothing, first of a text.  None of the last two is a common character.
_MARKS = "\n\x01\x02"
_FIRST = _MARKS[2]
#: Chunks that a worker remembers, some 30 bytes each; of more, the half that was used last stays.
_CACHE = 400_000
#: Chunks that go to the library as one text.
_LINE = 256
#: Ids that are packed together, a multiple of BLOCK.
_PIECE = 1 << 14
#: Bytes of texts whose different chunks are looked up together, and characters of those that are cut together.
_BYTES, _CUT = 1 << 22, 1 << 20


# ---------------------------------------------------------------- tokenizer


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, with what it said remembered.

    The library's pre-tokenizer cuts a text into pieces, and merges never cross them.  A text of the characters
    :data:`_PLAIN` without two white-space characters in a row is cut before each space, line feed, and comma or full stop behind a
    letter or digit; such chunks are whole pieces, so ids of a chunk seen before are remembered.  Any other text, and one that holds a
    special token's string, goes to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.cuts = bool(pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not made.get("normalizer"))
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4"
        self.n_ids = max(vocab.values(), default=0) + 1
        # what is known: chunks, how many ids each has, all their ids in one array, and when each was used last
        self.known = pa.array([], pa.large_string())
        self.size, self.flat, self.used, self.now = np.zeros(0, np.uint32), np.zeros(0, self.kind), np.zeros(0, np.uint32), 0
        # ids whose token begins with a space, and those that are a line feed
        self.spaced, self.fed = np.zeros(self.n_ids, bool), np.zeros(self.n_ids, bool)
        self.spaced[[i for t, i in vocab.items() if t[:1] == _SPACE_BYTE]] = True
        self.fed[[i for t, i in vocab.items() if t == _FEED_BYTE]] = True
        self.cuts = self.cuts and len(self._whole("\n")) == np.dtype(self.kind).itemsize

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _cut(self, text: str) -> str | None:
        """The text with a space before each chunk that is not behind one; chunks are marked as the first of a text, behind nothing (commas and
        full stops), or with their own line feed.  None for a text that the library must cut itself."""
        if not self.cuts or not text or text[0] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or not _PLAIN.fullmatch(text) or _ODD.search(text):
            return None
        for s in self.special:
            if s in text:
                return None
        return _FIRST + text.replace(",", " \x01,").replace(".", " \x01.").replace("\n", " \n")

    def _learn(self, chunks: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The order in which chunks are encoded, and in it the number of ids of each, and all ids.  Chunks behind a space are texts in which each
        begins at an id whose token begins with a space; marked ones are texts of lines, in which each begins behind a line feed."""
        lines, words, bare, marked = [], [], [], []
        for k, c in enumerate(chunks):
            (bare if not c or c in _MARKS else words if c[0] not in _MARKS else lines if c[0] == "\n" else marked).append(k)
        out = [self._taught([chunks[k] for k in words], " ", self.spaced, 0)]
        for drop, own in ((0, lines), (1, marked)):
            out.append(self._taught([chunks[k][1:] for k in own], "\n", self.fed, drop))
        out.append(self._one_by_one([chunks[k].strip(_MARKS[1:]) if chunks[k] else " " for k in bare]))
        return words + lines + marked + bare, *(np.concatenate(x) for x in zip(*out, strict=True))

    def _taught(self, chunks: list[str], mark: str, begins: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each chunk behind its mark, and these ids without the first ``drop``; chunks are encoded many to a text, and one
        by one where a text does not fall apart into as many."""
        sizes, found = [np.zeros(0, np.int64)], [np.zeros(0, self.kind)]
        lots = [chunks[k : k + _LINE] for k in range(0, len(chunks), _LINE)]
        said = self.tok.encode_batch_fast([mark + mark.join(x) for x in lots], add_special_tokens=False)
        for own, e in zip(lots, said, strict=True):
            ids = np.asarray(e.ids, self.kind)
            first = begins[ids]
            at = np.flatnonzero(first)
            if len(at) != len(own) or at[0] != 0:
                n, ids = self._one_by_one([("" if drop else mark) + c for c in own])
            else:
                n = np.diff(np.r_[at, len(ids)]) - drop
                ids = ids[~first] if drop else ids
            sizes.append(n)
            found.append(ids)
        return np.concatenate(sizes), np.concatenate(found)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.asarray(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.asarray([len(x) for x in ids], np.int64), np.concatenate([np.zeros(0, self.kind), *ids])

    def _starts(self) -> np.ndarray:
        return np.cumsum(self.size, dtype=np.int64) - self.size

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where each of some different chunks stands among what is known; new ones are encoded first."""
        if len(self.known) > _CACHE:
            keep = np.sort(np.argsort(self.used, kind="stable")[-(_CACHE // 2) :])
            n, starts = self.size[keep], self._starts()[keep]
            self.flat = self.flat[_ranges(starts, n)]
            self.known, self.size, self.used = self.known.take(pa.array(keep)), n, self.used[keep]
        found = pc.index_in(chunks, value_set=self.known)
        new = pc.is_null(found)
        where = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        if (missing := chunks.filter(new)) and len(missing):
            order, n, ids = self._learn(missing.to_pylist())
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order)) + len(self.known)
            where[new.to_numpy(zero_copy_only=False)] = place
            self.known = pa.concat_arrays([self.known, missing.take(pa.array(order, pa.int64()))])
            self.size, self.flat = np.concatenate([self.size, n.astype(np.uint32)]), np.concatenate([self.flat, ids])
            self.used = np.concatenate([self.used, np.zeros(len(order), np.uint32)])
        self.now += 1
        self.used[where] = self.now
        return where

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  Chunks of all texts are cut and told apart by Arrow, so only different ones are looked up."""
        lots, k = [], 0
        ends = np.cumsum([len(t) for t in texts])
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + _CUT, "right")))
            cut = [self._cut(t) for t in texts[k:stop]]
            parts = pc.split_pattern(pa.array([c for c in cut if c is not None], pa.large_string()), " ")
            lots.append((k, [c is None for c in cut], parts.offsets.to_numpy(), parts.flatten().dictionary_encode()))
            k = stop
        coded = pa.chunked_array([x[3] for x in lots], pa.dictionary(pa.int32(), pa.large_string())).unify_dictionaries()
        where = self._places(coded.chunk(0).dictionary) if lots else None
        starts = self._starts()
        out: list = []
        for (k, whole, offsets, _), chunk in zip(lots, coded.chunks, strict=True):
            which = where[chunk.indices.to_numpy()]
            n = self.size[which].astype(np.int64)
            # ids of the chunks in order of the texts: from where a chunk's ids stand to where they go
            every = self.flat[_ranges(starts[which], n)]
            at, j = np.r_[0, np.cumsum(n)][offsets - offsets[:1]].tolist(), 0
            for i, alone in enumerate(whole):
                if alone:
                    out.append(np.frombuffer(self._whole(texts[k + i]), self.kind))
                else:
                    out.append(every[at[j] : at[j + 1]])
                    j += 1
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of ranges, one behind the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


_encoders: dict[str, Encoder] = {}
common.caches.append(_encoders.clear)


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, so many at a time that their texts have about _BYTES."""
    size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy().cumsum()
    k = 0
    while k < b.num_rows:
        stop = max(k + 1, int(np.searchsorted(size, (size[k - 1] if k else 0) + _BYTES, "right")))
        yield b.slice(k, stop - k)
        k = stop


def _tokenised(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, at = _encoder(path), TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(max(enc.n_ids, end_id + 1), np.int64)
        end = np.asarray([end_id], enc.kind)
        for b in batches:
            for some in _slices(b):
                ids = [np.concatenate([x, end]) for x in enc.ids([t or "" for t in some.column(1).to_pylist()])]
                sizes = np.asarray([len(x) for x in ids])
                counts += np.bincount(np.concatenate(ids), minlength=len(counts))
                yield _id_rows(some.column(0), part, seq, at + np.cumsum(sizes) - sizes, sizes, [x.tobytes() for x in ids])
                seq, at = seq + len(ids), at + int(sizes.sum())
                del ids
                common.trim(keep_caches=True)
        if seq:
            yield _id_rows(pa.array([None], pa.int64()), part, COUNTS, np.asarray([at]), np.asarray([at]), [counts.astype("<i8").tobytes()])
        common.trim(keep_caches=True)  # the next task of this stage goes on with what is known; any other operator's task empties it

    return run


def _id_rows(docs: pa.Array, part: int, seq: int, at: np.ndarray, n: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    k = len(docs)
    return pa.record_batch([docs, pa.array([part] * k, pa.int32()), pa.array(range(seq, seq + k), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "seq", "at", "n", "ids"])


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, part, seq, at, n, ids): ids of each document in range partitions of ascending id;
    ``seq`` and ``at`` count documents and ids before it in its partition.  A last row of each partition, with
    seq :data:`COUNTS`, holds how often each id occurs in it (as ``ids``) and all its ids (as ``n``)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = common.text_parts(d)
    d = d.repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")  # rows of one id can be many partitions
    return d.mapInArrow(_tokenised(tokenizer, end_id), "doc_id long, part int, seq long, at long, n long, ids binary")


# ---------------------------------------------------------------- code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the symbols with a count (package-merge)."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    max_bits = max(max_bits, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < len(leaves))
    take, lengths = 2 * (len(leaves) - 1), np.zeros(len(leaves), np.int64)
    for flags in reversed(is_leaf):
        n_leaf = int(flags[:take].sum())
        lengths[:n_leaf] += 1
        take = 2 * (take - n_leaf)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol); the first bit of a code is its highest."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    by_len = lengths[order].astype(int)
    first = 0
    for n in np.unique(by_len):
        code <<= int(n) - last
        m = int((by_len == n).sum())
        codes[order[first : first + m]] = np.arange(code, code + m, dtype=np.uint64)
        code, last, first = code + m, int(n), first + m
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids`` in 64-bit words, and the bit offset of every :data:`BLOCK`-th id."""
    high = codes << (64 - np.maximum(lengths, 1).astype(np.int64)).astype(np.uint64)  # codes at the upper end of a word
    n_bits = int(lengths[ids].sum(dtype=np.int64))
    words, marks, at = np.zeros(n_bits // 64 + 3, np.uint64), [np.zeros(0, np.int64)], 0
    for k in range(0, len(ids), _PIECE):  # a piece stays in the processor's cache
        own = ids[k : k + _PIECE]
        n, c = lengths[own], high[own]
        ends = np.cumsum(n, dtype=np.int64) + at
        starts = ends - n
        w, off = starts >> 6, starts & 63
        head = c >> off.view(np.uint64)
        first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        words[w[first]] |= np.bitwise_or.reduceat(head, first)
        tail = np.flatnonzero(off + n > 64)
        words[w[tail] + 1] |= c[tail] << (64 - off[tail]).astype(np.uint64)
        marks.append(starts[::BLOCK])
        at = int(ends[-1])
    return words.astype(">u8").tobytes(), np.concatenate(marks).astype("<u8")


def unpack(bits: bytes, marks: np.ndarray, n_ids: int, table: tuple[np.ndarray, int]) -> np.ndarray:
    """Ids of all blocks, decoded in lock step from their bit offsets."""
    symbols, width = table
    words = np.frombuffer(bits, ">u8").astype(np.uint64)
    at, out = marks.astype(np.int64), np.zeros((BLOCK, len(marks)), np.uint32)
    left = np.full(len(marks), BLOCK)
    if len(marks):
        left[-1] = n_ids - BLOCK * (len(marks) - 1)
    shift = np.uint64(64 - width)
    for i in range(min(BLOCK, n_ids)):
        if i == left[-1]:
            at = at[:-1]
        k, off = at >> 6, (at & 63).view(np.uint64)
        window = (words[k] << off) | ((words[k + 1] >> np.uint64(1)) >> (np.uint64(63) - off))
        code = symbols[(window >> shift).view(np.int64)]
        out[i, : len(at)] = code >> np.uint32(_SIZE_BITS)
        at = at + (code & np.uint32((1 << _SIZE_BITS) - 1))
    return out.T.reshape(-1)[:n_ids] if len(marks) else np.zeros(0, np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbol and, in the lowest bits, code size for every window of as many bits as the longest code has."""
    width = int(lengths.max()) if len(lengths) and lengths.max() else 1
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    spans = np.left_shift(1, width - lengths[order].astype(np.int64))
    both = np.repeat((order.astype(np.uint32) << np.uint32(_SIZE_BITS)) | lengths[order].astype(np.uint32), spans)
    return np.pad(both, (0, (1 << width) - len(both)), constant_values=1), width  # a code of one symbol leaves windows unused


# ---------------------------------------------------------------- shards


def shard_bytes(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, start: int, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    bits, marks = pack(ids, codes, lengths)
    head = json.dumps({"docs": len(doc_ids), "ids": len(ids), "start": start, "block": BLOCK, "blocks": len(marks), "code": zlib.crc32(lengths.tobytes())}).encode()
    known = np.asarray([0 if x is None else x for x in doc_ids], "<i8")
    null = np.asarray([x is None for x in doc_ids], "u1")
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, known.tobytes(), null.tobytes(), sizes.astype("<u4").tobytes(), marks.tobytes(), bits])


def read_shard(raw: bytes, lengths: np.ndarray, table: tuple) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Document ids, ids per document, all ids and the ids before the shard."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token shard")
    (h,) = struct.unpack_from("<I", raw, 4)
    head, at = json.loads(raw[8 : 8 + h]), 8 + h
    if head["code"] != zlib.crc32(lengths.tobytes()) or head["block"] != BLOCK:
        raise ValueError("the shard was written with another code")

    def array(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(raw, kind, n, at)
        at += x.nbytes
        return x

    known, null, sizes, marks = array("<i8", head["docs"]), array("u1", head["docs"]), array("<u4", head["docs"]), array("<u8", head["blocks"])
    ids = unpack(raw[at:], marks, head["ids"], table)
    return [None if x else int(k) for k, x in zip(known, null, strict=True)], sizes, ids, head["start"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0):
            total = np.frombuffer(raw.as_py(), "<i8")
            seen = np.flatnonzero(total)
            yield pa.record_batch([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def _sharded(lengths: np.ndarray, bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            part, seq, at = rows[0][1], rows[0][2], rows[0][3]
            sizes = np.asarray([r[4] for r in rows])
            raw = shard_bytes([r[0] for r in rows], sizes, np.concatenate([_unpacked(r[5], r[4]) for r in rows]), bases[part] + at, codes, lengths)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "shard"])

        rows, held = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                follows = rows and r[1] == rows[-1][1] and r[2] == rows[-1][2] + 1
                if rows and (not follows or held + r[4] > SHARD_IDS):
                    yield flush(rows)
                    rows, held = [], 0
                rows.append((*r[:5], r[5].as_py()))
                held += r[4]
        if rows:
            yield flush(rows)

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write shards of all documents below ``path``: ``shards`` (one row a shard, ordered by part and
    seq) and ``code`` (code length of every id).  A third table holds ids between the passes; it is
    removed at the end.  To the driver go one count for each id of the vocabulary and one sum for each
    range partition."""
    spark = docs.sparkSession
    table, ids_path = common.saved(tokenize(docs, tokenizer, end_id, id_col, text_col), "token-ids", compression="none")
    sums, ids = table.where(F.col("seq") == COUNTS), table.where(F.col("seq") >= 0)
    counts = sums.select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(max((r.id for r in counts), default=0) + 1, np.int64)
    for r in counts:
        freq[r.id] = r.n
    lengths, bases, total = code_lengths(freq), {}, 0
    for r in sums.select("part", "n").orderBy("part").collect():
        bases[r.part], total = total, total + r.n
    ids.mapInArrow(_sharded(lengths, bases), "part int, seq long, shard binary").write.option("compression", "none").parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    common.drop(spark, ids_path)


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    return np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Decode shards: doc_id, start, n_tokens, ids_crc32 (and ids, with ``with_ids``) per document."""
    lengths = read_code(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(lengths)
        for b in batches:
            for raw in b.column(0):
                docs, sizes, ids, start = read_shard(raw.as_py(), lengths, lookup)
                ends = np.cumsum(sizes, dtype=np.int64)
                wide, own = ids.astype("<u4").tobytes(), [(int(e - n), int(e)) for e, n in zip(ends, sizes, strict=True)]
                cols = [pa.array(docs, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(wide[4 * x : 4 * y]) for x, y in own], pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[x:y].astype(np.int64) for x, y in own], pa.list_(pa.int64())))
                yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return spark.read.parquet(f"{path}/shards").select("shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    write(common.table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return read(spark, path)
