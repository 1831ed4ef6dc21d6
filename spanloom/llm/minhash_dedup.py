r"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has ``SYMBOLS`` symbols of 16 bits, one for each of as many MinHash functions over its distinct
word shingles.  The distance of two signatures is the number of different symbols; pairs up to ``MAX_DISTANCE`` are
candidates (Jaccard 0.8 differs in 12.8 of 64 symbols on average, with a deviation of 3.2).

Multi-index join: a signature is split into ``CHUNKS`` chunks of four symbols.  By pigeonhole two signatures that differ in
less than 2 * CHUNKS symbols have a chunk with at most one difference; enumerating the place of that one error gives
four keys a chunk (the other three symbols, exact), and such a pair shares a key.

A second sketch, the LOWEST smallest shingle hashes (of most texts the whole set), drops candidates that
cannot reach the similarity before they leave the task of a key: texts that only share a common passage stop there.

Keys are not joined pairwise.  Texts with equal shingle sets are one class, represented by its smallest id.
Round 1 links each class to the smallest id it shares a key with, takes the nearest of these for each class and confirms
it on the full shingle sets.  Round 2 looks only at keys that classes of *different* components share, compares their
signatures inside the task of the key and confirms every pair within the distance.  So a group of thousands of near copies
gives one link for each member, while no link between components is lost.  A map task sends one id for each key it
holds; a key shared by very many different texts is split once more by the keys of the other chunks, over as many tasks
(two signatures within MAX_DISTANCE share keys of at least two chunks).  A class's sketch goes to a task once, however many keys it has there.

Defined cases: null and empty texts have no shingles and are linked with nothing; texts of fewer words than a shingle are one
shingle; rows of one id are one document (its texts' links are all its own); a null id is linked with nothing and kept;
very long texts are worked through as one array; of classes that are equally near the smallest id is taken; extra columns, whatever their names, are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components
from .rounds import between, mixed, sums_of, texts_of
from .substring_dedup import _BYTES, _TABLE, _WORDS, _joined, word_hashes

SYMBOLS = 64
#: Smallest shingle hashes of a set that are kept as a second sketch: the whole set, if it has no more.
LOWEST = 256
#: What an estimate from LOWEST hashes may fall below the truth (4.5 deviations at 0.8), and one from whole sets (clashes of 32 bits).
SLACK, WHOLE_SLACK = 11.25, 1.0
CHUNKS = 16
MAX_DISTANCE = 28
LARGE_KEY = 2048
#: Signatures whose keys a map task sorts at a time.
LOCAL_ROWS = 1 << 13
#: A distance at which most pairs are similar enough.
LIKELY = 12

_FOLD = _TABLE.copy()
_FOLD[65:91] = _TABLE[97:123]
_A = mixed(np.arange(1, SYMBOLS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mixed(np.arange(101, SYMBOLS + 101, dtype=np.uint64))


# ---------------------------------------------------------------- shingles and signatures


def shingle_sets(table: pa.Table, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (A-Z folded to lower case)."""
    for data, offsets in texts_of(table):
        words, before = word_hashes(data, offsets, _FOLD)
        sums = sums_of(words, _WORDS)
        every = between(sums, np.arange(max(len(words) - size + 1, 0)), np.arange(max(len(words) - size + 1, 0)) + size, _WORDS)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(every[a : b - size + 1])
            elif b > a:
                yield between(sums, np.asarray([a]), np.asarray([b]), _WORDS)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, ~np.uint64(0))
    for k in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, k : k + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (mixed(low) >> np.uint64(48)).astype("<u2")


def lowest(shingles: np.ndarray) -> np.ndarray:
    """The smallest LOWEST hashes of a sorted set, 32 bits each."""
    return (shingles[:LOWEST] >> np.uint64(32)).astype("<u4")


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Rows of lowest hashes (padded with the largest number): may the sets be similar enough?  Among the smallest hashes of both
    sets together, those in both are counted."""
    if len(a) > 2048:  # a few megabytes at a time
        return np.concatenate([plausible(a[k : k + 2048], b[k : k + 2048], na[k : k + 2048], nb[k : k + 2048], percent) for k in range(0, len(a), 2048)])
    both = np.concatenate([a, b], axis=1)
    both.sort(axis=1)
    pad = both == _PAD
    twin = np.zeros(both.shape, bool)
    twin[:, 1:] = (both[:, 1:] == both[:, :-1]) & ~pad[:, 1:]
    own = ~twin & ~pad
    counted = np.cumsum(own, axis=1, dtype=np.int16) <= LOWEST
    whole = (na <= LOWEST) & (nb <= LOWEST)
    counted |= whole[:, None]
    union = (own & counted).sum(axis=1)
    shared = (twin & counted).sum(axis=1)
    return 100 * shared >= (percent - np.where(whole, WHOLE_SLACK, SLACK)) * union


_PAD = np.uint32(0xFFFFFFFF)


def _padded(column) -> np.ndarray:
    """Lowest hashes of a column, one row each."""
    blobs = column.to_pylist()
    out = np.full((len(blobs), LOWEST), _PAD, np.uint32)
    for i, x in enumerate(blobs):
        v = np.frombuffer(x, "<u4")
        out[i, : len(v)] = v
    return out


def _text_table(b: pa.RecordBatch) -> pa.Table:
    return pa.table([b.column(1)], names=["text"])


def sketches(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (fingerprint of the set), sig, low (lowest hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, sigs, low = [], [], [], [], []
            for s in shingle_sets(_text_table(b), size):
                n.append(len(s))
                f1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                sigs.append(signature(s).tobytes() if len(s) else b"")
                low.append(lowest(s).tobytes())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sigs, pa.binary()), pa.array(low, pa.binary())], names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "low"])
        common.trim()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, low binary")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


# ---------------------------------------------------------------- multi-index keys


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """(rows, 4 * CHUNKS) keys: three of the four symbols of a chunk and which three they are, mixed."""
    c = sigs.reshape(len(sigs), CHUNKS, 4).astype(np.uint64)
    out = np.empty((len(sigs), CHUNKS, 4), np.uint64)
    for e in range(4):
        x, y, z = (c[:, :, k] for k in range(4) if k != e)
        out[:, :, e] = x | (y << np.uint64(16)) | (z << np.uint64(32)) | (np.uint64(e) << np.uint64(54))
    out |= np.arange(CHUNKS, dtype=np.uint64)[None, :, None] << np.uint64(48)
    return mixed(out.reshape(len(sigs), -1))


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SYMBOLS)


def _by_target(keys: np.ndarray, targets: int) -> np.ndarray:
    """Edges of the target ranges in sorted keys."""
    cuts = (np.arange(1, targets, dtype=object) * (1 << 64) // targets).astype(np.uint64)
    return np.r_[0, np.searchsorted(keys, cuts), len(keys)].astype(np.int64)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest id, and links (a, b) from that id to the others."""
    order = np.lexsort((ids, keys))
    k, i = keys[order], ids[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    lead = i[new][np.cumsum(new) - 1] if len(k) else i
    off = lead != i
    pairs = np.unique(np.stack([lead[off], i[off]], axis=1), axis=0) if off.any() else np.zeros((0, 2), np.int64)
    return k[new], i[new], pairs[:, 0], pairs[:, 1]


def star_links(reps: DataFrame) -> DataFrame:
    """(a, b): every class b with the smallest id a it shares a key with, for each key."""
    targets = common.parts_for(reps.sparkSession)

    def packed(ids: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        keys = keys_of(sigs)
        keys, lead, x, y = _stars(keys.ravel(), np.repeat(ids, keys.shape[1]))
        edges = _by_target(keys, targets)
        rows = [(t, keys[edges[t] : edges[t + 1]].tobytes(), lead[edges[t] : edges[t + 1]].tobytes()) for t in range(targets) if edges[t] < edges[t + 1]]
        rows.append((-1 - int(ids[0]) % targets, x.tobytes(), y.tobytes()))  # links found here
        t, k, i = zip(*rows, strict=True)
        return pa.record_batch([pa.array(t, pa.int32()), pa.array(k, pa.binary()), pa.array(i, pa.binary())], names=["target", "k", "i"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sigs = [], []
        for b in batches:
            ids.append(np.asarray(b.column(0)))
            sigs.append(_sigs(b.column(1)))
            if sum(map(len, ids)) >= LOCAL_ROWS:
                yield packed(np.concatenate(ids), np.concatenate(sigs))
                ids, sigs = [], []
        if sum(map(len, ids)):
            yield packed(np.concatenate(ids), np.concatenate(sigs))
        common.trim()

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        k, i = (b"".join(rows.column(c).to_pylist()) for c in ("k", "i"))
        if key[0].as_py() < 0:
            x, y = np.frombuffer(k, np.int64), np.frombuffer(i, np.int64)
        else:
            _, _, x, y = _stars(np.frombuffer(k, np.uint64), np.frombuffer(i, np.int64))
        return pa.table([pa.array(x), pa.array(y)], names=["a", "b"])

    sent = reps.select("id", "sig").mapInArrow(local, "target int, k binary, i binary")
    return sent.groupBy("target").applyInArrow(common.trimmed(meet), "a long, b long").distinct()


def near_links(links: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(a, b, dist) of the links within MAX_DISTANCE whose set sizes allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = (_sigs(b.column(2)) != _sigs(b.column(3))).sum(axis=1)
            near = pa.array((d <= MAX_DISTANCE) & plausible(_padded(b.column(4)), _padded(b.column(5)), np.asarray(b.column(6)), np.asarray(b.column(7)), percent))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(d, pa.int64())], names=["a", "b", "dist"]).filter(near)
        common.trim()

    x, y = (reps.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"), F.col("low").alias(f"l{k}")) for k in "ab")
    j = links.join(x, "a").join(y, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return j.select("a", "b", "sa", "sb", "la", "lb", "na", "nb").mapInArrow(run, "a long, b long, dist long")


#: What is known of a class where its keys meet, and a key it brings there: the class by its place among those of the sender.
_SKETCH = np.dtype([("id", "<i8"), ("comp", "<i8"), ("n", "<i8"), ("sig", "<u2", SYMBOLS), ("low", "<u4", LOWEST)])
_ENTRY = np.dtype([("key", "<u8"), ("at", "<u4"), ("slot", "u1")])


def foreign_links(reps: DataFrame, percent: int, large: int = LARGE_KEY) -> DataFrame:
    """(a, b, dist) within MAX_DISTANCE that share a key and are of different components (column comp).  Keys that more than ``large``
    entries share are sent with each key of the other chunks, so their classes meet in as many tasks."""
    spark = reps.sparkSession
    n = common.parts_for(spark)
    dealt = reps.select(F.pmod(F.xxhash64("id"), F.lit(2 * n)).cast("int").alias("bucket"), "id", "n", "comp", "sig", "low").repartition(n, "bucket")

    def entries(rows: pa.Table):
        """Distinct (key, component) of the bucket in order of key, their targets, and each row's entries."""
        keys = keys_of(_sigs(rows.column("sig")))
        comp = np.repeat(np.asarray(rows.column("comp")), keys.shape[1])
        k = keys.ravel()
        order = np.lexsort((comp, k))
        ks, cs = k[order], comp[order]
        new = np.ones(len(k), bool)
        new[1:] = (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])
        which = np.empty(len(k), np.int64)
        which[order] = np.cumsum(new) - 1
        return keys, ks[new], cs[new], _by_target(ks[new], n), which

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        _, k, c, edges, _ = entries(rows)
        full = [t for t in range(n) if edges[t] < edges[t + 1]]
        return pa.table([pa.array(full, pa.int32()), pa.array([key[0].as_py()] * len(full), pa.int32()), pa.array([k[edges[t] : edges[t + 1]].tobytes() for t in full], pa.binary()), pa.array([c[edges[t] : edges[t + 1]].tobytes() for t in full], pa.binary())], names=["target", "bucket", "k", "c"])

    def reply(rows: pa.Table) -> pa.Table:
        blobs = rows.column("k").to_pylist()
        k, c = np.frombuffer(b"".join(blobs), np.uint64), np.frombuffer(b"".join(rows.column("c").to_pylist()), np.int64)
        order = np.argsort(k, kind="stable")
        at = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]]) if len(k) else np.zeros(0, np.int64)
        size = np.diff(np.r_[at, len(k)])
        low, high = np.minimum.reduceat(c[order], at), np.maximum.reduceat(c[order], at)
        found, many = np.empty(len(k), bool), np.empty(len(k), bool)
        found[order] = np.repeat(low != high, size)
        many[order] = np.repeat(size > large, size)
        sizes = np.asarray([len(b) // 8 for b in blobs])
        ends = np.cumsum(sizes)
        packed = [pa.array([np.packbits(x[e - m : e]).tobytes() for e, m in zip(ends, sizes, strict=True)], pa.binary()) for x in (found, many)]
        return pa.table([rows.column("bucket"), rows.column("target"), *packed], names=["bucket", "target", "bits", "large"])

    def send(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        keys, k, _, edges, which = entries(rows)
        found, many = np.zeros(len(k), bool), np.zeros(len(k), bool)
        for t, *bits in zip(*(told.column(c).to_pylist() for c in ("target", "bits", "large")), strict=True):
            for x, b in zip((found, many), bits, strict=True):
                x[edges[t] : edges[t + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=edges[t + 1] - edges[t]).astype(bool)
        found, many = (x[which].reshape(keys.shape) for x in (found, many))
        row, slot = np.nonzero(found & ~many)
        sent = [_entries(keys[row, slot], row, slot)]
        row, slot = np.nonzero(found & many)
        for other in range(keys.shape[1]):  # a pair within the distance shares keys of two chunks
            of = np.flatnonzero(slot // 4 != other // 4)
            sent.append(_entries(mixed(keys[row[of], slot[of]] ^ (keys[row[of], other] << np.uint64(1))), row[of], slot[of]))
        every = np.concatenate(sent)
        every = every[np.argsort(every["key"], kind="stable")]
        cut = _by_target(every["key"], n)
        sketch = np.zeros(len(rows), _SKETCH)
        sketch["sig"], sketch["low"] = _sigs(rows.column("sig")), _padded(rows.column("low"))
        for name in ("id", "comp", "n"):
            sketch[name] = np.asarray(rows.column(name))
        full, packed = [t for t in range(n) if cut[t] < cut[t + 1]], ([], [])
        for t in full:  # a class goes to a target once, however many keys it has there
            own = every[cut[t] : cut[t + 1]]
            present, own["at"] = np.unique(own["at"], return_inverse=True)
            packed[0].append(own.tobytes())
            packed[1].append(sketch[present].tobytes())
        return pa.table([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in packed)], names=["target", "keys", "sketches"])

    def compare(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), _SKETCH) for x in rows.column("sketches")]
        keys = [np.frombuffer(x.as_buffer(), _ENTRY).copy() for x in rows.column("keys")]
        base = 0
        for part, own in zip(parts, keys, strict=True):
            own["at"] += base
            base += len(part)
        sketch, every = np.concatenate(parts), np.concatenate(keys)
        every = every[np.argsort(every["key"], kind="stable")]
        at = np.flatnonzero(np.r_[True, every["key"][1:] != every["key"][:-1]]) if len(every) else np.zeros(0, np.int64)
        found = [near_pairs(sketch, every["at"][a:b], int(every["slot"][a]), percent) for a, b in zip(at, np.r_[at[1:], len(every)], strict=True)]
        pairs = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *found]), axis=0)
        return pa.table([pa.array(pairs[:, i]) for i in range(3)], names=["a", "b", "dist"])

    asked = dealt.groupBy("bucket").applyInArrow(common.trimmed(ask), "target int, bucket int, k binary, c binary")
    told = asked.groupBy("target").applyInArrow(common.trimmed(reply), "bucket int, target int, bits binary, large binary")
    sent = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(common.trimmed(send), "target int, keys binary, sketches binary")
    return sent.groupBy("target").applyInArrow(common.trimmed(compare), "a long, b long, dist long").distinct()


def _entries(keys: np.ndarray, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), _ENTRY)
    out["key"], out["at"], out["slot"] = keys, row, slot
    return out


def near_pairs(sketch: np.ndarray, at: np.ndarray, slot: int, percent: int) -> np.ndarray:
    """(a, b, dist) of the classes ``at``, which share the key of a slot: those of different components within the distance that may be similar
    enough; a pair that shares several keys is taken at the first of them only."""
    out = []
    for x in range(0, len(at), 256):
        a = sketch[at[x : x + 256]]
        for y in range(x, len(at), 1024):
            b = sketch[at[y : y + 1024]]
            ok = (a["comp"][:, None] != b["comp"][None, :]) & (100 * np.minimum(a["n"][:, None], b["n"][None, :]) >= percent * np.maximum(a["n"][:, None], b["n"][None, :]))
            if y < x + 256:
                ok &= np.arange(x, x + len(a))[:, None] < np.arange(y, y + len(b))[None, :]
            i, j = np.nonzero(ok)
            for s in range(0, len(i), 1 << 13):
                i_, j_ = i[s : s + (1 << 13)], j[s : s + (1 << 13)]
                same = (a["sig"][i_] == b["sig"][j_]).reshape(len(i_), CHUNKS, 4)
                d = SYMBOLS - same.sum(axis=(1, 2))
                chunk = np.argmax(same.sum(axis=2) >= 3, axis=1)
                first = 4 * chunk + np.argmin(same[np.arange(len(i_)), chunk], axis=1)
                near = np.flatnonzero((d <= MAX_DISTANCE) & (first == slot))
                p, q = i_[near], j_[near]
                may = plausible(a["low"][p], b["low"][q], a["n"][p], b["n"][q], percent)
                x_id, y_id = a["id"][p][may], b["id"][q][may]
                out.append(np.stack([np.minimum(x_id, y_id), np.maximum(x_id, y_id), d[near][may]], axis=1))
    return np.unique(np.concatenate([np.zeros((0, 3), np.int64), *out]), axis=0)


# ---------------------------------------------------------------- confirmation on full sets


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b) of the pairs with 100 * intersection >= percent * union of their full shingle sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([s.tobytes() for s in shingle_sets(_text_table(b), size)], pa.binary())
            yield pa.record_batch([b.column(0), found], names=["id", "s"])
        common.trim()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
        common.trim()

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    few = 2 * pairs.count() <= common.MAX_BROADCAST_IDS  # else the texts are shuffled to their ids
    found = _texts(docs, id_col, text_col).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(sets, "id long, s binary")
    # both sides read one exchange of the sets
    x, y = (found.select(F.col("id").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "sa", "sb").mapInArrow(judge, "a long, b long").distinct()


def _crossing(near: DataFrame, comp: DataFrame) -> DataFrame:
    """(a, b, dist) of the links between different components."""
    x, y = (comp.select(F.col("v").alias(k), F.col("comp").alias(f"c{k}")) for k in "ab")
    return near.join(x, "a", "left").join(y, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "dist")


def _best(near: DataFrame) -> DataFrame:
    """(a, b): one link for each class at the end b, the smallest id within the distance LIKELY, else the nearest."""
    rank = F.struct((F.col("dist") > LIKELY).alias("far"), F.when(F.col("dist") <= LIKELY, F.col("a")).alias("first"), "dist", "a")
    return near.groupBy("b").agg(F.min(rank).alias("m")).select(F.col("m.a").alias("a"), "b")


# ---------------------------------------------------------------- the operator


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    sk, _ = common.saved(sketches(docs, size, id_col, text_col), "sketches")
    real = sk.where("n_shingles > 0 and doc_id is not null")
    reps = real.groupBy("fp1", "fp2", F.col("n_shingles").alias("n")).agg(F.min(F.struct("doc_id", "sig", "low")).alias("r"))
    reps, _ = common.saved(reps.select("fp1", "fp2", "n", F.col("r.doc_id").alias("id"), F.col("r.sig").alias("sig"), F.col("r.low").alias("low")), "classes")
    member = real.join(reps, [real.fp1 == reps.fp1, real.fp2 == reps.fp2, real.n_shingles == reps.n]).select("doc_id", "id")
    # an id with several texts is one document: it joins the classes of all of them
    spread = member.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("top")).where("a < top")
    spread = member.join(spread, "doc_id").select("a", F.col("id").alias("b")).where("a <> b").distinct()

    links, comp, tested, paths = spread, components(spread), None, []
    for source in ("stars", "foreign"):
        if source == "stars":
            near = near_links(star_links(reps), reps, percent)
        else:
            others = reps.join(comp, reps.id == comp.v, "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), "sig", "low")
            near = foreign_links(others, percent)
            near = near if tested is None else near.join(tested, ["a", "b"], "left_anti")
        near, path = common.saved(common.narrow(near, heavy=True), "near-links")
        paths.append(path)
        for turn in range(3):
            # some turns take one link of each class only, since one confirmed link joins whole components; then all that is left
            open_links = _crossing(near, comp)
            open_links = open_links if tested is None else open_links.join(tested, ["a", "b"], "left_anti")
            todo, path = common.saved(common.narrow(_best(open_links) if turn < 2 else open_links.select("a", "b")), "todo")
            paths.append(path)
            if todo.isEmpty():
                break
            tested = todo if tested is None else tested.union(todo)
            new, path = common.saved(common.narrow(confirmed(todo, docs, size, percent, id_col, text_col), heavy=True), "links")
            paths.append(path)
            if not new.isEmpty():
                links = links.union(new)
                comp = components(links)
    own = sk.join(reps.select("fp1", "fp2", F.col("n").alias("n_shingles"), "id"), ["fp1", "fp2", "n_shingles"], "left")
    common.drop(docs.sparkSession, *paths)  # what is left to compute reads sketches, classes and labels only
    own = own.join(comp, own.id == comp.v, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "id", "doc_id")).alias("component_id"))
    return own.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` of which one document of each component stays (the smallest id); of several rows with one id, one."""
    gone = near_duplicates(docs, size, percent, id_col, text_col).where("not kept").select("doc_id")
    left = common.without(docs, gone, id_col)
    again = left.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    return left if again.isEmpty() else left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=2)
