import collections
import hashlib
import itertools
import re
import struct
import textwrap
import zlib

import numpy as np
import pytest
from helpers import oracle, rows_of
from pyspark.sql import functions as F

from spanloom.llm import common, components, decontamination, html_text, license_scan, minhash_dedup, quality_classifier, quality_rules, queries, source_mix, substring_dedup, suffix_dedup, token_files
from spanloom.llm.run_index import RunIndex, packed, suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    got = queries.queries()[name](spark, sf).toPandas()
    assert rows_of(got) == rows_of(oracle(queries.oracle_sql()[name], sf))


# ---------------------------------------------------------------- 1 quality classifier


def test_quality_classifier(spark, corpus, empty):
    good = [f"good plain words number {i} about many things and others" for i in range(60)]
    bad = [f"BUY ### now $$$ click {i} *** win &&& cash" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(500, 1), (3, None)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    s = {r.doc_id: r.score for r in quality_classifier.scored(docs, model).collect()}
    assert all((s[i] > 0.5) == (i < 60) for i in range(120)) and all(0 <= v <= 1 for v in s.values())
    out = quality_classifier.scored(corpus, model)  # a column named score is replaced
    assert out.count() == corpus.count() and out.where("score is null or not (score between 0 and 1)").isEmpty()
    assert quality_classifier.scored(empty, model).count() == 0
    none = quality_classifier.fit(docs, labels.where("quality = 1"))
    assert quality_classifier.scored(docs, none).select("score").distinct().count() == 1
    assert quality_classifier.fit(docs, labels.limit(0)).scorer()("x") == 0.5
    held = {r.doc_id for r in docs.where(quality_classifier.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i in range(120) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_quality_of_long_texts_and_other_columns(spark):
    model = quality_classifier.fit_texts(["plain good words about things " * 9] * 9, ["### $$$ BUY *** " * 9] * 9)
    texts = [None, "", "plain good words about things " * 100_000, "### $$$ BUY *** " * 100_000, "x"]
    d = spark.createDataFrame([(i, bytearray((t or "").encode()) if t is not None else None, "mine") for i, t in enumerate(texts)], "doc_id long, text binary, __score_text string")
    got = {r.doc_id: r for r in quality_classifier.scored(d, model).collect()}
    assert got[0].score == got[1].score and got[2].score > 0.5 > got[3].score and {r["__score_text"] for r in got.values()} == {"mine"}
    assert quality_classifier.scored(d.limit(0), model).columns == ["doc_id", "text", "__score_text", "score"]


def test_quality_on_held_out_rows(spark, sf):
    """On sf0.1, which has about 120 bad documents among the held-out ones (sf0.01 has 11)."""
    folder = sf.replace("0.001", "0.1")
    d = queries.queries()["op1_quality_classifier"](spark, folder).where("held_out")
    rows = d.join(common.table(spark, folder, "labels"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9 and np.mean([g >= 0.3 for g in good]) > 0.95 and np.mean([b >= 0.3 for b in bad]) < 0.4
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


# ---------------------------------------------------------------- 2 decontamination


def test_decontamination(spark, corpus, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    w = item.split()
    every_fourth = " ".join(x if i % 4 != 3 else "other" for i, x in enumerate(w))
    rows = [(1, f"so {item} it is"), (2, "Alpha, " + ", ".join(w[1:]).upper()), (3, every_fourth), (4, " ".join(w[:8])), (5, " ".join(reversed(w))), (6, None), (7, ""), (1, f"so {item} it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (9, item), (8, None), (7, "too short")], "item_id long, text string")
    got = {(r.doc_key, r.item_key): (r.n_equal, r.n_tokens) for r in decontamination.overlaps(docs, items).collect()}
    assert set(got) == {(1, 9), (2, 9), (3, 9)} and got[(1, 9)] == (16, 16) and got[(3, 9)][0] == 12
    assert sorted(r.doc_id for r in decontamination.clean(docs, items).collect()) == [4, 5, 6, 7]
    assert decontamination.clean(corpus, items).count() == corpus.count() and decontamination.clean(empty, items).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == 8
    old, decontamination.MAX_BROADCAST_ROWS = decontamination.MAX_BROADCAST_ROWS, 0
    try:
        assert decontamination.overlaps(docs, items).count() == 3  # the way without broadcast
    finally:
        decontamination.MAX_BROADCAST_ROWS = old


def test_decontamination_finds_all_it_accepts(spark):
    rows, want = [], set()
    for n in (*range(1, 17), 19):
        w = [f"w{n}x{k}" for k in range(n)]
        k = min(n, 16)
        accepted = [c for d in range(k) if k - d >= 0.7 * k and (n >= 7 or d == 0) for c in itertools.combinations(range(k), d)]
        refused = [] if n == 19 else [c for c in itertools.combinations(range(n), 5) if n - 5 < 0.7 * n][:50]
        for c in accepted + refused:
            rows.append((len(rows), n, " ".join(["before", *("other" if x in c else y for x, y in enumerate(w[:k])), "behind"])))
            if c in accepted:
                want.add((len(rows) - 1, n, k - len(c), k))
    docs = spark.createDataFrame(rows, "doc_id long, n long, text string")
    items = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in (*range(1, 17), 19)], "item_id long, text string")
    assert {(r.doc_key, r.item_key, r.n_equal, r.n_tokens) for r in decontamination.overlaps(docs, items).collect()} == want


# ---------------------------------------------------------------- 3 substring dedup


@pytest.mark.parametrize("window,period,cover", [(35, 21, (0, 1, 4, 14, 16)), (9, 7, (0, 1, 3)), (5, 3, (0, 1))])
def test_substring_dedup(corpus, plain, empty, window, period, cover):
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    seen = collections.Counter()
    cut = [(d, WORD.findall(t or "")) for d, t, _ in plain]
    for _, w in cut:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    want = []
    for d, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup.repeated_words(corpus, window, period, cover).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 0
    assert substring_dedup.repeated_words(empty).count() == 0


# ---------------------------------------------------------------- 4 suffix dedup


@pytest.mark.parametrize("length", [100, 40])
def test_suffix_dedup(corpus, plain, empty, length):
    counts = collections.Counter(d for d, _, _ in plain)
    seen, want = set(), {}
    for d, t, _ in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want.setdefault(d, []).append((len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    got = {}
    for r in suffix_dedup.repeated_bytes(corpus, length, with_spans=True).collect():
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans
        got.setdefault(r.doc_id, []).append(tuple(r)[1:5])
    for d, n in counts.items():
        if n == 1:
            assert got[d] == want[d]
        else:  # rows of one id: their order is by bucket, what is removed in all is the same
            assert sorted(x[0] for x in got[d]) == sorted(x[0] for x in want[d]) and sum(x[1] for x in got[d]) == sum(x[1] for x in want[d])
    assert suffix_dedup.repeated_bytes(empty).count() == 0


def test_run_index():
    rng = np.random.default_rng(3)
    for _ in range(25):
        letters = int(rng.integers(2, 5))
        base = bytes(rng.integers(0, letters, int(rng.integers(1, 60)), dtype=np.uint8))
        strings = []
        for _ in range(int(rng.integers(1, 9))):
            b = bytearray(base[int(rng.integers(len(base))) :])
            b[int(rng.integers(len(b)))] = int(rng.integers(letters))
            strings.append(bytes(b))
        index = RunIndex(strings, 4)
        key = lambda p: [(1, x) for x in strings[p[0]][p[1] :]] + [(0, p[0])]  # noqa: E731,B023
        order = sorted(((i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)), key=key)
        places = [int(index.starts[i] + j) for i, j in order]
        assert suffix_order(index.text, index.ends, packed(index.text, index.ends)).tolist() == places
        patterns = [*strings, bytes(rng.integers(0, letters, 20, dtype=np.uint8))]
        for at, lanes, length, row, place in index.matching_statistics(patterns):
            for a, lane, n, q, p in zip(at, lanes, length, row, place):
                own = patterns[lane][a:]
                longest = max((k for s in strings for j in range(len(s)) for k in range(len(own) + 1) if s[j : j + k] == own[:k] and len(s[j : j + k]) == k), default=0)
                assert n == longest and (not n or (places[q] == p and bytes((index.text[p : p + n] - 1).astype(np.uint8)) == own[:n]))


# ---------------------------------------------------------------- 5 mixing


def test_source_mix(spark, corpus, plain, empty):
    got = source_mix.mix(corpus).collect()
    assert len(got) == len(plain)
    sizes = collections.defaultdict(int)
    for _, t, s in plain:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, capped, total = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
    for s in order:
        assert sum(r.taken for r in got if r.source == s) == int(target[s] + 1e-6)
    assert sorted(map(str, got)) == sorted(map(str, source_mix.mix(corpus.repartition(1)).collect()))
    out = source_mix.mixed(corpus)
    assert out.columns == corpus.columns and sum(len(WORD.findall(r.text)) for r in out.collect()) == sum(r.taken for r in got)
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed(empty).count() == 0
    assert source_mix.mixed(corpus.withColumn("text", F.lit(None).cast("string"))).count() == 0


# ---------------------------------------------------------------- 6 licences


def test_license_scan(spark, corpus, empty):
    from spanloom.llm.license_templates import TEMPLATES

    mit = TEMPLATES["MIT"][2]
    w = mit.split(" ")
    few = " ".join(x for i, x in enumerate(w) if i not in (20, 45))
    rows = [
        (1, "prose and prose\nReleased under the MIT License.\nmore prose about nothing at all"), (2, "This work is licensed under the GNU General Public License, version 2."),
        (3, f"code\n{mit}\ncode"), (4, few), (5, " ".join(w[:30])), (6, "a licensed person with permission"), (7, None), (8, ""),
        (9, "Copyright (c) 2020 Somebody. All rights reserved.\nLicensed under CC BY-SA 4.0.\nLicensed under CC BY-NC 4.0."), (1, "Released under the MIT License."),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = collections.Counter((r.doc_id, r.license_id, r.n_missing) for r in got)
    assert found[(1, "MIT", 0)] == 2 and found[(2, "GPL-2.0", 0)] == 1 and found[(3, "MIT", 0)] == 1 and found[(4, "MIT", 2)] == 1
    assert not {d for d, _, _ in found} & {5, 6, 7, 8} and {i for d, i, _ in found if d == 9} == {"Proprietary", "CC-BY-SA-4.0", "CC-BY-NC-4.0"}
    assert [r.line for r in got if r.doc_id == 3] == [1]
    assert license_scan.scan(corpus).count() == 0 and license_scan.scan(empty).count() == 0


@pytest.mark.parametrize("hyphens", [True, False])
@pytest.mark.parametrize("prefix", ["", " * "])
def test_license_notices_wrapped(prefix, hyphens):
    scanner = license_scan.Scanner()
    for i, k, w, _, _ in scanner.templates:
        text = license_scan.TEMPLATES[i][k].replace("<year> <holder>", "2020 Somebody")
        for lead in (0, 50):  # the notice begins anywhere in a line
            for width in range(60, 81):
                lines = textwrap.wrap("x" * lead + " " + text if lead else text, width, break_on_hyphens=hyphens)
                got = scanner.notices("\n".join(prefix + x for x in ["some prose", *lines, "more prose"]))
                assert [(n.license_id, n.missing) for n in got] == [(i, ())], (i, k, width, got)
                assert "<" in license_scan.TEMPLATES[i][k] or (got[0].template, got[0].n_words) == (k, len(w))


@pytest.mark.parametrize("between", ["\n", " "])
def test_license_list_of_all_notices(between):
    scanner = license_scan.Scanner()
    every = [(i, k, t) for i, many in license_scan.TEMPLATES.items() for k, t in enumerate(many) if "<" not in t]
    got = scanner.notices(between.join(t for _, _, t in every * 2))
    assert collections.Counter((n.license_id, n.template) for n in got) == collections.Counter((i, k) for i, k, _ in every * 2)
    grant = license_scan.TEMPLATES["MIT"][2].split()
    around = " ".join([*grant[:40], license_scan.TEMPLATES["Apache-2.0"][1], *grant[40:]])
    assert {(n.license_id, n.template) for n in scanner.notices(around)} == {("MIT", 2), ("Apache-2.0", 1)}


def test_license_lines_of_the_test_data(spark, sf):
    got = {(r.doc_id, r.license_id) for r in license_scan.op6_license_scan(spark, sf).collect()}
    lines = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary"}
    want = {(r.doc_id, i) for r in common.table(spark, sf, "documents").collect() for x, i in lines.items() if x in r.text}
    assert got == want


def test_license_files():
    T, scanner = license_scan.TEMPLATES, license_scan.Scanner()
    fill = lambda text, width: "\n".join(textwrap.wrap(text, width))
    mit = f"The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n\n{fill(T['MIT'][2], 80)}\n\n{fill(T['MIT'][3][len(T['MIT'][2]) + 1 :], 80)}"
    assert [(n.license_id, n.template, n.line, n.missing) for n in scanner.notices(mit)] == [("MIT", 3, 4, ())]
    assert [(n.license_id, n.template) for n in scanner.notices(fill(T["BSD-2-Clause"][1], 72))] == [("BSD-2-Clause", 1)]
    assert [n.license_id for n in scanner.notices("// SPDX-License-Identifier: GPL-2.0-only\ncode")] == ["GPL-2.0"]
    every = sorted(i for i in T if any(len(license_scan.words(t)) < license_scan.SHORT for t in T[i]))
    listed = "\n".join(next(t for t in T[i] if len(license_scan.words(t)) < license_scan.SHORT) for i in every)
    assert sorted(n.license_id for n in scanner.notices(listed)) == every
    # 200 KB of prose around a notice, and a notice that is a line of 100 KB
    prose = "words of prose without any meaning " * 3000
    assert [(n.license_id, n.line) for n in scanner.notices(f"{prose}\n{mit}\n{prose}")] == [("MIT", 5)]
    assert [n.license_id for n in scanner.notices(f"{prose} Licensed under the MIT License. {prose}")] == ["MIT"]


def test_license_scan_against_plain_search(spark, sf):
    folder = sf.replace("0.001", "0.01")
    got = {(r.doc_id, r.license_id) for r in license_scan.op6_license_scan(spark, folder).collect()}
    short = [(i, license_scan.words(t)) for i, many in license_scan.TEMPLATES.items() for t in many if len(license_scan.words(t)) < license_scan.SHORT and "<" not in t]
    want = set()
    for r in common.table(spark, folder, "documents").collect():
        said = "\n" + "\n".join(license_scan.words(r.text or "")) + "\n"
        want |= {(r.doc_id, i) for i, w in short if "\n" + "\n".join(w) + "\n" in said}
    assert got == want and want


def test_license_scan_ignores_other_columns(spark):
    d = spark.createDataFrame([(1, "Licensed under the MIT License.", "x", 3), (2, None, "y", 4)], "doc_id long, text string, license_id string, line long")
    assert [(r.doc_id, r.license_id, r.line) for r in license_scan.scan(d).collect()] == [(1, "MIT", 0)]


# ---------------------------------------------------------------- 7 near duplicates


def components_of(plain, size, percent):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = [], {d: d for d, _, _ in plain if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t, _ in plain:
        w = WORD.findall((t or "").translate(fold))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
        sets.append((d, s))
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else root(d)) for d, s in sets]


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_dedup(corpus, plain, empty, size):
    got = minhash_dedup.near_duplicates(corpus, size).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(str, components_of(plain, size, 80)))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert minhash_dedup.near_duplicates(empty, size).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_recall(spark, sf, size):
    """Every pair of sf0.01 that is similar enough, found by exact prefix filtering, is in one component, and nothing else is joined."""
    docs = common.table(spark, sf.replace("0.001", "0.01"), "documents")
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[r.doc_id] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    often, holders, parent = collections.Counter(x for s in sets.values() for x in s), collections.defaultdict(list), {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sorted(sets.items(), key=lambda x: len(x[1])):
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-8 * len(s) // 10) + 1]
        for e in {e for x in rare for e in holders[x]}:
            if 100 * len(s & sets[e]) >= 80 * len(s | sets[e]):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
        for x in rare:
            holders[x].append(d)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs, size).collect()} == {d: root(d) for d in sets}


def test_deduplicated_keeps_one_of_each(corpus, plain):
    left = minhash_dedup.deduplicated(corpus)
    want = {d for d, _, c in components_of(plain, 5, 80) if d is not None and d == c}
    assert left.columns == corpus.columns and sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(want)


def test_pairs_within_a_key(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, minhash_dedup.SYMBOLS, dtype=np.uint16)
    rows = []
    for i in range(60):
        s = base.copy()
        at = rng.choice(minhash_dedup.SYMBOLS, int(rng.integers(0, 24)), replace=False)
        s[at] = rng.integers(0, 1 << 16, len(at))
        rows.append(s)
    sigs, low = np.stack(rows), np.arange(100, dtype="<u4")
    keys = minhash_dedup.keys_of(sigs)
    want = {(i, j): int((sigs[i] != sigs[j]).sum()) for i in range(60) for j in range(i + 1, 60) if (sigs[i] != sigs[j]).sum() <= minhash_dedup.MAX_DISTANCE}
    sketch = np.zeros(60, minhash_dedup._SKETCH)
    sketch["id"] = sketch["comp"] = np.arange(60)
    sketch["n"], sketch["sig"], sketch["low"] = 100, sigs, minhash_dedup._PAD
    sketch["low"][:, :100] = low
    found = {}
    for slot in range(keys.shape[1]):
        for k in np.unique(keys[:, slot]):
            found |= {(int(a), int(b)): int(d) for a, b, d in minhash_dedup.near_pairs(sketch, np.flatnonzero(keys[:, slot] == k), slot, 80)}
    assert found == want
    reps = spark.createDataFrame([(i, 100, i, bytearray(sigs[i].astype("<u2").tobytes()), bytearray(low.tobytes())) for i in range(60)], "id long, n long, comp long, sig binary, low binary")
    for large in (minhash_dedup.LARGE_KEY, 3):  # whole, and split by the keys of other chunks
        assert {(r.a, r.b): r.dist for r in minhash_dedup.foreign_links(reps, 80, large).collect()} == want
    one = minhash_dedup.foreign_links(reps.withColumn("comp", F.col("id") % 2), 80, 3)
    assert {(r.a, r.b) for r in one.collect()} == {(a, b) for a, b in want if a % 2 != b % 2}


def test_sketch_bounds_the_similarity():
    rng = np.random.default_rng(2)
    for n, shared in ((80, 70), (80, 40), (3000, 2700), (3000, 1500)):
        both = np.unique(rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2))
        a, b = np.sort(both[rng.permutation(len(both))][:n]), None
        b = np.sort(np.concatenate([np.setdiff1d(both, a), rng.permutation(a)[:shared]]))
        pad = lambda s: np.concatenate([minhash_dedup.lowest(s), np.full(max(0, minhash_dedup.LOWEST - len(s)), minhash_dedup._PAD, np.uint32)])[None]
        j = shared / (2 * n - shared)
        got = bool(minhash_dedup.plausible(pad(a), pad(b), np.asarray([n]), np.asarray([len(b)]), 80)[0])
        assert got if j >= 0.78 else not got or j > 0.65


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 60), (7, 7), (200, 201)]
    got = {r.v: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", (0, 40, 1 << 20))
def test_components_in_one_task(spark, monkeypatch, most):
    """Edges that one task holds are contracted there, in a number of jobs that does not follow the number of rounds; whichever way, results are the same."""
    rng = np.random.default_rng(3)
    chain = rng.permutation(200).tolist()
    edges = [*zip(chain, chain[1:]), *((1000, k) for k in range(1001, 1050)), (5000, 5000), (-7, -(1 << 62)), (7000, 6999), (7000, 6998), (6990, 6998)]
    monkeypatch.setattr(components, "ONE_TASK", most, raising=False)
    tracker, group = spark.sparkContext.statusTracker(), f"components-{most}"
    spark.sparkContext.setJobGroup(group, group)
    got = {r.v: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = {k: 0 for k in range(200)} | {k: 1000 for k in range(1000, 1050)} | {-7: -(1 << 62), -(1 << 62): -(1 << 62)} | dict.fromkeys((6990, 6998, 6999, 7000), 6990)
    assert got == want
    assert most < 1 << 20 or jobs <= 8


# ---------------------------------------------------------------- 8 token files


def test_token_files(spark, corpus, plain, empty):
    path = common.new_path(spark, "t")
    token_files.write(corpus, path, token_files.tokenizer_path(), end_id=2)
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.tokenizer_path())
    want, at = [], 0
    for d, t, _ in sorted(plain, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), ids))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    path = common.new_path(spark, "t")
    token_files.write(empty, path, token_files.tokenizer_path(), end_id=2)
    assert token_files.read(spark, path).count() == 0


def test_only_pieces_that_share_a_minimizer_are_indexed(monkeypatch):
    rng, length, made, real = np.random.default_rng(5), 100, [], suffix_dedup.RunIndex
    monkeypatch.setattr(suffix_dedup, "RunIndex", lambda strings, depth: (made.append(len(strings)), real(strings, depth))[1])
    some = rng.integers(97, 101, 3000).astype(np.uint8).tobytes()
    texts = [some, b"ab" * 400, b"a" * 700, b"", some, some[500:900], b"x" + some[:1200] + b"y" + some[100:300], b"abc" * 100 + some[7:207], rng.integers(0, 256, 900).astype(np.uint8).tobytes(), b"short"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    seen, want = set(), set()
    for a, b in zip(offsets, offsets[1:]):
        for x in range(a, b - length + 1):
            w = data[x : x + length].tobytes()
            want |= {x} if w in seen else set()
            seen.add(w)
    for segment, index in ((150, 1 << 19), (1 << 16, 1), (1 << 23, 1 << 19)):
        monkeypatch.setattr(suffix_dedup, "_SEGMENT", segment)
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", index)
        begin, end, key = suffix_dedup.pieces(data, offsets, length)
        known, opening, got = {}, [], set()
        for i, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
            if known.setdefault(data[x : y + length].tobytes(), i) == i:
                opening.append(i)
            else:
                got |= set(range(x, y + 1))
        made.clear()
        for i, flags in zip(opening, suffix_dedup.earlier_windows(list(known), key[opening], length), strict=True):
            got |= set((np.flatnonzero(flags) + begin[i]).tolist())
        assert got == want
        several = dict(zip(*np.unique(key[opening], return_counts=True)))
        assert 0 < sum(made) == sum(n for n in several.values() if n > 1) < len(opening)


def test_encoder_remembers_and_forgets(monkeypatch):
    from tokenizers import Tokenizer

    path = token_files.tokenizer_path()
    tok, enc, sent = Tokenizer.from_file(path), token_files.Encoder(path), []
    learn = enc._learn
    enc._learn = lambda missing: (sent.append(len(missing)), learn(missing))[1]
    many = [" ".join(f"w{chr(97 + i % 26)}{i:x}" for i in range(k, k + 30_000)) for k in range(0, 300_000, 30_000)]
    for t in many:
        enc.ids([t])
    assert sum(sent) >= 300_000
    sent.clear()
    for t in many:
        enc.ids([t])
    assert not sum(sent)  # chunks in use are encoded once

    odd = ["", "a", "\n", " a", "a ", "a  b", "a,b. c.\nd,\ne", "x.", ",x", "..", "é,è.", "1,2.3", "日本 語", "<|endoftext|>", "a <|endoftext|> b", "don't, can't.", "a\x01b", "\x02", "a\nb c\nd", ".", ", ,", "a ,b", "a\tb", "a" * 5000, "\n\n"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in odd + many[:2]]
    monkeypatch.setattr(token_files, "_CACHE", 4)
    for cut in (1, 20, 1 << 20):
        monkeypatch.setattr(token_files, "_CUT", cut)
        enc = token_files.Encoder(path)
        for _ in range(2):
            assert [x.tolist() for x in enc.ids(odd + many[:2])] == want
            for t, w in zip(odd, want):
                assert [x.tolist() for x in enc.ids([t])] == [w]
        assert enc.ids([]) == []


def test_codes():
    rng = np.random.default_rng(0)
    for n, v in ((0, 5), (1, 5), (127, 3), (128, 1), (129, 2), (5000, 50000), (40000, 3000)):
        ids = rng.zipf(1.3, n) % v
        lengths = token_files.code_lengths(np.bincount(ids, minlength=v))
        assert lengths.max(initial=0) <= token_files.MAX_BITS and (n == 0 or (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1 + 1e-9)
        bits, marks = token_files.pack(ids, token_files.canonical(lengths), lengths)
        assert (token_files.unpack(bits, marks, n, token_files.decode_table(lengths)) == ids).all()
    counts = np.asarray([1, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512])
    short = token_files.code_lengths(counts, 5)
    assert short.max() == 5 and token_files.code_lengths(counts).max() == 10
    with pytest.raises(ValueError):
        token_files.read_shard(b"nope", lengths, None)


# ---------------------------------------------------------------- 9 quality rules


def test_quality_rules(spark, corpus, plain, empty):
    got = quality_rules.judge(corpus, max_docs=3).collect()
    lines, texts = collections.defaultdict(set), []
    for d, t, s in plain:
        for x in (t or "").split("\n"):
            if WORD.search(x):
                lines[(s, x.strip(" \t\n\v\f\r").lower())].add(d)
    for d, t, s in plain:
        t = t or ""
        w, own = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.defaultdict(list)
        for i in range(len(w) - 2):
            grams[tuple(w[i : i + 3])].append(i)
        covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        gone = sum(len(WORD.findall(x)) for x in own if len(lines[(s, x.strip(" \t\n\v\f\r").lower())]) > 3)
        texts.append((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), len(covered), failed, gone, not failed and len(w) - gone >= 0.5 * len(w)))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, texts))
    assert quality_rules.judge(empty).count() == 0


def test_lines_count_documents(spark):
    rows = [(i, "same line  \r\nof all\n" + f"own {i}", "h") for i in range(4)] * 2 + [(i, "Same line\nelse", "g") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.n_docs for r in quality_rules.frequent_lines(docs, 3).collect()) == [4, 4]
    got = {(r.doc_id, r.n_words): r.n_removed_words for r in quality_rules.judge(docs, 3).collect()}
    assert got == {**{(i, 6): 4 for i in range(4)}, **{(i, 3): 0 for i in range(3)}}
    old, quality_rules.MAX_BROADCAST_LINES = quality_rules.MAX_BROADCAST_LINES, 0
    try:
        assert quality_rules.judge(docs, 3).agg(F.sum("n_removed_words")).first()[0] == 32  # the way without broadcast
    finally:
        quality_rules.MAX_BROADCAST_LINES = old


def test_repeats_in_a_very_long_text(spark):
    w = [f"w{i}" for i in range(300_000)]
    w[200_000:200_004] = w[100:104]
    d = spark.createDataFrame([(1, " ".join(w), "s")], "doc_id long, text string, source string")
    assert quality_rules.base_rules(d).select("n_words", "n_repeat_words").first()[:] == (300_000, 8)


# ---------------------------------------------------------------- 10 html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site head</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
{open}<h1>A &amp; B</h1><p>First   paragraph with <b>bold text that<br>goes on</b> and on.<p>To.<div class="ad">Buy now</div>
<ul><li>One item of a list</li><li>Two items of a list</li></ul><form>Your name <input></form><section id="comments"><p>I like this long comment very much indeed</p></section>{close}
<aside>Related things</aside><footer>&copy; foot</footer></body></html>"""
MAIN = "A & B\n\nFirst paragraph with bold text that goes on and on.\n\nTo.\n\nOne item of a list\n\nTwo items of a list"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html_text.main_text(PAGE.replace("{open}", f"<{tag}>").replace("{close}", f"</{tag}>")) == MAIN


def test_html_region_holds_all_text():
    def prose(n):
        return " ".join(["some plain words of a long text"] * n)

    links = "".join(f"<span><a href=/{i}><b>go {i}</b></a></span>" for i in range(4))
    for long, shorter in ((6, 4), (7, 3), (9, 1), (40, 5)):
        content = f"<div id=content><div class=part>{prose(long)}</div><div class=part>{prose(shorter)}</div></div>"
        for top in ("", f"<div>{links}</div><div>{links}</div><div>{links}</div>"):
            got = html_text.main_text(f"<body>{top}{content}</body>")
            assert got == f"{prose(long)}\n\n{prose(shorter)}", (long, shorter, bool(top))
    items = "".join(f"<li><b><i>{i}</i></b></li>" for i in range(9))
    nine = "\n\n".join("012345678")
    assert html_text.main_text(f"<article><p>{prose(9)}</p></article><article><ul>{items}</ul></article>") == prose(9) + "\n\n" + nine
    assert html_text.main_text(f"<main><ul>{items}</ul></main><div><p>{prose(9)}</p></div>") == nine + "\n\n" + prose(9)


def test_html_names_are_evidence():
    long = "some plain words of a long text " * 4
    text = long.strip()
    inside = f'<p class="legal">{long}</p><p class="notice-board share">{long}</p><p>An <span class="copyright">inline</span> name</p><h2 class="banner">Head</h2>'
    want = f"{text}\n\n{text}\n\nAn inline name\n\nHead"
    assert html_text.main_text(f"<body><div class=menu>Home</div><article>{inside}<div class=share>Share</div></article><p class=legal>c</p></body>") == want
    # a container with a name that holds the article, or most of the text, is no sidebar
    assert html_text.main_text(f'<div class="with-sidebar sidebar"><article><p>{long}</p></article><div class="sidebar">x</div></div>') == text
    assert html_text.main_text(f'<div class="content sidebar"><p>{long}</p><p>{long}</p></div><div class="ad">Buy this now</div>') == f"{text}\n\n{text}"
    # reader comments go even where they are longer than the article
    assert html_text.main_text(f'<article><p>{long}</p></article><div id="comments"><p>{long * 9}</p></div>') == text
    assert html_text.main_text(f'<article><p>{long}</p><section class="comments"><p>{long * 9}</p></section></article>') == text
    assert html_text.main_text('<div class="ad">only this</div>') == "only this"


def test_html_work_grows_with_length():
    import time

    for page in ("<span><div>" * 8000, "<span><div>x" * 8000, '<div class="ad"><p>x' * 8000, "<li><b>x" * 8000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 5


def test_html_pages_of_the_test_data(spark, sf):
    import html as entities

    for r in common.table(spark, sf, "pages").collect():
        got = html_text.main_text(r.html)
        said = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = [" ".join(entities.unescape(re.sub(r"<(?!p|h1|/p|/h1)[^>]*>", " " if "<br" in x else "", x.replace("<br>", "\n"))).split()) for x in re.split(r"</?(?:p|h1)>", said)]
        assert got == "\n\n".join(x for x in want if x)


def test_html_edges(spark):
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain", "<p>cut off &lt;tag", "<p>end <foo bar=", "<![bad <p>x</p>")][:6] == ["", "", "", "plain", "cut off <tag", "end"]
    html_text.main_text("<![bad <p>x</p>")
    html_text.main_text("<div>" * 3000 + "deep")
    d = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>", "t"), (2, None, None, None), (1, "u", "<article><p>x y</p></article>", "t")], "page_id long, url string, html string, text string")
    assert sorted(map(str, html_text.extract(d).collect())) == sorted(map(str, [d.sparkSession.createDataFrame([(1, "u", "x y")], "page_id long, url string, text string").first()] * 2 + [d.sparkSession.createDataFrame([(2, None, "")], "page_id long, url string, text string").first()]))
    assert html_text.extract(d.limit(0)).count() == 0
    clash = d.withColumn("__html", F.lit("mine")).withColumn("tags", F.lit(1))
    assert {(r["__html"], r.tags) for r in html_text.extract(clash).collect()} == {("mine", 1)}


def test_smoothing_and_threshold():
    assert html_text.smoothed([3.0]) == [3.0] and len(html_text.smoothed([1.0, 9.0, 1.0])) == 3
    assert 1 < html_text.threshold([1.0, 1.2, 9.0, 11.0]) < 9
