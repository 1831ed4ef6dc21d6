"""Each stage against a plain version of it on its own input."""

import collections
import re

from test_operators import components_of

import corpus_pipeline as P
from spanloom.llm import common, quality_classifier, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out, _ = common.saved(stage(spark, docs, sf), name)
        if name != "token_files":
            assert out.columns == columns
        ids = collections.Counter(r.doc_id for r in out.collect())
        if name == "quality_classifier":
            score = quality_classifier.fit(docs, common.table(spark, sf, "labels")).scorer()
            assert ids == collections.Counter(d for d, t, _ in before if score(t or "") >= 0.3) and 0 < sum(ids.values()) < len(before)
        if name == "minhash_near_dedup":
            assert set(ids) == {d for d, _, c in components_of(before, 5, 80) if d == c} and max(ids.values()) == 1
        if name == "benchmark_decontamination":
            items = [r.text for r in common.table(spark, sf, "benchmark").collect()]
            assert set(ids) == {d for d, t, _ in before if not any(i in t for i in items)}
        if name == "source_mix":
            taken = {r.doc_id: r.taken for r in source_mix.mix(docs).collect()}
            words = collections.Counter()
            for r in out.collect():
                words[r.doc_id] += len(WORD.findall(r.text))
            assert dict(words) == {d: n for d, n in taken.items() if n}
        if name == "token_files":
            assert ids == collections.Counter(d for d, _, _ in before)
        kept[name], docs = sum(ids.values()), out
    assert [name for name, _ in P.STAGES] == list(kept)
    again = P.run(spark, sf)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, sf, corpus, empty):
    """Nulls, empty and long texts, repeated rows and clashing column names go through the whole chain."""
    for docs in (corpus, empty):
        columns = docs.columns
        for name, stage in P.STAGES:
            last, (docs, _) = docs, common.saved(stage(spark, docs, sf), name)
            assert docs.columns == (columns if name != "token_files" else ["doc_id", "start", "n_tokens", "ids_crc32"])
            assert docs.select("doc_id").subtract(last.select("doc_id")).isEmpty()
            if name == "source_mix":
                assert docs.where("text is null or text = ''").isEmpty()
        assert (docs.count() == 0) == (columns == empty.columns and last.count() == 0)
