"""The pipeline's stages, each held against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
import pytest

from loomgraph.llm import entry, simhash
from loomgraph.llm._shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], SF), name))
    return docs


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "n_tokens", "token_ids"]


def test_toxic_rows_go(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in d.select("doc_id").collect()} for d in steps[:2])
    gone = before - after
    assert after <= before and gone
    assert sum(labels[d] for d in gone if d in labels) >= 0.8 * sum(1 for d in gone if d in labels)


def shingles(text):
    words = text.lower().split()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_one_of_each_group_stays(steps):
    before = {r.doc_id: shingles(r.text) for r in steps[1].collect()}
    after = {r.doc_id for r in steps[2].collect()}
    assert after <= set(before)
    kept = {d: before[d] for d in after}
    for d in set(before) - after:
        best = max(len(before[d] & s) / len(before[d] | s) for e, s in before.items() if e != d)
        assert best >= 0.8, d
    sets = Counter(kept.values())
    assert max(sets.values()) == 1
    loose = [d for d in after if any(e != d and len(kept[d] & s) / len(kept[d] | s) >= 0.8 for e, s in kept.items())]
    assert not loose


def test_mixture_keeps_every_document(steps):
    """Every document stays, none comes over twice, and sources are more alike than before."""
    before, after = (d.select("doc_id", "source", "text").collect() for d in steps[2:4])
    times = Counter(r.doc_id for r in after)
    assert set(times) == {r.doc_id for r in before} and max(times.values()) <= 2 and len(after) > len(before)
    tokens = [Counter() for _ in range(2)]
    for t, rows in zip(tokens, (before, after)):
        for r in rows:
            t[r.source] += len(r.text.split())
    assert min(tokens[1].values()) / max(tokens[1].values()) > min(tokens[0].values()) / max(tokens[0].values())


def test_ids_decode(steps):
    from loomgraph.llm.bpe import Codec, _pretok

    codec = Codec(entry.tokenizer("byte_bpe_multi_50k.tiktoken"), _pretok.tiktoken_classes())
    for r in steps[-1].select("text", "n_tokens", "token_ids").collect():
        assert r.n_tokens == len(r.token_ids)
        assert b"".join(codec.bytes_of[i] for i in r.token_ids) == r.text.encode()


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[-1].count()


def test_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text", "lang", "source", "score")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0 and out.columns[:5] == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_plan_is_the_similar_one():
    assert simhash.SIMILAR.words == 5
