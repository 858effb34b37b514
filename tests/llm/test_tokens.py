"""Operators 1, 4 and 5 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from loomgraph.llm import _pretok, bpe, token_counts, token_store  # noqa: E402

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_pieces_are_those_of_the_pattern():
    import regex

    pattern, table = regex.compile(P.PATTERN), _pretok.tiktoken_classes()
    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice("ab'sStdmrevl1 2\n\t .,!é中 ’") for _ in range(draw.randint(0, 14)))
        assert _pretok.pieces(text, table) == pattern.findall(text)


def test_classes_agree():
    assert (_pretok.tokenizers_classes() == _pretok.tiktoken_classes()).all()


def test_rank_queue_gives_least_rank_and_keeps_order():
    queue, draw = bpe.RankQueue(70_000), random.Random(1)
    there = {}
    for at in range(3000):
        rank = draw.randrange(70_000) if draw.random() < 0.8 else 17
        queue.push(rank, [at])
        there.setdefault(rank, []).append(at)
    while (rank := queue.first()) >= 0:
        assert rank == min(there)
        assert queue.take(rank) == sorted(there.pop(rank))
    assert not there and not any(queue.low) and not any(queue.mid) and not queue.top


def test_rank_merges_match_the_library(tiktoken_encoding):
    codec, draw = bpe.Codec(RANKS, _pretok.tiktoken_classes()), random.Random(2)
    texts = ["".join(draw.choice("aab é中\U0001f600xyzthe in") for _ in range(draw.randint(0, 60))) for _ in range(500)]
    texts += ["a" * 50_000, "ab" * 20_000, "the" * 10_000, " " * 9_000, "é" * 9_000, ""]
    for text, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_round_trip(which, request, tiktoken_encoding):
    docs = request.getfixturevalue(which)
    got = sorted(map(tuple, bpe.round_trip(docs, RANKS).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = np.array(tiktoken_encoding.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_keeps_other_columns(odd, empty, tiktoken_encoding):
    out = bpe.encode(odd, RANKS)
    assert out.columns == [c for c in odd.columns if c != "n_tokens"] + ["n_tokens", "token_ids"]
    for r in out.collect():
        assert r.token_ids == tiktoken_encoding.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) and r.score == 1.5
    assert bpe.encode(empty, RANKS).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_counts(which, request, library):
    docs = request.getfixturevalue(which)
    got = sorted(map(tuple, token_counts.token_counts(docs, JSON).collect()), key=str)
    want = []
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_proven_strings_are_single(library):
    proven = token_counts.proven_single(JSON)
    assert len(proven) > 30_000
    for s in random.Random(3).sample(proven, 300):
        assert len(library.encode(f"{s}", add_special_tokens=False).ids) == 1


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    made = token_store.PerfectHash.build(keys)
    assert made.size == len(keys) and sorted(made.slots(keys).tolist()) == list(range(len(keys)))


def stored_want(docs, library):
    want, start = [], 0
    texts = [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4")) for r in docs.collect()]
    for doc, ids in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes())):
        want.append((doc, start, len(ids), ids))
        start += len(ids)
    return want


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_store_gives_back_what_it_got(which, request, spark, library):
    docs = request.getfixturevalue(which)
    stored = token_store.write(docs, JSON, 2, shards=3)
    # rows that tie by doc_id are ordered by their compressed ids: any order of them is right
    want = stored_want(docs, library)
    got = [tuple(r) for r in token_store.read(spark, stored, docs.select("doc_id").distinct()).collect()]
    assert sorted((d is not None, d or 0, tuple(i)) for d, _, _, i in got) == sorted((d is not None, d or 0, tuple(i.tolist())) for d, _, _, i in want)
    got.sort(key=lambda r: r[1])
    start = 0
    for doc, at, n, ids in got:
        assert (at, n) == (start, len(ids))
        start += n
    assert [r[0] for r in got] == [r[0] for r in want]
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.read(spark, stored, docs.select("doc_id").distinct(), ids=False).collect()}
    assert sums == {(d, s): zlib.crc32(np.array(i, "<u4").tobytes()) for d, s, _, i in got}


def test_store_refuses_foreign_keys(spark, documents):
    stored = token_store.write(documents, JSON, 2, shards=3)
    foreign = spark.range(10_000, 10_500).select("id").withColumnRenamed("id", "doc_id")
    assert token_store.read(spark, stored, foreign).count() == 0


def test_empty_store(spark, empty):
    stored = token_store.write(empty, JSON, 2)
    assert token_store.read(spark, stored, empty.select("doc_id")).count() == 0


def test_memo_holds_a_bounded_weight():
    from loomgraph.llm._pretok import Memo

    memo = Memo(lambda found: [p.upper() for p in found], room=50_000, fixed={"a": "A"})
    for i in range(300):
        found = [f"w{i}-{j}" for j in range(20)] + ["a", "x" * 5000 + str(i), "again"]
        memo.learn(found)
        assert all(memo.young[p] == p.upper() for p in found)
        assert sum(len(p) > memo.longest for p in memo.young) == 1 and not any(len(p) > memo.longest for p in memo.old if p not in memo.brief[:1] and len(p) > 6000)
        assert len(memo.young) + len(memo.old) < 900


def test_special_strings_are_found_longest_first():
    from loomgraph.llm.token_counts import split_special

    special = ["<|a|>", "<|a|><|b|>"]
    assert split_special("x<|a|><|b|>y<|a|>z", special) == ["x", "y", "z"]
    assert split_special("<|a|><|a|><|b|>", special) == ["", "", ""] and split_special("none", special) == ["none"] and split_special("", []) == [""]


def test_bounds_cut_ids_evenly(spark):
    from loomgraph.llm._shared import id_bounds

    cases = [list(range(1000)), [0] * 500 + list(range(500)), [2**62 + i for i in range(900)] + [5], [-(2**63), 2**63 - 1, 0, 7], [3] * 40, [None] * 5, [None, 1, 2]]
    for ids in cases:
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        real = sorted(i for i in ids if i is not None)
        for n in (1, 4, 9):
            bounds = id_bounds(df, "doc_id", n)
            assert bounds == sorted(set(bounds)) and len(bounds) < n and set(bounds) <= set(real) and (not bounds or bounds[0] > real[0])
            if len(set(real)) == len(real) >= 900 and max(real) < 2**53:
                sizes = [sum(a <= i < b for i in real) for a, b in zip([real[0], *bounds], [*bounds, real[-1] + 1])]
                assert len(sizes) == n and max(sizes) < 1.5 * len(real) / n
