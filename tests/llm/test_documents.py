"""Operators 2, 7, 9 and 10 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import audio, fingerprints, simhash, toxicity


def ordered(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("which", ["documents", "odd"])
@pytest.mark.parametrize("ranges", [1, 7])
def test_fingerprints_against_next(which, ranges, request):
    docs = request.getfixturevalue(which)
    rows = ordered(docs)
    got = fingerprints.compare_edited(docs, ranges).collect()
    want = []
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        other = text[: len(text) - half] + following[:half]
        a, b, c = (fingerprints.chunk_set(x.encode()) for x in (text, other, following))
        want.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), fingerprints.packed(a), fingerprints.packed(b), fingerprints.contained(a, b), fingerprints.contained(a, c)))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_chunks_hold_their_bounds_and_resist_shifts():
    draw = random.Random(4)
    data = "".join(draw.choice("abcdefghij klmnop") for _ in range(20_000)).encode()
    cuts = fingerprints.boundaries(data)
    sizes = np.diff([0, *cuts])
    assert cuts[-1] == len(data) and sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST
    moved = fingerprints.chunk_set(b"some words in front " + data)
    assert fingerprints.contained(fingerprints.chunk_set(data), moved) > 0.97
    assert fingerprints.unpacked(fingerprints.packed(moved)) == moved
    assert fingerprints.contained({}, {}) == 1 and fingerprints.contained({}, moved) == 0


def test_one_and_no_rows(spark, empty):
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert fingerprints.compare_edited(one).first().near_next == 1
    assert fingerprints.compare_edited(empty).count() == 0


def plain_simhash(text, words, seed=42):
    import xxhash

    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, near):
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if near(rows[i][1], rows[j][1]):
            root[top(j)] = top(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(doc, least.get(top(i), doc))
    return [(doc, fp, least.get(top(i))) for i, (doc, fp) in enumerate(rows)]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash(which, request):
    docs = request.getfixturevalue(which)
    rows = [(d, plain_simhash(t, 4)) for d, t in ordered(docs)]
    want = plain_components(rows, lambda a, b: (a ^ b).bit_count() <= 4)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def made_points(spark, seed, n=400, family=300):
    """Random fingerprints, and a family of near ones of which some are chains."""
    draw, base = random.Random(seed), random.Random(seed + 1).getrandbits(64)
    some = [draw.getrandbits(64) for _ in range(n)]
    some += [base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(family)]
    at = draw.getrandbits(64)
    for _ in range(60):
        for _ in range(draw.randint(1, 4)):
            at ^= 1 << draw.randrange(64)
        some.append(at)
    return sorted(set(some))


def classes(names, pairs):
    root = {p: p for p in names}

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[top(a)] = top(b)
    out = {}
    for p in names:
        out.setdefault(top(p), set()).add(p)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("block", [20, 20_000])
def test_links_lose_no_component(spark, block):
    points = made_points(spark, 7)
    plan = simhash.Plan(limit=4, block=block)
    df = spark.createDataFrame([(i, simhash._long(p)) for i, p in enumerate(points)], "node long, w0 long")
    edges = simhash.links(simhash.signature_rows(df, plan), plan)
    roots = {r.node: r.root for r in simhash.components(edges.select("a", "b")).collect()}
    got = classes(range(len(points)), roots.items())
    want = classes(range(len(points)), ((i, j) for i, j in combinations(range(len(points)), 2) if (points[i] ^ points[j]).bit_count() <= 4))
    assert got == want and all(root == min(c) for c in got for root in {roots.get(x, x) for x in c})


def test_signatures_meet_within_the_bound():
    """Any two that differ in at most 2 * cuts - 1 bits share a signature, however the bits lie."""
    draw = random.Random(9)
    for plan in (simhash.Plan(limit=4), simhash.Plan(cuts=4, limit=7), simhash.SIMILAR):
        most = 2 * plan.cuts - 1
        for k in range(300):
            a = b = draw.getrandbits(plan.size)
            spread = [lo + k % (hi - lo) for lo, hi in plan.segments] + [hi - 1 - k % (hi - lo - 1) for lo, hi in plan.segments]
            for bit in set(draw.sample(range(plan.size), most) if k % 2 else spread[:most]):
                b ^= 1 << bit
            assert simhash.signatures(a, plan) & simhash.signatures(b, plan)


@pytest.mark.parametrize("plan", [simhash.Plan(block=10), simhash.Plan(block=10_000), simhash.SIMILAR])
def test_signature_rows_are_the_signatures(spark, plan):
    """Keys made from halves are those of the whole definition, and each half's value or key is whole in one partition."""
    draw = random.Random(3)
    made = [draw.getrandbits(plan.size) for _ in range(40)]
    if plan.block == 10:
        made += [made[0] ^ (1 << i) for i in range(40)]
    words = lambda p: [simhash._long(p >> 64 * i & (1 << 64) - 1) for i in range(plan.size // 64)]
    df = spark.createDataFrame([(i, *words(p)) for i, p in enumerate(made)], "node long, " + ", ".join(f"{w} long" for w in plan.parts))
    cold, hot = simhash.signature_rows(df, plan)
    assert (hot is None) == (plan.block > 10)
    for table, shift in ((cold, 16), (hot, 0)):
        where = {}
        for r in table.withColumn("at", F.spark_partition_id()).collect() if table is not None else []:
            where.setdefault(r[0] >> shift, set()).add(r["at"])
        assert all(len(x) == 1 for x in where.values())
    got = set()
    for r in simhash.keyed(simhash.halves(df, plan), plan).collect():
        b, tag, own, rest = r.key >> 48, r.key >> 32 & 0xFFFF, r.key >> 16 & 0xFFFF, r.key & 0xFFFF
        lo, hi = plan.segments[tag // 2]
        half = (hi - lo) // 2
        got.add((lo + half + b, rest << half | own, r.node) if tag % 2 == 0 else (lo + b, own << half | rest, r.node))
    assert got == {(bit, rest, i) for i, p in enumerate(made) for bit, rest in simhash.signatures(p, plan)}


def test_majority_is_that_of_every_bit():
    draw = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 5000, 40_000):
        hashes = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        words = simhash.spread(hashes, 12)
        assert (words[:, 0] == hashes).all()
        want = [sum(1 << b for b in range(64) if n and 2 * int((words[:, i] >> np.uint64(b) & np.uint64(1)).sum()) > n) for i in range(12)]
        assert simhash.majority(hashes, 768).tolist() == want


def test_candidates_keep_the_classes_of_every_bound():
    """A least spanning forest joins what all pairs up to any distance join, beyond the sure one."""
    draw = random.Random(3)
    made = []
    for _ in range(6):
        base = draw.getrandbits(128)
        for _ in range(40):
            p = base
            for bit in draw.sample(range(128), draw.randint(0, 18)):
                p ^= 1 << bit
            made.append(p)
    made = sorted(set(made))
    plan = simhash.Plan(limit=34, sure=0, similarity=0.8, size=128, cuts=8)
    w0, w1 = (np.array([p >> 64 * i & (1 << 64) - 1 for p in made], np.uint64) for i in (0, 1))
    far = lambda i, j: (made[i] ^ made[j]).bit_count()
    every = list(combinations(range(len(made)), 2))
    pairs = [(int(i), int(j)) for a, b in simhash.nearest(w0, w1, plan) for i, j in zip(a, b)]
    assert len(pairs) < len(made) and all(far(i, j) <= 34 for i, j in pairs)
    for most in (8, 14, 20, 27, 34):
        assert classes(range(len(made)), [p for p in pairs if far(*p) <= most]) == classes(range(len(made)), [p for p in every if far(*p) <= most])


def test_pairs_of_one_root_are_no_candidates(spark):
    plan = simhash.SIMILAR
    rows = [(i, *[7] * len(plan.parts), root) for i, root in ((1, 1), (2, 1), (3, 3))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ("node", *plan.parts, "root")))
    for found, some in ((df, slice(plan.lead, plan.cuts)), (df.drop("root"), slice(0, plan.lead))):
        got = {(r.a, r.b) for r in simhash.links(simhash.signature_rows(found, plan, some), plan).collect()}
        assert got == ({(1, 3), (2, 3)} if "root" in found.columns else {(1, 2), (1, 3)})  # the third is needless: a chain of equal words


def test_thinning_keeps_the_classes_of_every_bound(spark):
    draw = random.Random(8)
    pairs = {tuple(sorted(draw.sample(range(120), 2))): draw.randint(0, 30) for _ in range(2900)}
    df = spark.createDataFrame([(*k, d) for k, d in pairs.items()] * 2, "a long, b long, d int").repartition(5)
    names = range(120)
    for shares in (1, 8):
        got = {(r.a, r.b): r.d for r in simhash.thinned(df, simhash.SIMILAR, shares).collect()}
        assert got.items() <= pairs.items() and 119 <= len(got) <= 119 * shares * simhash.FORESTS
        for most in (0, 1, 2, 4, 30):
            assert classes(names, (k for k, d in got.items() if d <= most)) == classes(names, (k for k, d in pairs.items() if d <= most))
    # where no pair is tight, the nearest pairs of each node are there, as many as forests
    far = {k: d + simhash.TIGHT + 1 for k, d in pairs.items()}
    a, b, d = (np.array(x) for x in zip(*[(*k, d) for k, d in far.items()]))
    kept = set(zip(*(x.tolist() for x in simhash.thin(a, b, d, simhash.FORESTS)[:2])))
    for x in names:
        own = sorted((d, k) for k, d in far.items() if x in k)[: simhash.FORESTS]
        assert all(k in kept for _, k in own)


def test_long_texts_are_cut_at_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + "  \n end"
    whole = simhash.shingle_hashes(text, 5, 42)
    for block in (1, 7, 1000):
        monkeypatch.setattr(simhash, "TEXT_BLOCK", block)
        assert (simhash.shingle_hashes(text, 5, 42) == whole).all()
    assert len(whole) == 3001 - 4


def test_keep_first(spark, odd, empty):
    plan = simhash.SIMILAR
    kept = simhash.keep_first(odd, plan)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 5, 7, 8] and kept.filter("doc_id is null").count() == 1
    assert simhash.keep_first(empty, plan).count() == 0 and simhash.near_duplicates(empty).count() == 0


def test_keep_first_at_the_similarity(spark):
    """Groups are proven by whole shingle sets, at 0.8 on both sides; bits alone link them all, and blocks do not matter."""
    text = lambda n, name: " ".join([*(f"w{i}" for i in range(n)), *(f"{name}{i}" for i in range(200 - n))])
    # sets of 196 shingles of which n - 4 are shared: 182 of 200 words 0.832, 178 0.798, 176 0.782
    rows = [(1, text(200, "")), (2, text(182, "a")), (3, text(178, "b")), (4, text(176, "c")), (5, text(200, "")), (6, " ".join(f"z{i}" for i in range(50)))]
    # 0.8 itself: 8 of 10 shingles
    rows += [(7, " ".join(f"y{i}" for i in range(14))), (8, " ".join(f"y{i}" for i in range(12)))]
    # the same majority of bits, but few shingles in common
    again = "the very same line of words " * 300
    rows += [(9, again + " ".join(f"p{i}" for i in range(100))), (10, again + " ".join(f"q{i}" for i in range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loose = simhash.Plan(words=5, size=768, cuts=32, limit=128, similarity=0.8, sure=10)
    assert sorted(r.doc_id for r in simhash.keep_first(docs, loose).collect() if r.doc_id not in (7, 8)) == [1, 3, 4, 6, 9, 10]
    assert sorted(r.doc_id for r in simhash.keep_first(docs, simhash.SIMILAR).collect() if r.doc_id not in (7, 8)) == [1, 3, 4, 6, 9, 10]
    pairs = spark.createDataFrame(list(combinations(range(1, 11), 2)), "a long, b long")
    for chunk in (2, 256):
        assert {tuple(r) for r in simhash.verified(docs, pairs, loose, chunk).collect()} == {(1, 2), (1, 5), (2, 5), (7, 8)}


def near_texts():
    """Texts of 1 to 300 words in families with all likenesses, with a line that many share."""
    draw, rows = random.Random(11), []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(draw.choice((1, 4, 6, 9, 40, 120, 300)))]
        for _ in range(12):
            words, at = list(base), draw.randrange(len(base))
            words[at : at + draw.randint(0, len(base) // 6)] = [f"x{draw.random()}" for _ in range(draw.randint(0, len(base) // 8))]
            rows.append(" ".join(words + ["a line that many of the texts have in common"] * draw.randint(0, 1)))
    return list(enumerate([*rows, "", None, rows[5]], 1))


def true_links(rows):
    sets = {d: frozenset(simhash.shingle_hashes(t or "", 5, 42).tolist()) for d, t in rows}
    return {p for p in combinations(sets, 2) if (s := sets[p[0]]) == (t := sets[p[1]]) or len(s & t) / len(s | t) >= 0.8}


@pytest.mark.parametrize("block, common", [(20_000, 64), (10, 5), (10, 0)])
def test_no_pair_of_the_similarity_is_missed(spark, monkeypatch, block, common):
    monkeypatch.setattr(simhash, "COMMON", common)
    rows, plan = near_texts(), simhash.Plan(words=5, size=768, cuts=32, similarity=0.8, block=block)
    links = true_links(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for root in (lambda d: d, lambda d: d % 3):
        joined = spark.createDataFrame([(d, root(d)) for d, _ in rows], "node long, root long")
        pairs = [tuple(r) for r in simhash.missed(docs, joined, plan).collect()]
        # two empty sets have no shingle to meet by; as copies they are one point before
        want = {(a, b) for a, b in links if root(a) != root(b) and rows[a - 1][1]}
        assert want <= set(pairs) and len(set(pairs)) == len(pairs) < 3 * len(want)
        assert all(a < b and root(a) != root(b) for a, b in pairs)


def test_groups_are_those_of_all_pairs(spark, monkeypatch):
    """Also if thinning leaves out every candidate, or signatures hardly ever meet."""
    rows = near_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(min, classes([d for d, _ in rows], true_links(rows))))
    assert len(want) < len(rows) - 20
    kept = lambda plan: sorted(r.doc_id for r in simhash.keep_first(docs, plan).collect())
    assert kept(simhash.Plan(words=5, size=128, cuts=4, limit=1, similarity=0.8, lead=2)) == want
    monkeypatch.setattr(simhash, "thinned", lambda candidates, plan: candidates.limit(0))
    assert kept(simhash.SIMILAR) == want


def test_rows_that_repeat_a_doc_id_are_one(spark):
    rows = [(1, "b " * 30, 2), (1, "a b c d e f g", 9), (2, "x y z u v w", None), (2, "x y z u v w", None), (3, "x y z u v w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = [(1, "a b c d e f g", 9), (2, "x y z u v w", None)]
    for n in (1, 3):
        assert sorted(map(tuple, simhash.keep_first(docs.repartition(n)).collect())) == want


def test_dropped_documents_have_a_similar_one(spark, documents):
    sets = {}
    for r in documents.collect():
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if w]
        sets[r.doc_id] = frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    kept = {r.doc_id for r in simhash.keep_first(documents).collect()}
    like = lambda a, b: len(a & b) / len(a | b) >= 0.8
    assert len(kept) < len(sets)
    assert all(any(like(s, t) for e, t in sets.items() if e != d) for d, s in sets.items() if d not in kept)
    assert not [d for d in kept if any(d != e and like(sets[d], sets[e]) for e in kept)]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_audio_holds_the_bytes(which, request):
    docs = request.getfixturevalue(which)
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * ((64 - len(data) % 64) % 64) if data else b"\0" * 64
        want.append((r.doc_id, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    got = audio.describe(audio.media(docs)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by_payload = {}
    for r in got:
        by_payload.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(x) == 1 for x in by_payload.values())


def test_resampling_keeps_a_tone():
    s = audio.Settings()
    t = np.arange(s.rate) / s.rate
    out = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), s)
    assert len(out) == s.rate_out
    assert np.argmax(np.abs(np.fft.rfft(out))) == 440
    # blocks do not show
    assert (audio.resample(np.sin(t).astype(np.float32), s, block=100) == audio.resample(np.sin(t).astype(np.float32), s)).mean() > 0.999


def test_hysteresis():
    s = audio.Settings(low=0.0, high=1.0)
    energy = np.array([0, 0, 10, 4, 5, 0, 0, 4, 0, 10, 0], np.float32)
    assert audio.segments(energy, s) == [(2, 5), (9, 10)]


def test_tensors_are_stored(spark, documents, tmp_path):
    import pyarrow as pa

    s = audio.Settings()
    rows = audio.describe(audio.media(documents), s, f"file://{tmp_path}").collect()
    n = sum(r.n_windows for r in rows)
    assert {r.tensor_file for r in rows} == {p.name for p in tmp_path.glob("*.arrow")}
    tables = [pa.ipc.open_file(p.open("rb")).read_all() for p in tmp_path.glob("*.arrow")]
    assert sum(t.num_rows for t in tables) == n
    assert tables[0].schema.field("log_mel").type.shape == [s.window, s.mels]
    assert all(a < b for t in tables for a, b in zip(t["begin_s"].to_pylist(), t["end_s"].to_pylist()))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == docs.count()
    for doc, r in got.items():
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(got[d].score, y) for d, y in truth.items() if got[d].held_out]
    right = sum(a > b or 0.5 * (a == b) for a, y in held if y for b, z in held if not z)
    pairs = sum(y for _, y in held) * sum(1 - y for _, y in held)
    assert right / pairs > 0.9


def test_toxicity_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (7, 0), (8, 0), (3, None), (None, 1), (9, 1), (9, 0)], "doc_id long, toxic int")
    got = toxicity.judge(odd, labels).collect()
    assert len(got) == odd.count() and not any(math.isnan(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    none = toxicity.judge(odd, labels.filter("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.judge(empty, labels).count() == 0
    assert toxicity.judge(odd, labels.limit(0)).count() == odd.count()


def plain_grams(text, grams=(3, 4, 5)):
    whole = f" {(text or '').lower()} "
    return {whole[i : i + n] for n in grams for i in range(len(whole) - n + 1)}


def test_features_are_the_distinct_grams_of_code_points():
    text = "the same words the same words " * 40 + "and others, \u00e9\u4e2d\U0001f600 too"
    whole = toxicity.features(text, (3, 4, 5))
    assert len(whole) == len(plain_grams(text)) and (np.diff(whole.view(np.uint64).astype(object)) > 0).all()
    for block in (1, 5, 64):
        assert (toxicity.features(text, (3, 4, 5), block) == whole).all()
    # a gram has one hash wherever it stands, and one by its length
    assert toxicity.features("\u4e2d\U0001f600", (4,)).tolist() == [h for h in toxicity.features("\u4e2d\U0001f600", (3, 4)).tolist() if h not in toxicity.features("\u4e2d\U0001f600", (3,)).tolist()]


def test_model_against_plain_counts_and_fit(spark):
    """Ratios by counting sets of strings; the weights by another solver of the same problem; scores by plain sums."""
    draw = random.Random(2)
    words = ["".join(draw.choice("abcde\u00e9\u4e2d") for _ in range(draw.randint(2, 5))) for _ in range(30)]
    rows = []
    for i in range(80):
        toxic = i % 3 == 0
        rows.append((i, " ".join(draw.choice(words[:18] if toxic else words[10:]) for _ in range(8)), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    s = toxicity.Settings(grams=(2, 3), ridge=1.0, steps=3000)
    model = toxicity.fit(docs, labels, s)
    sets = [plain_grams(t, (2, 3)) for _, t, _ in rows]
    names = sorted(set().union(*sets))
    n1 = sum(y for *_, y in rows)
    by_hash = dict(zip(model.keys.tolist(), zip(model.ratio, model.weight)))
    assert len(by_hash) == len(names)
    ratio = {}
    for g in names:
        p, q = (sum(g in f for f, r in zip(sets, rows) if r[2] == y) for y in (1, 0))
        ratio[g] = math.log((p + 1) / (n1 + 2)) - math.log((q + 1) / (len(rows) - n1 + 2))
    assert sorted(round(r, 9) for r in ratio.values()) == sorted(round(float(r), 9) for r, _ in by_hash.values())
    # the objective at the weights against Newton's method on a dense matrix
    x = np.array([[ratio[g] if g in f else 0.0 for g in names] for f in sets])
    y = np.array([r[2] for r in rows], float)
    w, b = np.zeros(len(names)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        one = np.hstack([x, np.ones((len(x), 1))])
        ridge = np.diag([*[s.ridge] * len(names), 0.0])
        step = np.linalg.solve(one.T @ (one * (p * (1 - p))[:, None]) + ridge + 1e-12 * np.eye(len(ridge)), one.T @ (p - y) + ridge @ np.append(w, b))
        w, b = w - step[:-1], b - step[-1]
    want = 1 / (1 + np.exp(-(x @ w + b)))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model, s).collect()}
    assert [got[r[0]] for r in rows] == pytest.approx(want.tolist(), abs=2e-3)


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, toxicity.Settings(rows=8)).collect()
    assert len(rows) == 8 and len({r.doc_id for r in rows}) == 8
    first = toxicity.fit(docs, labels)
    assert (toxicity.fit(docs.repartition(7), labels).weight == first.weight).all()


def plain_chunks(data):
    """The chunking rule byte by byte: the sum of shifted numbers of the last 16 bytes, its bits from 16 on."""
    numbers = random.Random(20240601)
    gear = [numbers.getrandbits(32) for _ in range(256)]
    out, begin = [], 0
    for i in range(len(data)):
        size = i + 1 - begin
        h = sum(gear[data[j]] << (i - j) for j in range(max(0, i - 15), i + 1)) % (1 << 32) >> 16
        # below the usual length six bits must be zero, from there on three; a chunk has 12 to 120 bytes
        if size == 120 or size >= 12 and h % (64 if size < 32 else 8) == 0:
            out.append(data[begin : i + 1])
            begin = i + 1
    return out + ([data[begin:]] if begin < len(data) else [])


def test_chunks_against_the_rule_byte_by_byte(documents):
    import base64

    import xxhash

    texts = ["", "a", "a" * 500, "\u00e9\u4e2d" * 300, *[r.text for r in documents.limit(60).collect()]]
    sets = []
    for t in texts:
        chunks = plain_chunks(t.encode())
        ends = np.cumsum([len(c) for c in chunks]).tolist()
        assert fingerprints.boundaries(t.encode()) == ends
        mine = {xxhash.xxh3_64_intdigest(c) >> 16: len(c) for c in chunks}
        raw = b"".join(d.to_bytes(6, "big") + bytes([n]) for d, n in sorted(mine.items()))
        assert fingerprints.packed(fingerprints.chunk_set(t.encode())) == base64.b64encode(raw).decode()
        sets.append(mine)
    for one, other in zip(sets, sets[1:] + sets[:1]):
        want = sum(n for d, n in one.items() if d in other) / sum(one.values()) if one else float(not other)
        assert fingerprints.contained(one, other) == pytest.approx(want)


def test_audio_against_plain_sums():
    """Resampling as a sum over the inputs, bands as sums over a plain transform, frame by frame."""
    s, draw = audio.Settings(), np.random.default_rng(1)
    x = draw.integers(0, 256, 2000).astype(np.uint8)
    wave = (x.astype(np.float64) - 128) / 128
    taps = s.up * s.taps
    t = np.arange(taps) - (taps - 1) / 2
    cut = 1 / max(s.up, s.down)
    low = np.sinc(t * cut) * cut * np.hamming(taps) * s.up
    n = -(-len(wave) * s.up // s.down)
    # output k is at k * down of the signal with up - 1 zeros after each sample
    plain = np.array([sum(wave[i] * low[k * s.down - i * s.up] for i in range(len(wave)) if 0 <= k * s.down - i * s.up < taps) for k in range(n)])
    got = audio.resample(wave.astype(np.float32), s)
    assert got == pytest.approx(plain, abs=1e-4)
    mel, energy = audio.log_mel(got, s)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(2595 * math.log10(1 + 20 / 700), 2595 * math.log10(1 + s.rate_out / 2 / 700), s.mels + 2)]
    for i in (0, 1, len(mel) - 1):
        frame = np.zeros(s.frame)
        part = plain[i * s.hop : i * s.hop + s.frame]
        frame[: len(part)] = part
        frame *= [0.5 - 0.5 * math.cos(2 * math.pi * k / (s.frame - 1)) for k in range(s.frame)]
        turn = np.exp(-2j * np.pi * np.outer(np.arange(s.frame // 2 + 1), np.arange(s.frame)) / s.frame)
        power = np.abs(turn @ frame) ** 2
        for m in range(s.mels):
            a, b, c = edges[m : m + 3]
            f = np.arange(len(power)) * s.rate_out / s.frame
            bank = np.clip(np.minimum((f - a) / (b - a), (c - f) / (c - b)), 0, None)
            assert mel[i, m] == pytest.approx(math.log(power @ bank + 1e-6), abs=2e-2)
        assert energy[i] == pytest.approx(math.log((frame * frame).sum() + 1e-6), abs=1e-2)
