"""Operators 3, 6 and 8 against plain versions."""

import hashlib
import io
import math
from base64 import b32encode
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import mixing, url_filter, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.org/x", "<p>one</p>", 1), (5, None, "<p>one</p>", 1), (3, "http://b.org/\r\nX: y", "<p>one</p>", 1), (2, "u", None, 1), (9, "u", "", 1), (4, "u", "é" * 70_000, 1), (None, "u", "alone", 1), (None, "v", "", 1), (9, "w", "", 1)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, file int")
    return odd.unionByName(spark.read.parquet(f"{SF}/pages.parquet").withColumn("page_id", F.col("page_id") + 100).withColumn("file", F.lit(1)))


@pytest.mark.parametrize("packed", [True, False])
def test_warc_round_trip(spark, pages, packed, tmp_path):
    rows = [(r.page_id, r.html or "") for r in pages.collect()]
    best = {}
    for page, html in rows:
        if page is not None:
            best[html] = max(page, best.get(html, page))
    count = Counter(h for _, h in rows)
    want = []
    for page, html in rows:
        revisit = count[html] > 1 and html in best and page != best[html]
        want.append((page, len(html.encode()), b32encode(hashlib.sha1(html.encode()).digest()).decode(), "revisit" if revisit else "response", best[html] if revisit else None))
    archives = warc.write(pages, f"file://{tmp_path}/w", packed=packed)
    got = warc.read(spark, archives, payloads=True)
    assert got.filter("kind = 'gap'").count() == 0
    cells = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in cells), key=str) == sorted(want, key=str)
    assert {(r.page_id, bytes(r.payload).decode()) for r in cells if r.record_type == "response"} <= set(rows)


def test_warc_threshold_and_empty(spark, pages):
    got = warc.read(spark, warc.write(pages, least=5)).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 5)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "drop"])
def test_salvage(packed, harm):
    parts = [warc.record(i, f"http://x/{i}", (f"payload {i} " * 60).encode(), None) for i in range(8)]
    parts = [warc.member(p) for p in parts] if packed else parts
    begin = sum(map(len, parts[:3]))
    data = bytearray(b"".join(parts))
    lost = {3}
    if harm == "flip":
        at = begin + len(parts[3]) // 2
        data[at : at + 4] = bytes(b ^ 0x5A for b in data[at : at + 4])
    elif harm == "cut":
        del data[-(len(parts[7]) // 2) :]
        lost = {7}
    elif harm == "junk":
        data[begin:begin] = b"\x1f\x8b\x08 some junk that is no record "
        lost = set()
    else:
        del data[begin + 30 : begin + len(parts[3]) - 20]
    found = list(warc.salvage(io.BytesIO(bytes(data))))
    assert {r["page_id"] for r in found if r["kind"] == "record"} == set(range(8)) - lost
    gaps = [(g["begin"], g["end"]) for g in found if g["kind"] == "gap"]
    assert gaps and all(g["reason"] for g in found if g["kind"] == "gap")
    # records and gaps cover every byte once
    edges = sorted((r["begin"], r["end"]) for r in found)
    assert edges[0][0] == 0 and edges[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_holds_little(packed, tmp_path):
    """A length that leads past everything, and a long damaged tail: what is held does not grow with them."""
    import os
    import tracemalloc

    good = [warc.record(i, None, b"x" * 2000, None) for i in range(3)]
    bad = warc.record(7, None, b"y" * 2000, None).replace(b"Content-Length: 2", b"Content-Length: 900000002")
    parts = [warc.member(r) if packed else r for r in (good[0], bad, good[1])]
    path = tmp_path / "a.warc"
    with open(path, "wb") as f:
        f.write(b"".join(parts))
        noise = os.urandom(1 << 20)
        for _ in range(200):
            f.write(noise)
        f.write(warc.member(good[2]) if packed else b"\r\n\r\n" + good[2])
        for _ in range(50):
            f.write(noise)
    tracemalloc.start()
    with open(path, "rb") as f:
        found = list(warc.salvage(f))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert [r["page_id"] for r in found if r["kind"] == "record"] == [0, 1, 2]
    edges = sorted((r["begin"], r["end"]) for r in found)
    assert edges[0][0] == 0 and edges[-1][1] == path.stat().st_size and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))


@pytest.mark.parametrize("packed", [True, False])
def test_large_records_are_read_whole(packed, monkeypatch):
    monkeypatch.setattr(warc, "HOLD", 1000)
    monkeypatch.setattr(warc, "READ", 512)
    parts = [warc.record(i, None, bytes(range(256)) * 40, None) for i in range(3)]
    hurt = bytearray(parts[1])
    hurt[-500] ^= 1
    for middle, want in ((parts[1], [0, 1, 2]), (bytes(hurt), [0, 2])):
        data = b"".join(warc.member(p) if packed else p for p in (parts[0], middle, parts[2]))
        assert [r["page_id"] for r in warc.salvage(io.BytesIO(data)) if r["kind"] == "record"] == want


def test_archives_roll_and_copies_travel_either_way(spark, pages, monkeypatch):
    want = None
    for sent in (warc.SENT_ROWS, -1):
        monkeypatch.setattr(warc, "SENT_ROWS", sent)
        archives = warc.write(pages.coalesce(1), roll=20_000)
        assert archives.count() > 3 and archives.filter("records > 1").agg(F.max("bytes")).first()[0] < 200_000
        rows = sorted(map(str, warc.read(spark, archives).drop("file", "begin", "end").collect()))
        assert want in (None, rows)
        want = rows


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_rules(spark):
    cases = [
        ("http://A.Example.org/es/x?q", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("https://x.com/de/", "x.com", "/de/", "com/de/", "block"),
        ("https://com?/de/", "com", "", None, "allow"),
        ("http://x.org#/es/", "x.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        ("http://x.net/\nfr/é?a", "x.net", "/\nfr/é", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "h") for i, c in enumerate(cases)] + [(0, cases[0][0], "again")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = url_filter.judge(pages, none, RULES, 0.6).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:]
    assert url_filter.judge(pages.limit(0), none, RULES).count() == 0


def plain_reputation(rows, z):
    """The same shrinkage in plain loops; rows: host, bad."""
    hosts = defaultdict(lambda: [0, 0])
    for h, b in rows:
        hosts[h][0] += 1
        hosts[h][1] += b
    up = {h: (".".join(h.split(".")[-2:]), h.split(".")[-1]) for h in hosts}
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, b) in hosts.items():
        for table, key in ((domains, up[h][0]), (suffixes, up[h][1])):
            table[key][0] += n
            table[key][1] += b
    n, b = sum(x[0] for x in hosts.values()), sum(x[1] for x in hosts.values())
    every = (b + 1) / (n + 2)

    def level(table, prior):
        m = {k: prior(k) for k in table}
        chance = sum(m[k] * (1 - m[k]) * n for k, (n, b) in table.items())
        spread = sum((b - n * m[k]) ** 2 for k, (n, b) in table.items())
        most = sum(m[k] * (1 - m[k]) * n * (n - 1) for k, (n, b) in table.items())
        share = (spread - chance) / most if most else 0
        kappa = max(1, min(1000, 1 / share - 1)) if share > 0 else 1000
        return {k: ((b + m[k] * kappa) / (n + kappa), n + kappa) for k, (n, b) in table.items()}

    s = level(suffixes, lambda k: every)
    d = level(domains, lambda k: s[k.split(".")[-1]][0])
    h = level(hosts, lambda k: d[up[k][0]][0])
    return {k: (m, m - z * math.sqrt(m * (1 - m) / (w + 1))) for k, (m, w) in h.items()}


def test_url_reputation(spark):
    rows = [(f"{s}.{d}.{t}", int((i * 7 + len(s) + 3 * (d == "bad")) % 10 < (8 if d == "bad" else 1))) for t in ("net", "edu") for d in ("good", "bad", "ugly") for s in ("a", "bb", "ccc") for i in range(11)]
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, (h, _) in enumerate(rows)] + [(9999, "http://new.bad.net/"), (9998, "http://new.good.net/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(rows)], "page_id long, bad int")
    want = plain_reputation(rows, 1.645)
    got = {r.page_id: r for r in url_filter.judge(pages, outcomes, [], 0.5).collect()}
    for i, (h, _) in enumerate(rows):
        assert got[i].mean == pytest.approx(want[h][0]) and got[i].low == pytest.approx(want[h][1])
        assert got[i].verdict == ("block" if want[h][1] > 0.5 else "allow")
    assert got[9999].mean > 2 * got[9998].mean


def plain_exponent(tokens, entropy, repeats, budget):
    """The least exponent, in steps of a fine grid, that is neither flatter than wanted nor repeats too often."""
    total = sum(tokens)
    p = [x / total for x in tokens]

    def weights(a):
        return [x**a / sum(y**a for y in p) for x in p]

    def bad(a):
        w = weights(a)
        r = [x / y for x, y in zip(w, p)]
        size = budget if budget is not None else 1 / min(r)
        return max(r) * size > repeats * (1 + 1e-9) or -sum(x * math.log(x) for x in w) > entropy * math.log(len(p)) + 1e-9

    if len(p) == 1:
        return 1.0, [1.0]
    steps = 20_000
    a = next((i / steps for i in range(steps) if not bad(i / steps)), 1.0)
    return a, weights(a)


CASES = [
    ([4000, 700, 120, 60], 0.7, 30.0, 1.0, True),  # steep: flattened to the entropy
    ([4000, 700, 120, 60], 0.99, 1.5, None, False),  # the limit comes first
    ([100, 90, 110], 0.95, 4.0, 1.0, True),  # flatter than the target: as they are
    ([100, 90, 110], 1.0, 4.0, 1.0, True),  # all alike
    ([50, 50, 50], 1.0, 2.0, None, True),
    ([70], 0.5, 2.0, None, True),  # single
    ([9, 1], 0.9, 2.0, 3.0, False),  # a budget over the limit
    ([10**9, 5, 3], 0.5, 10.0, 1.0, False),
]


@pytest.mark.parametrize("tokens,entropy,repeats,budget,met", CASES)
def test_exponent_against_a_grid(spark, tokens, entropy, repeats, budget, met):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(tokens)], "source string, tokens long")
    target = mixing.Target(entropy, repeats, budget)
    got = mixing.solve(df, target)
    a, w = plain_exponent(tokens, entropy, repeats, budget)
    assert 0 <= got.exponent <= 1 and got.met == met
    assert got.exponent == pytest.approx(a, abs=1e-4)
    rows = {r.source: r for r in mixing.weights(df, target).collect()}
    assert [rows[f"s{i}"].weight for i in range(len(tokens))] == pytest.approx(w, abs=1e-3)
    # never sharper than the shares themselves
    assert max(r.weight for r in rows.values()) <= max(tokens) / sum(tokens) + 1e-9
    if tokens == [100, 90, 110] and entropy == 0.95:
        assert got.exponent == 1 and got.natural >= 0.95 and got.entropy == pytest.approx(got.natural)


def test_many_sources_take_seconds(spark):
    import time

    df = spark.range(100_000).selectExpr("cast(id as string) as source", "1 + pmod(xxhash64(id), 1000000) as tokens").cache()
    df.count()
    began = time.time()
    got = mixing.solve(df, mixing.Target(entropy=0.99, repeats=1000.0))
    assert got.met and 0 < got.exponent < 1 and got.entropy == pytest.approx(0.99, abs=1e-6)
    assert time.time() - began < 60


@pytest.mark.parametrize("target", [mixing.Target(entropy=0.9, repeats=3.0, budget=1.0), mixing.Target(entropy=0.99, repeats=1.5, budget=None), mixing.Target(entropy=1.0, repeats=3.0, budget=None)])
@pytest.mark.parametrize("sent", [0, mixing.SENT_ROWS])
def test_mixture_meets_its_budget(spark, target, sent, monkeypatch):
    monkeypatch.setattr(mixing, "SENT_ROWS", sent)
    sizes = {"big": 4000, "mid": 700, "small": 120, None: 60}
    rows, n = [], 0
    for source, k in sizes.items():
        for i in range(k):
            n += 1
            rows.append((n, source, "w " * (1 + (i * 7) % 13), "clash"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, place string")
    got = mixing.mixture(docs, target).collect()
    tokens = Counter()
    for d, s, t, _ in rows:
        tokens[s] += len(t.split())
    names = list(sizes)
    a, w = plain_exponent([tokens[s] for s in names], target.entropy, target.repeats, target.budget)
    assert got[0].exponent == pytest.approx(a, abs=1e-4)
    total = sum(tokens.values())
    size = target.budget * total if target.budget is not None else total * max(tokens[s] / total / x for s, x in zip(names, w))
    out = Counter()
    for r in got:
        out[r.source] += r.n_tokens
    for s, x in zip(names, w):
        assert x * size * 0.999 - 14 <= out[s] <= x * size * 1.001 + 1
        assert out[s] <= target.repeats * tokens[s] * 1.001
        if target.budget is None:
            assert len({r.doc_id for r in got if r.source == s}) == sizes[s]
    times = Counter(r.doc_id for r in got)
    for s in names:
        per = [times[d] for d, src, _, _ in rows if src == s]
        assert max(per) - min(per) <= 1
    assert len({(r.doc_id, r["round"]) for r in got}) == len(got)
    # shares change, and so does the number of rows
    assert len(got) != len(rows)


def test_mixture_odd_rows(odd, empty):
    out = mixing.mixture(odd, mixing.Target(budget=None))
    assert out.filter("doc_id = 2").select("doc_id", "round").count() >= 2
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert mixing.mixture(empty, mixing.Target()).count() == 0
    one = mixing.mixture(odd.filter("source = 'u'"), mixing.Target())
    assert one.count() == 3 and one.first().weight == 1


def test_two_label_suffixes_can_be_given(spark):
    hosts = spark.createDataFrame([("a.com.ar",), ("x.b.co.il",), ("c.com.sg",), ("d.co.uk",), ("e.f.example",)], "host string")
    found = lambda *a: [tuple(r) for r in hosts.select(*[c.alias(n) for n, c in url_filter.levels("host", *a)]).collect()]
    assert found() == [("a.com.ar", "com.ar"), ("b.co.il", "co.il"), ("c.com.sg", "com.sg"), ("d.co.uk", "co.uk"), ("f.example", "example")]
    assert found(("f.example",)) == [("com.ar", "ar"), ("co.il", "il"), ("com.sg", "sg"), ("co.uk", "uk"), ("e.f.example", "f.example")]


def test_unrelated_hosts_under_a_two_label_suffix_share_no_domain(spark):
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.com.ar"] * 40 + ["good.com.ar"] * 40 + ["new.com.ar"])], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "page_id long, bad int")
    mean = lambda *a: {r.host: r.mean for r in url_filter.judge(pages, outcomes, [], 0.5, 1.645, *a).collect()}
    apart, together = mean(), mean(("co.uk",))
    assert apart["bad.com.ar"] != together["bad.com.ar"]
