"""Queries held against plain versions over all rows of their tables."""

from collections import Counter, defaultdict

from loomgraph import catalogue

SF = "/root/testdata/sf0.001"


def got(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_nfkc_fold_folds_whole_texts(spark):
    import unicodedata

    want = {r.doc_id: r.text and unicodedata.normalize("NFKC", r.text).casefold() for r in rows(spark, "documents")}
    assert max(len(t or "") for t in want.values()) > 200
    assert {r.doc_id: r.folded for r in got(spark, "nfkc_fold")} == want


def test_candidates_are_told_apart_by_their_whole_text(spark):
    groups = defaultdict(dict)
    for r in sorted(rows(spark, "documents"), key=lambda r: (r.doc_id % 3, r.doc_id)):
        groups[r.doc_id // 12].setdefault(r.text, (r.doc_id % 3, r.doc_id))
    want = set()
    for source, kept in groups.items():
        turns, order = Counter(), []
        for method, i in sorted(kept.values()):
            turns[method] += 1
            order.append((turns[method], method, i))
        want |= {(source, i, n) for n, (_, _, i) in enumerate(sorted(order)[:3], 1)}
    assert {tuple(r) for r in got(spark, "candidate_round_robin")} == want


def test_numeric_exact_match_reads_all_orders(spark):
    import math

    sides = defaultdict(lambda: (Counter(), Counter()))
    for r in rows(spark, "orders"):
        sides[r.o_custkey % 50][r.o_orderkey % 2][math.floor(r.o_totalprice + 0.5) % 7] += 1
    equal = [a == b for a, b in sides.values()]
    (r,) = got(spark, "numeric_exact_match")
    assert (r.cases, r.exact, r.mean) == (len(equal), sum(equal), round(sum(equal) / len(equal), 9))


def test_layout_similarity_holds_all_boxes_of_a_page(spark):
    from itertools import combinations

    from loomgraph.sources import corpora

    pages = defaultdict(list)
    for r in corpora.boxes(spark, SF).collect():
        pages[r.page].append((r.x1, r.y1, r.x1 + (r.id % 3 - 1) * 2 * (r.id % 7), r.y1 + (r.id % 5 - 2) * (r.id % 11)))
    want = {}
    for page, boxes in pages.items():
        axes = [(a[k] - b[k], a[k + 2] - b[k + 2]) for a, b in combinations(boxes, 2) for k in (0, 1) if abs(a[k] - b[k]) > 3]
        if len(boxes) > 1:
            want[page] = len(axes), round(sum(abs(e) > 3 and (d > 0) == (e > 0) for d, e in axes) / len(axes), 9) if axes else None
    assert {r.page: (r.axes, r.similarity) for r in got(spark, "layout_similarity")} == want


def test_gantt_schedule_has_every_order(spark):
    from datetime import UTC

    orders = defaultdict(list)
    for r in rows(spark, "lineitem"):
        orders[r.l_orderkey].append((r.l_linenumber, r.l_partkey, r.l_extendedprice, r.l_quantity, r.l_shipdate))
    want = set()
    for g, tasks in orders.items():
        end = None
        for pos, (*_, n, ship) in enumerate(sorted(tasks), 1):
            begin = spark_millis(ship, UTC) if end is None else end
            end = begin + int(n) * 86400000
            want.add((g, pos, begin, end))
    assert {tuple(r) for r in got(spark, "gantt_schedule")} == want


def spark_millis(day, zone):
    """Milliseconds of the start of a date, or of a time without or in its zone."""
    from datetime import datetime, time

    at = day if isinstance(day, datetime) else datetime.combine(day, time())
    return int(at.replace(tzinfo=zone).timestamp() * 1000)


def test_kanban_board_has_every_card(spark):
    cards = defaultdict(list)
    for r in rows(spark, "documents"):
        cards[r.lang].append(r.doc_id)
    want = {c: (len(cards[c]), " ".join(map(str, sorted(cards[c])))) for c in ("en", "de", "fr", "es", "it")}
    assert {r.col: (r.cards, r.ids) for r in got(spark, "kanban_board")} == want


def test_radar_plan_counts_every_customer(spark):
    nation = {r.n_nationkey: (r.n_regionkey, r.n_name) for r in rows(spark, "nation")}
    counts = Counter((*nation[r.c_nationkey], r.c_mktsegment) for r in rows(spark, "customer"))
    top, dims = defaultdict(int), Counter()
    for (g, series, _), n in counts.items():
        top[g] = max(top[g], n)
        dims[g, series] += 1
    assert {(r.g, r.series): (r.dims, r.scale_max) for r in got(spark, "radar_plan")} == {k: (n, top[k[0]]) for k, n in dims.items()}


def test_evidence_within_its_budget(spark):
    """Against the phases written out as one loop over the order of each."""
    from loomgraph.operators import evidence
    from loomgraph.queries.evidence import _evidence

    seen = defaultdict(list)
    for r in sorted(_evidence(spark, SF).collect(), key=lambda r: r["index"]):
        seen[r.g].append((r["index"], r.kind, r.trust, r["size"]))
    for most, chars, least, name in ((20, 300, 5, "evidence_budget"), (3, 40, 1, None)):
        want = set()
        for g, items in seen.items():
            rank = {i: (0 if k == "user_edit" else 1 if t == "connector" else 2 if t == "label" else evidence.RANKS[k], i) for i, k, t, _ in items}
            size = {i: n for i, _, _, n in items}
            by_rank = sorted(rank, key=rank.get)
            critical = [i for i in by_rank if rank[i][0] < 2]
            buckets, turns = {k: [i for i, kind, _, _ in items if kind == k] for k in evidence.STRUCTURAL}, []
            while any(buckets.values()):
                turns += [b.pop(0) for b in buckets.values() if b]
            phase, quota, count, left, taken, done = "critical", min(len(critical), max(1, most // 8)), 0, chars, [], set()
            ahead = list(critical)
            while True:
                if phase != "ranked" and (count >= quota or not ahead):
                    free = max(0, most - len(taken))
                    phase, ahead, quota, count = ("structural", list(turns), -(-free // 4), 0) if phase == "critical" else ("ranked", list(by_rank), 0, 0)
                    continue
                if phase == "ranked" and (len(taken) >= most or not ahead):
                    break
                i = ahead.pop(0)
                if i in done:
                    continue
                done.add(i)
                comma = bool(taken)
                if left < least + comma:
                    break
                if size[i] + comma <= left:
                    left -= size[i] + comma
                    taken.append(i)
                    count += 1
                    want.add((g, i, len(taken), phase))
        rows = got(spark, name) if name else evidence.select(_evidence(spark, SF), most, chars, least).collect()
        assert {tuple(r) for r in rows} == want


def test_kanban_board_names_unknown_columns(spark):
    from loomgraph.plans import ordered

    columns = spark.createDataFrame([("a", 1), ("b", 2)], "col string, pos int")
    cards = spark.createDataFrame([(1, "a", 1), (2, "?", 1), (3, "?", 0), (4, None, 1)], "id long, col string, pos int")
    rows = {(r.col, r.pos, r.error, r.cards, tuple(r.ids)) for r in ordered.board(columns, cards).collect()}
    assert rows == {("a", 1, None, 1, (1,)), ("b", 2, None, 0, ()), ("?", None, "unknown column", 2, (3, 2)), (None, None, "unknown column", 1, (4,))}
