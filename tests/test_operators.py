"""Operators on small scenes worked out by hand."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.functions import geom, numeric, policy, security, temporal, text
from loomgraph.operators import align, bags, folds, fusion, gates, graph, identifiers, repair, review, spatial
from loomgraph.plans import charts, network, ordered, release, trees


def values(df, *columns):
    return sorted((tuple(r[c] for c in (columns or df.columns)) for r in df.collect()), key=str)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


REL = "source_id string, target_id string, arrow_at_start boolean, arrow_at_end boolean"


def test_arcs_by_arrow_heads(spark):
    r = spark.createDataFrame([("b", "a", False, True), ("b", "a", True, False), ("b", "a", False, False), ("b", "a", True, True), (None, "a", False, True)], REL)
    assert values(graph.arcs(r)) == sorted([("b", "a", "directed"), ("a", "b", "directed"), ("a", "b", "undirected"), ("b", "a", "directed"), ("a", "b", "directed")])


def edges(spark, *pairs, g=1):
    return spark.createDataFrame([(g, a, b) for a, b in pairs], "g long, src string, dst string")


def test_paths_roots_cycles(spark):
    e = edges(spark, ("A", "B"), ("B", "C"), ("A", "C"), ("A", "C"))
    assert values(graph.simple_paths(e).select(F.array_join("path", "").alias("p"))) == [("ABC",), ("AC",)]
    assert values(graph.roots_and_terminals(e, ["g"]), "node", "role") == [("A", "root"), ("C", "terminal")]
    assert graph.acyclic(e).first().acyclic
    assert not graph.acyclic(edges(spark, ("A", "B"), ("B", "A"))).first().acyclic
    assert graph.simple_paths(edges(spark, ("A", "B"), ("B", "A"))).count() == 0
    assert graph.degree_ends(edges(spark, ("A", "B"), ("A", "C")), ["g"]).first()["first"] is None


def test_too_many_paths_are_unavailable(spark):
    layers = [(f"{i}{a}", f"{i + 1}{b}") for i in range(5) for a in "abcdefgh" for b in "abcdefgh"]
    assert graph.path_counts(edges(spark, *layers)).first().paths is None
    whole = [(a, b) for a in "abcdefghijklmn" for b in "abcdefghijklmn" if a != b] + [("start", "a"), ("a", "stop")]
    assert graph.path_counts(edges(spark, *whole)).first().paths is None
    assert not graph.acyclic(edges(spark, *whole)).first().acyclic


@pytest.mark.parametrize("most", [2, 1_000_000])
def test_cycles_whatever_the_size(spark, most):
    e = edges(spark, *((f"a{i}", f"a{i + 1}") for i in range(9))).unionByName(edges(spark, ("x", "y"), ("y", "z"), ("z", "y"), ("z", "w"), g=2)).unionByName(edges(spark, ("s", "s"), g=3))
    assert {r.g: (r.nodes, r.acyclic) for r in graph.acyclic(e, most).collect()} == {1: (10, True), 2: (4, False), 3: (1, False)}


def test_preorder(spark):
    t = spark.createDataFrame([(1, "r", None, 0, "r"), (1, "b", "r", 2, "b"), (1, "a", "r", 1, "a"), (1, "c", "a", 1, "c"), (1, "x", "y", 0, "x"), (1, "y", "x", 0, "y")], "g long, id string, parent string, pos int, label string")
    rows = {r.id: (r.place, r.depth, r.error) for r in trees.hierarchy(t).collect()}
    assert rows["r"][:2] == (1, 0) and rows["a"][:2] == (2, 1) and rows["c"][:2] == (3, 2) and rows["b"][:2] == (4, 1)
    assert rows["x"] == (None, None, "cycle or unknown parent")


def test_trees_have_64_levels_and_lose_no_node(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None, 0, "x") for i in range(100)] + [(2, f"n{i}", f"n{i - 1}" if i else None, 0, "x") for i in range(64)] + [(1, "o", "nobody", 0, "x")]
    schema = "g long, id string, parent string, pos int, label string"
    rows = {(r.g, r.id): (r.place, r.depth, r.error) for r in trees.hierarchy(spark.createDataFrame(chain, schema)).collect()}
    assert len(rows) == len(chain)
    assert all(rows[2, f"n{i}"] == (i + 1, i, None) for i in range(64)) and rows[1, "n63"] == (64, 63, None)
    assert rows[1, "n64"] == (None, None, "too deep")
    assert {rows[1, f"n{i}"][2] for i in range(65, 100)} | {rows[1, "o"][2]} == {"not reached or below a node that is too deep"}
    assert {r.g for r in trees.mindmap(spark.createDataFrame(chain, schema)).collect()} == {2}


def test_ties_and_repeated_ids_in_trees(spark):
    schema = "g long, id string, parent string, pos int, label string"
    t = [(1, "r", None, 0, "r"), (1, "b", "r", 1, "b"), (1, "a", "r", 1, "a"), (1, "a1", "a", 5, "a1"), (1, "b1", "b", 1, "b1"), (2, "r", None, 0, "r"), (2, "d", "r", 1, "d"), (2, "d", "d", 2, "d"), (2, "e", "d", 1, "e")]
    rows = trees.hierarchy(spark.createDataFrame(t, schema)).collect()
    # children stay under their parent where positions tie
    assert [r.id for r in sorted((r for r in rows if r.g == 1), key=lambda r: r.place)] == ["r", "a", "a1", "b", "b1"]
    assert [r.error for r in rows if r.g == 2 and r.id == "d"] == ["duplicate id"] * 2 and [r.place for r in rows if r.id == "e"] == [None]


def test_a_million_and_a_half_nodes(spark):
    t = spark.range(1_500_000).selectExpr("id div 1000 as g", "id % 1000 as n").selectExpr("g", "n as id", "CASE WHEN n > 0 THEN (n - 1) div 4 END as parent", "cast(n as int) as pos")
    got = graph.preorder(t).agg(F.count("place"), F.max("place"), F.max("depth"), F.countDistinct("g")).first()
    assert tuple(got) == (1_500_000, 1000, 5, 1500)


def test_tree_codes_and_railroads(spark):
    schema = "g long, id string, parent string, pos int, label string"
    t = spark.createDataFrame([(1, "r", None, 0, "top"), (1, "a", "r", 1, "leaf")], schema)
    assert trees.mindmap(t).first().code == "mindmap\n  top\n    leaf"
    assert trees.treeview(t).first().code.startswith("treeView")
    assert {r.error for r in trees.organization(t.filter("id = 'r'")).collect()} == {"no relation"}
    effect, causes = spark.createDataFrame([(1, "e", "late")], "g long, id string, label string"), spark.createDataFrame([(1, "m", None, 1, "machine"), (1, "n", "m", 1, "worn")], schema)
    assert [r.id for r in trees.ishikawa(effect, causes).orderBy("place").collect()] == ["e", "m", "n"]
    rail = spark.createDataFrame([(1, "s", None, 0, "sequence", ""), (1, "c", "s", 1, "choice", ""), (1, "t", "c", 1, "terminal", "x"), (1, "q", "s", 2, "query", "")], "g long, id string, parent string, pos int, kind string, label string")
    assert {r.id: r.error for r in trees.railroad(rail).collect()} == {"s": None, "c": "wrong number of parts", "t": None, "q": "unknown kind"}


bag_of = st.dictionaries(st.sampled_from("abcde"), st.integers(1, 4), max_size=5)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(bag_of, bag_of)
def test_bag_algebra(spark, a, b):
    frame = lambda d: spark.createDataFrame(list(d.items()), "k string, n long")
    x, y = frame(a), frame(b)
    keys = set(a) | set(b)
    assert dict(values(bags.union_max(x, y, ["k"]))) == {k: max(a.get(k, 0), b.get(k, 0)) for k in keys}
    assert dict(values(bags.intersection(x, y, ["k"]))) == {k: min(a[k], b[k]) for k in set(a) & set(b)}
    assert dict(values(bags.difference(x, y, ["k"]))) == {k: a[k] - b.get(k, 0) for k in a if a[k] > b.get(k, 0)}
    f = bags.f1(x, y, ["k"]).first()
    assert f.f1 is None if not b else f.f1 == pytest.approx(2 * sum(min(a.get(k, 0), b[k]) for k in b) / (sum(a.values()) + sum(b.values())))


def test_reversed_arrows_share_no_arc(spark):
    e = edges(spark, ("A", "B"), ("B", "C")).withColumn("n", F.lit(1))
    back = e.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    assert bags.f1(graph.undirected(e), graph.undirected(back), ["a", "b"]).first().f1 == 1
    assert bags.f1(e, back, ["src", "dst"]).first().f1 == 0


def test_alignment_drops_what_is_ambiguous(spark):
    s = spark.createDataFrame([(1, "x", None), (2, "x", "k"), (3, "y", "m"), (4, "z", None)], "id long, label string, key string")
    g = spark.createDataFrame([(7, "x", "k"), (3, "q", None), (9, "z", None)], "id long, label string, key string")
    assert values(align.unique_pairs(s, g, "label")) == [(4, 9)]
    got = values(align.cascade(s.withColumn("i", F.col("id")), g.withColumn("i", F.col("id")), [("id", "i"), ("alias", "key"), ("label", "label")]))
    assert got == sorted([(3, 3, "id"), (2, 7, "alias"), (4, 9, "label"), (1, None, "unmatched")], key=str)
    r = align.remap(spark.createDataFrame([(7, 8)], "a long, b long"), align.unique_pairs(s, g, "key"), ["a", "b"]).first()
    assert (r.a, r.b) == ("2", "generated:8")


def test_align_itself_is_perfect(spark):
    s = spark.createDataFrame([(i, f"l{i}") for i in range(20)], "id long, label string")
    assert align.unique_pairs(s, s, "label").filter("source_id = generated_id").count() == 20


def test_text_functions(spark):
    r = one(spark, a=text.normal_label(F.lit("Groß-Straße  2_x")), b=text.portable(F.lit("1 a/b")), c=text.portable(F.lit("--")), d=text.numbers(F.lit("é5 x7% +3.5% 12 .5")), e=text.utf16_length(F.lit("a\U0001f600")), f=text.csv_field(F.lit('a"b')), g=text.caption(F.lit("Figure 2 (continued)")), h=text.is_continued(F.lit("Figure 2 cont.")), i=text.has_control(F.lit("a​b")), j=text.bounded(text.words(F.lit("a b c")), 2), k=text.nfkc_casefold(F.lit("ＡSS ß")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, r.j, r.k) == ("gross strasse 2_x", "n_1_a_b", "node", ["+3.5%", "12", ".5"], 3, '"a""b"', "figure 2", True, True, None, "ass ss")
    a, b = text.agreed(F.lit("x"), F.lit("y"))
    assert tuple(one(spark, a=a, b=b)) == ("x", True)


def test_numbers_and_dates(spark):
    r = one(spark, a=numeric.decimal_text(F.lit("1.500")), b=numeric.decimal_text(F.lit("0.0")), c=numeric.same_number(F.lit("1"), F.lit("1.00")), d=numeric.percent(F.lit(1), F.lit(200)), e=numeric.hundredths(F.lit(1.005)), f=numeric.round_trips(F.lit("0.1")), g=numeric.round_trips(F.lit("0.10000000000000001")), h=numeric.decimal_text(F.lit("100")))
    assert tuple(r) == ("1.5", "0", True, 1, 1.0, True, False, "100")
    r = one(spark, a=temporal.duration_ms(F.lit("1.5h")), b=temporal.duration_ms(F.lit("1.5d")), c=temporal.duration_ms(F.lit("2M")), d=temporal.parse(F.lit("2024-02-30"), "YYYY-MM-DD"), e=temporal.parse(F.lit("2024-2-03"), "YYYY-MM-DD"))
    assert tuple(r) == (5_400_000, None, 2 * 2_678_400_000, None, None)
    assert one(spark, x=temporal.parse(F.lit("86400000"), "x")).x.day == 2


def test_geometry(spark):
    b = tuple(F.lit(float(x)) for x in (0, 0, 2, 2))
    c = tuple(F.lit(float(x)) for x in (1, 1, 3, 3))
    zero = tuple(F.lit(0.0) for _ in range(4))
    r = one(spark, a=geom.iou(b, c), b=geom.iou(zero, zero), c=geom.crosses(b, tuple(F.lit(float(x)) for x in (2, 0, 3, 1))), d=geom.point_to_box(F.lit(5.0), F.lit(6.0), b), e=geom.reading_direction(F.lit(1.0), F.lit(-3.0)), f=geom.overlap_share(F.lit(0), F.lit(2), F.lit(1), F.lit(5)))
    assert r.a == pytest.approx(1 / 7) and r.b == 0 and r.c is False and r.d == 5 and r.e == "BT" and r.f == 0.5
    m = tuple(F.lit(float(x)) for x in (0, 1, -1, 0, 0, 0))
    assert tuple(one(spark, **dict(zip("abcd", geom.affine_box(m, c))))) == (-3.0, 1.0, -1.0, 3.0)
    assert geom.sharpest and one(spark, x=geom.sharpest(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 4), (2, 0))]))).x == 1


def test_grades_and_policy(spark):
    none = F.lit(None).cast("double")
    r = one(spark, a=policy.grade(F.lit(0.85)), b=policy.grade(none), c=policy.weighted({"syntax": F.lit(1.0), "ocr": none}), d=policy.weighted({"syntax": F.lit(1.0), "ocr": F.lit(0.5)}), e=policy.weighted({"syntax": F.lit(1.0), "ocr": F.lit(0.5)}, True))
    assert (r.a, r.b, r.c, r.e) == ("A", "U", None, 0.5) and r.d == pytest.approx((0.12 + 0.07) / 0.26)
    rows = spark.createDataFrame([("c", "syntax", 1.0), ("c", "ocr", 0.5), ("c", "edge", None), ("d", "syntax", 1.0)], "c string, metric string, value double")
    got = {x.c: x.aggregate for x in policy.weighted_rows(rows, ["c"]).collect()}
    assert got["d"] is None and got["c"] == pytest.approx((0.12 + 0.07) / 0.26)


def test_gates_fail_closed(spark):
    rows = spark.createDataFrame([(True, 1, "x"), (None, 1, "x"), (True, 0, "y")], "v boolean, s int, k string")
    G = gates.Gate
    wanted = {
        G("missing is not true", "all_true", "v", "k = 'x'"): "fail", G("true", "all_true", "v", "k = 'y'"): "pass", G("nothing", "all_true", "v", "k = 'z'"): "unavailable",
        G("no violation", "all_false", "v", "k = 'z'"): "pass", G("no sample", "all_false", "v", "k = 'z'", needs=True): "unavailable", G("violation", "all_false", "v"): "fail",
        G("sum", "sum_zero", "s", "k = 'y'"): "pass", G("mean", "mean", "s", "k = 'z'"): "unavailable", G("over", "ratio_max", "s", "true", 0.5, "1"): "fail", G("no denominator", "ratio", "s", "true", 0.5, "0"): "unavailable",
        G("incomplete", "mean", "CASE WHEN v THEN 1 END", "true", 0.5, complete=True): "unavailable", G("few", "count", "1", "true", 4): "fail", G("one", "any", "v", "k = 'x'"): "pass",
    }
    g = gates.evaluate(rows, list(wanted))
    assert {r.gate: r.status for r in g.collect()} == {k.name: v for k, v in wanted.items()}
    assert gates.overall(g).first().status == "fail" and gates.overall(g.filter("status <> 'fail'")).first().status == "unavailable"


def test_a_release_has_all_gates():
    assert {s: len(g) for s, g in release.SECTIONS.items()} == {"hard": 14, "annotation": 4, "fixture": 9, "functional": 22, "quality": 10}


BOXES = "page long, id long, x1 double, y1 double, x2 double, y2 double, score double"


def test_nearest_ties_are_void(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 2.0, 2.0, 1.0), (1, 2, 6.0, 0.0, 8.0, 2.0, 1.0)], BOXES)
    p = spark.createDataFrame([(1, 1, 4.0, 1.0), (1, 2, 3.0, 1.0), (1, 3, 40.0, 1.0)], "page long, pid long, x double, y double")
    assert values(spatial.nearest(p, b, 3.0)) == [(1, None, None), (2, 1, 1.0), (3, None, None)]


def test_greedy_choices(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 0.0, 30.0, 10.0, 0.5), (2, 4, 0.0, 0.0, 1.0, 1.0, 0.1)], BOXES)
    assert values(spatial.greedy_keep(b, 0.35), "id") == [(1,), (3,), (4,)]
    assert values(spatial.greedy_keep(b, 0.35, 1), "id") == [(1,), (4,)]
    c = spatial.greedy_clusters(b.withColumns({"key": F.col("id").cast("string"), "rank": F.lit(1)}))
    at = dict(values(c, "id", "cluster"))
    assert at[1] == at[2] != at[3]
    assert dict(values(spatial.box_components(b, 2.0), "id", "component")) == {1: 1, 2: 1, 3: 3, 4: 4}
    assert dict(values(spatial.box_components(b, 2.0, most_area=50.0), "id", "component"))[2] == 2


def test_pairs_across_cells_come_once(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0, 1.0), (1, 2, 10.0, 10.0, 90.0, 90.0, 1.0)], BOXES)
    assert spatial.iou_pairs(b, 0.1, size=7.0).count() == 1


def test_fusion_follows_rankings(spark):
    rows = spark.createDataFrame([(1, 0, "vlm", "o1", "a", 0.0, 0.0, 1.0, 1.0, "decision", 0.9, ["e1"]), (1, 0, "vector", "o2", "b", 5.0, 5.0, 6.0, 6.0, "unknown", 0.4, ["e2", "e1"])], "g long, cluster long, source string, owner string, id string, x1 double, y1 double, x2 double, y2 double, role string, confidence double, evidence array<string>")
    for r in (rows, rows.orderBy(F.desc("id"))):
        f = fusion.fuse_elements(r, ["g"]).first()
        assert (f.id, f.x1, f.role, f.confidence, f.evidence) == ("b", 5.0, "decision", 0.9, ["e1", "e2"])
    many = spark.createDataFrame([(1, "vector", "o", "e", "p", 0.5, [str(i) for i in range(200)]), (1, "ocr", "o2", "e", "q", 0.9, [str(i) for i in range(150, 300)])], "g long, source string, owner string, id string, payload string, score double, blocks array<string>")
    m = fusion.merge_evidence(many, ["g"]).first()
    assert (m.payload, m.score, m.collision, m.conflict, len(m.blocks)) == ("p", 0.9, True, True, 200)


def test_relations_with_different_labels_stay(spark):
    rows = spark.createDataFrame([(1, "vlm", "o", "1", "a", "b", "yes", 0.5), (1, "vlm", "o", "2", "a", "b", "no", 0.5), (1, "ocr", "o", "3", "c", "d", None, 0.5), (1, "vlm", "o", "4", "d", "c", "go", 0.5)], "g long, source string, owner string, id string, source_id string, target_id string, label string, confidence double")
    got = values(fusion.fuse_relations(rows, ["g"]), "a", "b", "label", "source_id", "conflict")
    assert got == sorted([("a", "b", "yes", "a", True), ("a", "b", "no", "a", True), ("c", "d", "go", "d", True)], key=str)


def test_pie_rules(spark):
    rows = [(1, 1, "a", 1), (1, 2, "b", 199), (2, 1, "A ", 1), (2, 2, "a", 1), (3, 1, "x", 0)]
    got = {(r.g, r.label): r for r in charts.pie(spark.createDataFrame(rows, "g long, pos long, label string, value long")).collect()}
    assert got[1, "a"].percent == 1 and got[1, "a"].hidden and got[1, "b"].percent == 100
    assert got[2, "a"].error == "duplicate label" and got[3, "x"].error == "no total" and not got[3, "x"].native


def test_venn_checks(spark):
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("a", 2), ("b", 2), ("a", 3)], "name string, member long")
    sizes = {tuple(r.sets): r.size for r in charts.venn(m).collect()}
    assert sizes == {("a",): 3, ("b",): 2, ("c",): 1, ("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1, ("a", "b", "c"): 1}
    four = spark.createDataFrame([(n, i) for i in range(5) for n in "abcd"[: i + 1]], "name string, member long")
    whole = {"".join(r.sets): r.size for r in charts.venn(four).collect()}
    assert len(whole) == 15 and whole["abcd"] == 2 and whole["d"] == 2 and whole["a"] == 5 and whole["bc"] == 3
    assert {len(r.sets) for r in charts.venn(four, 2).collect()} == {1, 2}
    bad = spark.createDataFrame([(["a"], 2), (["b"], 5), (["a", "b"], 3), (["a", "b", "c"], 1)], "sets array<string>, size long")
    errors = {tuple(r.sets): r.error for r in charts.venn_checks(bad).collect()}
    assert errors[("a", "b")] == "larger than a part of it" and errors[("a", "b", "c")] == "a part is missing"


def test_wardley_and_radar(spark):
    n, e = charts.wardley(spark.createDataFrame([(1, "a", "A", 0.5, 1.5), (1, "b", "B", 0.1, 0.2)], "g long, id string, label string, x double, y double"), spark.createDataFrame([(1, "a", "b"), (1, "b", "b"), (1, "a", "z")], "g long, source string, target string"))
    assert {r.id: r.error for r in n.collect()} == {"a": "point is outside", "b": None}
    assert {r.target + r.source: r.error for r in e.collect()} == {"ba": None, "bb": "link to itself", "za": "unknown end"}
    v = [(1, "s", i, float(i)) for i in range(3)] + [(1, "t", 0, 1.0)]
    assert {r.series: r.error for r in charts.radar(spark.createDataFrame(v, "g long, series string, dim int, value double")).collect()} == {"s": None, "t": "a value is missing"}


def test_network_suffixes_follow_what_was_emitted(spark):
    rows = [(1, "nodes", 1, "a b", None, None), (1, "nodes", 2, "a-b", None, None), (1, "nodes", 3, "a_b_2", None, "hexagon"), (1, "nodes", 4, None, None, None), (1, "nodes", 5, "", "five", None), (1, "nodes", 6, "a b", None, None), (1, "nodes", 7, "--", None, None), (1, "nodes", 8, "7", None, None)]
    k = network.KINDS["state"]
    n = network.nodes(k, spark.createDataFrame(rows, "g long, record string, pos int, id string, label string, role string"))
    got = {r.pos: (r.id, r.emitted, r.error) for r in n.collect()}
    twice = "duplicate id"
    assert got == {1: ("a b", "a_b", twice), 2: ("a-b", "a_b_2", None), 3: ("a_b_2", "a_b_2_2", "unknown role"), 4: ("N4", "N4", None), 5: ("N5", "N5", None), 6: ("a b", "a_b_3", twice), 7: ("--", "N7", None), 8: ("7", "n_7", None)}
    assert {r.pos: r.label for r in n.collect()}[4] == "N4"
    n = n.filter("pos < 4")
    e = network.edges(k, spark.createDataFrame([(1, 1, "a b", "a-b", "x", None), (1, 2, "a b", "?", None, None)], "g long, pos int, source string, target string, label string, token string"), n)
    assert {r.target: r.error for r in e.collect()} == {"a-b": None, "?": "unknown target"}
    assert network.lines(k, n, e).count() == 0
    code = network.lines(k, n.withColumn("error", F.lit(None).cast("string")), e.filter("error is null")).first().code
    assert code == 'stateDiagram-v2\n  a_b["a b"]\n  a_b_2["a-b"]\n  a_b_2_2["a_b_2"]\n  a_b -->|"x"| a_b_2'


def test_ambiguous_ids_reach_a_fixed_point(spark):
    def found(*ids):
        rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(ids)], "g long, pos int, id string")
        got = identifiers.ambiguous(rows, ["pos"]).collect()
        return {r.id for r in got if r.side == "source"}, {r.id for r in got if r.side == "emitted"}

    assert found("a b", "a-b", "a_b_2", "c") == ({"a b", "a-b", "a_b_2"}, {"a_b", "a_b_2", "a_b_2_2"})
    # through what the third is emitted as, the fourth
    assert found("a b", "a-b", "a_b_2", "a_b_2_2") == ({"a b", "a-b", "a_b_2", "a_b_2_2"}, {"a_b", "a_b_2", "a_b_2_2", "a_b_2_2_2"})
    assert found("a_b", "c", "d") == (set(), set()) and found("x", "x")[0] == {"x"}
    source = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a-b"), (1, 2, "a_b_2"), (1, 3, "c"), (1, 4, None)], "g long, pos int, id string")
    other = spark.createDataFrame([(1, 0, "a b"), (1, 2, "a_b_2"), (1, 3, "c"), (1, 4, None), (1, 5, "a_b")], "g long, pos int, id string")
    assert values(align.by_id(source, other, ["pos"])) == [(1, "c", "c")]


@pytest.mark.parametrize("name", sorted(network.KINDS))
def test_every_network_kind(spark, name):
    k = network.KINDS[name]
    role = k.roles[0] if k.roles else None
    parts = {r: spark.createDataFrame([(1, i, f"{r}{i}", None, role) for i in range(2)], "g long, pos int, id string, label string, role string") for r in k.records}
    n = network.nodes(k, network.merged(parts))
    first = k.records[0]
    token = k.tokens[0] if k.tokens else None
    e = network.edges(k, spark.createDataFrame([(1, 0, f"{first}0", f"{first}1", None, token), (1, 1, f"{first}0", f"{first}0", None, "no such")], "g long, pos int, source string, target string, label string, token string"), n)
    errors = {r.pos: r.error for r in e.collect()}
    assert errors[0] is None and (errors[1] is not None) == (bool(k.tokens) or not k.loops)
    assert network.lines(k, n, e.filter("pos = 0")).first().code.startswith(k.header)
    scene, relations = network.to_scene(n, e)
    assert scene.count() == 2 * len(k.records) and relations.count() >= 1
    assert network.visible_text(n, e).count() >= scene.count()


def test_git_rules(spark):
    log = [(1, "branch", "x", "0"), (2, "commit", "", "a"), (3, "branch", "x", "0"), (4, "commit", "", "b"), (5, "merge", "x", "m"), (6, "checkout", "main", ""), (7, "merge", "x", "m"), (8, "commit", "", "a")]
    df = spark.createDataFrame([(1, *r) for r in log], "g long, seq int, op string, branch string, id string")
    r = ordered.git_replay(df).first()
    assert (r.operations, r.commits, r.branches, r.current, r.head, r.merges) == (5, 3, 2, "main", "m", 1) and r.error.startswith("1: branch without")
    assert ordered.git_replay(df, strict=True).first().operations == 0


def test_schedule_errors(spark):
    rows = [(1, 1, 1, None, 0, 5), (1, 2, 2, [1], None, 5), (1, 3, 3, [9], None, 5), (1, 4, 4, None, None, 5), (1, 5, 1, None, 0, 1)]
    got = {r.pos: (r.end_ms, r.error) for r in ordered.schedule(spark.createDataFrame(rows, "g long, pos long, id long, after array<long>, start_ms long, duration_ms long")).collect()}
    assert got == {1: (5, None), 2: (10, None), 3: (None, "dependency is not earlier"), 4: (None, "no start"), 5: (None, "duplicate id")}


def test_review_timeline(spark):
    s = review.State()
    for op, rev in (("edit", 1), ("edit", 2), ("undo", 0), ("edit", 3), ("redo", 0)):
        s.apply(op, rev)
    assert (s.timeline, s.cursor, s.version, s.refused) == ([-1, 1, 3], 2, 4, 1)
    assert not s.apply("edit", 4, expected=0)
    n = spark.createDataFrame([(1, "a", "A"), (1, "b", "B")], "bundle long, id string, label string")
    e = spark.createDataFrame([(1, "e", "a", "b", None)], "bundle long, id string, source string, target string, label string")
    ops = spark.createDataFrame([(1, 1, "relabel", "a", None, None, "AA"), (1, 2, "delete_node", "b", None, None, None), (1, 3, "add_node", "c", None, None, "C"), (1, 4, "add_edge", "f", "a", "c", "new")], "bundle long, seq long, op string, id string, source string, target string, label string")
    got = review.apply_operations(n, e, ops)
    assert values(got, "kind", "id", "label") == [("edge", "f", "new"), ("node", "a", "AA"), ("node", "c", "C")]


def test_review_operations_meet_the_scene_before_them(spark):
    n = spark.createDataFrame([(1, "a", "A"), (1, "b", "B"), (2, "a", "other")], "bundle long, id string, label string")
    e = spark.createDataFrame([(1, "e", "a", "b", "old")], "bundle long, id string, source string, target string, label string")
    log = [
        ("relabel", "c", None, None, "too early", None), ("add_node", "c", None, None, "C", None), ("relabel", "c", None, None, "CC", None), ("add_edge", "f", "a", "c", None, None), ("label_edge", "f", None, None, "said", None),
        ("group", "g", None, None, "G", ["a", "c"]), ("group", "h", None, None, "H", ["b", "c"]), ("reconnect", "e", "c", "b", None, None), ("label_edge", "e", None, None, None, None), ("delete_node", "b", None, None, None, None),
        ("add_node", "b", None, None, "again", None), ("add_edge", "k", "a", "z", None, None), ("group", "m", None, None, "M", ["b"]), ("delete_node", "a", None, None, None, None), ("ungroup", "g", None, None, None, None), ("group", "p", None, None, "P", ["b", "c"]),
    ]
    ops = spark.createDataFrame([(1, i, *r) for i, r in enumerate(log)], "bundle long, seq long, op string, id string, source string, target string, label string, members array<string>")
    got = review.apply_operations(n, e, ops).collect()
    assert {(r.bundle, r.kind, r.id, r.label) for r in got if r.kind != "refused"} == {(1, "node", "c", "CC"), (1, "node", "b", "again"), (1, "group", "p", "P"), (2, "node", "a", "other")}
    assert sorted((r.label, r.id) for r in got if r.kind == "refused") == sorted([("relabel", "c"), ("group", "h"), ("add_edge", "k"), ("group", "m")])


def test_code_findings(spark):
    cases = {
        "%%{init: {}}%%": {(1, "directive")}, "a\n---\nconfig: x": {(2, "frontmatter"), (3, "frontmatter")}, "click A call()": {(1, "callback"), (1, "click")}, "A[\"//x.org\"]": {(1, "protocol_relative_url")},
        "A -->|\"<b>\"| B": {(1, "html")}, "A --> B <-- C > D": set(), "a <br/ > b": {(1, "html")}, "<a b='>' c=d>": {(1, "html")}, "<a b='>": set(), "x <!DOCTYPE": {(1, "html")}, "x <!doctypes": set(),
        "icon fa:fa-x": {(1, "remote_icon")}, "@import 'x'": {(1, "css_import")}, "a\r\nb HTTPS:": {(2, "external_url")}, "ab\0": {(0, "nul_byte")},
        "stateDiagram-v2\nstate s <<choice>>": set(), "flowchart LR\nstate s <<choice>> ": {(2, "html")}, "stateDiagram\n<x>": {(2, "html")},
        "flowchart LR\nA[\"x; click B\"]; click C d": {(2, "click")}, "flowchart LR\nA --> B; style A fill:#fff": {(2, "style_syntax")}, "sequenceDiagram\nA: \"x; click B y\"": {(2, "click")}, "%% click A\nclass x": set(),
        "accTitle: a; click b c": set(), "flowchart LR\naccDescr { a\nclick b c\n}\nclassDef x": {(5, "style_syntax")},
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(99, None)], "id long, code string")
    got = security.code_findings(rows, "id", "code").collect()
    for i, (code, want) in enumerate(cases.items()):
        assert {(r.line, r.rule) for r in got if r.id == i} == want, code
    loose = security.code_findings(rows, "id", "code", strict=False)
    assert loose.filter("rule = 'style_syntax'").count() == 0 and loose.filter("rule = 'click'").count() > 0
    # no part of a tag is tried twice
    import time

    long = spark.createDataFrame([(1, "<a " + "b=" * 20_000), (2, "<a " + "b" * 50_000), (3, "<" * 50_000)], "id long, code string")
    began = time.time()
    assert security.code_findings(long, "id", "code").count() == 0 and time.time() - began < 20


def test_svg_findings():
    ok = '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 1 1">{}</svg>'
    find = lambda inner, **kw: security.svg_findings(ok.format(inner), **kw)
    assert find("<g/>") == [] and find('<a href="#x" style="fill:url(#a)"/>') == []
    assert find("<script/>") == ["rendered SVG contains forbidden <script>"]
    assert find("<foreignObject/>") == ["rendered SVG contains forbidden <foreignObject>"] and find("<foreignObject/>", strict=False) == []
    assert find('<a href="http://x" onClick="y"/>') == ["rendered SVG contains an external href", "rendered SVG contains event handler onclick"]
    assert find('<g style="fill: URL( \'http://x\' )"/><style>@IMPORT "x"</style>') == ["rendered SVG contains external CSS"]
    assert find('<rect x="NaN" viewBox="0 Infinity"/>') == ["rendered SVG contains non-finite geometry attribute viewbox", "rendered SVG contains non-finite geometry attribute x"]
    assert find('<rect class="a task" width="0" height="1"/>', diagram_type=" Gantt ") == ["rendered Gantt contains a non-visible task rectangle"] and find('<rect class="task" width="2" height="1"/>', diagram_type="gantt") == []
    assert security.svg_findings("<p/>") == ["rendered SVG has no dimensions", "rendered output does not have an SVG root"]
    assert security.svg_findings("<svg")[0].startswith("rendered output is not XML")


def test_folds_stream_over_batches(spark):
    df = spark.range(50_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))

    def step(k, rows):
        total = last = 0
        for (v,) in rows:
            assert v >= last
            total, last = total + v, v
        yield k, total

    got = dict(values(folds.fold(df, "k", ["v"], step, "k long, total long")))
    assert got == {k: sum(range(k, 50_000, 3)) for k in range(3)}


def test_repairs(spark):
    code = F.lit('﻿```diagram\nflowchart LR\r\n  a["x]\n```')
    assert one(spark, x=repair.clean_code(code)).x == 'flowchart LR\n  a["x"]\n'
    assert one(spark, x=repair.code_events(F.lit("flowchart LR\n"))).x == []
    lines = spark.createDataFrame([(1, 1, "a[x]"), (1, 2, "a[x]"), (1, 3, "a --> b"), (1, 4, "a --> b")], "g long, pos int, line string")
    assert values(repair.drop_repeated_lines(lines), "pos") == [(1,), (3,), (4,)]
    none = F.lit(None).cast("double")
    assert one(spark, x=repair.accepted(F.lit(0.5), F.lit(0.6), F.lit(0.5), F.lit(0.4)), y=repair.accepted(none, F.lit(0.6), none, none), z=repair.accepted(F.lit(0.5), F.lit(0.6), F.lit(0.5), F.lit(0.5)))[:] == (False, False, True)


def test_bold_and_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, "Pay now"), (1, 2, 20.0, 0.0, 30.0, 10.0, "Stop")], "page long, id long, x1 double, y1 double, x2 double, y2 double, label string")
    spans = spark.createDataFrame([(1, 1, 5.0, 1.0, 9.0, 2.0, "now", True), (1, 2, 1.0, 1.0, 4.0, 2.0, "Pay", True), (1, 3, 21.0, 1.0, 24.0, 2.0, "Stop", False)], "page long, pid long, x1 double, y1 double, x2 double, y2 double, text string, bold boolean")
    assert dict(values(repair.bold_support(labels, spans), "id", "bold")) == {1: True, 2: False}
    ev = spark.createDataFrame([(1, 1, 5.0, 5.0, "Pay later", "ocr", 0.9), (1, 2, 25.0, 5.0, "Halt", "ocr", 0.5)], "page long, pid long, x double, y double, text string, kind string, score double")
    assert values(repair.trusted_labels(labels.withColumnRenamed("label", "text"), ev), "id", "proposed") == [(1, "Pay later")]
