"""Code of class, entity and requirement diagrams: errors, directions, suffixes."""

from loomgraph.plans import uml
from loomgraph.operators import fusion, vector

CLASS = "g long, pos long, id string, label string"
MEMBER = "g long, id string, pos long, kind string, name string, type string, parameters string, visibility string, classifier string"
CLASS_RELATION = "g long, pos long, source string, target string, type string, label string, source_cardinality string, target_cardinality string"


def test_classes(spark):
    records = spark.createDataFrame([(1, 0, "a b", 'A "x"'), (1, 1, "a-b", None), (2, 0, "c", "C"), (3, 0, "d", "D")], CLASS)
    members = spark.createDataFrame([(1, "a b", 1, "method", "run", "int", "long n", "+", None), (1, "a b", 0, None, "size", "int", None, None, "static"), (2, "c", 0, "field", "x{", None, None, None, None)], MEMBER)
    relations = spark.createDataFrame([(1, 0, "a b", "a-b", "inheritance", "is", "1", "n"), (3, 0, "d", "e", "link", None, None, None), (3, 1, "d", "d", "odd", None, None, None)], CLASS_RELATION)
    got = {r.g: (r.code, r.error) for r in uml.classes(records, members, relations).collect()}
    assert got[1] == ('classDiagram\n    class a_b["A #quot;x#quot;"] {\n        int size$\n        +run(long n) int\n    }\n    class a_b_2["a-b"]\n    a_b_2 "n" <|-- "1" a_b : is', None)
    assert got[2] == (None, "member has unsupported syntax")
    assert got[3] == (None, "unknown relation")


def test_entities(spark):
    records = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", "B"), (2, 0, "c", "c")], CLASS)
    attributes = spark.createDataFrame([(1, "b", 0, "int", "n", ["PK", "UK"], "no"), (2, "c", 0, "int", "n", ["XX"], None)], "g long, id string, pos long, type string, name string, keys array<string>, comment string")
    relations = spark.createDataFrame([(1, 0, "a", "b", "one", "zero_or_more", False, "has")], "g long, pos long, source string, target string, source_cardinality string, target_cardinality string, identifying boolean, label string")
    got = {r.g: (r.code, r.error) for r in uml.entities(records, attributes, relations).collect()}
    assert got[1] == ('erDiagram\n    a\n    b["B"] {\n        int n PK,UK "no"\n    }\n    a ||..o{ b : "has"', None)
    assert got[2] == (None, "unknown key")


def test_requirements(spark):
    records = spark.createDataFrame([(1, 0, "r", None, "must", None, "Test"), (2, 0, "s", "odd", "must", None, None), (3, 0, "t", None, "", None, None)], "g long, pos long, id string, type string, text string, risk string, method string")
    elements = spark.createDataFrame([(1, 0, "e", None, None)], "g long, pos long, id string, type string, docref string")
    relations = spark.createDataFrame([(1, 0, "e", "r", None)], "g long, pos long, source string, target string, type string")
    got = {r.g: (r.code, r.error) for r in uml.requirements(records, elements, relations).collect()}
    assert got[1] == ('requirementDiagram\ndirection TB\nrequirement r {\nid: "r"\ntext: "must"\nrisk: medium\nverifyMethod: test\n}\nelement e {\ntype: "element"\ndocref: "e"\n}\ne - traces -> r', None)
    assert got[2] == (None, "unknown type")
    assert got[3] == (None, "requirement without a text")


def test_vector_duplicates(spark):
    shapes = "page long, id long, kind string, points string, x1 double, y1 double, x2 double, y2 double, confidence double"
    rows = [(1, 1, "line", "p", 0.0, 0.0, 100.0, 100.0, 0.5), (1, 2, "line", "p", 0.0, 0.0, 100.0, 100.0, 0.9), (1, 3, "line", "p", 0.5, 0.0, 100.5, 100.0, 0.1), (1, 4, "line", "q", 0.5, 0.0, 100.5, 100.0, 0.1), (1, 5, "line", "p", 9.0, 0.0, 9.0, 5.0, 0.1), (1, 6, "line", "p", 9.0, 0.0, 8.0, 5.0, 0.1)]
    assert sorted(r.id for r in vector.distinct_primitives(spark.createDataFrame(rows, shapes)).collect()) == [2, 4, 5]
    assert vector.distinct_primitives(spark.createDataFrame([], shapes)).collect() == []
    texts = [(1, i, "t", 0.0, 0.0, 2.0, 2.0, c, w) for i, c, w in ((1, 0.5, 400), (2, 0.5, None), (3, 0.1, 400))] + [(1, 9, "u", 0.0, 0.0, 2.0, 2.0, 0.5, 700), (1, 10, "u", 0.0, 0.0, 0.0, 2.0, 0.5, 700)]
    got = vector.distinct_texts(spark.createDataFrame(texts, "page long, id long, text string, x1 double, y1 double, x2 double, y2 double, confidence double, weight int")).collect()
    assert sorted((r.text, r.id, r.weight) for r in got) == [("t", 1, None), ("u", 9, 700)]


def test_shared_authority(spark):
    inputs = spark.createDataFrame([(1, 0, ["a", "a", "b"]), (1, 1, ["b", "c"]), (2, 0, ["a"]), (2, 1, None), (3, 0, ["a"]), (3, 1, [])], "g long, input long, ids array<string>")
    assert [(r.g, r.id) for r in fusion.shared_authority(inputs, ["g"]).collect()] == [(1, "b")]
