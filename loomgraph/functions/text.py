"""Text functions as column expressions; they stay in generated code.

One thing has no built-in: compatibility normalisation (NFKC), for which ``nfkc_casefold`` is an
Arrow UDF.  ``casefold`` covers what lower-casing leaves in the scripts at hand.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"
#: A number that no word character precedes, with an optional sign, fraction and percent sign.
NUMBER = r"(?U)(?<!\w)[+-]?(?:\d+(?:\.\d+)?|\.\d+)%?"
#: Control, format, line and paragraph separators.
CONTROL = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
ZERO_WIDTH = "​"


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def words(c: Column) -> Column:
    """Word tokens of the folded text."""
    return F.regexp_extract_all(casefold(c), F.lit(f"({WORD})"), F.lit(1))


def normal_label(c: Column) -> Column:
    """Word tokens with one space between them."""
    return F.array_join(words(c), " ")


def normal_space(c: Column) -> Column:
    return casefold(F.trim(F.regexp_replace(c, r"\s+", " ")))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))


def bounded(tokens: Column, most: int) -> Column:
    """Null, not a prefix, when there are too many tokens."""
    return F.when(F.size(tokens) <= most, tokens)


def portable(c: Column, fallback: str = "node") -> Column:
    """An identifier of ASCII letters, digits and underscores that no digit begins."""
    bare = F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")
    return F.when(bare == "", F.lit(fallback)).when(bare.rlike("^[0-9]"), F.concat(F.lit("n_"), bare)).otherwise(bare)


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("long")


def neutral(c: Column, tokens: list[str]) -> Column:
    """A zero-width space after each token that the target grammar would act on."""
    for t in tokens:
        c = F.replace(c, F.lit(t), F.lit(t + ZERO_WIDTH))
    return c


def glyphs(c: Column, pairs: dict[str, str]) -> Column:
    return F.translate(c, "".join(pairs), "".join(pairs.values()))


def csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def caption(c: Column) -> Column:
    """A caption without a mark that it goes on from before."""
    return F.trim(F.regexp_replace(normal_space(c), r"\(?\b(continued|cont\.?)(?!\w)\)?", ""))


def is_continued(c: Column) -> Column:
    return normal_space(c).rlike(r"\b(continued|cont\.?)(?!\w)")


def agreed(a: Column, b: Column) -> tuple[Column, Column]:
    """A field that has two names: its value, and whether both are given and differ."""
    return F.coalesce(a, b), a.isNotNull() & b.isNotNull() & (a != b)


def code_labels(line: Column) -> Column:
    """Labels in a line of diagram code: what is quoted, and what is in brackets or after a colon."""
    quoted = F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1))
    boxed = F.regexp_extract_all(line, F.lit(r"[\[({|]([^\[\](){}|\"]+)[\])}|]"), F.lit(1))
    after = F.regexp_extract(line, r"^[^:\"]*:\s*([^:]+)$", 1)
    return F.when(F.size(quoted) > 0, quoted).when(F.size(boxed) > 0, boxed).when(after != "", F.array(F.trim(after))).otherwise(F.array().cast("array<string>"))


#: First word of a diagram's code, and the grammar that it names.
GRAMMARS = {"flowchart": "flowchart", "graph": "flowchart", "sequenceDiagram": "sequence", "classDiagram": "class", "stateDiagram": "state", "stateDiagram-v2": "state", "erDiagram": "er", "gantt": "gantt", "pie": "pie", "mindmap": "mindmap", "timeline": "timeline", "journey": "journey", "kanban": "kanban", "gitGraph": "gitgraph", "quadrantChart": "quadrant", "xychart-beta": "xychart", "sankey-beta": "sankey", "radar-beta": "radar", "treemap-beta": "treemap", "packet-beta": "packet", "requirementDiagram": "requirement", "block-beta": "block", "architecture-beta": "architecture"}


def grammar(code: Column) -> Column:
    first = F.regexp_extract(code, r"^\s*([A-Za-z0-9-]+)", 1)
    return F.element_at(F.create_map(*[F.lit(x) for pair in GRAMMARS.items() for x in pair]), F.when(first != "", first))


def command(c: Column) -> Column:
    """op, a, b, label of an editing sentence in English or Korean; op is null if none fits."""
    ident = r"([A-Za-z0-9_.-]+)"
    rules = [
        ("delete_node", rf"(?i)^(?:delete|remove) node {ident}$", 1, None, None),
        ("add_edge", rf"(?i)^(?:connect|link) {ident} (?:to|with) {ident}$", 1, 2, None),
        ("delete_edge", rf"(?i)^(?:disconnect|unlink) {ident} (?:from) {ident}$", 1, 2, None),
        ("relabel", rf"(?i)^rename (?:node )?{ident} to (.+)$", 1, None, 2),
        ("delete_node", rf"^노드 {ident} 삭제$", 1, None, None),
        ("add_edge", rf"^{ident}(?:와|과|에서) {ident}(?:로)? 연결$", 1, 2, None),
        ("relabel", rf"^{ident} 이름을 (.+?)(?:으)?로 변경$", 1, None, 2),
    ]
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("op"), none.alias("a"), none.alias("b"), none.alias("label"))
    for op, pattern, a, b, label in reversed(rules):
        pick = lambda g: F.regexp_extract(text, pattern, g) if g else none  # noqa: B023, E731
        out = F.when(text.rlike(pattern), F.struct(F.lit(op).alias("op"), pick(a).alias("a"), pick(b).alias("b"), pick(label).alias("label"))).otherwise(out)
    return out
