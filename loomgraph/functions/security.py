"""Scans of diagram code and of rendered SVG for what must not be in them.

Rules of a line are regular expressions that Spark evaluates.  Rules of a statement need the code cut at semicolons
outside of quoted labels; only codes that name such a statement at all go through Python, in Arrow batches.
SVG is parsed there too.
"""

from __future__ import annotations

import math
import re
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rules of a line
LINE_RULES = {
    "directive": r"%%\s*\{",
    "callback": r"\b(?:call|callback)\s*\(",
    "external_url": r"(?:https?|ftp|file|data|javascript):",
    "protocol_relative_url": r"[\"'(=]\s*//[^/\s]",
    "frontmatter": r"^\s*(?:---|config\s*:)",
    "css_import": r"@import\b",
    "remote_icon": r"iconify|fa:|logos:",
}
# fixed values: rules of a statement, and the header and the line under which an angle bracket is no tag
STATEMENT_RULES = {"click": r"^\s*click\s+", "style_syntax": r"^\s*(?:style|classDef|linkStyle)\b"}
STATE_HEADER = r"^\s*stateDiagram(?:-v2)?\s*$"
PSEUDOSTATE = r"^\s*state\s+[A-Za-z_][A-Za-z0-9_]*\s+<<(?:choice|fork|join)>>\s*$"
FLOWCHART_HEADER = r"^\s*(?:flowchart|graph)\b"
COMMENT = r"^\s*%%"
#: What ends a line.
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"

_NAME = r"[^\s\x00\"'><=/]++"
_VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<=>]++(?![\"'<=]))"
#: A comment, an instruction, a document type, or a whole tag: no part is tried twice.
HTML = rf"<!--|<\?|<!doctype(?=\s|>|$)|</[A-Za-z][A-Za-z0-9_:-]*+\s*+>|<[A-Za-z][A-Za-z0-9_:-]*+(?:\s++(?:{_NAME}\s*+(?:=\s*+{_VALUE}\s*+)?+)*+)?+(?:/\s*+)?+>"


def _rule(pattern: str) -> str:
    """White space and case as Unicode has them."""
    return f"(?iuU){pattern}"


def _first_statement(code: Column) -> Column:
    lines = F.split(code, LINE_END)
    return F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(_rule(r"\S")) & ~x.rlike(_rule(COMMENT))), F.lit(0)), F.lit(""))


def statements(code: str) -> list[tuple[int, str]]:
    """(line of the beginning, text) of each statement.

    Statements end with a line or a semicolon.  In a flowchart a label in double quotes (opened after a bracket,
    slash or colon) holds both; so does a block of accessible text in braces; accessible text after a colon
    holds semicolons.  Comment lines are left out.
    """
    lines = code.splitlines()
    first = next((x for x in lines if x.strip() and not re.match(COMMENT, x)), "")
    flowchart = re.match(FLOWCHART_HEADER, first, re.I) is not None
    out, now, begin, inside = [], "", 1, None
    for n, line in enumerate(lines, 1):
        if inside is None and re.match(COMMENT, line):
            begin = n + 1
            continue
        said = False
        for c in line:
            if inside == "block":
                now += c
                inside = None if c == "}" else inside
            elif said:
                now += c
            elif inside == "quote":
                now += c
                inside = None if c == '"' else inside
            elif c == ";":
                out.append((begin, now))
                now, begin = "", n
            else:
                if flowchart and c == '"' and now.rstrip()[-1:] in tuple("[({>/\\:"):
                    inside = "quote"
                now += c
                said = c == ":" and re.fullmatch(r"\s*acc(?:Title|Descr)\s*:", now, re.I) is not None
                if c == "{" and re.fullmatch(r"\s*accDescr\s*\{", now, re.I):
                    inside = "block"
        if inside is None:
            out.append((begin, now))
            now, begin = "", n + 1
        else:
            now += "\n"
    if now:
        out.append((begin, now))
    return out


def code_findings(rows: DataFrame, id: str, code: str, strict: bool = True) -> DataFrame:
    """id, line (from 1; 0: the whole code), rule of what must not be in diagram code; style statements only if ``strict``.

    A null code has no findings.
    """
    lean = rows.select(F.col(id).alias("id"), F.col(code).alias("code")).filter(F.col("code").isNotNull())
    lines = lean.withColumn("state", _first_statement(F.col("code")).rlike(_rule(STATE_HEADER))).select("id", "state", F.posexplode(F.split("code", LINE_END)).alias("n", "text"))
    broken = [F.when(F.col("text").rlike(_rule(p)), F.lit(name)) for name, p in LINE_RULES.items()]
    broken.append(F.when(F.col("text").rlike(_rule(HTML)) & ~(F.col("state") & F.col("text").rlike(_rule(PSEUDOSTATE))), F.lit("html")))
    found = lines.select("id", (F.col("n") + 1).alias("line"), F.explode(F.array_compact(F.array(*broken))).alias("rule"))
    whole = lean.filter(F.contains("code", F.lit("\0"))).select("id", F.lit(0).alias("line"), F.lit("nul_byte").alias("rule"))
    wanted = {k: re.compile(v, re.I) for k, v in STATEMENT_RULES.items() if strict or k == "click"}
    schema = lean.select("id").schema.add("line", "integer").add("rule", "string")
    arrow = pa.schema([pa.field("line", pa.int32()), pa.field("rule", pa.string())])

    def run(batches):
        for batch in batches:
            at, line, rule = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                # a rule is broken once on a line, whatever statements begin there
                hits = {(n, name) for n, s in statements(text) for name, p in wanted.items() if p.search(s)}
                for n, name in sorted(hits):
                    at.append(i)
                    line.append(n)
                    rule.append(name)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(line, arrow.field("line").type), pa.array(rule)], names=["id", "line", "rule"])

    some = lean.filter(F.col("code").rlike(r"(?i)click|style|classDef")).mapInArrow(run, schema)
    return found.unionByName(whole).unionByName(some)


# fixed values: elements that must not be drawn, and attributes that must be finite
FORBIDDEN = ("script", "iframe", "object", "embed", "link")
GEOMETRY = ("cx", "cy", "d", "height", "points", "r", "rx", "ry", "transform", "viewbox", "width", "x", "x1", "x2", "y", "y1", "y2")


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _outside(css: str) -> bool:
    """Whether style text reaches out of the document."""
    css = css.casefold()
    inner = (m[2].strip() for m in re.finditer(r"url\s*\(\s*(['\"]?)(.*?)\1\s*\)", css))
    return "@import" in css or any(not x.startswith("#") for x in inner)


def _finite(text: str | None) -> bool:
    try:
        return math.isfinite(float(text or "")) and float(text) > 0
    except ValueError:
        return False


def svg_findings(svg: str, strict: bool = True, diagram_type: str | None = None) -> list[str]:
    """What must not be in a rendered SVG, in order and each once."""
    try:
        root = ElementTree.fromstring(svg)
    except ElementTree.ParseError as e:
        return [f"rendered output is not XML: {e}"]
    said = {
        "rendered output does not have an SVG root": _local(root.tag) != "svg",
        "rendered SVG has no dimensions": not (root.get("viewBox") or root.get("width") or root.get("height")),
    }
    kind = root.get("aria-roledescription") if diagram_type is None else diagram_type
    gantt = (kind or "").strip().casefold() == "gantt"
    never = {*FORBIDDEN, "foreignObject"} if strict else set(FORBIDDEN)
    for e in root.iter():
        if not isinstance(e.tag, str):
            continue
        tag = _local(e.tag)
        if tag in never:
            said[f"rendered SVG contains forbidden <{tag}>"] = True
        if gantt and tag == "rect" and "task" in (e.get("class") or "").split() and not (_finite(e.get("width")) and _finite(e.get("height"))):
            said["rendered Gantt contains a non-visible task rectangle"] = True
        if tag == "style" and _outside("".join(e.itertext())):
            said["rendered SVG contains external CSS"] = True
        for name, value in ((_local(k).lower(), v.strip().lower()) for k, v in e.attrib.items()):
            if name.startswith("on"):
                said[f"rendered SVG contains event handler {name}"] = True
            if name == "href" and value and value[0] != "#":
                said["rendered SVG contains an external href"] = True
            if _outside(value):
                said["rendered SVG contains external CSS"] = True
            if name in GEOMETRY and ("nan" in value or "infinity" in value):
                said[f"rendered SVG contains non-finite geometry attribute {name}"] = True
    return sorted(k for k, v in said.items() if v)


def svg_scan(rows: DataFrame, id: str, svg: str, strict: bool = True) -> DataFrame:
    """id, finding of rendered SVGs; a null one has none."""
    lean = rows.select(F.col(id).alias("id"), F.col(svg).alias("svg")).filter(F.col("svg").isNotNull())

    def run(batches):
        for batch in batches:
            found = [svg_findings(x, strict) for x in batch.column(1).to_pylist()]
            at = [i for i, x in enumerate(found) for _ in x]
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([f for x in found for f in x])], names=["id", "finding"])

    return lean.mapInArrow(run, lean.select("id").schema.add("finding", "string"))
