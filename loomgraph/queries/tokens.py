"""Bags of words and numbers, and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import digest, numeric, security, temporal, text
from loomgraph.operators import bags
from loomgraph.queries._registry import query
from loomgraph.sources import corpora

TOK = "unnest(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+'))"
TURNS = f"WITH t AS (SELECT conv_id, role, {TOK.format(c='text')} AS token FROM conversations), u AS (SELECT conv_id, token, count(*) AS n FROM t WHERE role = 'user' GROUP BY 1, 2), a AS (SELECT conv_id, token, count(*) AS n FROM t WHERE role = 'assistant' GROUP BY 1, 2)"


def _turn_bags(spark, sf_dir):
    c = corpora.table(spark, sf_dir, "conversations").filter(F.col("role").isin("user", "assistant"))
    b = bags.bag(c.select("conv_id", "role", F.explode(text.words(F.col("text"))).alias("token")), "conv_id", "role", "token")
    return b.filter("role = 'user'"), b.filter("role = 'assistant'")


@query(f"SELECT token, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs FROM (SELECT doc_id, {TOK.format(c='text')} AS token FROM documents) GROUP BY 1")
def token_multiset(spark, sf_dir):
    """Multiplicity of every folded word, and in how many texts it is."""
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("token"))
    return bags.bag(d, "doc_id", "token").groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(TURNS + " SELECT conv_id, CAST(sum(least(coalesce(u.n, 0), coalesce(a.n, 0))) AS BIGINT) AS overlap, CAST(coalesce(sum(u.n), 0) AS BIGINT) AS wanted, round(sum(least(coalesce(u.n, 0), coalesce(a.n, 0))) / nullif(coalesce(sum(u.n), 0), 0), 9) AS recall FROM u FULL JOIN a USING (conv_id, token) GROUP BY conv_id")
def ocr_recall_by_case(spark, sf_dir):
    """How much of one bag of words another holds, by case; null where nothing is wanted."""
    u, a = _turn_bags(spark, sf_dir)
    return bags.recall(a, u, ["token"], ["conv_id"]).withColumn("recall", F.round("recall", 9))


@query(TURNS + " SELECT CAST(sum(least(u.n, coalesce(a.n, 0))) AS BIGINT) AS overlap, CAST(sum(u.n) AS BIGINT) AS wanted, round(sum(least(u.n, coalesce(a.n, 0))) / sum(u.n), 9) AS recall FROM u LEFT JOIN a USING (conv_id, token)")
def ocr_recall_micro(spark, sf_dir):
    """The same over the corpus: words count by case, sums come before the ratio."""
    u, a = _turn_bags(spark, sf_dir)
    return bags.recall(a, u, ["conv_id", "token"]).withColumn("recall", F.round("recall", 9))


@query(TURNS + " SELECT token, CAST(sum(greatest(coalesce(u.n, 0), coalesce(a.n, 0))) AS BIGINT) AS n FROM u FULL JOIN a USING (conv_id, token) GROUP BY token")
def bag_union_max(spark, sf_dir):
    """The union of multisets takes the greater multiplicity of each case."""
    return bags.union_max(*_turn_bags(spark, sf_dir), ["conv_id", "token"]).groupBy("token").agg(F.sum("n").alias("n"))


@query(TURNS + " SELECT conv_id, token, CAST(u.n - coalesce(a.n, 0) AS BIGINT) AS n FROM u LEFT JOIN a USING (conv_id, token) WHERE u.n > coalesce(a.n, 0)")
def bag_difference(spark, sf_dir):
    """What one bag has over another."""
    return bags.difference(*_turn_bags(spark, sf_dir), ["conv_id", "token"])


@query(TURNS + " SELECT conv_id, token, CAST(least(u.n, a.n) AS BIGINT) AS n FROM u JOIN a USING (conv_id, token)")
def bag_intersection(spark, sf_dir):
    """What two bags have in common."""
    return bags.intersection(*_turn_bags(spark, sf_dir), ["conv_id", "token"])


@query("""WITH o AS (SELECT o_custkey % 50 AS g, o_orderkey AS k, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents, left(o_orderpriority, 1) AS p FROM orders),
c AS (SELECT g, token, count(*) AS n FROM (SELECT g, cents AS token FROM o UNION ALL SELECT g, p FROM o) GROUP BY 1, 2), r AS (SELECT g, cents AS token, count(*) AS n FROM o WHERE k % 3 <> 0 GROUP BY 1, 2),
b AS (SELECT g, coalesce(c.n, 0) AS x, coalesce(r.n, 0) AS y FROM c FULL JOIN r USING (g, token))
SELECT g, CAST(sum(least(x, y)) AS BIGINT) AS overlap, CAST(sum(x) AS BIGINT) AS candidate, CAST(sum(y) AS BIGINT) AS reference, round(sum(least(x, y)) / sum(x), 9) AS precision, round(sum(least(x, y)) / nullif(sum(y), 0), 9) AS recall, CASE WHEN sum(y) > 0 THEN round(2.0 * sum(least(x, y)) / (sum(x) + sum(y)), 9) END AS f1 FROM b GROUP BY g""")
def numeric_consistency(spark, sf_dir):
    """F1 of the numbers in two texts, by case; comments do not count, nor digits that end a word."""
    cents = corpora.cents("o_totalprice").cast("string")
    o = corpora.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("g"), F.concat(F.lit("total "), cents, F.lit(" at "), "o_orderpriority", F.lit(" é5 x7%\n%% 12 is a comment")).alias("code"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("sum "), cents)).alias("truth"))
    found = lambda c: o.select("g", F.explode(text.numbers(F.regexp_replace(c, r"(?m)^\s*%%.*$", ""))).alias("token"))
    out = bags.f1(bags.bag(found("code"), "g", "token"), bags.bag(found("truth"), "g", "token"), ["token"], ["g"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("""WITH n AS (SELECT o_custkey % 50 AS g, o_orderkey % 2 AS side, CAST(round(o_totalprice) AS BIGINT) % 7 AS v FROM orders),
b AS (SELECT g, v, count(*) FILTER (WHERE side = 0) AS x, count(*) FILTER (WHERE side = 1) AS y FROM n GROUP BY 1, 2), e AS (SELECT g, bool_and(x = y) AS equal FROM b GROUP BY g)
SELECT CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (WHERE equal) AS BIGINT) AS exact, round(avg(CAST(equal AS INTEGER)), 9) AS mean FROM e""")
def numeric_exact_match(spark, sf_dir):
    """The share of cases whose numbers are the same bag."""
    o = corpora.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("g"), (F.col("o_orderkey") % 2).alias("side"), (F.round("o_totalprice").cast("long") % 7).alias("v"))
    b = bags.bag(o, "g", "side", "v")
    e = bags.equal(b.filter("side = 0"), b.filter("side = 1"), ["v"], ["g"])
    return e.agg(F.count("*").alias("cases"), F.count(F.when(F.col("equal"), 1)).alias("exact"), F.round(F.avg(F.col("equal").cast("int")), 9).alias("mean"))


@query("""SELECT doc_id, sha256(encode(text)) AS digest, CAST(count(*) OVER (PARTITION BY sha256(encode(text))) AS BIGINT) AS copies, row_number() OVER (PARTITION BY sha256(encode(text)) ORDER BY doc_id) = 1 AS kept FROM documents""")
def content_dedup(spark, sf_dir):
    """Digest of each text, how many have it, and whether this is the first.

    Copies are counted by digest alone and the first is a minimum, so a large group of copies is
    never ordered; its key is split by Spark if it is skewed.
    """
    d = corpora.table(spark, sf_dir, "documents").select("doc_id", digest.sha256(F.col("text")).alias("digest"))
    by = d.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return d.join(by, "digest").select("doc_id", "digest", "copies", (F.col("doc_id") == F.col("first")).alias("kept"))


@query(r"""SELECT p_partkey AS id, trim(regexp_replace(replace(lower(p_name), 'ß', 'ss'), '\s+', ' ', 'g')) AS normal, contains(lower(p_type), lower(split_part(p_name, ' ', 1))) OR contains(lower(split_part(p_name, ' ', 1)), lower(p_type)) AS either,
  CAST(length(p_name) AS BIGINT) AS units, translate(p_brand, '#0', '＃〇') AS glyphs, CASE WHEN regexp_matches(p_name, '[" ]') THEN '"' || p_name || '"' ELSE p_name END AS quoted, replace(p_name, 'e', 'e' || chr(8203)) AS neutral FROM part""")
def text_functions(spark, sf_dir):
    """Folding, containment, UTF-16 length, glyphs, quoting, neutral text."""
    n = F.col("p_name")
    first = F.lower(F.split_part(n, F.lit(" "), F.lit(1)))
    return corpora.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.normal_space(n).alias("normal"), text.either_contains(F.lower("p_type"), first).alias("either"), text.utf16_length(n).alias("units"),
        text.glyphs(F.col("p_brand"), {"#": "＃", "0": "〇"}).alias("glyphs"), F.when(n.rlike('[" ]'), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(n).alias("quoted"), text.neutral(n, ["e"]).alias("neutral"),
    )


@query("""SELECT o_orderkey AS id, CASE WHEN contains(s, '.') THEN regexp_replace(s, '\\.?0+$', '') ELSE s END AS plain, CAST(floor(o_totalprice / 7 * 100 + 0.5) AS DOUBLE) / 100 AS hundredths, CAST(round(CAST(o_totalprice AS DECIMAL(30, 6)) * 100 / 500000) AS BIGINT) AS percent, format('{:,}', CAST(floor(o_totalprice + 0.5) AS BIGINT) + 1000) AS comma
FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS VARCHAR) AS s FROM orders)""")
def number_functions(spark, sf_dir):
    """Plain decimal text, hundredths, whole percents, thousands marks."""
    v = F.col("o_totalprice")
    return corpora.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), numeric.decimal_text(v.cast("decimal(20,2)"), 2).alias("plain"), numeric.hundredths(v / 7).alias("hundredths"), numeric.percent(v, F.lit(500000)).alias("percent"), numeric.thousands(F.floor(v + 0.5) + 1000).alias("comma"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || CASE l_linenumber % 8 WHEN 0 THEN 'ms' WHEN 1 THEN 's' WHEN 2 THEN 'm' WHEN 3 THEN 'h' WHEN 4 THEN 'd' WHEN 5 THEN 'w' WHEN 6 THEN 'M' ELSE '.5d' END AS txt,
  CAST(l_quantity AS BIGINT) * CASE l_linenumber % 8 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 60000 WHEN 3 THEN 3600000 WHEN 4 THEN 86400000 WHEN 5 THEN 604800000 WHEN 6 THEN 2678400000 END AS ms FROM lineitem)
SELECT txt, CAST(max(ms) AS BIGINT) AS ms, CAST(count(*) AS BIGINT) AS n FROM d GROUP BY txt""")
def duration_to_ms(spark, sf_dir):
    """Durations of fixed length; a fraction of a whole-number unit is none."""
    unit = F.element_at(F.array(*map(F.lit, ["ms", "s", "m", "h", "d", "w", "M", ".5d"])), (F.col("l_linenumber") % 8 + 1).cast("int"))
    d = corpora.table(spark, sf_dir, "lineitem").select(F.concat(F.col("l_quantity").cast("long").cast("string"), unit).alias("txt"))
    return bags.bag(d, "txt").select("txt", temporal.duration_ms(F.col("txt")).alias("ms"), "n")


@query("""WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-13-%d') ELSE strftime(o_orderdate, '%Y-%m-31') END AS txt FROM orders)
SELECT id, txt, CASE WHEN regexp_matches(txt, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(txt, '%Y-%m-%d') END AS at FROM d""")
def strict_dates(spark, sf_dir):
    """Dates that are in the format to the letter and exist."""
    d, r = F.col("o_orderdate"), F.col("o_orderkey") % 4
    txt = F.when(r == 0, F.date_format(d, "yyyy-MM-dd")).when(r == 1, F.date_format(d, "yyyy-M-dd")).when(r == 2, F.date_format(d, "yyyy-'13'-dd")).otherwise(F.date_format(d, "yyyy-MM-'31'"))
    o = corpora.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), txt.alias("txt"))
    return o.select("id", "txt", temporal.parse(F.col("txt"), "YYYY-MM-DD").alias("at"))


#: The rules again, as DuckDB's regular expressions.
_NAME, _VALUE = r"[^\s\x00\"''><=/]+", r"(?:\"[^\"]*\"|''[^'']*''|[^\s\"''<=>]+)"
FOUND = {
    "directive": r"%%\s*\{", "callback": r"\b(?:call|callback)\s*\(", "external_url": r"(?:https?|ftp|file|data|javascript):", "protocol_relative_url": r"[\"''(=]\s*//[^/\s]",
    "frontmatter": r"^\s*(?:---|config\s*:)", "css_import": r"@import\b", "remote_icon": r"iconify|fa:|logos:",
    "html": rf"<!--|<\?|<!doctype(?:\s|>|$)|</[a-z][a-z0-9_:-]*\s*>|<[a-z][a-z0-9_:-]*(?:\s+(?:{_NAME}\s*(?:=\s*{_VALUE}\s*)?)*)?(?:/\s*)?>",
}
FOUND_SQL = " UNION ALL ".join(f"SELECT page_id, '{k}' AS rule, line FROM lines WHERE regexp_matches(txt, '(?i){v}')" for k, v in FOUND.items())


@query(f"""WITH lines AS (
  SELECT page_id, unnest(parts) AS txt, generate_subscripts(parts, 1) AS line
  FROM (SELECT page_id, string_split_regex(html, '\\r\\n|[\\n\\x0b\\f\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS parts FROM pages WHERE html IS NOT NULL)),
cut AS (SELECT page_id, line, unnest(string_split(txt, ';')) AS txt FROM lines WHERE NOT regexp_matches(txt, '^\\s*%%'))
SELECT page_id, rule, CAST(line AS INTEGER) AS line FROM ({FOUND_SQL}
  UNION ALL SELECT DISTINCT page_id, 'click', line FROM cut WHERE regexp_matches(txt, '(?i)^\\s*click\\s+')
  UNION ALL SELECT DISTINCT page_id, 'style_syntax', line FROM cut WHERE regexp_matches(txt, '(?i)^\\s*(?:style|classDef|linkStyle)\\b'))""")
def security_findings(spark, sf_dir):
    """Lines of code that break a rule, each rule once a line."""
    return security.code_findings(corpora.table(spark, sf_dir, "pages").select("page_id", "html"), "page_id", "html").withColumnRenamed("id", "page_id")


@query(r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'script' WHEN 1 THEN 'foreignObject' WHEN 2 THEN 'g onclick' WHEN 3 THEN 'url' WHEN 4 THEN 'nan' ELSE 'none' END AS kind FROM pages)
SELECT page_id, CASE kind WHEN 'script' THEN 'rendered SVG contains forbidden <script>' WHEN 'foreignObject' THEN 'rendered SVG contains forbidden <foreignObject>' WHEN 'g onclick' THEN 'rendered SVG contains event handler onclick'
  WHEN 'url' THEN 'rendered SVG contains external CSS' WHEN 'nan' THEN 'rendered SVG contains non-finite geometry attribute x' END AS finding FROM p WHERE kind <> 'none'
UNION ALL SELECT page_id, 'rendered SVG has no dimensions' FROM p WHERE page_id % 4 = 0""")
def svg_findings(spark, sf_dir):
    """What must not be in a rendered SVG: active elements, handlers, styles from outside, sizes that are none."""
    i = F.col("page_id")
    parts = ["<script/>", "<foreignObject/>", "<g onclick='a()'/>", "<style>a { fill: url( 'http://x' ) } b { fill: url(#in) }</style>", "<text x='NaN'/>", "<a href='#in'/>"]
    inner = F.element_at(F.array(*map(F.lit, parts)), (i % 6 + 1).cast("int"))
    svg = F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg'"), F.when(i % 4 == 0, "").otherwise(" viewBox='0 0 1 1'"), F.lit(">"), inner, F.lit("</svg>"))
    return security.svg_scan(corpora.table(spark, sf_dir, "pages").select("page_id", svg.alias("svg")), "page_id", "svg").withColumnRenamed("id", "page_id")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS title, html FROM pages)
SELECT page_id, title, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS items, CAST(len(regexp_extract_all(html, 'href="([^"]*)"')) AS INTEGER) AS links FROM l""")
def markup_scan(spark, sf_dir):
    """Titles, list items and links of markup."""
    p = corpora.table(spark, sf_dir, "pages")
    count = lambda r: F.regexp_count("html", F.lit(r))
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<title>([^<]*)</title>"), F.lit(1))).alias("title"), count("<li>").alias("items"), count('href="([^"]*)"').alias("links"))


@query("""SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, CASE WHEN w <= 400 THEN w END AS words FROM (SELECT doc_id, text, len(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS w FROM documents)""".replace("length(text) - length(replace(text, chr(10), '')) + 1 AS lines", "CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines").replace("THEN w END AS words", "THEN CAST(w AS INTEGER) END AS words"))
def bounded_tokens(spark, sf_dir):
    """Words of a text, unavailable as a whole beyond the budget."""
    d = corpora.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.split("text", "\n")).alias("lines"), F.when(text.bounded(text.words(F.col("text")), 400).isNotNull(), F.size(text.words(F.col("text")))).alias("words"))
