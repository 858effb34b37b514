"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import audio, bpe, fingerprints, mixing, simhash, token_counts, token_store, toxicity, url_filter, warc
from loomgraph.llm._shared import table, written


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in shards behind a perfect-hash index, read back by key."""
    docs = table(spark, sf_dir, "documents")
    stored = token_store.write(docs, tokenizer("byte_bpe_50k.json"), end_id=2)
    return token_store.read(spark, stored, docs.select("doc_id").distinct(), ids=False)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-defined chunk sets, against the edited text and the next document."""
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of the corpus's size with 99.9 % of the most entropy, at most 4 rounds a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mixture(docs, mixing.Target()).select("doc_id", "source", "n_tokens", "round", "place", F.round("exponent", 6).alias("exponent"), F.round("weight", 8).alias("weight"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tokens counted by lookup, the rest by merging."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by the rank queue, and what they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back by the salvage reader."""
    archives = warc.write(table(spark, sf_dir, "pages"))
    records = warc.read(spark, archives).filter("kind = 'record'")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 4-word shingles, linked at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.Plan(words=4, seed=42, cuts=3, limit=4))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Verdict, host, path prefix.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, else host reputation; a page is a bad outcome if the label of its number has quality 0."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    found = url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES, limit=0.2)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as 8-bit samples in WAV files, stored, read back and described."""
    stored = written(audio.media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    return audio.describe(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_windows")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by a classifier learnt from the labelled texts outside the held-out fold."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_store, op2_fingerprints, op3_mixing, op4_token_counts, op5_byte_bpe, op6_warc, op7_simhash, op8_url_filter, op9_audio, op10_toxicity)
}

#: Base32 of a SHA-1 in hex: five hex digits are four letters.
_BASE32 = "array_to_string(list_transform(range(0, 40, 5), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, i + 1, 5) AS BIGINT) >> k) & 31) + 1 AS INTEGER), 1)), '')), '')"

_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages), r AS (SELECT *, max(page_id) OVER (PARTITION BY sha, html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM r"""

_FITS = "(host = '{1}' OR ends_with(host, '.{1}')) AND starts_with(path, '{2}')"
_RULE, _KIND = ("CASE " + " ".join(f"WHEN {_FITS.format(*r)} THEN '{x(r)}'" for r in sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))) + " END" for x in (lambda r: r[1] + r[2], lambda r: r[0]))


def _shrink(key: str, keep: str, above: str) -> str:
    """SQL of one level of reputation: ``above`` is the level whose mean is the prior."""
    return f"""{key}_j AS (SELECT t.*, u.mean AS m FROM {key}_n t JOIN {above}), {key}_k AS (SELECT (sum(pow(bad - n * m, 2)) - sum(m * (1 - m) * n)) / nullif(sum(m * (1 - m) * n * (n - 1)), 0) AS share FROM {key}_j),
  {key}_r AS (SELECT {keep}, (bad + m * kappa) / (n + kappa) AS mean, n + kappa AS weight FROM {key}_j, (SELECT CASE WHEN share > 0 THEN greatest(1.0, least(1000.0, 1 / share - 1)) ELSE 1000.0 END AS kappa FROM {key}_k))"""


_LEVELS = r"""regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '')"""
_URLS = f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
  o AS (SELECT u.host, CAST(1 - quality AS DOUBLE) AS bad FROM u JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL), hosts AS (SELECT DISTINCT host, {_LEVELS} AS bare FROM u),
  named AS (SELECT host, CASE WHEN contains(bare, '.') THEN array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') ELSE bare END AS domain, CASE WHEN contains(bare, '.') THEN string_split(bare, '.')[-1] ELSE bare END AS suffix FROM hosts),
  host_n AS (SELECT o.host, any_value(domain) AS domain, any_value(suffix) AS suffix, CAST(count(*) AS DOUBLE) AS n, sum(bad) AS bad FROM o JOIN named USING (host) GROUP BY o.host),
  domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY 1, 2), suffix_n AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain_n GROUP BY 1),
  every AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean, coalesce(sum(n), 0) + 2 AS weight FROM suffix_n),
  {_shrink('suffix', 'suffix', 'every u ON true')}, {_shrink('domain', 'domain, suffix', 'suffix_r u ON u.suffix = t.suffix')}, {_shrink('host', 'host', 'domain_r u ON u.domain = t.domain')},
  rate AS (SELECT host, CASE WHEN h.mean IS NOT NULL THEN h.mean WHEN d.mean IS NOT NULL THEN d.mean WHEN s.mean IS NOT NULL THEN s.mean ELSE every.mean END AS mean, CASE WHEN h.mean IS NOT NULL THEN h.weight WHEN d.mean IS NOT NULL THEN d.weight WHEN s.mean IS NOT NULL THEN s.weight ELSE every.weight END AS weight
    FROM named LEFT JOIN host_r h USING (host) LEFT JOIN domain_r d ON d.domain = named.domain LEFT JOIN suffix_r s ON s.suffix = named.suffix CROSS JOIN every)
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_KIND}, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.2 THEN 'block' ELSE 'allow' END) AS verdict FROM u JOIN rate USING (host)"""

_Z = "list_sum(list_transform(n, lambda x: pow(x / total, a)))"
_WEIGHTS = f"list_transform(n, lambda x: pow(x / total, a) / {_Z})"
_ENTROPY = f"list_sum(list_transform({_WEIGHTS}, lambda w: -w * ln(w)))"
_WORST = f"list_max(list_transform(n, lambda x: pow(x / total, a) / {_Z} / (x / total)))"
_DRAW = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
#: Halvings of [0, 1]: the exponent is too small while some source has over 4 rounds or the entropy is over the target.
_MIX = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(text, '\\S+')) AS n_tokens, {_DRAW.format("'mix:block:' || doc_id")} AS deal, {_DRAW.format("'mix:turn:' || doc_id")} AS turn FROM documents),
  every AS (SELECT source, sum(n_tokens) AS tokens, greatest(16, CAST(ceil(sqrt(CAST(sum(n_tokens) AS DOUBLE)) / 32) AS BIGINT)) AS blocks FROM d GROUP BY 1),
  t AS (SELECT source, CAST(tokens AS DOUBLE) AS tokens FROM every WHERE tokens > 0), one AS (SELECT list_sort(list(tokens)) AS n, sum(tokens) AS total FROM t),
  halved AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi UNION ALL
    SELECT i + 1, CASE WHEN small THEN a ELSE lo END, CASE WHEN small THEN hi ELSE a END
    FROM (SELECT *, {_WORST} > 4.0 OR {_ENTROPY} > CAST(0.999 AS DOUBLE) * ln(CAST(len(n) AS DOUBLE)) + 1e-9 AS small FROM (SELECT *, (lo + hi) / 2 AS a FROM halved, one WHERE i < 50))),
  chosen AS (SELECT CASE WHEN len(n) > 1 THEN (SELECT hi FROM halved WHERE i = 50) ELSE 1.0 END AS a, n, total FROM one),
  w AS (SELECT source, tokens, a AS exponent, pow(tokens / total, a) / {_Z} AS weight, CAST(floor(round(pow(tokens / total, a) / {_Z} * total, 3)) AS BIGINT) AS budget FROM t, chosen),
  dealt AS (SELECT d.*, deal % blocks AS block FROM d JOIN every USING (source)),
  b AS (SELECT source, block, sum(n_tokens) AS bt, {_DRAW.format("'mix:order:s' || source || ':' || block")} AS at_ FROM dealt GROUP BY 1, 2),
  p AS (SELECT b.*, exponent, weight, coalesce(budget // CAST(tokens AS BIGINT), 1) AS whole, coalesce(budget - budget // CAST(tokens AS BIGINT) * CAST(tokens AS BIGINT), 0) AS rest, row_number() OVER o - 1 AS place, sum(bt) OVER o AS upto FROM b LEFT JOIN w USING (source) WINDOW o AS (PARTITION BY b.source ORDER BY at_, block)),
  c AS (SELECT dealt.*, p.whole, p.place, p.exponent, p.weight, p.rest > 0 AND p.upto <= p.rest AS all_, p.upto > p.rest AND p.upto - p.bt < p.rest AND sum(n_tokens) OVER (PARTITION BY dealt.source, dealt.block ORDER BY turn, doc_id) <= p.rest - p.upto + p.bt AS fits FROM dealt JOIN p USING (source, block))
SELECT doc_id, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(unnest(range(whole + CAST(all_ OR fits AS INTEGER))) AS INTEGER) AS round, CAST(place AS INTEGER) AS place, round(exponent, 6) AS exponent, round(weight, 8) AS weight FROM c"""

#: The others encode, hash by chunk, train or follow links; tests hold them against plain versions.
ORACLES: dict[str, str] = {"op3_mixing": _MIX, "op6_warc": _WARC, "op8_url_filter": _URLS}
