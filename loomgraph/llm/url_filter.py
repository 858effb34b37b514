"""URL filters: rules, then host reputation by empirical Bayes (operator 8).

Labelled outcomes of pages (1 bad, 0 good) are summed by host.  A host's rate is drawn toward that
of its registered domain, the domain's toward its suffix's, the suffix's toward the rate of all:
each level's outcomes are taken as beta-binomial, with the mean of the level above and a strength
that the method of moments fits to the spread between siblings.  A page is blocked if its host's
posterior rate is bad beyond doubt: if the mean less ``z`` deviations is over ``limit``.

Rules (host, path prefix) come first: a rule fits its host and all below it, and the longest wins.

All DataFrame work.  Only page_id, url and outcomes are read; outcomes are summed on the map side,
and levels shrink by distinct hosts, domains, suffixes.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and the
verdict of the rate of all; a host without labelled pages has its domain's rate, and so on up;
rows that repeat a page_id are each judged; outcomes that repeat a page_id count each; null
outcomes count for nothing; without any outcome nothing is blocked but by rule; other columns do
not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm._shared import written

#: Labels under which names are registered, by country: the default of ``suffixes``, from memory and not the whole
#: public suffix list, which may be given instead.
_SECOND = {
    "ae": "ac co gov net org sch", "ar": "com edu gob int mil net org tur", "at": "ac co gv or", "au": "asn com edu gov id net org", "bd": "ac com edu gov net org", "bo": "com edu gob net org",
    "br": "com edu gov net org", "cn": "ac com edu gov net org", "co": "com edu gov net nom org", "cr": "ac co ed fi go or", "cu": "com edu gov net org", "cy": "ac com gov net org", "do": "com edu gob net org",
    "ec": "com edu gob net org", "eg": "com edu gov net org", "es": "com edu gob nom org", "gh": "com edu gov org", "gr": "com edu gov net org", "gt": "com edu gob net org", "hk": "com edu gov idv net org",
    "id": "ac co go my net or sch web", "il": "ac co gov k12 muni net org", "in": "ac co edu firm gen gov ind net nic org res", "jp": "ac ad co ed go gr lg ne or", "ke": "ac co go ne or", "kr": "ac co go ne or pe re",
    "lk": "com edu gov org", "mt": "com edu net org", "mx": "com edu gob net org", "my": "com edu gov net org", "ng": "com edu gov net org", "ni": "com edu gob net org", "np": "com edu gov net org",
    "nz": "ac co geek gen govt iwi maori net org school", "pa": "com edu gob net org", "pe": "com edu gob net org", "ph": "com edu gov net org", "pk": "com edu gov net org", "pl": "com edu gov net org", "pt": "com edu gov org",
    "py": "com edu gov net org", "sa": "com edu gov net org", "sg": "com edu gov net org per", "sv": "com edu gob org", "th": "ac co go in mi net or", "tr": "av bel com dr edu gen gov k12 net org web",
    "tw": "com edu gov idv net org", "tz": "ac co go or", "ua": "com edu gov in net org", "ug": "ac co go or", "uk": "ac co gov ltd me net nhs org plc police sch", "uy": "com edu gub net org", "ve": "co com gob net org",
    "vn": "ac com edu gov net org", "za": "ac co gov net org web", "zm": "ac co com gov org", "zw": "ac co gov org",
}
TWO_LABEL_SUFFIXES = tuple(f"{label}.{country}" for country, labels in _SECOND.items() for label in labels.split())


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str = "url") -> Column:
    u = F.col(url)
    return F.when(F.locate("://", u) > 0, ascii_lower(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: str = "url") -> Column:
    u = F.col(url)
    return F.when(F.locate("://", u) > 0, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def levels(host: str = "host", suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> list[tuple[str, Column]]:
    """domain and suffix of a host; addresses and names without a dot are their own.

    ``suffixes``: those of two labels under which names are registered.
    """
    bare = F.regexp_replace(F.regexp_replace(F.col(host), r"^.*@", ""), r":\d*$", "")
    parts = F.split(bare, r"\.")
    n = F.size(parts)
    two = F.concat_ws(".", F.slice(parts, F.greatest(n - 1, F.lit(1)), 2))
    deep = two.isin(*suffixes)
    address = bare.rlike(r"^[0-9.]+$") | F.contains(bare, F.lit("["))
    suffix = F.when(address | (n < 2), bare).when(deep, two).otherwise(F.element_at(parts, -1))
    domain = F.when(address | (n < 2), bare).when(deep & (n > 2), F.concat_ws(".", F.slice(parts, F.greatest(n - 2, F.lit(1)), 3))).otherwise(two)
    return [("domain", domain), ("suffix", suffix)]


def strength(n: str, bad: str, mean: str) -> Column:
    """The strength (alpha + beta) of a beta-binomial with means given, by moments over siblings.

    Between 1 and 1000; siblings that spread no more than chance does give the most.
    """
    m = F.col(mean)
    chance = F.sum(m * (1 - m) * F.col(n))
    spread = F.sum(F.pow(F.col(bad) - F.col(n) * m, 2.0))
    most = F.sum(m * (1 - m) * F.col(n) * (F.col(n) - 1))
    share = (spread - chance) / F.nullif(most, F.lit(0.0))
    return F.when(share > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), 1 / share - 1))).otherwise(F.lit(1000.0))


def reputations(outcomes: DataFrame, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posteriors by host, by domain, by suffix, and of all: key, mean, low (the lower bound).

    ``outcomes``: host, bad (0, 1 or null).
    """
    known = outcomes.filter("bad is not null and host is not null")
    hosts = known.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = written(hosts.withColumns(dict(levels(suffixes=suffixes))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = written(domains, "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    # a flat prior for the rate of all; one row
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    every = every.select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("mean"), (F.col("n") + 2).alias("weight"))

    def level(rows: DataFrame, key: str, above: DataFrame, on: str | None) -> DataFrame:
        up = above.select(*([on] if on else []), F.col("mean").alias("prior"))
        joined = rows.join(F.broadcast(up)) if on is None else rows.join(up, on)
        kappa = joined.agg(strength("n", "bad", "prior").alias("kappa"))
        # one number
        both = joined.join(F.broadcast(kappa))
        weight = F.col("n") + F.col("kappa")
        return written(both.select(key, *([c for c in ("domain", "suffix") if c in rows.columns and c != key]), ((F.col("bad") + F.col("prior") * F.col("kappa")) / weight).alias("mean"), weight.alias("weight")), f"{key}-rates")

    by_suffix = level(suffixes, "suffix", every, None)
    by_domain = level(domains, "domain", by_suffix, "suffix")
    by_host = level(hosts, "host", by_domain.drop("suffix"), "domain")
    low = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return tuple(x.withColumn("low", low) for x in (by_host, by_domain, by_suffix, every))


def rule_of(rules: list[tuple[str, str, str]], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none; rules: verdict, host, prefix."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col(host) == name) | F.endswith(F.col(host), F.lit(f".{name}"))) & F.startswith(F.col(path), F.lit(prefix))
        rule, verdict = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], limit: float = 0.5, z: float = 1.645, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the posterior mean and bound used, of every page.

    ``outcomes``: page_id, bad; ``suffixes``: those of two labels.  Pages meet the rates by host, which is computed once for each
    distinct host; a host with a large part of the pages is a skewed key that Spark splits.
    """
    urls = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    labelled = urls.join(outcomes.select("page_id", F.col("bad").cast("int").alias("bad")), "page_id")
    by_host, by_domain, by_suffix, every = reputations(labelled, z, suffixes)
    hosts = urls.select("host").distinct().withColumns(dict(levels(suffixes=suffixes)))
    pick = lambda df, key, to: df.select(key, F.col("mean").alias(f"{to}_mean"), F.col("low").alias(f"{to}_low"))
    rates = hosts.join(pick(by_host, "host", "h"), "host", "left").join(pick(by_domain, "domain", "d"), "domain", "left").join(pick(by_suffix, "suffix", "s"), "suffix", "left")
    rates = rates.join(F.broadcast(every.select(F.col("mean").alias("e_mean"), F.col("low").alias("e_low"))))
    rates = rates.select("host", F.coalesce("h_mean", "d_mean", "s_mean", "e_mean").alias("mean"), F.coalesce("h_low", "d_low", "s_low", "e_low").alias("low"))
    rule, verdict = rule_of(rules)
    judged = urls.join(written(rates, "rates"), "host", "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mean", "low")
