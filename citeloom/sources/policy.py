"""What may be fetched: rules by host, subdomains included, and link discovery under them."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeloom.functions.text import url_host

#: Files that can be parsed.
SUFFIXES = ("docx", "docm", "htm", "html", "pdf")


def check_urls(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host and tier (open, attributed, gated, refused).

    A rule (host, tier) holds for its host and all subdomains; the longest matching rule
    counts, and without one a URL is refused.  A host is looked up under each of its
    suffixes, so this is an equi join whatever the number of rules.
    """
    rows = urls.withColumn("host", url_host(F.col(url))).withColumn("_u", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1_000), "."))
    # distinct hosts only: many URLs share one
    hosts = rows.select("host").distinct().where("host is not null").withColumn("rule", F.explode(ends))
    known = hosts.join(rules.select(F.col("host").alias("rule"), "tier"), "rule").groupBy("host").agg(F.max_by("tier", F.length("rule")).alias("tier"))
    return rows.join(known, "host", "left").drop("_u").withColumn("tier", F.coalesce("tier", F.lit("refused")))


def discover_links(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", suffixes=SUFFIXES) -> DataFrame:
    """(page, link, tier, place): parseable files that pages link to, made absolute, allowed, each once at its first place.

    A page URL that is a file itself is its own only link.
    """
    pattern = r"\.(?:" + "|".join(suffixes) + r")$"
    direct = F.lower(F.regexp_replace(url, r"[?#].*$", "")).rlike(pattern)
    hrefs = F.when(direct, F.array(F.col(url))).otherwise(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']([^\"'<>]+)[\"']")))
    rows = pages.select(F.col(url).alias("page"), F.posexplode(hrefs).alias("place", "href"))

    @F.pandas_udf("string")
    def absolute(base: pd.Series, link: pd.Series) -> pd.Series:
        return pd.Series([urljoin(b, x.strip()) if b and x else None for b, x in zip(base, link)], dtype=object)

    rows = rows.withColumn("link", F.regexp_replace(absolute("page", "href"), r"#.*$", ""))
    rows = rows.where(F.lower(F.regexp_replace("link", r"\?.*$", "")).rlike(pattern))
    allowed = check_urls(rows, rules, "link").where("tier in ('open', 'attributed')")
    first = allowed.withColumn("_k", F.row_number().over(W.partitionBy("link").orderBy("page", "place"))).where("_k = 1")
    return first.select("page", "link", "tier", "place")
