"""URL filtering: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

All in DataFrame functions. The filter is a table whose size has a bound (shared.BLOOM_MOST blocks of
four longs), so it may be broadcast however long the list is; what passes goes to an exact join
that removes the false positives. A URL without a rule is blocked if its canonical form is listed.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.llm.shared import bloom_filter, bloom_split, checked_broadcast, stored

#: Query parameters that name a visit, not a page (fixed values).
TRACKING = ("fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host, its subdomains, and the paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One text for all addresses of a page: no scheme, `www.`, fragment, trailing slashes or tracking
    parameters; the host in lower case, the other parameters sorted. Null or no `://`: null."""
    query = F.regexp_extract(_after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.array_join(F.array_sort(kept), "&")
    page = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""))
    return F.when(F.locate("://", url) > 0, F.concat(page, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def rule_of(host: Column, path: Column, rules: list[Rule], value: str = "name") -> Column:
    """The longest rule that fits (its name or verdict); null if none does. Of rules of one length the
    first listed wins."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):  # later ones go outside
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, value))).otherwise(found)
    return found


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(id_col, url, host, path, rule, listed boolean, verdict): a row for each row of pages.

    listed: URLs, in any form, whose canonical form is blocked where no rule decides; repeats, nulls
    and malformed entries in it do no harm, and it may be empty. A null or malformed URL has an
    empty host and path, no rule, and the verdict allow. Repeated rows each keep a row.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url"))
    rows = rows.select(id_col, "url", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("page"))
    rows = rows.withColumn("item", F.when(F.col("page").isNotNull(), F.xxhash64("page")))
    entries = listed.select(canonical(F.col(listed_col).cast("string")).alias("page")).where("page IS NOT NULL").distinct()
    entries = stored(entries.withColumn("item", F.xxhash64("page")))
    # Rows without a page, or with one that isn't listed for sure, stay where they are.
    may, never = bloom_split(rows, "item", bloom_filter(entries, "item"))
    # Each possible hit once, so that a page that everyone links to is one row of the exact join.
    sure = stored(may.select("page").distinct().join(entries.select("page"), "page", "left_semi"))
    known = checked_broadcast(sure.withColumn("listed", F.lit(True)))
    found = may.join(known, "page", "left").select(*rows.columns, "listed").union(never.withColumn("listed", F.lit(False)))
    names, verdicts = (rule_of(F.col("host"), F.col("path"), rules, v) for v in ("name", "verdict"))
    listed_flag = F.coalesce("listed", F.lit(False))
    return found.select(
        id_col, "url", "host", "path", names.alias("rule"), listed_flag.alias("listed"),
        F.coalesce(verdicts, F.when(listed_flag, "block").otherwise("allow")).alias("verdict"),
    )
