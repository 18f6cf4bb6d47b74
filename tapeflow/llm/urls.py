"""URL filters: path rules, and a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeflow.llm.shared import aside, bloom, filter_words, might_hold
from tapeflow.plans.tables import keep

#: Rules become one expression; longer lists belong into the URL list.
MAX_RULES = 500


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, sorted query.

    Scheme and fragment do not count. Null for a URL without ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(_rest(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    parts = F.array_join(F.sort_array(F.split(query, "&", -1)), "&")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), parts)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule name, verdict) of the longest rule that fits; block wins among equal ones."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block", r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """All columns of ``pages`` and host, path, rule, verdict.

    ``listed(url)`` holds blocked URLs. A page that fits a rule gets the rule's verdict;
    otherwise it is blocked exactly if its canonical URL is that of a listed one. Canonical
    URLs first meet a blocked Bloom filter of the list (one 64-bit block a key, at most 2 MB
    whatever the list's length); what passes is joined with the list on the whole string, so
    there are no false positives. Other pages are not shuffled. Null URLs and URLs without
    ``://`` have empty host and path and are allowed; nulls in the list are ignored. Repeated
    rows each get a row; extra columns stay, but those with the added names are replaced.
    """
    own, back = aside(pages.drop("host", "path", "rule", "verdict"), ("_canon", "_hash", "_in", "_listed"))
    names = keep(listed.select(canonical(F.col("url")).alias("_canon")).where("_canon is not null").distinct())
    words = filter_words(names.count())
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = own.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "_canon": canonical(F.col("url"))})
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rows = rows.withColumns({"rule": rule, "verdict": said, "_hash": F.xxhash64("_canon")})
    asked = F.when(F.col("_canon").isNotNull() & F.col("verdict").isNull(), F.col("_hash"))
    rows = might_hold(rows, asked, bloom(names, F.xxhash64("_canon"), words), words, "_in")
    cols = [*own.columns, "host", "path", "rule"]
    sure = rows.where("not _in").select(*cols, F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    hits = rows.where("_in").join(names.withColumn("_listed", F.lit(True)), "_canon", "left")
    return back(sure.union(hits.select(*cols, F.when(F.col("_listed"), "block").otherwise("allow").alias("verdict"))))
