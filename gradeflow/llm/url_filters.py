"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens (runs of letters and digits) that each URL it fits must
hold. The rarest of them, counted over all URLs, is the rule's place in the index. A URL's
own tokens fetch the candidate rules, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.catalog import register

#: Rules are sent to every task; longer lists are refused.
MAX_RULES = 1_000_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """A regular expression on host + path, its literal tokens, and what it says.

    Site rules (host and path) are preferred to others, longer ones to shorter ones.
    """

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    length: int = 0


def site_rule(verdict: str, name: str) -> Rule:
    """Rule ``host/path``: fits the host and its subdomains if the URL's path starts with the path."""
    host, slash, path = name.partition("/")
    inner = re.findall(r"(?<=/)[a-z0-9]+(?=/)", slash + path)
    return Rule(name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}", (*TOKEN.findall(host), *inner), verdict, len(name))


def word_rule(verdict: str, *words: str) -> list[Rule]:
    """Rules for hosts with a label that holds one of the words between hyphens."""
    return [Rule(None, rf"^(?:[^/]*[.-])?{re.escape(w)}[.-]", tuple(TOKEN.findall(w)), verdict) for w in words]


# Host words of advertising, gambling, adult and spam sites.
BLOCKED_WORDS = ["ads", "adult", "bets", "casino", "pills", "porn", "spam", "warez", "xxx"]
# The site rules of the registered query.
SITE_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rarest_tokens(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs (host, path) hold each token of the rules; at most one number per token returns."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    tokens = F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))
    found = urls.select(F.explode(tokens).alias("token")).join(F.broadcast(known), "token").groupBy("token").count()
    return {t: 0 for t in wanted} | {r["token"]: r["count"] for r in found.collect()}


def _judge(index: dict[str, list[Rule]], always: list[Rule], default: str):
    def run(batches):
        compiled: dict[str, re.Pattern] = {}
        for b in batches:
            names, verdicts = [], []
            hosts, paths = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("_host", "_path"))
            for host, path in zip(hosts, paths):
                place = host + path
                best = None
                candidates = {r for t in TOKEN.findall(place.lower()) for r in index.get(t, ())}
                for r in (*candidates, *always):
                    rank = (r.length, r.name or "", r.pattern)
                    if best is None or rank > best[0]:
                        fits = compiled.get(r.pattern) or compiled.setdefault(r.pattern, re.compile(r.pattern, re.S))
                        if fits.search(place):
                            best = (rank, r)
                names.append(best[1].name if best else None)
                verdicts.append(best[1].verdict if best else default)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=[*b.schema.names, "_rule", "_verdict"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    Null urls and those without ``://`` have an empty host and path, which fits no rule with
    a host. Without a fitting rule the verdict is ``default`` and the rule null. Ties in
    length go to the larger name. Repeated rows are judged one by one; other columns are
    not read.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    parts = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    counts = rarest_tokens(parts, rules)
    index, always = defaultdict(list), []
    for rule in rules:
        if rule.tokens:
            index[min(rule.tokens, key=lambda t: (counts[t], t))].append(rule)
        else:
            always.append(rule)
    parts = parts.withColumnsRenamed({"host": "_host", "path": "_path"})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    out = parts.mapInArrow(_judge(dict(index), always, default), f"{kinds}, _rule string, _verdict string")
    return out.withColumnsRenamed({"_host": "host", "_path": "path", "_rule": "rule", "_verdict": "verdict"})


def _sql() -> str:
    by_length = sorted(SITE_RULES, key=lambda r: -len(r[1]))
    rule, verdict = "", ""
    for v, name in by_length:
        host, slash, path = name.partition("/")
        fits = f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash + path}')"
        rule += f" when {fits} then '{name}'"
        verdict += f" when {fits} then '{v}'"
    words = "|".join(BLOCKED_WORDS)
    return rf"""
    with h as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages)
    select page_id, host, path, case{rule} end rule,
      case{verdict} when regexp_matches(host, '(^|[.-])({words})[.-]') then 'block' else 'allow' end verdict from h"""


@register("op1_url_filters", _sql())
def op1(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rules = [site_rule(v, name) for v, name in SITE_RULES] + word_rule("block", *BLOCKED_WORDS)
    return filter_urls(pages, rules)
