"""URL rules indexed by their rarest literal token; native expressions only."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenfold.llm.common import lower_ascii


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains, and every path that starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over host and path as one string: hosts hold no slash, paths start with one."""
        return rf"(?s)^([^/]*\.)?{_literal(self.host)}{_literal(self.path)}.*"

    @property
    def tokens(self) -> list[str]:
        """Literals that every fitting url has as whole tokens: host labels and closed path parts."""
        parts = self.path.split("/")
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in parts[:-1] if x]


def _literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", text)


def url_host(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    after = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    slash = F.locate("/", after)
    return F.coalesce(F.when(slash > 0, F.substring(after, slash, F.length(after))).otherwise(F.lit("")), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (``h:``) and path parts (``p:``)."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def token_counts(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many urls hold each token of the rules; one row a rule token comes back."""
    wanted = sorted({t for r in rules for t in r.tokens})
    held = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("t")).where(F.col("t").isin(wanted))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}


def _constant(value: list, schema: str) -> Column:
    """A constant column that the optimizer folds once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id", default: str = "allow",
               counts: dict[str, int] | None = None) -> DataFrame:
    """Verdict of every url: (key, host, path, rule, verdict, n_candidates).

    Each rule stands in the index under the literal token that fewest urls hold
    (``counts``, else counted over ``pages``); a url's tokens fetch candidate
    rules and only these run their regular expression. The longest fitting rule
    wins, ties go to the smaller rule text; no fitting rule gives ``default``.
    The index is as large as the rule list the caller holds, and rows are judged
    where they are, without a shuffle. Defined cases: a null url or one without
    ``://`` has empty host and path and gets ``default``; repeated rows are
    judged each; an empty table gives no rows; other columns are not read.
    """
    seen = pages.select(F.col(key).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rules = sorted(rules, key=lambda r: (-len(r.text), r.text))
    if any(not r.tokens for r in rules):
        raise ValueError("a rule needs a host label or a closed path part")
    if not rules:
        return seen.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(0).alias("n_candidates"))
    counts = token_counts(seen, rules) if counts is None else counts
    buckets: list[list[dict]] = [[] for _ in range(4 * len(rules) + 1)]
    for i, r in enumerate(rules):
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
        buckets[zlib.crc32(rarest.encode()) % len(buckets)].append({"t": rarest, "i": i})
    index = _constant(buckets, "array<array<struct<t:string,i:int>>>")
    listed = _constant([{"rule": r.text, "verdict": r.verdict, "pattern": r.pattern} for r in rules],
                       "array<struct<rule:string,verdict:string,pattern:string>>")

    def fetch(t: Column) -> Column:
        held = F.get(index, (F.crc32(t.cast("binary")) % len(buckets)).cast("int"))
        return F.transform(F.filter(held, lambda x: x["t"] == t), lambda x: x["i"])

    fetched = F.flatten(F.transform(url_tokens(F.col("host"), F.col("path")), fetch))
    got = seen.withColumn("_candidates", F.array_sort(fetched)).withColumn("_line", F.concat("host", "path"))
    fits = F.filter("_candidates", lambda i: F.rlike(F.col("_line"), F.get(listed, i)["pattern"]))
    best = got.withColumn("_best", F.get(listed, F.get(fits, F.lit(0))))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
                       F.size("_candidates").alias("n_candidates"))
