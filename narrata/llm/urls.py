"""URL filters with redirect equivalence.

A url is judged by the longest rule that fits it. Urls that redirect to each
other or name each other as canonical are aliases: a block decision reaches
every alias that has no rule of its own, and an explicit allow of a url keeps
it. Only DataFrame operations are used.

Defined results: a null url or one without ``://`` has an empty host and path
and fits no rule; urls that differ in the case of scheme or host, or in the
fragment, are one node, as are repeated ones; relative links are resolved
against the page's url; links that are null, empty, of another kind (mailto:)
or to a page itself link nothing; columns that have the name of an output are
replaced.
"""

from __future__ import annotations

import string
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.components import components
from narrata.llm.rows import nest, unnest
from narrata.workspace import Workspace

#: Rules are literals of the plan, so their number is bounded.
MOST_RULES = 1000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + F.lit(3)))


def host(url: Column) -> Column:
    found = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(found, F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[Rule], url_host: Column, url_path: Column, value: str) -> Column:
    """``value`` ("rule" or "verdict") of the longest rule that fits; of equally long ones an allow comes first; null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    cases = []
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow", r)):
        fits = ((url_host == r.host) | F.endswith(url_host, F.lit(f".{r.host}"))) & F.startswith(url_path, F.lit(r.path))
        cases.append(F.when(fits, F.lit(r.host + r.path if value == "rule" else r.verdict)))
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*))", 1), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*'([^']*)'", 1), F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*([^\s>\"']+)", 1)


def _first(parts: tuple[Column, ...]) -> Column:
    return F.coalesce(*(F.when(p != "", p) for p in parts))


def node(url: Column) -> Column:
    """The name of a url in the graph: scheme and host in lower case, no fragment."""
    scheme = F.lower(F.substring_index(url, "://", 1))
    rest = F.regexp_replace(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"#.*$", "")
    return F.concat(scheme, F.lit("://"), host(url), rest)


def _without_dots(place: Column) -> Column:
    """A path whose ``.`` and ``..`` parts are carried out."""
    parts = F.split(place, "/")
    last = F.element_at(parts, -1).isin(".", "..")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(p == "..", up(a)).otherwise(F.array_append(a, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last & (F.size(kept) > 0), "/").otherwise(""))


def _resolved(url: Column, target: Column) -> Column:
    scheme = F.substring_index(url, "://", 1)
    base = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    place = F.regexp_extract(target, r"^[^?#]*", 0)
    more = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), r"[^/]*$", "")
    return (
        F.when((target == "") | F.startswith(target, F.lit("#")), None).when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target).when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None).when(F.startswith(target, F.lit("?")), F.concat(base, path(url), target))
        .when(F.startswith(target, F.lit("/")), F.concat(base, _without_dots(place), more)).otherwise(F.concat(base, _without_dots(F.concat(folder, place)), more))
    )


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """Edges (a, b) from each page's url to its canonical link and to the target of its refresh."""
    canonical = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    refresh = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    to = F.transform(canonical, lambda tag: _first(_attribute(tag, "href")))
    on = F.transform(refresh, lambda tag: F.regexp_extract(_first(_attribute(tag, "content")), r"(?is)\burl\s*=\s*['\"]?([^'\"]+)", 1))
    both = pages.where(F.col(url).isNotNull() & F.col(html).isNotNull()).select(F.col(url).alias("a"), F.explode(F.concat(to, on)).alias("_to"))
    return both.select(node(F.col("a")).alias("a"), node(_resolved(F.col("a"), F.trim("_to"))).alias("b")).where("a is not null and b is not null")


def judge(df: DataFrame, url: str, rules: list[Rule], edges: DataFrame, default: str = "allow", ws: Workspace | None = None) -> DataFrame:
    """Add host, path, rule and verdict; ``edges`` (a, b) link the nodes of urls that are aliases."""
    ws = ws or Workspace(df.sparkSession, "urls")
    parts = components(ws, edges)
    own = fitting(rules, host(F.col("node")), path(F.col("node")), "verdict")
    blocked = ws.save(parts.where(own == "block").select("component").distinct(), "blocked")
    reached = ws.save(parts.join(blocked, "component").select(F.col("node").alias("_node"), F.lit(True).alias("_reached")), "reached")
    nested = nest(df, F.col(url).alias("_url"))
    named = nested.withColumn("host", host(F.col("_url"))).withColumn("path", path(F.col("_url")))
    ruled = named.withColumn("rule", fitting(rules, F.col("host"), F.col("path"), "rule")).withColumn("_own", fitting(rules, F.col("host"), F.col("path"), "verdict"))
    met = ruled.join(reached, node(F.col("_url")) == F.col("_node"), "left")
    spread = F.when(F.col("_reached"), F.lit("block"))
    return unnest(met.withColumn("verdict", F.coalesce("_own", spread, F.lit(default))), df.columns, "host", "path", "rule", "verdict")
