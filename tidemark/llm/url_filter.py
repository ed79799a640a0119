"""URL filters: an index of pattern rules by their rarest literal token, with DataFrame functions alone.

Every rule names the literal tokens that any URL it matches must hold as whole tokens. The rule is filed
under the one of them that the fewest URLs have. The distinct tokens of a URL fetch the rules filed under
them by a hash join with the rule table, and only those run their expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rule table is broadcast up to this many rules; larger ones are joined by a shuffle.
MOST_RULES = 100_000


class Rule(NamedTuple):
    """A rule: a verdict, literal tokens of all its URLs, and a regular expression over the URL or a host and path prefix."""

    name: str
    verdict: str
    tokens: tuple[str, ...]
    pattern: str | None = None
    host: str | None = None
    path: str | None = None


def prefix_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and paths that start with ``path``; tokens cut off by the prefix's end don't count."""
    whole = path[: max(path.rfind("/"), 0)]
    return Rule(host + path, verdict, tuple(t for t in (host + whole).lower().replace("/", ".").split(".") if t.isalnum()), None, host, path)


#: Site rules, the longest that fits decides.
SITE_RULES = (
    prefix_rule("allow", "org", "/"),
    prefix_rule("block", "example.org", "/es/"),
    prefix_rule("block", "example.org", "/en/1"),
    prefix_rule("allow", "com", "/fr/"),
    prefix_rule("block", "com", "/de/"),
)

_TOPICS = {
    "gambling": ("casino", "bets", "betting", "poker", "jackpot", "roulette", "slots"),
    "drugs": ("pills", "viagra", "cialis", "pharmacy", "meds"),
    "adult": ("xxx", "porn", "adult", "escort", "nude"),
    "scam": ("lottery", "prize", "payday", "crypto", "giveaway"),
    "piracy": ("torrent", "warez", "crack", "keygen"),
}
_SIGNS = ("free", "win", "cheap", "best", "online", "buy")
#: The method's own rules: words of unwanted topics as whole tokens of the host, or of the path right after a second word, both of which are literals.
TOPIC_RULES = tuple(
    [Rule(f"{topic}:{word}", "block", (word,), rf"(?i)^[^:]*://[^/?#]*\b{word}\b") for topic, words in _TOPICS.items() for word in words]
    + [Rule(f"{topic}:{sign}-{word}", "block", (sign, word), rf"(?i)^[^:]*://[^/?#]*/[^?#]*\b{sign}[-_/]{word}\b") for topic, words in _TOPICS.items() for word in words for sign in _SIGNS]
)


def split_url(url):
    """Host and path columns: the host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; the path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(url.isNotNull() & (at > 0), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: Sequence[Rule] = SITE_RULES, method_rules: Sequence[Rule] = TOPIC_RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, matched (names of the method's rules that fit, sorted).

    The longest site rule that fits gives rule and verdict; else the verdict is block if any of the method's
    rules fits, and allow if none does. A null URL, or one without ``://``, has an empty host and path, fits
    no rule and is allowed. Repeated rows stay repeated; null ids are kept; an empty table gives an empty
    result; other columns are ignored.
    """
    rules = [*site_rules, *method_rules]
    few = F.broadcast if len(rules) <= MOST_RULES else lambda table: table
    spark = pages.sparkSession
    urls = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    host, path = split_url(F.col("url"))
    tokens = F.array_distinct(F.split(F.lower(F.col("url")), "[^a-z0-9]+"))
    # How many URLs have each literal: one row per literal of the rules.
    literals = sorted({t for r in rules for t in r.tokens})
    held = few(spark.createDataFrame([(t,) for t in literals], "token string"))
    counts = {r["token"]: r["n"] for r in urls.select(F.explode(tokens).alias("token")).join(held, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = [
        (min(r.tokens, key=lambda t: (counts.get(t, 0), t)), i, r.name, r.verdict, r.pattern, r.host, r.path, len(r.name) if r.host is not None else 0)
        for i, r in enumerate(rules)
    ]
    filed = spark.createDataFrame(index, "token string, nr int, name string, rule_verdict string, pattern string, rule_host string, rule_path string, length int")
    fits = F.when(
        F.col("rule_host").isNotNull(),
        ((F.col("host") == F.col("rule_host")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("rule_host")))) & F.startswith(F.col("path"), F.col("rule_path")),
    ).otherwise(F.regexp_like(F.col("url"), F.col("pattern")))
    found = (
        urls.where(F.instr("url", "://") > 0).withColumns({"host": host, "path": path})
        .withColumn("token", F.explode(tokens))
        .join(few(filed), "token").where(fits)
        .groupBy(F.col("id").alias("m_id"), F.col("url").alias("m_url"))
        .agg(F.max(F.when(F.col("length") > 0, F.struct("length", F.col("name").alias("rule"), F.col("rule_verdict").alias("v")))).alias("site"),
             F.array_sort(F.collect_set(F.when(F.col("length") == 0, F.col("name")))).alias("matched"))
    )
    joined = urls.join(found, urls["id"].eqNullSafe(found["m_id"]) & (urls["url"] == found["m_url"]), "left")
    verdict = F.coalesce(F.col("site")["v"], F.when(F.size("matched") > 0, "block").otherwise("allow"))
    return joined.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.col("site")["rule"].alias("rule"), verdict.alias("verdict"),
        F.concat_ws(",", F.coalesce("matched", F.array().cast("array<string>"))).alias("matched"),
    )


def oracle(site_rules: Sequence[Rule] = SITE_RULES, method_rules: Sequence[Rule] = TOPIC_RULES) -> str:
    """The same as SQL that tries every rule on every page."""
    site = ", ".join(f"('{r.name}', '{r.verdict}', '{r.host}', '{r.path}')" for r in site_rules)
    mine = ", ".join(f"('{r.name}', '{r.pattern}')" for r in method_rules)
    return rf"""
WITH s(name, verdict, h, p) AS (VALUES {site}), m(name, pattern) AS (VALUES {mine}),
u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path,
  (SELECT arg_max(s.name, length(s.name)) FROM s WHERE (host = s.h OR ends_with(host, '.' || s.h)) AND starts_with(path, s.p)) AS rule,
  coalesce((SELECT arg_max(s.verdict, length(s.name)) FROM s WHERE (host = s.h OR ends_with(host, '.' || s.h)) AND starts_with(path, s.p)),
    CASE WHEN (SELECT count(*) FROM m WHERE regexp_matches(url, m.pattern)) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce((SELECT string_agg(m.name, ',' ORDER BY m.name) FROM m WHERE regexp_matches(url, m.pattern)), '') AS matched
FROM q"""
