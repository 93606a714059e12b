"""URL filters: rules indexed by their rarest literal token; only rules that a URL's tokens fetch run their regular expression.

DataFrame operations only. A rule is a host and path prefix ("example.com/en/") or a pattern with
`*` (any run of characters) and `^` (an edge: a character other than a letter or digit, or an end).
Both become one regular expression over host and path, and a list of literal tokens that every match
must hold as whole tokens. The rule is filed under the one of them that is rarest in the URLs at hand.
A rule without such a token is filed under the empty token, which every URL has.

Defined cases: a null URL, or one without `://`, has an empty host and path and no rule fits it unless
its pattern matches the empty string. Repeated rows each get their own result row. Ties between rules of one
length go to the alphabetically last one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of up to this size are broadcast.
BROADCAST_BYTES = 8 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query.
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: The method's own rules, for URLs that no site rule fits.
PATTERN_RULES = (
    ("block", "^cheap-pills^"),
    ("block", "^spam-farm^"),
    ("block", "^casino^"),
    ("block", "^free-money^"),
    ("block", "^torrent^*^download^"),
    ("block", "^adserver^"),
    ("allow", "^docs^casino^"),
)


@dataclass(frozen=True)
class Rule:
    kind: str
    verdict: str
    rule: str
    regex: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, rule: str) -> Rule:
    """A host with its subdomains, and a prefix of the path."""
    host, slash, path = rule.partition("/")
    full = "/" + path if slash else ""
    pieces = re.findall(r"[0-9a-z]+", host) + [t.lower() for t in re.findall(r"[0-9A-Za-z]+(?=[^0-9A-Za-z])", full)]
    return Rule("site", verdict, rule, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(full)}", tuple(dict.fromkeys(pieces)))


def pattern_rule(verdict: str, rule: str) -> Rule:
    """A pattern with `*` and `^`; letters match as they stand in the lower-cased host and path."""
    regex = "".join({"*": ".*", "^": r"(?:^|$|[^0-9A-Za-z])"}.get(c) or _quote(c) for c in rule)
    edge = r"[^0-9A-Za-z*]"
    tokens = re.findall(rf"(?<={edge})[0-9A-Za-z]+(?={edge})", rule)
    return Rule("pattern", verdict, rule, f"(?s){regex}", tuple(dict.fromkeys(t.lower() for t in tokens)))


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(i, r.kind, r.verdict, r.rule, r.regex, list(r.tokens) or [""]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, kind string, verdict string, rule string, regex string, tokens array<string>")


def sized(small: bool) -> Callable[[DataFrame], DataFrame]:
    """Broadcast what follows from the rules, if they are few; else leave the join to the planner."""
    return F.broadcast if small else lambda df: df


def index_rules(rules: DataFrame, url_tokens: DataFrame, small: bool = False) -> DataFrame:
    """Each rule with the one of its tokens that the fewest URLs hold. url_tokens has a column `tokens`, one row a URL."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    seen = (
        url_tokens.select(F.explode("tokens").alias("token"))
        .join(sized(small)(wanted.select("token")), "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    chosen = (
        wanted.join(seen, "token", "left")
        .groupBy("rule_id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .select("rule_id", F.col("rarest.token").alias("token"))
    )
    return rules.drop("tokens").join(chosen, "rule_id")


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of the longest site rule that fits, else null), verdict, method_rule (the longest pattern)."""
    small = sum(len(r.regex) + sum(map(len, r.tokens)) + 64 for r in rules) <= BROADCAST_BYTES
    table = rules_table(pages.sparkSession, rules)
    urls = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    target = F.concat("host", F.coalesce("path", F.lit("")))
    split = F.split(F.translate(target, UPPER, LOWER), "[^0-9a-z]+")
    urls = urls.select(
        "page_id",
        "url",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.array_distinct(F.concat(F.coalesce(split, F.array()), F.array(F.lit("")))).alias("tokens"),
    )
    index = index_rules(table, urls, small)
    length = F.length("rule").alias("length")
    hit = (
        urls.select("page_id", "url", F.concat("host", "path").alias("target"), F.explode("tokens").alias("token"))
        .join(sized(small)(index), "token")
        .where(F.expr("target RLIKE regex"))
    )
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct(length, "rule", "verdict"))).alias(kind)
    found = hit.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u")).agg(best("site"), best("pattern"))
    return urls.join(found, F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u")), "left").select(
        "page_id",
        "host",
        "path",
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "pattern.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("site").isNull(), F.col("pattern.rule")).alias("method_rule"),
    )


def default_rules() -> list[Rule]:
    return [site_rule(*r) for r in SITE_RULES] + [pattern_rule(*r) for r in PATTERN_RULES]
