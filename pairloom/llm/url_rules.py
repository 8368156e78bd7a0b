"""URL rules, looked up by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` with literal tokens that every URL it fits must hold as
whole words. The rule is indexed under the one of them that the fewest URLs hold. Every URL is taken apart into
tokens, its tokens fetch candidate rules from the index, and only candidates run their expression. A rule without a
literal token is indexed under the empty token, which every URL holds. Rules are given as ``UrlRule`` or as the lines of a
rule list in a table, of any length: literal text that may stand anywhere in host + path, with ``*`` for anything, ``^`` for a
separator or the end, ``||`` in front for the host or one of its parents, ``|`` for the very beginning or end, ``@@`` in
front of exceptions, which go before all blocks of a list, and ``!`` before comments.

Only DataFrame functions are used. Token counts are gathered for the tokens of rules alone. The index is broadcast
while there are at most ``BROADCAST_RULES`` rules and joined by a shuffle beyond that. Candidates are those of distinct
(host, path), sorted by expression inside each partition, so that one is compiled once, and reduced to the best rule of
each (host, path) with partial aggregation; so a host or URL that holds a third of all rows meets one row.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which only rules that match the empty
string fit; repeated rows and equal ids are judged row by row; an empty table gives no rows, an empty or null line of a list
no rule; of two fitting rules of one tier the longer wins, then the one listed first, and of equal lines of a list the
block; URLs of any length are one row; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import lower_ascii

BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class UrlRule:
    """``tier`` 0 goes before tier 1; inside a tier the longest ``name`` wins."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    tier: int = 0


def host_rule(verdict: str, host: str, path: str = "/") -> UrlRule:
    """Fits the host and its subdomains where the path begins with ``path``."""
    # A word at the end of the path may go on in the URL, so it is no token.
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", host + path)
    return UrlRule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host + path)}", tuple(whole))


def pattern_rule(verdict: str, token: str, pattern: str) -> UrlRule:
    return UrlRule(pattern, verdict, pattern, (token,) if token else (), tier=1)


# Fixed values.
BASE_RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: Words of hosts that sell or trap rather than tell, and pages that are no content of their own.
BAD_HOST_WORDS = ("ads", "casino", "cheap", "pills", "poker", "porn", "spam", "viagra", "xxx")
NO_CONTENT = ("calendar", "cart", "checkout", "login", "search", "signup")
METHOD_RULES = (
    *(pattern_rule("block", word, rf"^(?:[^/]*[.-])?{word}[.-]") for word in BAD_HOST_WORDS),
    *(pattern_rule("block", word, rf"/{word}(?:[/.]|$)") for word in NO_CONTENT),
)

#: A rule list of pages that repeat others or hold no text of their own: mirrors, print and feed views, tag lists, system pages.
RULE_LIST = (
    "! mirrors for small screens",
    "|m.",
    "|amp.",
    "/amp^",
    "! other views of a page",
    "/print/",
    "/feed^",
    "/rss.xml|",
    "*/tag/*/page/",
    "||archive.*/snapshot/",
    "! system pages",
    "/cgi-bin/",
    "/wp-login.php|",
    "/wp-admin/",
    "! pages that stay",
    "@@||m.*/legal/",
    "@@/print/manual/",
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a URL; both empty where it has no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.concat(F.regexp_extract_all(url, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.array(F.lit(""))))


def rarest_tokens(urls: DataFrame, rules: Sequence[UrlRule]) -> list[str]:
    """The token of every rule that the fewest rows of ``urls`` (host, path) hold."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    if not wanted:
        return ["" for _ in rules]
    spark = urls.sparkSession
    names = spark.createDataFrame([(t,) for t in wanted], "token string")
    held = urls.select(F.explode(_tokens(F.concat("host", "path"))).alias("token"))
    names = F.broadcast(names) if len(wanted) <= BROADCAST_RULES else names
    # At most one row for each token of a rule.
    counts = dict(held.join(names, "token").groupBy("token").count().collect())
    return [min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="") for rule in rules]


_RULE = "token string, tier int, length int, place int, name string, verdict string, expression string"


def parse_rules(lines: DataFrame, column: str = "line") -> DataFrame:
    """(tier, length, place, name, verdict, expression, tokens) of the rules of a list: ``tokens`` are the words that every URL
    a rule fits holds as whole words."""
    line = F.trim(column)
    exception = line.startswith("@@")
    body = F.when(exception, F.substring(line, F.lit(3), F.length(line))).otherwise(line)
    rules = lines.select(line.alias("name"), exception.alias("exception"), body.alias("body")).filter(
        "body <> '' AND NOT startswith(name, '!')"
    ).distinct()
    front = F.when(F.col("body").startswith("||"), 2).when(F.col("body").startswith("|"), 1).otherwise(0)
    rules = rules.withColumn("front", front).withColumn("back", F.col("body").endswith("|") & (F.length("body") > F.col("front")))
    size = F.length("body") - F.col("front") - F.col("back").cast("int")
    rules = rules.withColumn("core", F.substring(F.col("body"), F.col("front") + 1, size)).filter("core <> ''")
    literal = F.regexp_replace("core", r"[\\\\.+?()\[\]{}|$]", r"\\$0")
    separated = F.replace(literal, F.lit("^"), F.lit("(?:[^A-Za-z0-9_.%-]|$)"))
    begin = F.when(F.col("front") == 2, r"^(?:[^/]*\.)?").when(F.col("front") == 1, "^").otherwise("")
    expression = F.concat(begin, F.replace(separated, F.lit("*"), F.lit(".*")), F.when(F.col("back"), "$").otherwise(""))
    # A word that touches a star, or an open end, may go on in the URL.
    closed = F.concat(F.when(F.col("front") > 0, "|").otherwise("*"), "core", F.when(F.col("back"), "|").otherwise("*"))
    tokens = F.regexp_extract_all(closed, F.lit("(?<![A-Za-z0-9*])([A-Za-z0-9]+)(?![A-Za-z0-9*])"), F.lit(1))
    return rules.select(
        # Higher goes first: exceptions, then blocks.
        F.when(F.col("exception"), -1).otherwise(-2).alias("tier"), F.length("core").alias("length"), F.lit(0).alias("place"), "name",
        F.when(F.col("exception"), "allow").otherwise("block").alias("verdict"), expression.alias("expression"), tokens.alias("tokens"),
    )


def _indexed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of a list, each under the token of it that the fewest ``urls`` hold."""
    words = rules.select("name", F.explode("tokens").alias("token")).distinct()
    held = urls.select(F.explode(_tokens(F.concat("host", "path"))).alias("token"))
    counts = held.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, "token", "left").groupBy("name").agg(
        F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token")
    )
    found = rules.join(rarest, "name", "left").withColumn("token", F.coalesce("token", F.lit("")))
    return found.select("token", "tier", "length", "place", "name", "verdict", "expression")


def candidates(urls: DataFrame, rules: Sequence[UrlRule], listed: DataFrame | None = None) -> DataFrame:
    """(host, path, and the columns of a rule) of the rules that the tokens of distinct ``urls`` (host, path) fetch."""
    urls = urls.distinct()
    rows = [
        (token, -rule.tier, len(rule.name), -k, rule.name, rule.verdict, rule.pattern)
        for k, (rule, token) in enumerate(zip(rules, rarest_tokens(urls, rules)))
    ]
    index, n = urls.sparkSession.createDataFrame(rows, _RULE), len(rows)
    if listed is not None:
        index, n = index.unionByName(_indexed(urls, listed)), n + listed.count()
    index = F.broadcast(index) if n <= BROADCAST_RULES else index
    return urls.select("host", "path", F.explode(_tokens(F.concat("host", "path"))).alias("token")).join(index, "token")


def judge(
    pages: DataFrame, rules: Sequence[UrlRule] = BASE_RULES + METHOD_RULES, otherwise: str = "allow", key: str = "page_id",
    listed: DataFrame | None = None,
) -> DataFrame:
    """(key, host, path, rule, verdict, pattern) of every URL.

    ``rule`` names the fitting rule of tier 0, ``pattern`` the rule that decided, whatever its tier. ``listed`` are
    rules of ``parse_rules``; they come after those of tier 0.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    fetched = candidates(urls.select("host", "path"), rules, listed).sortWithinPartitions("expression")
    best = (
        fetched.filter(F.expr("concat(host, path) RLIKE expression"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("tier", "length", "place", "verdict", "name")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        key, "host", "path",
        F.when(F.col("best.tier") == 0, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"),
        F.col("best.name").alias("pattern"),
    )
