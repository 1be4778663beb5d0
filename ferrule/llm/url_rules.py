"""URL filter: pattern rules indexed by their rarest literal token (DataFrame functions only).

A rule is a host and path prefix (it fits the host, all subdomains and every path that starts with its own) or a wildcard
pattern over host, path and the rest of the url.  A rule's *literal tokens* are its runs of letters and digits that
are bounded on both sides in every url it fits.  How often each such token occurs in the urls is counted over the
whole table, and every rule is filed under its rarest token.  A url's tokens fetch its candidate rules, and only
the candidates' regular expressions run on it.  Rules without a literal token are candidates for every url.

Of the fitting host rules the longest wins; where none fits, the verdict is ``block`` if a blocking pattern fits and no
allowing one, else ``allow``.

Up to ``INLINE_RULES`` rules the index is a map in the expression: one narrow pass, no shuffle.  Larger rule sets are joined by
token: distinct urls against the rule table, then the winners back to the rows by url.

Cases: a null url or one without ``://`` has an empty host and path and fits no rule; letters beyond A-Z are not
lower-cased; an empty path does not start with ``/``; equal rules are one; repeated rows give repeated results; an
empty table gives an empty result; extra columns are carried in ``row``; long urls are whole.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.rows import whole_row

INLINE_RULES = 1000
ALLOW, BLOCK = "allow", "block"
_TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    host_rule: bool = True


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains, below a path prefix."""
    bounded = host + (path if not path or not path[-1].isalnum() else re.sub("[A-Za-z0-9]+$", "", path))
    return Rule(host + path, verdict, r"^(?:[^/?#]*\.)?" + _quote(host + path), tuple(sorted(set(re.findall(_TOKEN, bounded.lower())))))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    """A pattern with ``*`` for any text, found anywhere in host, path and rest."""
    whole = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", pattern.lower())
    return Rule(pattern, verdict, ".*".join(_quote(p) for p in pattern.strip("*").split("*")), tuple(sorted(set(whole))), False)


def _quote(text: str) -> str:
    """A literal for Java regular expressions (no backslash-letter escapes)."""
    return "".join(c if c.isalnum() or c in "/_-" else f"[{c}]" if c not in "^\\[]" else "\\" + c for c in text)


#: Fixed rules of the query, as (host, path, verdict).
HOST_RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: Patterns that judge urls no host rule fits.
PATTERNS = (("/ads/*", BLOCK), ("/popup/*", BLOCK), ("?*sessionid=*", BLOCK))


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, what follows the path) of a url; all empty without ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.when(has, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, "(?s)^[^?#]*(.*)$", 1)


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(target), F.lit(f"({_TOKEN})"), 1))


def rarest_tokens(urls: DataFrame, rules: list[Rule]) -> dict[str, str | None]:
    """The rarest literal token of every rule, by the number of urls that hold it."""
    wanted = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if wanted:
        found = (urls.select(F.explode(_tokens(F.col("target"))).alias("token")).where(F.col("token").isin(wanted))
                 .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per rule token at most
        counts = {r["token"]: r["n"] for r in found}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None) for r in rules}


def _struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.regex).alias("regex"),
                    F.lit(rule.host_rule).alias("host_rule"))


_KIND = "array<struct<name: string, verdict: string, regex: string, host_rule: boolean>>"


def _fitting_inline(urls: DataFrame, rules: list[Rule], token_of: dict[str, str | None]) -> DataFrame:
    filed: dict[str | None, list[Rule]] = {}
    for rule in rules:
        filed.setdefault(token_of[rule.name], []).append(rule)
    everywhere = F.array(*[_struct(r) for r in filed.pop(None, [])]).cast(_KIND)
    if filed:
        index = F.create_map(*[x for token, some in filed.items()
                               for x in (F.lit(token), F.array(*[_struct(r) for r in some]))])
        fetched = F.flatten(F.transform(_tokens(F.col("target")), lambda t: F.coalesce(
            F.element_at(index, t), F.array().cast(_KIND))))
        candidates = F.concat(everywhere, fetched)
    else:
        candidates = everywhere
    return urls.withColumn("candidates", candidates).withColumn(
        "fitting", F.expr("filter(candidates, r -> target rlike r.regex)")).drop("candidates")


def _fitting_joined(urls: DataFrame, rules: list[Rule], token_of: dict[str, str | None]) -> DataFrame:
    spark = urls.sparkSession
    table = spark.createDataFrame([(token_of[r.name], r.name, r.verdict, r.regex, r.host_rule) for r in rules],
                                  "token string, name string, verdict string, regex string, host_rule boolean")
    targets = urls.select("target").distinct()
    by_token = targets.withColumn("token", F.explode(_tokens(F.col("target")))).join(table, "token")
    general = [r for r in rules if token_of[r.name] is None]
    fits = by_token.where(F.expr("target rlike regex")).select("target", "name", "verdict", "regex", "host_rule")
    if general:
        rest = targets.withColumn("r", F.explode(F.array(*[_struct(r) for r in general]))).select("target", "r.*")
        fits = fits.unionByName(rest.where(F.expr("target rlike regex")))
    grouped = fits.groupBy("target").agg(F.collect_set(F.struct("name", "verdict", "regex", "host_rule")).alias("fitting"))
    return urls.join(grouped, "target", "left").withColumn("fitting", F.coalesce("fitting", F.array().cast(_KIND)))


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", carry: Column | None = None,
          inline_rules: int = INLINE_RULES) -> DataFrame:
    """``row`` (``carry``, by default a struct of all columns), ``host``, ``path``, ``rule`` and ``verdict`` of every url."""
    carry = whole_row(pages) if carry is None else carry
    rules = list({r.name: r for r in rules}.values())
    host, path, rest = host_and_path(F.col(url).cast("string"))
    urls = pages.select(carry.alias("row"), host.alias("host"), path.alias("path"), F.concat(host, path, rest).alias("target"))
    token_of = rarest_tokens(urls.select("target"), rules)
    fitted = (_fitting_inline if len(rules) <= inline_rules else _fitting_joined)(urls, rules, token_of)
    blocked = F.expr(f"""exists(fitting, r -> NOT r.host_rule AND r.verdict = '{BLOCK}')
        AND NOT exists(fitting, r -> NOT r.host_rule AND r.verdict = '{ALLOW}')""")
    best = F.expr("""CASE WHEN exists(fitting, r -> r.host_rule) THEN
        array_sort(filter(fitting, r -> r.host_rule), (a, b) ->
            CASE WHEN length(a.name) <> length(b.name) THEN length(b.name) - length(a.name)
                 WHEN a.name < b.name THEN -1 WHEN a.name > b.name THEN 1 ELSE 0 END)[0] END""")
    return fitted.withColumn("best", best).select(
        "row", "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.verdict", F.when(blocked, BLOCK).otherwise(ALLOW)).alias("verdict"))
