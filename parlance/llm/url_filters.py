"""URL filters: rules indexed by their rarest literal token, all in DataFrame expressions."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index goes into the plan as one literal; so many rules keep it at a few megabytes. More rules are joined as a table.
MAX_RULES = 20_000
#: Urls of one token that one task of that join takes.
URLS = 100_000


@dataclass(frozen=True)
class Rule:
    """A verdict for urls whose host and path, joined, a regular expression is found in. alternatives: sets of alphanumeric tokens; every
    such url holds all tokens of one of them, each between other characters or the ends. A longer `rank` wins; `listed` rules go before all others."""

    name: str
    verdict: str
    pattern: str
    alternatives: tuple[tuple[str, ...], ...]
    rank: int
    listed: bool


def listed(verdict: str, name: str) -> Rule:
    """A rule such as example.org/es/: the host and its subdomains, with paths that start with the rule's."""
    host, slash, path = name.partition("/")
    quoted = "".join(c if c.isalnum() else "\\" + c for c in host + slash + path)
    # the last token of the path may be the start of a longer one, so it is no literal token of the url
    whole = re.sub(r"[0-9A-Za-z]+$", "", name) if slash else name
    return Rule(name, verdict, f"^(?:[^/]*\\.)?{quoted}", (tuple(re.findall(r"[0-9A-Za-z]+", whole)),), len(name), True)


def pattern(verdict: str, name: str, expression: str, *alternatives: tuple[str, ...]) -> Rule:
    return Rule(name, verdict, expression, alternatives, len(name), False)


RULES = (
    listed("allow", "org/"),
    listed("block", "example.org/es/"),
    listed("block", "example.org/en/1"),
    listed("allow", "com/fr/"),
    listed("block", "com/de/"),
    pattern("block", "cheap-pills", "^[^/]*(?:^|[.-])cheap-pills[.-]", ("cheap", "pills")),
    pattern("block", "spam-farm", "^[^/]*(?:^|[.-])spam-farm[.-]", ("spam", "farm")),
    pattern("block", "casino", "(?:^|[./_-])casino(?:[./_-]|$)", ("casino",)),
    pattern("block", "free-download", "(?:^|[./_-])free-downloads?(?:[./_-]|$)", ("free", "download"), ("free", "downloads")),
    pattern("block", "click-bait", "^[^/]*(?:^|[.-])click-?bait[.-]", ("click", "bait"), ("clickbait",)),
    pattern("block", "adult", "(?:^|[./_-])adult(?:[./_-]|$)", ("adult",)),
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.filter(F.split(subject, "[^0-9A-Za-z]+"), lambda t: t != ""))


def filed(urls: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[str, int]]:
    """(token, number of the rule): each rule under the token of each of its alternatives that the fewest urls hold.

    Only counts of the rules' own tokens reach the driver, so their number is bounded by the rules.
    """
    wanted = sorted({t for r in rules for a in r.alternatives for t in a})
    held = urls.select(F.explode("tokens").alias("token"))
    held = held.where(F.col("token").isin(wanted)) if len(wanted) <= 1_000 else held.join(urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted({(min(a, key=lambda t: (counts.get(t, 0), t)), i) for i, r in enumerate(rules) for a in r.alternatives})


def by_literal(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """urls with `best`, the rule that decides: the index is a literal of hash buckets, so all of it is one projection."""
    keys = filed(urls, rules)
    size = 1 << max(3, (2 * len(keys)).bit_length())
    buckets: list[list[dict]] = [[] for _ in range(size)]
    places = urls.sparkSession.range(1).select(*[F.pmod(F.xxhash64(F.lit(k)), F.lit(size)).cast("int") for k, _ in keys]).first() if keys else []
    for (token, i), place in zip(keys, places):
        rule = rules[i]
        buckets[place].append({"token": token, "pattern": rule.pattern, "rank": rule.rank, "name": rule.name, "verdict": rule.verdict, "listed": rule.listed, "first": -i})
    index = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<token:string,pattern:string,rank:int,name:string,verdict:string,listed:boolean,first:int>>>")
    found = F.flatten(F.transform("tokens", lambda t: F.filter(F.element_at(index, F.pmod(F.xxhash64(t), F.lit(size)).cast("int") + 1), lambda r: r["token"] == t)))
    fits = F.filter(found, lambda r: F.rlike(F.col("subject"), r["pattern"]))
    return urls.withColumn("best", F.array_max(F.transform(fits, lambda r: F.struct(r["listed"], r["rank"], r["first"], r["name"], r["verdict"]))))


def by_join(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The same with the index as a table, for any number of rules. Each distinct host and path is judged once; a token that many urls hold is
    dealt to several tasks, with its rules copied to each."""
    rows = [(t, rules[i].listed, rules[i].rank, -i, rules[i].name, rules[i].verdict, rules[i].pattern) for t, i in filed(urls, rules)]
    table = urls.sparkSession.createDataFrame(rows, "token string, listed boolean, rank int, first int, name string, verdict string, pattern string")
    distinct = urls.select("host", "path", "subject", "tokens").dropDuplicates(["host", "path"])
    held = distinct.select("host", "path", "subject", F.explode("tokens").alias("token")).join(table.select("token").distinct(), "token", "left_semi")
    copies = held.groupBy("token").agg(F.ceil(F.count("*") / URLS).cast("int").alias("copies"))
    spread = table.join(copies, "token").select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).drop("copies")
    dealt = held.join(copies, "token").withColumn("copy", F.pmod(F.xxhash64("subject"), F.col("copies")).cast("int"))
    fits = dealt.join(spread, ["token", "copy"]).where(F.rlike("subject", F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("listed", "rank", "first", "name", "verdict")).alias("best"))
    return urls.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the listed rule that decides, else null), matched (any rule that decides) and verdict of every url.

    A url's tokens fetch the rules filed under them; the regular expressions of those alone run. Of listed rules the longest wins,
    and of others too, where no listed rule fits; else the default holds. All of it is one projection without
    shuffle or Python, after a pass that counts the rules' tokens among the urls; beyond MAX_RULES rules it is a join by token
    with the same results. Null urls have empty host and path and get the default. Repeated rows are judged one by one, null ids
    stay null, an empty table gives none; other columns are not read.
    """
    if any(not a for r in rules for a in (r.alternatives or ((),))):
        raise ValueError("a rule needs a literal token in each of its alternatives")
    host, path = host_path(pages[url_col].cast("string"))
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("subject", F.concat("host", "path")).withColumn("tokens", tokens_of(F.col("subject")))
    judged = by_literal(urls, rules) if len(rules) <= MAX_RULES else by_join(urls, rules)
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
        F.col("best.name").alias("matched"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = """
WITH split AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts
), tried AS (
  SELECT *, CASE
    WHEN regexp_matches(host || path, '(?:^|[./_-])free-downloads?(?:[./_-]|$)') THEN 'free-download'
    WHEN regexp_matches(host || path, '^[^/]*(?:^|[.-])cheap-pills[.-]') THEN 'cheap-pills'
    WHEN regexp_matches(host || path, '^[^/]*(?:^|[.-])click-?bait[.-]') THEN 'click-bait'
    WHEN regexp_matches(host || path, '^[^/]*(?:^|[.-])spam-farm[.-]') THEN 'spam-farm'
    WHEN regexp_matches(host || path, '(?:^|[./_-])casino(?:[./_-]|$)') THEN 'casino'
    WHEN regexp_matches(host || path, '(?:^|[./_-])adult(?:[./_-]|$)') THEN 'adult' END AS spam FROM ruled
)
SELECT page_id, host, path, rule, coalesce(rule, spam) AS matched,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR spam IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM tried
"""
