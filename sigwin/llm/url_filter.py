"""Operator 6: URL filters with a rarest-token rule index (DataFrame functions only).

A rule is a regular expression over ``host + path`` together with the literal
tokens that every match must hold: the names of a host, a word, or the words of a
phrase.  The index files each rule under the literal that occurs in the fewest URLs.
A URL's distinct tokens fetch candidate rules, and only those rules' expressions are run
on it.  Host rules outrank phrases, phrases outrank words, and longer ones shorter ones.
Words and phrases are found in any case of A-Z; a host rule's path is as it is written.

Defined results: a null URL or one without ``://`` has an empty host and path and
no rule fits (verdict ``allow``); repeated rows are judged one by one; very long
URLs are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import ascii_lower

#: What the rules' patterns take as a border: a token is what a word between two borders is.
BORDER = "[^a-z0-9]"


@dataclass(frozen=True)
class Rule:
    """``order`` ranks fitting rules; ``any_case`` rules are matched with the lower-cased URL."""

    name: str | None
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    order: int
    any_case: bool


def host_rule(verdict: str, rule: str) -> Rule:
    """``rule`` is host and path, as in ``example.net/en/``; it fits subdomains; longer ones win."""
    host, _, path = rule.partition("/")
    tokens = [t for t in re.split(f"{BORDER}+", host) if t]
    # A path need not end where a token ends, so only the host's tokens are sure literals.
    return Rule(rule, verdict, f"^(?:[^/]*\\.)?{re.escape(host)}\\n/{re.escape(path)}", tuple(tokens),
                2000 + len(rule), False)


def phrase_rule(verdict: str, phrase: str) -> Rule:
    """The words of ``phrase`` as whole tokens of host or path, one after the other with borders between them."""
    words = tuple(phrase.split())
    between = f"{BORDER}+".join(words)
    return Rule(None, verdict, f"(?:^|{BORDER}){between}(?:$|{BORDER})", words,
                len(phrase) + (1000 if len(words) > 1 else 0), True)


#: Fixed values of the contract.
HOST_RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)
#: Words and phrases that mark adult, gambling, advert, fraud and piracy pages.
BLOCKED = (
    "adult", "adserver", "ads", "banner", "betting", "casino", "doubleclick", "escort", "gambling", "hentai", "jackpot",
    "malware", "phishing", "poker", "porn", "sex", "spam", "torrent", "tracker", "viagra", "warez", "xxx",
    "ad server", "ad click", "affiliate redirect", "adult dating", "adult video", "bank login verify", "buy followers",
    "casino bonus", "cheap pills", "crack keygen", "credit repair offer", "essay writing service", "free movies online",
    "free robux", "free spins", "full movie download", "hot singles", "instant win", "keno online", "live cams",
    "lottery winner", "male enhancement", "no deposit bonus", "nude photos", "online casino", "online pharmacy",
    "password reset verify", "payday loan", "payday loans", "pop under", "popup ads", "replica watches", "serial keys",
    "slot machine", "slot machines", "sports betting", "sugar daddy", "video poker", "watch free online", "webcam girls",
    "you have won", "work from home earn",
)
#: Phrases that hold such a word and are no such page.
ALLOWED = (
    "adult education", "adult learning", "adult literacy", "ads txt", "anti malware research", "anti spam research",
    "banner elk", "bug tracker", "gambling addiction help", "gps tracker", "issue tracker", "malware analysis",
    "phishing awareness", "poker history", "sex discrimination act", "sex education", "spam filter", "torrent valley",
    "tracker software", "red banner order", "casino royale film", "casino museum",
)
RULES = (HOST_RULES + tuple(phrase_rule("block", p) for p in BLOCKED) + tuple(phrase_rule("allow", p) for p in ALLOWED))


def host_and_path(url: Column) -> tuple[Column, Column]:
    there = F.instr(url, "://") > 0
    rest = F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.when(there, ascii_lower(F.substring_index(rest, "/", 1))).otherwise("")
    slash = F.instr(rest, "/")
    path = F.when(there & (slash > 0), F.substring(rest, slash, F.length(rest))).otherwise("")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _parsed(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    # Host and path are kept apart by a line feed, so that a host's pattern ends with the host.
    parsed = parsed.withColumn("_subject", F.concat_ws("\n", "host", "path"))
    parsed = parsed.withColumn("_lower", ascii_lower(F.col("_subject")))
    return parsed.withColumn("_tokens", F.array_distinct(F.split(F.col("_lower"), f"{BORDER}+")))


def rule_index(parsed: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """File each rule under its rarest literal.  What is collected is one count per literal of the rules."""
    literals = sorted({t for r in rules for t in r.literals})
    found = (parsed.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, literals)))).alias("t"))
             .groupBy("t").count().collect())
    count = {row["t"]: row["count"] for row in found}
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.literals, key=lambda t: (count.get(t, 0), t)), []).append(rule)
    return index


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    parsed = _parsed(pages)
    index = rule_index(parsed, rules)

    def literal(rule: Rule) -> Column:
        return F.struct(F.lit(rule.order).alias("order"), F.lit(rule.verdict).alias("verdict"),
                        F.lit(rule.name).cast("string").alias("name"), F.lit(rule.pattern).alias("pattern"),
                        F.lit(rule.any_case).alias("any_case"))

    entries = [x for token, own in index.items() for x in (F.lit(token), F.array(*map(literal, own)))]
    known = F.array(*[F.lit(t) for t in index])
    fetched = F.flatten(F.transform(F.array_intersect("_tokens", known), lambda t: F.create_map(*entries)[t]))
    fits = F.filter(fetched, lambda r: F.rlike(F.when(r["any_case"], F.col("_lower")).otherwise(F.col("_subject")), r["pattern"]))
    best = F.array_max(fits)
    return (parsed.withColumn("_best", best)
            .select("page_id", "host", "path", F.col("_best")["name"].alias("rule"),
                    F.coalesce(F.col("_best")["verdict"], F.lit("allow")).alias("verdict")))


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in DuckDB SQL, every word and phrase tried on every URL, the highest first."""
    ranked = sorted((r for r in rules if r.any_case), key=lambda r: (r.order, r.verdict), reverse=True)
    tried = "\n    ".join(f"WHEN regexp_matches(subject, '{r.pattern}') THEN '{r.verdict}'" for r in ranked)
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN
    regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END,
      {lower}) AS host,
    CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM cut),
fitted AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    translate(coalesce(host, '') || chr(10) || coalesce(path, ''), {lower}) AS subject,
    CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/'
    END AS rule FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    {tried}
    ELSE 'allow' END AS verdict FROM fitted"""
