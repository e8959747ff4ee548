"""URL filter: host and path rules first, then pattern rules that are looked up by their rarest literal token. Only
DataFrame functions on the main path.

A pattern rule is an RE2/Java-compatible regular expression. Its literal tokens (runs of ASCII letters and digits that
every match must contain as whole tokens) are given with it. The token that the fewest distinct urls hold becomes the
rule's key; a url fetches the rules whose keys are among its own tokens, and only those run their expressions. A rule
without tokens has the empty key, which every url holds. Host rules use the same index: their key is the host, and a
url holds every suffix of its own host. The index is written once and broadcast in blocks of at most `RULE_BLOCK` rules,
so the urls are never shuffled by their tokens, whatever the number of rules, and no key is hot.

The longest fitting host rule decides; else an allowing pattern rule, else a blocking one, else the url is allowed.
Defined results: a null url or one without `://` has empty host and path and no tokens, so only patterns without tokens
can block it; equal urls get equal verdicts; rules with a null or empty host never fit. Extra columns of the input are
carried through, result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawloom.llm.columns import ascii_lower
from lawloom.session import materialize

RULE_BLOCK = 100_000  # rows that are broadcast at once; more come in further blocks
HOST_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
HOST_SCHEMA = "host string, path string, verdict string"

# (id, expression on the whole lower-case url, literal tokens that any match holds as whole tokens, verdict)
PATTERN_RULES = [
    ("spam-farm", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.", ["spam", "farm"], "block"),
    ("cheap-pills", r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?cheap-pills\.", ["cheap", "pills"], "block"),
    ("casino", r"^[a-z][a-z0-9+.-]*://[^/?#]*\bcasino\b", ["casino"], "block"),
    ("adserver", r"^[a-z][a-z0-9+.-]*://(ads?|adserver|banners)\.[^/]+/", [], "block"),
    ("tracking-pixel", r"/pixel\.(gif|png)(\?|$)", ["pixel"], "block"),
    ("login", r"/(account/)?login(/|\?|$)", ["login"], "block"),
    ("cart-checkout", r"/cart/checkout(/|\?|$)", ["cart", "checkout"], "block"),
    ("help-login", r"://help\.[^/]+/(account/)?login(/|\?|$)", ["help", "login"], "allow"),
]
PATTERN_SCHEMA = "id string, pattern string, tokens array<string>, verdict string"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))


def url_tokens(url: Column) -> Column:
    found = F.split(ascii_lower(url), "[^0-9a-z]+")
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _join_blocks(rows: DataFrame, rules: DataFrame, key: str, block: int) -> DataFrame:
    """Rows with each rule of their key: the rules are broadcast in counted blocks, the rows stay where they are."""
    blocks = max(1, -(-rules.count() // block))
    at = F.pmod(F.xxhash64(*rules.columns), F.lit(blocks))
    out = None
    for i in range(blocks):
        part = rows.join(F.broadcast(rules if blocks == 1 else rules.filter(at == i)), key)
        out = part if out is None else out.unionByName(part)
    return out


def rule_index(urls: DataFrame, patterns: DataFrame, block: int = RULE_BLOCK) -> DataFrame:
    """Each pattern rule with its key: of its tokens, the one in the fewest distinct urls (ties: the first by name)."""
    tokens = patterns.select("id", F.explode("tokens").alias("token"))
    held = urls.select(F.explode(url_tokens(F.col("url"))).alias("token"))
    seen = _join_blocks(held, tokens.select("token").distinct(), "token", block).groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        tokens.join(seen, "token", "left")
        .groupBy("id")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("r"))
        .select(F.col("id").alias("rule_id"), F.col("r.token").alias("token"))
    )
    return (
        patterns.join(rarest, patterns["id"] == rarest["rule_id"], "left")
        .select(F.concat(F.lit("t:"), F.coalesce("token", F.lit(""))).alias("key"), "id", "pattern",
                F.lit(None).cast("string").alias("path"), "verdict")
    )


def judge_urls(
    pages: DataFrame, url: str = "url", host_rules: DataFrame | None = None, patterns: DataFrame | None = None,
    block: int = RULE_BLOCK,
) -> DataFrame:
    """All rows with host, path, rule, pattern_rule and verdict."""
    spark: SparkSession = pages.sparkSession
    host_rules = spark.createDataFrame(HOST_RULES, HOST_SCHEMA) if host_rules is None else host_rules
    patterns = spark.createDataFrame(PATTERN_RULES, PATTERN_SCHEMA) if patterns is None else patterns
    urls = pages.select(F.col(url).alias("url")).filter("url IS NOT NULL").distinct()
    by_host = host_rules.filter("host <> ''").select(
        F.concat(F.lit("h:"), "host").alias("key"), F.concat("host", "path").alias("id"),
        F.lit(None).cast("string").alias("pattern"), "path", "verdict",
    )
    index = materialize(by_host.unionByName(rule_index(urls, patterns, block)), "rules")
    keys = F.concat(
        F.transform(F.filter(host_suffixes(host_of(F.col("url"))), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(url_tokens(F.col("url")), lambda x: F.concat(F.lit("t:"), x)),
        F.array(F.lit("t:")),
    )
    held = urls.select("url", F.explode(keys).alias("key"))
    fits = F.col("path").isNotNull() & F.startswith(path_of(F.col("url")), F.col("path"))
    matches = F.col("pattern").isNotNull() & F.rlike(ascii_lower(F.col("url")), F.col("pattern"))
    rank = F.struct(F.length("id").alias("n"), F.col("id").alias("id"), F.col("verdict").alias("verdict"))
    first = F.struct((F.col("verdict") != "allow").alias("no"), F.col("id").alias("id"), F.col("verdict").alias("verdict"))
    hits = (
        _join_blocks(held, index, "key", block)
        .filter(fits | matches)
        .groupBy("url")
        .agg(F.max(F.when(fits, rank)).alias("by_host"), F.min(F.when(matches, first)).alias("by_pattern"))
        .withColumnRenamed("url", "_url")
    )
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern_rule", "verdict")]
    out = pages.join(hits, pages[url] == hits["_url"], "left")
    return out.select(
        *[pages[f"`{c}`"] for c in names], host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"),
        hits["by_host"]["id"].alias("rule"), hits["by_pattern"]["id"].alias("pattern_rule"),
        F.coalesce(hits["by_host"]["verdict"], hits["by_pattern"]["verdict"], F.lit("allow")).alias("verdict"),
    )
