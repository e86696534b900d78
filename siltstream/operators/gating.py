"""Gates before a page is parsed: response class, challenge pages, robots rules."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstream.functions.urls import origin, percent_encoded
from siltstream.operators.state import latest

# Marks of challenge pages, in the order in which the first that is found decides.
CHALLENGES = {
    "cloudflare_turnstile": ("cf-turnstile-wrapper", "challenges.cloudflare.com/turnstile"),
    "cloudflare_iuam": ("checking your browser before accessing", "cf-browser-verification", 'id="cf-content"'),
    "recaptcha": ("google.com/recaptcha", "g-recaptcha", "recaptcha-v3-token"),
    "hcaptcha": ("hcaptcha.com", "h-captcha"),
    "generic_captcha": ("captcha", "security challenge", "verify you are human"),
}


def challenge(html: str | Column) -> Column:
    """The kind of challenge a page shows, or null."""
    low = F.lower(F.col(html) if isinstance(html, str) else html)
    found = F.lit(None).cast("string")
    for kind, marks in reversed(CHALLENGES.items()):
        seen = low.contains(marks[0])
        for mark in marks[1:]:
            seen = seen | low.contains(mark)
        found = F.when(seen, kind).otherwise(found)
    return found


def response_class(status: str | Column) -> Column:
    """``ok``, ``empty`` (server error), ``blocked`` or ``error`` of an HTTP status."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s == 200, "ok").when(s == 500, "empty").when(s.isin(401, 403, 429), "blocked").otherwise("error")


def decoded(raw: str | Column, body: str | Column) -> Column:
    """A page's text from bytes, invalid sequences replaced; ``body`` where there are no raw bytes."""
    r, b = (F.col(x) if isinstance(x, str) else x for x in (raw, body))
    return F.make_valid_utf8(F.coalesce(F.nullif(r, F.lit(b"")), b).cast("string"))


#: Seconds for which a robots file holds.
ROBOTS_TTL = 3600.0
#: A rule of a robots file: the encoded beginning of the addresses it is for, and whether they may be fetched.
RULE = T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("allow", T.BooleanType())]))


def rules_of(body: str | None, agent: str) -> list[tuple[str, bool]]:
    """The rules of a robots file for ``agent`` in order; the first that fits decides."""
    parser = RobotFileParser()
    parser.parse((body or "").splitlines())
    for entry in (*parser.entries, parser.default_entry):
        if entry is not None and entry.applies_to(agent):
            return [("" if rule.path == "*" else rule.path, rule.allowance) for rule in entry.rulelines]
    return []


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, rules) of ``robots`` (origin, status, body): each file is parsed once.

    401 and 403 forbid all, 200 has the rules of its body, any other status none.
    """

    @F.pandas_udf(RULE)
    def parsed(bodies: pd.Series) -> pd.Series:
        return pd.Series([[{"path": path, "allow": allow} for path, allow in rules_of(body, agent)] for body in bodies], dtype=object)

    none = F.array(F.struct(F.lit("").alias("path"), F.lit(False).alias("allow"))).cast(RULE)
    rules = F.when(F.col("status").isin(401, 403), none).when(F.col("status") == 200, parsed("body"))
    return robots.select("origin", F.coalesce(rules, F.array().cast(RULE)).alias("rules"))


def fresh_robots(robots: DataFrame, now: Column, ttl: float = ROBOTS_TTL) -> DataFrame:
    """The last row an origin of ``robots`` (origin, status, body, fetched_at) that is not older than ``ttl`` seconds.

    Origins without one are those to be asked again. Rows without a time are too old.
    """
    last = latest(robots, "origin", F.col("fetched_at"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return last.filter(age < ttl * 1_000_000)


def robots_gate(pages: DataFrame, robots: DataFrame, agent: str = "*", url: str = "url") -> DataFrame:
    """``pages`` with ``allowed``, by ``robots`` (origin, status, body), one row an origin.

    An origin without a row allows all. Null addresses are not allowed. What joins each address is its origin's list
    of rules, not the file, and the first that fits is found in the JVM; give this the addresses, not their pages.
    Spark broadcasts the rules only while their size permits.
    """
    rules = robots_rules(robots, agent).select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules"))
    joined = pages.join(rules, origin(F.col(url)) == F.col("_origin"), "left")
    rest = F.regexp_replace(F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "[?#]\\z", "")
    # Where an escape is malformed, it stands as it is, with its percent sign encoded.
    target = F.coalesce(percent_encoded(rest), percent_encoded(F.replace(rest, F.lit("%"), F.lit("%25"))), rest)
    first = F.try_element_at(F.filter("_rules", lambda rule: F.startswith(F.when(target == "", "/").otherwise(target), rule["path"])), F.lit(1))
    allowed = F.when(F.col(url).isNull(), False).otherwise(F.coalesce(F.when(F.size("_rules") > 0, first["allow"]), F.lit(True)))
    return joined.withColumn("allowed", allowed).drop("_origin", "_rules")
