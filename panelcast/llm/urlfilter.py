"""URL filtering by pattern rules indexed by their rarest literal token.

A rule is text: ``||host/path`` fits the host and its subdomains where the path goes on
as the rule does; any other rule is looked for in the whole address. ``*`` stands for
any run, ``^`` for a separator or the end, and a leading or trailing ``|`` for the
address's ends. Literal tokens are the rule's runs of letters and digits with a literal
non-token character on both sides, so that an address the rule fits has them as tokens
of its own. Each rule is filed under the one that fewest addresses have; an address
fetches the rules filed under its tokens, and only those run their regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Site rules of the contract.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Addresses of pages that are not documents (forms, sessions, search, feeds' copies).
PATTERN_RULES = (
    ("/login^", "block"), ("/cart^", "block"), ("/cgi-bin/", "block"), ("/wp-admin/", "block"), ("^sessionid=", "block"),
    ("^replytocom=", "block"), ("/search?*q=", "block"), ("/print/", "block"), (".exe|", "block"), ("^utm_source=feed^", "block"),
)
DEFAULT = "allow"

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_table(spark: SparkSession, site=SITE_RULES, patterns=PATTERN_RULES) -> DataFrame:
    """Rules as rows: rule (as shown in results), pattern, verdict."""
    rows = [(r, f"||{r}", v) for r, v in site] + [(r, r, v) for r, v in patterns]
    return spark.createDataFrame(rows, "rule string, pattern string, verdict string")


def regex_of(pattern: Column) -> Column:
    """Java regular expression: over host and path for site rules, else over the address."""
    body = F.regexp_replace(pattern, r"^\|\|?|\|$", "")
    body = F.regexp_replace(body, r"([\\.+?(){}\[\]$|])", r"\\$1")
    body = F.regexp_replace(F.regexp_replace(body, r"\*", ".*"), r"\^", r"(?:[^A-Za-z0-9_.%-]|\$)")
    start = F.when(pattern.startswith("||"), F.lit(r"(?s)^(?:[^/]*\.)?")).when(pattern.startswith("|"), F.lit("(?s)^")).otherwise(F.lit("(?s)"))
    return F.concat(start, body, F.when(pattern.endswith("|"), F.lit("$")).otherwise(F.lit("")))


def literal_tokens(pattern: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(lower_ascii(pattern), F.lit(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), F.lit(1)))


def url_tokens(url: Column) -> Column:
    """Distinct runs of ASCII letters and digits, and the empty token that every address has."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lower_ascii(url), "[^a-z0-9]+")))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules with ``token``, the literal that fewest addresses have (of equally rare ones
    the first); rules without a literal are filed under the empty token. ``tokens`` has
    one row per address and token."""
    own = rules.select("rule", "pattern", "verdict", regex_of(F.col("pattern")).alias("regex"), literal_tokens(F.col("pattern")).alias("literals"))
    own = own.select("rule", "pattern", "verdict", "regex", F.explode(F.when(F.size("literals") > 0, F.col("literals")).otherwise(F.array(F.lit("")))).alias("token"))
    counts = tokens.join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("pattern", "verdict").orderBy(F.coalesce("n", F.lit(0)), "token")
    return own.join(counts, "token", "left").withColumn("place", F.row_number().over(rarest)).where("place = 1").drop("n", "place")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, pattern.

    Of the site rules that fit, the longest wins (of equally long ones a blocking one,
    then the last in the alphabet); without any, the longest other rule that fits decides, and without
    that ``default``. ``rule`` is the site rule, ``pattern`` the other one, or null.
    Null addresses and addresses without ``://`` have empty host and path; a null address
    fits no rule. Equal addresses are judged once; repeated rows and null ids stay.
    """
    asked = pages.select("page_id", F.col("url").cast("string").alias("url"))
    urls = asked.where("url is not null").select("url").distinct().withColumn("site", F.concat(host_of(F.col("url")), path_of(F.col("url"))))
    tokens = urls.select("url", "site", F.explode(url_tokens(F.col("url"))).alias("token"))
    index = rule_index(rules, tokens)
    site = F.col("pattern").startswith("||")
    fits = tokens.join(index, "token").where(F.rlike(F.when(site, F.col("site")).otherwise(F.col("url")), F.col("regex")))
    # max: longest, blocking before allowing, then the last in the alphabet
    rank = F.struct(F.length("rule").alias("length"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule"))
    best = fits.groupBy("url").agg(F.max(F.when(site, rank)).alias("s"), F.max(F.when(~site, rank)).alias("p"))
    out = asked.join(best, "url", "left")
    url = F.col("url")
    return out.select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("s.rule").alias("rule"),
        F.coalesce("s.verdict", "p.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("s").isNull(), F.col("p.rule")).alias("pattern"),
    )
