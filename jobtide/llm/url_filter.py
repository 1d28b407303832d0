"""URL filters: rules found through their rarest literal token.

A rule is a pattern with literal tokens around it. Each rule is filed under the one of its
tokens that the fewest URLs of the table have, the tokens of a URL fetch the rules filed
under them, and only those rules are run as regular expressions. Rules without any token
have no place in such an index: each URL goes through them in its own row.

Distinct URLs are judged once, so a hot URL costs one row, and the verdicts are joined back.
Lists of rules are stored before they are joined, so that Spark knows how large they are and
chooses the join by that.

Defined results: a null URL, and one without ``://``, has an empty host and path and is
judged by the default verdict. Of the rules that match, the one with the highest
``priority`` wins, then the longest name, then the first by name. Repeated rows get equal
verdicts, and an empty table gives an empty table. A very long URL is judged whole. Columns of
the table named like a result are replaced; names that begin with ``_u_`` are taken.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch

TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in the lower-cased host and all that follows it.

    A host has no ``/``, ``?`` or ``#``, so these end it in a pattern.

    ``tokens`` are literal tokens every matching URL has, in lower case.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    priority: int = 0
    listed: bool = True


def site_rule(name: str, verdict: str) -> Rule:
    """A rule ``host/path``: the host and its subdomains, and paths that begin so."""
    host, _, path = name.partition("/")
    quoted = _quoted(host), _quoted("/" + path)
    tokens = tuple(t for t in host.replace("-", ".").split(".") if t)
    return Rule(name, verdict, rf"^([^/?#]*\.)?{quoted[0]}{quoted[1]}", tokens, 100 + len(name))


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in literal)


# Rules of the method itself: adverts, trackers and machine-made listings.
PATTERN_RULES = [
    Rule("adserver", "block", r"^([^/?#]*\.)?adserver\.", ("adserver",), listed=False),
    Rule("doubleclick", "block", r"^([^/?#]*\.)?doubleclick\.[a-z]+(/|$)", ("doubleclick",), listed=False),
    Rule("ads folder", "block", r"^[^/?#]*/([^?#]*/)?ads/", ("ads",), listed=False),
    Rule("banner image", "block", r"/banner/[^?#]*\.(gif|png|jpg)", ("banner",), listed=False),
    Rule("tracking pixel", "block", r"/(pixel|beacon)\.gif", ("gif",), listed=False),
    Rule("cgi script", "block", r"^[^/?#]*/cgi-bin/", ("cgi", "bin"), listed=False),
    Rule("login page", "block", r"^[^/?#]*/([^?#]*/)?login(\.[a-z]+)?([?]|$)", ("login",), listed=False),
    Rule("calendar trap", "block", r"[?&]date=[0-9]{4}-[0-9]{2}-[0-9]{2}", ("date",), listed=False),
]


def url_host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def _tokens(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(subject), F.lit(TOKEN), F.lit(0)))


def filter_urls(
    table: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
) -> DataFrame:
    """``table`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is the winning rule's name if it is a listed one, else null.
    """
    spark = table.sparkSession
    address = F.col("_u_url")
    rest = F.regexp_extract(address, r"^(?s)(?:(?!://).)*://[^/?#]*(.*)$", 1)
    judged = table.select(F.col(url).alias("_u_url")).distinct().select(
        "_u_url", F.concat(url_host(address), F.coalesce(rest, F.lit("")))
        .alias("_u_subject"))
    with_tokens = judged.withColumn("_u_token", F.explode(_tokens(F.col("_u_subject"))))

    listed = scratch.stored(spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, list(r.tokens), r.priority, r.listed) for r in rules if r.tokens],
        "_u_rule string, _u_verdict string, _u_pattern string, _u_tokens array<string>, "
        "_u_priority int, _u_listed boolean"), "rules")
    wanted = listed.select(F.explode("_u_tokens").alias("_u_token")).distinct()
    counts = (with_tokens.join(wanted, "_u_token", "left_semi").groupBy("_u_token")
              .agg(F.count(F.lit(1)).alias("_u_count")))
    choice = (listed.withColumn("_u_token", F.explode("_u_tokens"))
              .join(counts, "_u_token", "left").groupBy("_u_rule", "_u_pattern")
              .agg(F.min(F.struct(F.coalesce("_u_count", F.lit(0)).alias("n"),
                                  F.col("_u_token").alias("t"))).alias("_u_rarest")))
    filed = scratch.stored(
        listed.join(choice, ["_u_rule", "_u_pattern"])
        .withColumn("_u_token", F.col("_u_rarest.t")).drop("_u_tokens", "_u_rarest"), "filed-rules")

    fetched = with_tokens.join(filed, "_u_token").drop("_u_token")
    if bare := [r for r in rules if not r.tokens]:
        every = F.array(*[
            F.struct(*[F.lit(value).alias(name) for name, value in (
                ("_u_rule", r.name), ("_u_verdict", r.verdict), ("_u_pattern", r.pattern),
                ("_u_priority", r.priority), ("_u_listed", r.listed))])
            for r in bare])
        tried = judged.withColumn("_u_tried", F.explode(every)).select("_u_url", "_u_subject", "_u_tried.*")
        fetched = fetched.unionByName(tried)
    hits = (fetched.filter("regexp_like(_u_subject, _u_pattern)")
            .groupBy("_u_url")
            .agg(F.min(F.struct(
                (-F.col("_u_priority")).alias("p"), (-F.length("_u_rule")).alias("l"),
                F.col("_u_rule").alias("rule"), F.col("_u_verdict").alias("verdict"),
                F.col("_u_listed").alias("listed"))).alias("_u_best")))
    taken = [c for c in table.columns if c not in ("host", "path", "rule", "verdict")]
    return (table.join(hits, F.col(url).eqNullSafe(F.col("_u_url")), "left")
            .select(*[F.col(f"`{c}`") for c in taken], url_host(F.col(url)).alias("host"),
                    url_path(F.col(url)).alias("path"),
                    F.when(F.col("_u_best.listed"), F.col("_u_best.rule")).alias("rule"),
                    F.coalesce("_u_best.verdict", F.lit(default)).alias("verdict")))
