"""URL filter rules matched by hash prefix.

Each URL is expanded into host-suffix x path-prefix expressions, as a
safe-browsing client does it. Expressions and rules meet in an equi-join on a
short hash prefix; the full digest confirms a meeting, and precedence picks
one rule per URL.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and meets no rule. Repeated rows each keep their own result row. Of several
rules that fit, the one with the longest expression wins, and among equally
long ones ``block`` goes before ``allow``. An empty table gives an empty
result. Columns of the input other than the id and the URL are not read, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.shared import ascii_lower, written

#: Hex digits of the joined prefix: 32 bits, as in update protocols for lists.
PREFIX_HEX = 8
#: Rules up to this number go to every executor; more are joined by shuffle.
BROADCAST_RULES = 50_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """``pages`` (all rows of it) with host, path, rule and verdict.

    ``rules`` has the columns host, path and verdict; a rule without a host fits
    nothing. The expansion works on distinct host and path pairs, so a host that
    holds a third of all pages is expanded once for each of its paths only.
    Columns of ``pages`` that are called like one of the four new ones are replaced.
    """
    host, path = split_url(F.col(url))
    pages = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")

    signed = rules.where(F.col("host") != "").select(
        F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
        digest(F.concat_ws("\n", "host", "path")).alias("rule_digest"),
        F.length("path").alias("path_len"),
    )
    signed = signed.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    facts = signed.agg(F.count("*").alias("n"), F.collect_set("path_len").alias("lens")).first()
    n_rules, lengths = facts["n"], sorted(facts["lens"])
    signed = signed.drop("path_len")

    distinct = pages.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    wanted = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(
        F.filter(wanted, lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = (
        distinct.withColumn("suffix", F.explode(F.filter(suffixes, lambda s: s != "")))
        .withColumn("start", F.explode(prefixes))
        .withColumn("full", digest(F.concat_ws("\n", "suffix", "start")))
        .withColumn("prefix", F.substring("full", 1, PREFIX_HEX))
    )
    met = expressions.join(
        F.broadcast(signed) if n_rules <= broadcast_rules else signed, "prefix"
    ).where(F.col("full") == F.col("rule_digest"))
    best = met.groupBy("host", "path").agg(
        F.max(
            F.struct(
                F.length("rule").alias("size"),
                (F.col("rule_verdict") == "block").alias("blocks"),
                F.col("rule").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    # Only pairs that a rule fits are written, and the join below is one of plain
    # tables, so that Spark can split a page that a third of all rows name. Rows
    # without a host take no part in it.
    best = written(best.select("host", "path", "best.rule", "best.verdict"), "best-rules")
    columns = pages.columns
    some = pages.where(F.col("host") != "").join(best, ["host", "path"], "left")
    none = pages.where(F.col("host") == "").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    judged = some.select(*columns, "rule", "verdict").unionByName(none)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
