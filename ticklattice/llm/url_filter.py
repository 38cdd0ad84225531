"""URL filters: listed rules first, mined association rules for the rest.

Urls become sets of tokens. Labelled urls are transactions of their tokens and their verdict; FP-growth finds the frequent
token sets, and those that imply a verdict with enough support and confidence, and surely more often than all labelled urls
have it, are the rules. Support is a number of labelled urls, the same however many there are. A rule is dropped when
a rule of fewer of its tokens is as confident. Rules are matched by an inverted index on the token of theirs that is
rarest among labelled urls; the other tokens are then checked. The fitting rule most confident against its verdict's share
of all labelled urls decides, else the commoner verdict of the labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklattice.llm.common import ascii_lower, small_side
from ticklattice.session import stored

#: (verdict, host, path): a listed rule fits its host and all subdomains where the path starts with its path.
Rule = tuple[str, str, str]
_VERDICT = "verdict="


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in small ASCII letters, and path. Null urls and those without ``://`` have neither."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: scheme, labels of the host, folders and endings of the path, names of the query, fragment.

    Numbers are one token whatever their value. Urls without host have no tokens.
    """
    host, path = url_parts(url)
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"^(\w*)://", 1))))
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), x))
    folders = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    names = F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    fragment = F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_sort(F.array_distinct(F.concat(scheme, labels, folders, names, fragment)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, *, support: int = 10, confidence: float = 0.6, lift: float = 1.05, z: float = 1.96) -> tuple[DataFrame, str]:
    """Rules ``tokens, verdict, confidence, lift, key`` from ``labelled(tokens, verdict)``, and the commoner verdict.

    A rule's tokens and verdict come together in ``support`` labelled urls at least, and Wilson's lower bound of its
    confidence (``z`` deviations) is above the verdict's share of all. Without labelled urls there are no rules and the
    verdict is ``allow``.
    """
    counts = {r.verdict: r["count"] for r in labelled.groupBy("verdict").count().collect()}  # two verdicts
    usual, n = max(sorted(counts), key=counts.get) if counts else "allow", max(sum(counts.values()), 1)
    rows = labelled.select(F.array_append("tokens", F.concat(F.lit(_VERDICT), F.col("verdict"))).alias("items"))
    # half a row less, as the product with the count is rounded up; no set is in more than all rows
    model = FPGrowth(itemsCol="items", minSupport=min((support - 0.5) / n, 1.0), minConfidence=confidence).fit(rows)
    found = model.associationRules.where(F.size("consequent") == 1).select(
        "antecedent", F.col("consequent")[0].alias("then"), "confidence", "lift", F.round(F.col("support") * n / F.col("confidence")).alias("m")
    )
    p, m = F.col("confidence"), F.col("m")
    sure = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    found = found.where(F.col("then").startswith(_VERDICT) & (F.col("lift") >= lift) & (sure > p / F.col("lift")) & (p * m > support - 0.5))
    found = found.where(~F.exists("antecedent", lambda x: x.startswith(_VERDICT))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring("then", len(_VERDICT) + 1, 100).alias("verdict"), "confidence", "lift"
    )
    often = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("t"), "freq")
    keyed = found.withColumn("t", F.explode("tokens")).join(often, "t").groupBy("tokens", "verdict", "confidence", "lift").agg(
        F.min_by("t", F.struct("freq", "t")).alias("key")
    )
    keyed = stored(keyed, "rules")
    # fewer tokens, as confident: found through the rarest of them
    every = keyed.select("tokens", "verdict", "confidence", F.explode("tokens").alias("t"))
    shorter = keyed.select(F.col("tokens").alias("few"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("key").alias("t"))
    covered = every.join(shorter, "t").where(
        (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size("few") < F.size("tokens")) & (F.size(F.array_except("few", "tokens")) == 0)
    )
    return stored(keyed.join(covered.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti"), "rules"), usual


def judge(tokens: DataFrame, rules: DataFrame, usual: str) -> DataFrame:
    """``tokens, mined``: the verdict for each distinct token set."""
    sets = tokens.select("tokens").distinct()
    index = small_side(rules.select(F.col("tokens").alias("need"), "verdict", "confidence", "lift", "key"))
    met = sets.select("tokens", F.explode("tokens").alias("key")).join(index, "key").where(F.size(F.array_except("need", "tokens")) == 0)
    # of rules as strong against their verdict's share the more confident, the longer, then by name
    best = F.max_by("verdict", F.struct(F.round("lift", 9), "confidence", F.size("need"), "verdict"))
    return sets.join(met.groupBy("tokens").agg(best.alias("mined")), "tokens", "left").select("tokens", F.coalesce("mined", F.lit(usual)).alias("mined"))


def listed(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest listed rule that fits, as ``(rule, verdict)``; null if none does."""
    fitting = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def url_filter(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule], *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict, mined``.

    ``labelled`` has ``url`` and ``verdict`` (``allow`` or ``block``). ``rule`` is the listed rule that decided, else null and the
    verdict is the mined one. Null, empty and malformed urls have empty host and path and get the commoner verdict.
    Repeated rows are judged each; very long urls are judged whole; other columns are not looked at.
    """
    url = F.col(url_col)
    host, path = url_parts(url)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), url_tokens(url).alias("tokens"))
    mined, usual = mine(labelled.select(url_tokens(F.col("url")).alias("tokens"), "verdict").where(F.size("tokens") > 0), **options)
    judged = judge(rows, mined, usual)
    rows = rows.withColumn("l", listed(F.col("host"), F.col("path"), rules)).join(small_side(judged, 100_000), "tokens", "left")
    return rows.select("page_id", "host", "path", F.col("l.rule").alias("rule"), F.coalesce("l.verdict", "mined").alias("verdict"), "mined")
