"""URL filtering by fixed rules and mined association rules, in DataFrame functions only.

A URL's host and path are cut out and compared with the fixed rules; the longest
that fits decides.  URLs that no rule fits are judged by rules that Spark's
FP-growth mines from the tokens of labelled pages: token combinations that imply
a bad label with enough confidence and support.  Mined rules are found through
an inverted index: each is filed under its rarest token, a page looks up its own
tokens there, and the whole combination is then tested on the page's tokens.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is allowed unless a mined rule fits; equally long fixed rules
can't both fit; repeated page_ids are told apart, and each counts in the mining;
with no labelled page, or none that is bad, no rule passes; a URL of any length is
one value of its row; columns of the input other than those named are not read and
can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, lower_ascii

#: Fixed values: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
LEAST_CONFIDENCE = 0.8
#: A rule needs this share of the labelled pages, and this many.
LEAST_SUPPORT = 0.0005
LEAST_PAGES = 30
BAD = "label=bad"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to /, ?, # or the end; A-Z lower-cased) and path (then up to ? or #)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fixed rule that fits, else null."""
    choice = None
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        result = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, result) if choice is None else choice.when(fits, result)
    return choice


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host labels with the parts of hyphenated ones, and path segments
    without digits, each marked with its place."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    pieces = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    segments = F.filter(F.split(lower_ascii(path), "/"), lambda x: x != "")
    shapes = F.transform(segments, lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    parts = F.concat(labels, F.filter(pieces, lambda x: x != ""))
    return F.array_sort(F.array_distinct(F.concat(F.transform(parts, lambda x: F.concat(F.lit("h:"), x)), shapes)))


def mine_rules(
    labelled: DataFrame, least_confidence: float = LEAST_CONFIDENCE, least_support: float = LEAST_SUPPORT, least_pages: int = LEAST_PAGES
) -> DataFrame:
    """(antecedent, confidence, support) of rules implying a bad label, from rows of tokens and a boolean ``bad``.

    Of rules with nested antecedents and no gain in confidence only the shorter stays.
    """
    baskets = cut_lineage(labelled.select(F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens")).alias("items")))
    n = baskets.count()
    support = min(1.0, max(least_support, least_pages / max(1, n)))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=least_confidence).fit(baskets)
    found = model.associationRules.filter((F.element_at("consequent", 1) == BAD) & (F.round(F.col("support") * n) >= least_pages))
    return without_nested(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))


def without_nested(rules: DataFrame) -> DataFrame:
    """``rules`` but those with a shorter one inside that is at least as confident.

    A shorter rule is filed under its first token and looked up by the tokens of the longer one.
    """
    rules = cut_lineage(rules)
    short = rules.select(F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("inner"), F.col("confidence").alias("inner_confidence"))
    asked = rules.withColumn("token", F.explode("antecedent"))
    inside = (F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0)
    needless = asked.join(short, "token").filter(inside & (F.col("inner_confidence") >= F.col("confidence"))).select("antecedent").distinct()
    return rules.join(needless, "antecedent", "left_anti")


def inverted_index(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """``rules`` filed under the token of the antecedent that the fewest of ``pages`` have (token, antecedent, confidence)."""
    each = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token"))
    wanted = each.select("token").distinct()
    counts = pages.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("pages"))
    rarest = Window.partitionBy("antecedent").orderBy(F.coalesce("pages", F.lit(0)), "token")
    filed = each.join(counts, "token", "left").withColumn("__place", F.row_number().over(rarest))
    return filed.filter("__place = 1").select("token", "antecedent", "confidence")


def judge(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
    rules=RULES,
    **limits,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence (of the mined rule that blocks, else null)."""
    host, path = split_url(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fixed", rule_for(F.col("host"), F.col("path"), rules)).withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))
    marks = labels.groupBy(F.col(label_id_col).alias("page_id")).agg(
        F.max((F.coalesce(F.col(quality_col) == 0, F.lit(False)) | F.coalesce(F.col(toxic_col) == 1, F.lit(False))).cast("int")).alias("bad")
    )
    mined = cut_lineage(mine_rules(rows.join(marks, "page_id").select("tokens", (F.col("bad") == 1).alias("bad")), **limits))
    index = cut_lineage(inverted_index(mined, rows))
    asked = rows.filter("fixed is null").select("row", "tokens", F.explode("tokens").alias("token"))
    hits = asked.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    blocked = hits.groupBy("row").agg(F.max("confidence").alias("confidence"))
    return rows.join(blocked, "row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "confidence",
    )
