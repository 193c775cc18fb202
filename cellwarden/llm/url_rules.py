"""URL verdicts from a host and path list, and from association rules that FP-growth mines where the list is silent.

Everything here is DataFrame work: token sets are built by expressions, ``FPGrowth`` mines the
combinations of tokens that go with a verdict, rules are pruned by support, by confidence and by
whether a shorter rule says as much, and they are matched through an inverted index from token to
rule.

Defined results: a null url, or one without ``://``, has an empty host and an empty path, fits no
listed rule and has no tokens, so it gets the default verdict. Every row gives one row, repeated
ones too. Of several listed rules that fit the longest wins. Of several mined rules the most
confident wins, then the one with more tokens, more support, and the first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.llm.tables import Scratch

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("`url_`")))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest of ``rules`` (host, path, verdict) that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels, their hyphenated parts, path segments, and the first digit of numbers."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    parts = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    segments = F.filter(F.split(F.translate(path, _UPPER, _LOWER), "/"), lambda x: x != "")
    number = F.transform(
        F.filter(segments, lambda x: x.rlike("^[0-9]")), lambda x: F.concat(F.lit("number:"), F.substring(x, 1, 1))
    )
    word = F.transform(F.filter(segments, lambda x: ~x.rlike("^[0-9]")), lambda x: F.concat(F.lit("path:"), x))
    last = F.transform(F.slice(labels, F.greatest(F.size(labels), F.lit(1)), 1), lambda x: F.concat(F.lit("top:"), x))
    return F.array_distinct(
        F.concat(
            F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
            F.transform(parts, lambda x: F.concat(F.lit("part:"), x)),
            last, word, number,
        )
    )


def mine(labelled: DataFrame, scratch: Scratch, min_support: float = 0.005, min_confidence: float = 0.8) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows with ``tokens`` and ``verdict``.

    The same token sets are common, but FP-growth adds each row up in its tree, so they need no
    grouping. A frequent token is in a share ``min_support`` of the rows, so there are no more of them than
    tokens per row / ``min_support``, whatever the number of rows.
    """
    mark = F.concat(F.lit("verdict:"), F.col("verdict"))
    rows = labelled.select(F.array_append("tokens", mark).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=0.0).fit(rows)
    verdicts = [f"verdict:{ALLOW}", f"verdict:{BLOCK}"]
    found = (
        model.associationRules.where(F.col("consequent")[0].isin(verdicts))
        .where(~F.arrays_overlap("antecedent", F.array(*map(F.lit, verdicts))))
        .select(
            F.array_sort("antecedent").alias("tokens"),
            F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"),
            F.round("confidence", 12).alias("confidence"),
            F.round("support", 12).alias("support"),
        )
    )
    rules = scratch.keep(found, "rules")
    # A rule goes if leaving out one of its tokens gives one at least as confident.
    shorter = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("left_out")).select(
        "tokens", "verdict", "confidence", F.array_remove("tokens", F.col("left_out")).alias("rest")
    )
    base = rules.select(F.col("tokens").alias("rest"), "verdict", F.col("confidence").alias("before"))
    needless = (
        shorter.join(base, ["rest", "verdict"]).where("before >= confidence").select("tokens", "verdict").distinct()
    )
    return scratch.keep(
        rules.where(F.col("confidence") >= min_confidence).join(needless, ["tokens", "verdict"], "left_anti"), "pruned"
    )


def apply_rules(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule of each distinct token set: ``tokens``, ``mined``, ``confidence``; sets without a rule are absent.

    The inverted index has a row for each token of each rule; a rule fits if all its tokens were met.
    """
    named = rules.withColumn("rule", F.array_join("tokens", " "))
    index = named.select(F.explode("tokens").alias("token"), "rule", "verdict", "confidence", "support",
                         F.size("tokens").alias("needed"))
    met = (
        sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("tokens", "rule", "verdict", "confidence", "support", "needed").agg(F.count("*").alias("hits"))
        .where("hits = needed")
    )
    # Greatest confidence first; the smallest of negated values puts ties in alphabetical order.
    order = F.struct(-F.col("confidence"), -F.col("needed"), -F.col("support"), "rule", "verdict")
    best = met.groupBy("tokens").agg(F.min(order).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("mined"), (-F.col("best.col1")).alias("confidence"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    min_support: float = 0.005,
    min_confidence: float = 0.8,
    default: str = ALLOW,
) -> DataFrame:
    """Id, host, path, listed rule, verdict and ``confidence`` (of a mined rule) of every url.

    The urls that a listed rule fits are the labelled ones; rules mined from them decide the others.
    """
    scratch = Scratch(pages.sparkSession)
    urls = pages.select(F.col(f"`{id_col}`").alias("id_"), F.col(f"`{url_col}`").alias("url_"))
    host, path = host_and_path(F.col("url_"))
    split = urls.select("id_", host.alias("host"), path.alias("path"))
    rule, says = listed_rule(F.col("host"), F.col("path"), rules)
    known = split.select("*", rule.alias("rule"), says.alias("says"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    labelled = known.where("says is not null").select("tokens", F.col("says").alias("verdict"))
    mined = mine(labelled, scratch, min_support, min_confidence)
    # Tokens that occur in rules: at most tokens per row / min_support of them.
    used = [r[0] for r in mined.select(F.explode("tokens")).distinct().sort("col").collect()]
    kept = F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, used)).cast("array<string>")))
    open_urls = known.withColumn("tokens", F.when(F.col("says").isNull(), kept).otherwise(F.array().cast("array<string>")))
    sets = open_urls.where(F.size("tokens") > 0).select("tokens").distinct()

    def dealt(rows: DataFrame, without: Column) -> DataFrame:
        """Urls without such tokens fit no rule, so any task may take them: they are dealt by their own content."""
        return rows.withColumn("deal", F.when(F.size("tokens") > 0, F.lit(0).cast("long")).otherwise(without))

    decided = dealt(apply_rules(sets, mined), F.lit(1).cast("long"))
    return dealt(open_urls, F.xxhash64("id_", "host", "path")).join(decided, ["tokens", "deal"], "left").select(
        F.col("id_").alias(id_col), "host", "path", "rule",
        F.coalesce("says", "mined", F.lit(default)).alias("verdict"), "confidence",
    )
