"""URL filters: rules first, gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licenses import UPPER

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Parts of the sample: a row's log odds while fitting come from the other parts.
FOLDS = 5
#: Labelled rows that the trees are fitted on, at most: a bounded sample in a pseudo-random order.
SAMPLE = 20_000
TREES, DEPTH = 12, 4
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "host_labels", "host_suffix", "path_suffix", "first_folder")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: the host follows the first ``://``, A-Z lower-cased; both empty without one."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = text.partition("/")
        rule_host = rule_host.lower()
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(urls: DataFrame) -> DataFrame:
    """Add the features that need no training, and the three suffixes, to rows with url, host, path."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url)
    characters = F.split(url, "", -1)
    shares = F.transform(F.array_distinct(F.filter(characters, lambda c: c != "")), lambda c: (size - F.length(F.replace(url, c, F.lit("")))) / size)
    return urls.withColumns({
        "length": size.cast("double"), "host_length": F.length("host").cast("double"), "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "digit_ratio": F.coalesce(F.try_divide(F.regexp_count(url, F.lit("[0-9]")), size), F.lit(0.0)).cast("double"),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)),
        "parameters": F.regexp_count(url, F.lit(r"[?&][^?&=#]*=")).cast("double"), "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "host_labels": F.regexp_count("host", F.lit(r"\.")).cast("double"), "_host_suffix": F.substring_index("host", ".", -1),
        "_path_suffix": F.regexp_extract("path", r"(\.[^./]*|/)$", 1), "_first_folder": F.regexp_extract("path", r"^/([^/]*)/", 1),
    })


SUFFIXES = ("host_suffix", "path_suffix", "first_folder")


class UrlFilter:
    """A fitted model: trees, and for each suffix its log odds in the labelled sample."""

    def __init__(self, trees: GBTClassificationModel | None, odds: dict[str, DataFrame], default: str):
        self.trees, self.odds, self.default = trees, odds, default

    def _with_odds(self, rows: DataFrame) -> DataFrame:
        for name in SUFFIXES:
            # At most one row for each row of the bounded sample.
            rows = rows.join(F.broadcast(self.odds[name]), f"_{name}", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        return rows

    def features(self, rows: DataFrame) -> DataFrame:
        """Rows with url, host and path and the vector that the trees read, ``_features``."""
        return VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(self._with_odds(lexical(rows)))

    def verdicts(self, rows: DataFrame) -> DataFrame:
        """Add ``method`` (allow or block) to rows with url, host and path."""
        if self.trees is None:
            return rows.withColumn("method", F.lit(self.default))
        judged = self.trees.transform(self.features(rows))
        return judged.select(*rows.columns, F.when(F.col("_prediction") > 0.5, "block").otherwise("allow").alias("method"))


def fit_urls(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, default: str = "allow") -> UrlFilter:
    """Fit on rows (url, host, path, label) with label allow or block.

    At most ``sample`` rows are used, in the order of a hash of the url, ties by url and label.  A suffix's
    log odds are those of its rows in the sample; for a row of the sample itself, of those rows only that
    lie in other folds, so the trees do not see its own label in them.  Without rows of both labels there
    is nothing to learn: every verdict is then the one label seen, or ``default``.
    """
    spark = labelled.sparkSession
    rows = labelled.select("url", "host", "path", (F.col("label") == "block").cast("double").alias("_label"))
    bounded = rows.orderBy(F.xxhash64("url"), "url", "_label").limit(sample).collect()
    seen = {r._label for r in bounded}
    if len(seen) < 2:
        return UrlFilter(None, {}, {0.0: "allow", 1.0: "block"}[seen.pop()] if seen else default)
    rows = lexical(spark.createDataFrame(bounded, "url string, host string, path string, _label double").coalesce(1))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("url", F.lit(3)), F.lit(FOLDS))).persist()
    log_odds = lambda blocked, n: F.log((blocked + 1) / (n - blocked + 1))
    odds, known = {}, rows
    for name in SUFFIXES:
        stats = rows.groupBy(f"_{name}").agg(F.sum("_label").alias("b"), F.count("*").alias("n"))
        odds[name] = stats.select(f"_{name}", log_odds(F.col("b"), F.col("n")).alias(name))
        in_fold = rows.groupBy(f"_{name}", "_fold").agg(F.sum("_label").alias("fb"), F.count("*").alias("fn"))
        others = in_fold.join(stats, f"_{name}").select(f"_{name}", "_fold", log_odds(F.col("b") - F.col("fb"), F.col("n") - F.col("fn")).alias(name))
        known = known.join(F.broadcast(others), [f"_{name}", "_fold"])
    model = UrlFilter(None, odds, default)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(known).select("_features", "_label").coalesce(1).persist()
    grower = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=trees, maxDepth=depth, seed=7)
    model.trees = grower.fit(vectors)
    vectors.unpersist()
    rows.unpersist()
    return model


def filter_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, **fitting) -> DataFrame:
    """A verdict for every page: rows (page_id, host, path, rule, verdict, method).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest wins.
    Other pages get the verdict of trees fitted on ``labelled`` (url, label), by default the pages that
    a rule decides; those labels are weak ones, which the trees carry over to pages that no rule fits.  A
    null url, or one without ``://``, has an empty host and path and is judged by the trees.  Very long urls
    are judged whole.  Repeated rows, null and repeated page_ids each give one row; an empty table gives
    none.  Other columns, whatever their names, are not read.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "_by_rule": verdict})
    if labelled is None:
        known = parts.filter("_by_rule is not null").withColumn("label", F.col("_by_rule"))
    else:
        host, path = split_url(F.col("url"))
        known = labelled.select("url", host.alias("host"), path.alias("path"), "label").filter("label in ('allow', 'block')")
    judged = fit_urls(known, **fitting).verdicts(parts)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", "method").alias("verdict"), "method")
