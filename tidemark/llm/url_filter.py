"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

Rules, features, suffix statistics and scoring are DataFrame expressions; no Python runs on the
executors. The trees are grown on the driver over a bounded sample of labelled URLs, pre-aggregated
to distinct feature rows, and compiled into one expression.

A suffix's rate of label 1 is taken, for each URL that is learned from, over the other folds only, and
each tree sees a part of the features, so that no statistic of the labels decides alone.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is scored
by its other features; without labelled URLs every score is 0.5 and the verdict allow; repeated rows
are judged each; an empty table gives an empty result; further columns stay unread.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled URLs that are learned from, at most.
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LAMBDA = 24, 3, 0.3, 16, 1.0
#: Folds for the rates of suffixes; share of the features that a tree sees.
FOLDS, SEEN = 5, 0.6
#: Labelled URLs that a suffix needs for its own statistic to weigh as much as the average.
PRIOR = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_entropy", "parameters", "hyphens", "fragment", "suffix_rate", "suffix_count"]

_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _upper, _upper.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else the empty string."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ``host/path`` that fits, else null."""

    def fits(rule: str) -> Column:
        at = rule.index("/")
        return ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])

    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return F.coalesce(*(F.when(fits(r), F.lit(r)) for r in ordered), F.lit(None).cast("string"))


def entropy(text: Column) -> Column:
    """Bits a character."""

    def summed(c: Column) -> Column:
        n = F.size(c)
        share = lambda x: F.size(F.filter(c, lambda y: y == x)) / n
        return F.aggregate(F.transform(F.array_distinct(c), share), F.lit(0.0), lambda s, p: s - p * F.log2(p))

    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.round(F.transform(F.array(chars), summed)[0], 4)


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with host, path, suffix and the features that need no statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    parts = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumn("suffix", suffix_of(F.col("host")))
    count = lambda column, characters: (F.length(column) - F.length(F.translate(column, characters, ""))).cast("double")
    query = F.regexp_extract(text, "^[^?#]*[?]([^#]*)", 1)
    return parts.withColumns({
        "url_length": F.length(text).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/"),
        "host_labels": count(F.col("host"), ".") + 1,
        "digit_ratio": F.coalesce(F.round(F.try_divide(count(text, "0123456789"), F.length(text)), 4), F.lit(0.0)),
        "host_entropy": entropy(F.col("host")),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "hyphens": count(F.col("host"), "-"),
        "fragment": F.contains(text, F.lit("#")).cast("double"),
    })


def seen(tree: int, features: int) -> list[int]:
    """The features that a tree may use, ascending; the same in every run."""
    return sorted(random.Random(tree).sample(range(features), max(1, math.ceil(SEEN * features))))


def _grow(rows: list[tuple], edges: list[list[float]], gradients: list[tuple[float, float]], members: list[int], depth: int, allowed: list[int]) -> tuple | float:
    """A tree: (feature, edge, left, right), left if the feature is at most the edge, or a leaf's value."""
    g, h = (sum(gradients[i][k] for i in members) for k in (0, 1))
    leaf = -RATE * g / (h + LAMBDA)
    if depth == 0 or len(members) < 2:
        return leaf
    best, gain = None, 1e-6
    for f in allowed:
        cuts = edges[f]
        sums = [[0.0, 0.0] for _ in range(len(cuts) + 1)]
        for i in members:
            s = sums[rows[i][f]]
            s[0] += gradients[i][0]
            s[1] += gradients[i][1]
        gl = hl = 0.0
        for b in range(len(cuts)):
            gl, hl = gl + sums[b][0], hl + sums[b][1]
            if min(hl, h - hl) < 1e-3:
                continue
            new = gl * gl / (hl + LAMBDA) + (g - gl) ** 2 / (h - hl + LAMBDA) - g * g / (h + LAMBDA)
            if new > gain:
                best, gain = (f, b), new
    if best is None:
        return leaf
    f, b = best
    sides = [[i for i in members if (rows[i][f] <= b) == left] for left in (True, False)]
    return f, edges[f][b], *(_grow(rows, edges, gradients, side, depth - 1, allowed) for side in sides)


def boost(examples: list[tuple[tuple[float, ...], int, int]]) -> tuple[float, list]:
    """(base score, trees) for (features, rows, rows of label 1)."""
    total, ones = sum(n for _, n, _ in examples), sum(k for _, _, k in examples)
    base = math.log((ones + 0.5) / (total - ones + 0.5))
    edges = []
    for f in range(len(examples[0][0])):
        values = sorted({x[f] for x, _, _ in examples})
        step = max(1, -(-(len(values) - 1) // BINS))
        edges.append([(a + b) / 2 for a, b in zip(values, values[1:], strict=False)][::step])
    binned = [tuple(sum(v > e for e in cuts) for v, cuts in zip(x, edges, strict=True)) for x, _, _ in examples]
    scores, trees = [base] * len(examples), []
    for number in range(TREES):
        gradients = []
        for s, (_, n, k) in zip(scores, examples, strict=True):
            p = 1 / (1 + math.exp(-s))
            gradients.append((n * p - k, n * p * (1 - p)))
        tree = _grow(binned, edges, gradients, list(range(len(examples))), DEPTH, seen(number, len(edges)))
        trees.append(tree)
        scores = [s + _value(tree, x) for s, (x, _, _) in zip(scores, examples, strict=True)]
    return base, trees


def _value(tree: tuple | float, x: tuple[float, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def compiled(model: tuple[float, list] | None) -> Column:
    """The probability of label 1 as one expression over the features."""
    if model is None:
        return F.lit(0.5)

    def column(tree: tuple | float) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(F.col(FEATURES[tree[0]]) <= F.lit(float(tree[1])), column(tree[2])).otherwise(column(tree[3]))

    base, trees = model
    total = F.lit(float(base))
    for tree in trees:
        total = total + column(tree)
    return 1 / (1 + F.exp(-total))


class Filter:
    """Trees and suffix statistics learned from labelled URLs (url, label 0 or 1)."""

    def __init__(self, labelled: DataFrame, rows: int = TRAIN_ROWS) -> None:
        usable = labelled.filter(F.col("url").isNotNull() & F.col("label").isin(0, 1)).groupBy("url").agg(F.max("label").alias("label"))
        sample = lexical(usable.orderBy(F.xxhash64("url"), "url").limit(rows))
        sample = sample.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int"))
        known = sample.groupBy("suffix", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("k")).collect()  # FOLDS * `rows` at most
        total, ones = sum(r["n"] for r in known), sum(r["k"] for r in known)
        self.mean = ones / total if total else 0.5
        sums: dict[str, dict[int, tuple[int, int]]] = {}
        for r in known:
            sums.setdefault(r["suffix"], {})[r["fold"]] = r["n"], r["k"]
        # fold -> what the other folds say; FOLDS: what all say, for URLs that were not learned from
        self.known = []
        for suffix, folds in sorted(sums.items()):
            n, k = (sum(x[i] for x in folds.values()) for i in (0, 1))
            for fold in (*sorted(folds), FOLDS):
                own_n, own_k = folds.get(fold, (0, 0))
                rate = (k - own_k + PRIOR * self.mean) / (n - own_n + PRIOR)
                self.known.append({"suffix": suffix, "fold": fold, "rate": round(rate, 4), "size": round(math.log2(1 + n), 1)})
        cells = self.features(sample).groupBy(FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("k")).orderBy(FEATURES).collect()  # at most `rows`
        self.model = boost([(tuple(float(c[f]) for f in FEATURES), c["n"], c["k"]) for c in cells]) if 0 < ones < total else None

    def features(self, parts: DataFrame) -> DataFrame:
        """Add the suffix statistics to ``lexical`` columns and fold; their table is bounded by the sample."""
        spark = parts.sparkSession
        table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(self.known)), "array<struct<suffix: string, fold: int, rate: double, size: double>>")))
        joined = parts.join(F.broadcast(table), ["suffix", "fold"], "left")
        return joined.withColumns({"suffix_rate": F.coalesce("rate", F.lit(self.mean)), "suffix_count": F.coalesce("size", F.lit(0.0))}).drop("rate", "size", "fold")

    def score(self, urls: DataFrame) -> DataFrame:
        """``urls`` with host, path, the features and score, the probability of label 1."""
        own = {*FEATURES, "host", "path", "suffix", "score", "rate", "size", "fold"}
        clash = [c for c in urls.columns if c.lower() in own]
        return self.features(lexical(urls.drop(*clash)).withColumn("fold", F.lit(FOLDS))).withColumn("score", compiled(self.model))


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, *, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, score and verdict of every page.

    ``rules`` maps ``host/path`` to block or allow. Without ``labelled`` (url, label 1 for block) the
    URLs that a rule decides are the labelled ones.
    """
    urls = pages.select("page_id", "url")
    if labelled is None:
        ruled = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
        blocked = [r for r, v in rules.items() if v == "block"]
        labelled = urls.select("url", ruled.alias("rule")).filter("rule is not null").select("url", F.col("rule").isin(blocked).cast("int").alias("label"))
    scored = Filter(labelled, rows).score(urls).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", "score", verdict.alias("verdict"))
