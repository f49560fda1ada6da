"""URL filter: rules first, and gradient-boosted trees on lexical features for the rest, in DataFrame operations only.

Labelled URLs are those that a rule decides. Suffix statistics (share of blocked labelled URLs per last label and per last two labels of the
host, smoothed) are computed over all of them. The trees are fitted on the driver on at most `sample` labelled URLs, taken by a hash of the URL,
and become one SQL expression, so scoring stays in generated code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, materialize

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule(BLOCK, "net/"), Rule(ALLOW, "example.net/en/"), Rule(BLOCK, "example.com/de/"), Rule(ALLOW, "org/fr/"))


def _rest(url: Column) -> Column:
    """What follows the first ://, up to ? or #; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^?#]*", 0)).otherwise("")


def host(url: Column) -> Column:
    return ascii_lower(F.substring_index(_rest(url), "/", 1))


def path(url: Column) -> Column:
    rest = _rest(url)
    return F.substring(rest, F.length(F.substring_index(rest, "/", 1)) + 1, F.length(rest))


def rule_for(host_col: Column, path_col: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule's text, rule's verdict) of the longest rule that fits host or a parent of it and the path's start; null if none. rules is a list held by the program."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # later ones, longer, take precedence
        fits = ((host_col == r.host) | host_col.endswith("." + r.host)) & path_col.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "host_digits", "hyphens", "entropy", "parameters", "query_length", "fragment", "top_rate", "domain_rate")


def lexical(url: Column, host_col: Column, path_col: Column) -> dict[str, Column]:
    """Features of the URL itself; counts of an empty or null URL are 0."""
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    count = lambda col, chars: (F.length(col) - F.length(F.translate(col, chars, ""))).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    chars = F.array_distinct(F.split(url, ""))
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host_col).cast("double"),
        "path_length": F.length(path_col).cast("double"),
        "depth": count(path_col, "/"),
        "host_labels": count(host_col, "."),
        "digit_ratio": F.coalesce(F.try_divide(count(url, "0123456789"), n), F.lit(0.0)),
        "host_digits": count(host_col, "0123456789"),
        "hyphens": count(url, "-"),
        "entropy": F.coalesce(bits, F.lit(0.0)),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
        "query_length": F.length(query).cast("double"),
        "fragment": F.when(F.contains(url, F.lit("#")), 1.0).otherwise(0.0),
    }


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, l2: float):
    """Nested (feature, threshold, left, right) or a leaf's value."""
    leaf = float(-g[rows].sum() / (h[rows].sum() + l2))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, base = (1e-6, 0, 0.0), g[rows].sum() ** 2 / (h[rows].sum() + l2)
    for f in range(x.shape[1]):
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        s = v[order]
        gl, hl = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
        gt, ht = gl[-1] + g[rows][order][-1], hl[-1] + h[rows][order][-1]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - base
        ok = s[1:] > s[:-1]
        ok[: least - 1] = False
        ok[len(ok) - least + 1 :] = False
        gain = np.where(ok, gain, -1)
        i = int(gain.argmax())
        if gain[i] > best[0]:
            best = (float(gain[i]), f, float((s[i] + s[i + 1]) / 2))
    if best[0] <= 1e-6:
        return leaf
    left = x[rows, best[1]] <= best[2]
    return best[1], best[2], _tree(x, g, h, rows[left], depth - 1, least, l2), _tree(x, g, h, rows[~left], depth - 1, least, l2)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, t, a, b = tree
    return np.where(x[:, f] <= t, _value(a, x), _value(b, x))


@dataclass(frozen=True)
class BoostedTrees:
    bias: float
    rate: float
    trees: tuple

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((_value(t, x) for t in self.trees), np.zeros(len(x)))

    def column(self, names: tuple[str, ...]) -> Column:
        """The margin as an expression over the columns `names`."""

        def sql(t) -> str:
            return f"({t!r}D)" if isinstance(t, float) else f"(CASE WHEN `{names[t[0]]}` <= {t[1]!r}D THEN {sql(t[2])} ELSE {sql(t[3])} END)"

        return F.expr(f"{self.bias!r}D" + "".join(f" + {self.rate!r}D * {sql(t)}" for t in self.trees))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.2, least: int = 10, l2: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss. Without rows: a margin of -1 (allow); with one verdict only: that one."""
    if len(y) == 0 or y.min() == y.max():
        return BoostedTrees(4.0 if len(y) and y[0] else -1.0, rate, ())
    bias = float(np.log(y.mean() / (1 - y.mean())))
    m, out = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        t = _tree(x, p - y, p * (1 - p), np.arange(len(y)), depth, least, l2)
        out.append(t)
        m = m + rate * _value(t, x)
    return BoostedTrees(bias, rate, tuple(out))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", sample: int = 4000, smooth: float = 20.0, threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: id, host, path, rule (null if none fits), verdict, probability of block by the trees.

    Null URLs and URLs without :// have an empty host and path, and are judged by the trees. Repeated rows and equal ids are judged each.
    Without any labelled URL all others are allowed. Very long URLs are read whole. Other columns are not read. An empty table gives an empty result.
    """
    u = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    u = u.withColumn("rule", rule).withColumn("by_rule", verdict)
    u = u.withColumn("top", F.substring_index("host", ".", -1)).withColumn("domain", F.substring_index("host", ".", -2))
    u = u.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    # One pass over all labelled URLs, pre-aggregated per last two labels and written; the last label's counts follow from those.
    per_domain = u.where("by_rule is not null").groupBy("top", "domain").agg(F.count("*").alias("n"), F.sum(F.when(F.col("by_rule") == BLOCK, 1).otherwise(0)).alias("b"))
    per_domain = materialize(per_domain, "domains")
    per_top = per_domain.groupBy(F.col("top").alias("s_top")).agg(F.sum("n").alias("top_n"), F.sum("b").alias("top_b"))
    per_domain = per_domain.select(F.col("domain").alias("s_domain"), F.col("n").alias("domain_n"), F.col("b").alias("domain_b"))
    own = F.when(F.col("by_rule") == BLOCK, 1).otherwise(0)
    labelled = F.col("by_rule").isNotNull().cast("int")

    def rate(kind: str) -> Column:
        """Without the URL's own label, smoothed towards a half."""
        n, b = F.coalesce(f"{kind}_n", F.lit(0)) - labelled, F.coalesce(f"{kind}_b", F.lit(0)) - own
        return (b + smooth / 2) / (n + smooth)

    def rated(df: DataFrame) -> DataFrame:
        """A row per domain meets the rows of df; what exceeds Spark's limit for a broadcast is joined by shuffle, where adaptive execution splits a domain that has very many."""
        df = df.join(per_top, F.col("top") == F.col("s_top"), "left").join(per_domain, F.col("domain") == F.col("s_domain"), "left")
        return df.withColumn("top_rate", rate("top")).withColumn("domain_rate", rate("domain"))

    # The sample is taken before the joins: one more pass, over the labelled URLs alone.
    chosen = u.where("by_rule is not null").orderBy(F.xxhash64("url"), "url", "id").limit(sample)
    chosen = rated(chosen).select((F.col("by_rule") == BLOCK).cast("double").alias("y"), *FEATURES, "url", "id").collect()
    chosen = [tuple(r)[:-2] for r in sorted(chosen, key=lambda r: (r["url"], r["id"] is not None, r["id"]))]
    data = np.array([tuple(r) for r in chosen], float).reshape(len(chosen), 1 + len(FEATURES))
    model = fit_trees(data[:, 1:], data[:, 0])
    p = 1 / (1 + F.exp(-model.column(FEATURES)))
    out = rated(u).withColumn("probability", p)
    verdict = F.coalesce("by_rule", F.when(F.col("probability") >= threshold, F.lit(BLOCK)).otherwise(ALLOW))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), "probability")
