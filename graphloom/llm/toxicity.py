"""Toxicity by a classifier chain: one linear model per category, in order; later models also see the earlier categories' probabilities.

Training: earlier probabilities enter as out-of-fold predictions, so that a later model sees them as they will be on documents that no
model was trained on. Features are the distinct words of a text and their prefixes, hashed: the letters of each token between
white space together, and each run of letters in it. Runs of scripts written without spaces, and runs too long to be a word, have their character n-grams as
well, from every position. A model keeps the `features` most telling ones, chosen by counts in Spark, and an L1 penalty leaves most of those at zero. Their weights are never negative: a text without
telling words has no evidence against it, however short or long. Weights are whole millionths: a score doesn't depend on the order of its sum.

The models are fitted on the driver on at most `per_class` labelled documents of each value of the last category (taken by a hash of the id), of which the driver
gets the chosen features only. Each value's rows weigh as much as all labels of that value, in the choice of features and in the fit, so a probability
means the same at every size. Every document is scored, over its whole text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, ship, takes_over, unused

_LETTERS = re.compile(r"[^\W\d_]+")
#: Scripts written without spaces between words: Thai to Tibetan, Myanmar, Khmer, Tai, Kana, Han, Yi, Javanese.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\ua980-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: Combining marks belong to the letter before them.
_MARKS = "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.category(chr(c))[0] == "M")
#: Either group is one run.
_RUNS = re.compile(rf"((?:(?=[{_UNSPACED}])[^\W\d_][{_MARKS}]*)+)|((?:(?![{_UNSPACED}])[^\W\d_][{_MARKS}]*)+)")
#: A run of more letters is taken for several words whose white space was lost.
LONG = 20
_ODD = re.compile(f"[{_UNSPACED}{_MARKS}]")
_CACHE: dict = {}
UNIT = 1_000_000


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _ngrams(run: str, sizes: range) -> set[str]:
    return {run[i : i + n] for n in sizes for i in range(len(run) - n + 1)}


@lru_cache(maxsize=1 << 16)
def _whole(w: str) -> tuple[int, ...]:
    return (*[_hash(f"{k}{w[:k]}") for k in range(3, 9) if len(w) > k], _hash(f"={w}")) if w else ()


def word_features(word: str) -> list[int]:
    """Hashes of one token (between white space), each once: of its letters together and of each run of letters, that whole and its first 3 to 8 letters where there
    are more. Unspaced runs: n-grams of 1 to 6 letters too. Long runs: n-grams of 3 to 8, and each piece of 4 to 16 as if it were a word."""
    low = word.lower()
    runs = _LETTERS.findall(low)
    joined = "".join(runs)
    if low.isascii() or not _ODD.search(low):  # nearly all tokens: no marks, no unspaced scripts
        if len(runs) <= 1 and len(joined) <= LONG:
            return list(_whole(joined))
        pairs = [("", run) for run in runs]
    else:
        pairs = _RUNS.findall(low)
    words, pieces, grams = {joined, *runs}, set(), set()
    for unspaced, spaced in pairs:
        run = unspaced or spaced
        words |= {run, "".join(_LETTERS.findall(run))}
        if unspaced:
            grams |= _ngrams(run, range(1, 7))
        elif len(run) > LONG:
            grams |= _ngrams(run, range(3, 9))
            pieces |= _ngrams(run, range(4, 17))
    return list({h for w in words for h in _whole(w)} | {_hash(f"={w}") for w in pieces} | {_hash(f"~{g}") for g in grams})


def text_features(text: str | None) -> list[int]:
    return sorted({f for w in set((text or "").split()) for f in word_features(w)})


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(x: np.ndarray, y: np.ndarray, share: np.ndarray, l1: float, words: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic regression (FISTA) of rows that count `share` each; the first `words` weights stay at 0 or above, the bias isn't penalised."""
    n, k = share.sum(), x.shape[1]
    part = share.astype(x.dtype)
    w, b, v, c, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    u = np.ones(k, x.dtype) / np.sqrt(max(1, k))
    for _ in range(15):  # the largest singular value sets the step
        u = x.T @ (part * (x @ u))
        size = np.linalg.norm(u)
        u = u / (size or 1.0)
    lr = 1 / (0.25 * (size + n) / n + 1e-9)
    for _ in range(steps):
        g = share * (_sigmoid(x @ v.astype(x.dtype) + c) - y) / n
        w2 = v - lr * (x.T @ g.astype(x.dtype))
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - lr * l1, 0)
        w2[:words] = np.maximum(w2[:words], 0)
        b2 = c - lr * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass
class ChainModel:
    """categories in order; per category: the weights of feature hashes, of earlier categories' probabilities, and the bias, in millionths."""

    categories: tuple[str, ...]
    words: list[dict[int, int]] = field(default_factory=list)
    chain: list[list[int]] = field(default_factory=list)
    bias: list[int] = field(default_factory=list)

    def digest(self) -> str:
        """Equal for equal models only."""
        parts = (self.categories, [sorted(w.items()) for w in self.words], self.chain, self.bias)
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    def score(self, sums: np.ndarray) -> np.ndarray:
        """Probabilities (rows, categories) from the sums of word weights (rows, categories)."""
        p = np.zeros(sums.shape)
        for k in range(sums.shape[1]):
            z = sums[:, k] + self.bias[k] + (p[:, :k] * np.array(self.chain[k], float)).sum(axis=1)
            p[:, k] = np.round(_sigmoid(z / UNIT), 6)
        return p


def fit_chain(rows: list[tuple[list[int], list[int]]], categories: tuple[str, ...], features: int = 800, l1: float = 0.00005, folds: int = 4, weights: tuple[float, float] = (1.0, 1.0)) -> ChainModel:
    """rows: (feature hashes, label 0/1 per category); those with 0 and 1 in the last category count weights[0] and weights[1] each. Without rows, or with one value only, a category's probability is constant."""
    model = ChainModel(tuple(categories))
    y_all = np.array([y for _, y in rows], float).reshape(len(rows), len(categories))
    names, inverse = np.unique(np.concatenate([np.array(f, np.int64) for f, _ in rows] or [np.zeros(0, np.int64)]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows]).astype(np.int64)
    oof = np.zeros((len(rows), 0))
    fold = np.arange(len(rows)) % folds
    share = np.where(y_all[:, -1] == 1, weights[1], weights[0])
    seen, every = np.bincount(inverse, minlength=len(names)), np.bincount(inverse, weights=share[row], minlength=len(names))
    for k in range(len(categories)):
        y = y_all[:, k]
        if len(y) == 0 or y.min() == y.max():
            model.words.append({})
            model.chain.append([0] * k)
            model.bias.append(int(UNIT * (0 if len(y) and y.min() == 1 else -10)) + (10 * UNIT if len(y) and y.min() == 1 else 0))
            oof = np.column_stack([oof, np.full(len(rows), y.min() if len(y) else 0.0)])
            continue
        pos, n, ones = np.bincount(inverse, weights=(share * y)[row], minlength=len(names)), share.sum(), (share * y).sum()
        a, b = (pos + 0.5) / (ones + 1), (every - pos + 0.5) / (n - ones + 1)
        telling = np.where((seen >= 2) & (a > b), (a - b) / np.sqrt((every + 1) / n * (1 - every / (n + 1)) + 1e-9), 0)
        top = np.lexsort((names, -telling))[: min(features, int((telling > 0).sum()))]
        at = np.full(len(names), -1)
        at[top] = np.arange(len(top))
        col = at[inverse]
        x = np.zeros((len(rows), len(top)), np.float32)
        x[row[col >= 0], col[col >= 0]] = 1
        x = np.column_stack([x, oof]).astype(np.float32)
        held = np.zeros(len(rows))
        for f in range(folds):
            w, b0 = _fit_linear(x[fold != f], y[fold != f], share[fold != f], l1, len(top))
            held[fold == f] = _sigmoid(x[fold == f] @ w + b0)
        w, b0 = _fit_linear(x, y, share, l1, len(top))
        model.words.append({int(names[top[i]]): int(v) for i in range(len(top)) if (v := round(float(w[i]) * UNIT))})
        model.chain.append([round(float(v) * UNIT) for v in w[len(top) :]])
        model.bias.append(round(float(b0) * UNIT))
        oof = np.column_stack([oof, np.round(held, 6)])
    return model


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"), per_class: int = 3000, features: int = 800, id_col: str = "doc_id", text_col: str = "text") -> ChainModel:
    """Fit a chain on labelled documents; labels has id_col and a 0/1 column per category. Labels with nulls and labels without a document are left out.

    An id with several labels has a category if one of them says so; of documents that share an id, the one whose text has the smallest hash is read. So each picked id is one row of
    the sample, however often it repeats.
    """
    spark = docs.sparkSession
    ship(spark)
    clean = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories)]).dropna()
    clean = materialize(clean.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))]), "labels")
    last = f"y{len(categories) - 1}"
    # Bounded by per_class for each value of the last category.
    picked = [r for v in (0, 1) for r in clean.where(F.col(last) == v).orderBy(F.xxhash64("id"), *clean.columns).limit(per_class).collect()]
    if not picked:
        return fit_chain([], categories)
    # What a picked row stands for: labels of its value over those picked, in units of the mean, so that the penalty weighs the same with and without a cut.
    labelled = {r[last]: r["count"] for r in clean.groupBy(last).count().collect()}
    taken = [sum(r[last] == v for r in picked) for v in (0, 1)]
    unit = sum(labelled.get(v, 0) for v in (0, 1)) / sum(taken)
    weights = tuple(labelled.get(v, 0) / taken[v] / unit if taken[v] else 1.0 for v in (0, 1))
    sample = spark.createDataFrame(picked, clean.schema)

    marks = clean.columns[1:]

    def run(batches):
        takes_over("toxicity", _whole.cache_clear)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "f": [text_features(t) for t in pdf["text"]], **{c: pdf[c] for c in marks}})

    text = F.struct(F.xxhash64("text").alias("h"), "text")
    few = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").groupBy(*clean.columns).agg(F.min(text).alias("t")).select(*clean.columns, "t.text")
    kind = clean.schema["id"].dataType.simpleString()
    featured = materialize(few.mapInPandas(run, f"id {kind}, f array<bigint>, " + ", ".join(f"{c} int" for c in marks)), "features")
    # Whole numbers per value of the last category, weighted afterwards: the sums don't depend on their order.
    sides = [F.when(F.col(last) == v, 1).otherwise(0) for v in (0, 1)]
    tally = [F.sum(side if c == "n" else side * F.col(c)).alias(f"{c}_{v}") for v, side in enumerate(sides) for c in ("n", *marks)]
    total = featured.agg(*tally).first()
    counts = featured.select(F.explode("f").alias("f"), *marks).groupBy("f").agg(F.count("*").alias("seen"), *tally).where("seen >= 2")
    counts = materialize(counts, "counts")
    chosen: set[int] = set()
    for c in marks:
        n, pos = (sum(weights[v] * (total[f"{x}_{v}"] or 0) for v in (0, 1)) for x in ("n", c))
        every, ones = (F.col(f"{x}_0") * weights[0] + F.col(f"{x}_1") * weights[1] for x in ("n", c))
        gap = (ones + 0.5) / (pos + 1) - (every - ones + 0.5) / (n - pos + 1)
        telling = gap / F.sqrt((every + 1) / n * (1 - every / (n + 1)) + 1e-9)
        chosen |= {r["f"] for r in counts.withColumn("t", telling).where("t > 0").orderBy(F.desc("t"), "f").limit(features).select("f").collect()}
    held = F.array(*[F.lit(f) for f in sorted(chosen)]).cast("array<bigint>")
    got = featured.select("id", F.array_sort(F.array_intersect("f", held)).alias("f"), *marks).collect()
    got.sort(key=lambda r: (r["id"], r["f"], *r[2:]))
    return fit_chain([(r["f"], list(r[2:])) for r in got], categories, features, weights=weights)


def score(docs: DataFrame, model: ChainModel, text_col: str = "text", prefix: str = "p_", threshold: float = 0.5, flag: str = "is_toxic") -> DataFrame:
    """docs with a probability per category and the decision on the last one. Null or empty text: the bias alone decides.

    Columns of docs stay as they are: a new name that one of them has is refused with a ValueError; choose another prefix or flag then. Repeated rows are scored each. An empty table
    gives an empty result.
    """
    ship(docs.sparkSession)
    new = [*[prefix + c for c in model.categories], flag]
    if clash := sorted({c.lower() for c in new} & {c.lower() for c in docs.columns}):
        raise ValueError(f"documents have columns of these names already: {clash}")
    known, k, key = {f for w in model.words for f in w}, len(model.categories), model.digest()
    tables = [{f: w.get(f, 0) for f in known} for w in model.words]

    def run(texts):
        takes_over("toxicity", _whole.cache_clear)
        if _CACHE.get("key") != key:
            _CACHE.clear()
            _CACHE.update(key=key, words={})
        cache = _CACHE["words"]
        def feature_sums(text) -> list[int]:
            words = set((text or "").split())
            total, seen = [0] * k, set()
            for w in words:
                got = cache.get(w)
                if got is None:
                    got = tuple(f for f in word_features(w) if f in known)
                    if len(w) <= 64:  # long tokens hardly come again
                        if len(cache) > 300_000:
                            cache.clear()
                        cache[w] = got
                seen.update(got)
            for f in seen:  # a feature counts once, in whichever words it stands
                for i in range(k):
                    total[i] += tables[i][f]
            return total

        for t in texts:
            p = model.score(np.array([feature_sums(x) for x in t], float).reshape(len(t), k))
            yield pd.DataFrame({f"c{i}": p[:, i] for i in range(k)})

    def typed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(texts)

    udf = F.pandas_udf(typed, ", ".join(f"c{i} double" for i in range(k)))
    held = unused([*docs.columns, *new], "chain")
    out = docs.withColumn(held, udf(F.col(text_col)))
    p = [F.col(f"{held}.c{i}") for i in range(k)]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[x.alias(n) for x, n in zip(p, new, strict=False)], (p[-1] >= threshold).alias(flag))


def with_low_quality(labels: DataFrame) -> DataFrame:
    """labels (doc_id, quality, toxic) as the chain's categories: low_quality is quality = 0."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
