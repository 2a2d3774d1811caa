"""Quality classifier: evidence of each document joined with host and path posteriors by hierarchical empirical Bayes.

A logistic model over shape features of the whole text gives a document's evidence. Over all documents, hosts and paths are
groups of such outcomes: a host's rate is drawn from the global one, a path's from its host's. The spread between groups,
estimated from the group totals (method of moments), says how many documents a prior is worth, so that sparse sites shrink
towards their parent. A document's verdict takes its evidence and the posterior of its path without the document itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.arrowtext import SPACES, extend, least_hashed, raw, span_hashes, words
from rankloom.llm.neardup import counted, shingles
from rankloom.session import cut, small

#: Labelled documents that a model is fitted on, those of the smallest hash of their id.
LABELLED = 20_000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_bytes", "long_words", "symbols", "upper", "digits", "bars", "marks", "lines", "distinct", "repeated")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_KINDS = {"symbols": _class("#*$%&<>=@^~_{}[]\\"), "upper": _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": _class("0123456789"), "bars": _class("|"), "marks": _class("!?"), "lines": _class("\n")}


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; a text without words has zeros only."""
    data, at = raw(texts)
    begin, end, owner = words(data, at, SPACES)
    size = len(texts)
    n = np.bincount(owner, minlength=size)
    some = np.maximum(n, 1)
    of = {"log_words": np.log1p(n), "word_bytes": np.bincount(owner, end - begin, size) / some, "long_words": np.bincount(owner, end - begin > 15, size) / some}
    for name, kind in _KINDS.items():
        total = np.r_[0, np.cumsum(kind[data])]
        of[name] = np.log1p((total[at[1:]] - total[at[:-1]]) / some)
    of["distinct"] = np.bincount(counted(span_hashes(data, begin, end), owner)[1], minlength=size) / some
    values, docs, _, _ = shingles(texts)
    _, d, c = counted(values, docs)
    of["repeated"] = np.bincount(d, np.where(c > 1, c, 0), size) / np.maximum(np.bincount(docs, minlength=size), 1)
    return np.where(n[:, None] > 0, np.stack([of[f] for f in FEATURES], 1), 0.0)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    bias: float
    base_rate: float

    def evidence(self, values: Column) -> Column:
        """Log of how much likelier the features are in a good document than in a bad one."""
        score = reduce(lambda a, b: a + b, [F.get(values, F.lit(i)) * w for i, w in enumerate(self.weights)], F.lit(self.bias))
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score - F.lit(float(np.log(self.base_rate / (1 - self.base_rate))))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Model:
    """Logistic regression with a ridge, by Newton steps. Without labels of both kinds there is no evidence and a rate of one half."""
    if len(set(y.tolist())) < 2:
        return Model((0.0,) * x.shape[1], 0.0, 0.5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, keep = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 0.0]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return Model(tuple(map(float, weights)), float(w[-1] - (weights * mean).sum()), float(y.mean()))


def train(table: DataFrame, labels: DataFrame, id_col: str, label: str, rows: int = LABELLED) -> Model:
    """Fit on at most ``rows`` labelled rows of a table with ``_features``; labels other than 0 and 1 are left out."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("_y"))
    sample = least_hashed(table.select(id_col, "_features").join(known, id_col), id_col, rows).orderBy(id_col).select("_features", "_y").toPandas()
    x = np.array(sample["_features"].tolist(), float).reshape(len(sample), len(FEATURES))
    return fit(x, sample["_y"].to_numpy(float))


def _precision(spread: Column, q: Column, chance: Column, mass: Column) -> Column:
    """How many documents a prior is worth: the variance of one document over that between groups, less one.

    ``spread``: rate (1 - rate) of a document; ``q``: squared distances of groups from their rates, by their documents; ``chance``:
    what q would be if groups did not differ; ``mass``: how much of q a unit of variance between groups makes.
    """
    between = F.greatest((q - chance) / F.greatest(mass, F.lit(1.0)), F.lit(1e-6))
    return F.least(F.greatest(spread / between - 1, F.lit(1.0)), F.lit(1e6))


def posteriors(scored: DataFrame) -> DataFrame:
    """Per (host, path) of rows with _host, _path and chance _p: counts, sums, prior strengths and the global rate.

    Only sums of groups are joined and compared; a global line of four numbers is attached to each group.
    """
    paths = cut(scored.groupBy("_host", "_path").agg(F.count("*").alias("path_n"), F.sum("_p").alias("path_sum")))
    hosts = paths.groupBy("_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_sum").alias("host_sum"), F.sum(F.col("path_n") * F.col("path_n")).alias("squares"))
    hosts = cut(hosts)
    n, total = hosts.agg(F.sum("host_n"), F.sum("host_sum")).first()
    rate = min(max((total or 0.0) / max(n or 0, 1), 1e-6), 1 - 1e-6)
    c = F.col
    spread = hosts.agg(
        F.sum(c("host_n") * (c("host_sum") / c("host_n") - rate) ** 2).alias("q"), ((F.count("*") - 1) * (rate * (1 - rate))).alias("chance"),
        (F.sum("host_n") - F.sum(c("host_n") * c("host_n")) / F.sum("host_n")).alias("mass"),
    ).select(_precision(F.lit(rate * (1 - rate)), c("q"), c("chance"), c("mass"))).first()[0]
    host_worth = float(spread if spread is not None else 1.0)
    joined = paths.join(hosts, "_host").withColumn("_r", (c("host_sum") + host_worth * rate) / (c("host_n") + host_worth))
    own = c("_r") * (1 - c("_r"))  # a document of the host
    inner = joined.agg(
        F.sum(c("path_n") * (c("path_sum") / c("path_n") - c("_r")) ** 2).alias("q"), F.sum((1 - c("path_n") / c("host_n")) * own).alias("chance"),
        F.sum(c("path_n") - c("path_n") * c("path_n") / c("host_n")).alias("mass"), (F.sum(c("path_n") * own) / F.sum("path_n")).alias("spread"),
    ).select(_precision(c("spread"), c("q"), c("chance"), c("mass"))).first()[0]
    path_worth = float(inner if inner is not None else 1.0)
    return joined.select("_host", "_path", "path_n", "path_sum", "host_n", "host_sum", F.lit(rate).alias("rate"), F.lit(host_worth).alias("host_worth"), F.lit(path_worth).alias("path_worth"))


def classify(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", label: str = "quality",
    threshold: float = THRESHOLD, keep: tuple[str, ...] = (), rows: int = LABELLED,
) -> DataFrame:
    """Every row's id, the columns ``keep``, evidence, site_rate (its path's posterior without itself), chance and kept.

    Null hosts and paths are groups of their own. Empty texts have features of zero and are judged like others; repeated rows
    stay. Only these columns are read, so others may have any name.
    """
    values = T.StructType([T.StructField("_features", T.ArrayType(T.DoubleType()))])
    source = df.select(id_col, *[c for c in keep if c not in (id_col, text)], F.col(host).alias("_host"), F.col(path).alias("_path"), text)
    source = source.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("_host", "_path")})
    table = cut(extend(source, text, values, lambda texts: [pa.array(list(features(texts)), pa.list_(pa.float64()))], drop=() if text in keep else (text,)))
    model = train(table, labels, id_col, label, rows)
    logistic = lambda s: 1 / (1 + F.exp(-s))
    prior = float(np.log(model.base_rate / (1 - model.base_rate)))
    scored = table.withColumn("evidence", model.evidence(F.col("_features"))).withColumn("_p", logistic(F.col("evidence") + prior)).drop("_features")
    joined = scored.join(small(posteriors(scored)), ["_host", "_path"])
    c = F.col
    host_rate = (c("host_sum") - c("_p") + c("host_worth") * c("rate")) / (c("host_n") - 1 + c("host_worth"))
    site = (c("path_sum") - c("_p") + c("path_worth") * host_rate) / (c("path_n") - 1 + c("path_worth"))
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), site))
    chance = logistic(c("evidence") + F.log(site / (1 - site)))
    judged = joined.select(id_col, *[x for x in keep if x != id_col], "evidence", site.alias("site_rate"), chance.alias("chance"))
    return judged.withColumn("kept", c("chance") >= threshold)
