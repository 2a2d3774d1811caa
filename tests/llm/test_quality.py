"""The hierarchical classifier against plain sums, and its accuracy on labels that it has not seen."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality

SF = "/root/testdata/sf0.01"


def plain_posteriors(rows):
    """(host, path) to (rate, host_worth, path_worth) from (host, path, p)."""
    hosts, paths = defaultdict(list), defaultdict(list)
    for h, p, x in rows:
        hosts[h].append(x)
        paths[h, p].append(x)
    n = len(rows)
    rate = sum(x for *_, x in rows) / n

    def worth(spread, q, chance, mass):
        return min(max(spread / max((q - chance) / max(mass, 1.0), 1e-6) - 1, 1.0), 1e6)

    q = sum(len(v) * (np.mean(v) - rate) ** 2 for v in hosts.values())
    host_worth = worth(rate * (1 - rate), q, (len(hosts) - 1) * rate * (1 - rate), n - sum(len(v) ** 2 for v in hosts.values()) / n)
    r = {h: (sum(v) + host_worth * rate) / (len(v) + host_worth) for h, v in hosts.items()}
    q = sum(len(v) * (np.mean(v) - r[h]) ** 2 for (h, _), v in paths.items())
    chance = sum((1 - len(v) / len(hosts[h])) * r[h] * (1 - r[h]) for (h, _), v in paths.items())
    mass = sum(len(v) - len(v) ** 2 / len(hosts[h]) for (h, _), v in paths.items())
    spread = sum(len(v) * r[h] * (1 - r[h]) for (h, _), v in paths.items()) / n
    return rate, host_worth, worth(spread, q, chance, mass)


@pytest.mark.parametrize("seed", range(3))
def test_posteriors_equal_plain_sums(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for h in range(12):
        level = rng.beta(4, 4)
        for p in range(int(rng.integers(1, 5))):
            own = np.clip(level + rng.normal(0, 0.1), 0.05, 0.95)
            rows += [(f"h{h}", f"p{p}", float(x)) for x in rng.beta(5 * own + 0.1, 5 * (1 - own) + 0.1, int(rng.integers(1, 400 if h == 0 else 30)))]
    got = quality.posteriors(spark.createDataFrame(rows, "_host string, _path string, _p double")).collect()
    want = plain_posteriors(rows)
    assert all(np.allclose((r.rate, r.host_worth, r.path_worth), want, rtol=1e-9) for r in got)
    assert len(got) == len({(h, p) for h, p, _ in rows}) and sum(r.path_n for r in got) == len(rows)


def test_chances_equal_plain_arithmetic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels, keep=("source", "lang")).collect()
    base = spark.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id").where("quality in (0, 1)").agg(F.avg("quality")).first()[0]
    prior = math.log(base / (1 - base))
    p = lambda e: 1 / (1 + math.exp(-(e + prior)))
    rows = [(r.source, r.lang, p(r.evidence)) for r in got]
    rate, host_worth, path_worth = plain_posteriors(rows)
    host, path = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for h, q, x in rows:
        for held in (host[h], path[h, q]):
            held[0] += 1
            held[1] += x
    for r, (h, q, x) in zip(got, rows, strict=True):
        own = (host[h][1] - x + host_worth * rate) / (host[h][0] - 1 + host_worth)
        site = (path[h, q][1] - x + path_worth * own) / (path[h, q][0] - 1 + path_worth)
        site = min(max(site, 1e-6), 1 - 1e-6)
        assert abs(r.site_rate - site) < 1e-9
        assert abs(r.chance - 1 / (1 + math.exp(-(r.evidence + math.log(site / (1 - site)))))) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("quality in (0, 1)")
    seen, unseen = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality.classify(docs, seen).join(unseen, "doc_id")
    right = got.agg(F.avg(((F.col("chance") >= 0.5).cast("int") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[1] > 100 and right[0] >= 0.9
