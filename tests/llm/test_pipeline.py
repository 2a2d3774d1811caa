"""The pipeline's stages, each on its own input, against plain versions; and run() as their composition."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rankloom.llm import pii

SF = "/root/testdata/sf0.001"


def base_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit.update(range(i, i + 5))
    return len(words) < 10 or 100 * len(hit) > 20 * len(words)


def shingles(text):
    words = text.lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(texts):
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in sets:
        for j in sets:
            if i < j and sum((sets[i] & sets[j]).values()) >= 0.8 * sum((sets[i] | sets[j]).values()):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: top(i) for i in texts}


def test_stages_against_plain_versions(spark):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs, outs = spark.read.parquet(f"{SF}/documents.parquet"), []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SF))
        outs.append(docs)
    ruled, judged, single, clean = ({r.doc_id: r.text for r in x.collect()} for x in outs[:4])
    assert set(ruled) <= {i for i, t in texts.items() if not base_failed(t)}
    assert {i for i, t in texts.items() if good.get(i) == 1 and not base_failed(t)} <= set(ruled)
    assert set(judged) <= set(ruled) and {i for i in ruled if good.get(i) == 1} <= set(judged)
    of = classes(judged)
    assert len(single) == len(set(of.values())) and {of[i] for i in single} == set(of.values())
    assert set(clean) == set(single)
    assert all(clean[i] == t for i, t in single.items() if not pii.base_spans(t)) and not any(pii.base_spans(t) for t in clean.values())
    lib, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), outs[4].toPandas()
    ids = {i: np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in clean.items()}
    assert pieces.length.sum() == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces.itertuples())
    assert all(bytes(r.ids) == ids[r.doc_id][r.start : r.start + r.length].tobytes() for r in pieces.itertuples())
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)
