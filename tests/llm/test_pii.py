"""Sanitisation against a plain version of its estimates, on planted entities and classes."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest

from rankloom.llm import pii

WORDS = [f"w{a}{b}{c}" for a in "abc" for b in "defg" for c in "hij"]


def plain_terms(texts, disclosure=0.9, support=3, context=10):
    """Per text the (start, end) of its disclosing terms, by counting over all texts."""
    rows, near_rows, near_texts, with_e, texts_e, df = [], defaultdict(int), defaultdict(set), defaultdict(int), defaultdict(set), defaultdict(int)
    for text in texts:
        spans = pii.base_spans(text)
        found = [(m.start(), m.end(), m[0].translate({i: i + 32 for i in range(65, 91)})) for m in re.finditer(r"[A-Za-z\u0080-\U0010ffff]+", text)]
        found = [t for t in found if len(t[2].encode()) >= 3]
        for t in {t[2] for t in found}:
            df[t] += 1
        free = [t for t in found if all(t[1] <= a or t[0] >= b for a, _, b in spans)]
        pairs, chains = set(), []
        for a, kind, b in spans:
            chain = pii.classes(text, kind, a, b)
            chains.append(chain)
            p = sum(t[0] < a for t in free)
            pairs |= {(e, t[2]) for e in chain for t in free[max(0, p - context) : p + context]}
        for e, t in pairs:
            near_rows[e, t] += 1
            near_texts[e, t].add(text)
        for e in {e for chain in chains for e in chain}:
            with_e[e] += 1
            texts_e[e].add(text)
        rows.append((chains, free))
    n, out = len(texts), []
    for chains, free in rows:
        marked = set()
        for chain in chains:
            e = next((e for e in chain if len(texts_e[e]) >= support), None)
            for a, b, t in free if e is not None and with_e[e] < n else ():
                if len(near_texts[e, t]) >= support and 1 - math.log(near_rows[e, t] / df[t]) / math.log(with_e[e] / n) >= disclosure - 1e-12:
                    marked.add((a, b))
        out.append(sorted(marked))
    return out


def found(spark, texts, **settings):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pii.sanitise(df, **settings).collect()
    return [[(s.start, s.end) for s in r._spans if s.kind == len(pii.KINDS)] for r in sorted(rows, key=lambda r: r.doc_id)], rows


@pytest.mark.parametrize("seed", range(3))
def test_terms_equal_a_plain_version(spark, seed):
    rng = np.random.default_rng(seed)
    texts = []
    for i in range(300):
        words = rng.choice(WORDS, rng.integers(3, 40)).tolist()
        if i % 7 == 0:
            who = f"{rng.choice(['ann', 'bob', f'p{i}'])}@{rng.choice(['acme.example', f'host{i}.example', 'mail.acme.example'])}"
            at = int(rng.integers(0, len(words)))
            words[at:at] = ["Falcon", who, "nests"] if "acme" in who else [who]
        if i % 31 == 0:
            words += ["call", f"+4930{rng.integers(100000, 999999)}", "Überall"]
        if i % 43 == 0:
            words.insert(0, f"10.1.{rng.integers(0, 2)}.{rng.integers(0, 9)}")
        texts.append(" ".join(words))
    texts += [texts[0], texts[7], "", "Falcon nests here"]
    want = plain_terms(texts)
    got, rows = found(spark, texts)
    assert got == want and sum(map(len, want)) > 20
    bases = {r.doc_id: [(s.start, s.kind, s.end) for s in r._base] for r in rows}
    assert all(bases[i] == pii.base_spans(t) for i, t in enumerate(texts))


def test_rare_entities_stand_for_their_domain_and_terms_count_at_any_distance(spark):
    filler = [" ".join(WORDS[(i * 7 + k) % 36] for k in range(30)) for i in range(60)]
    texts = [f"Falcon p{i}@acme.example {filler[i]}" for i in range(12)] + [f"q@acme.example {filler[5]} {filler[6]} falcon", "falcon without a name", *filler]
    got, rows = found(spark, texts)
    assert all(got[i] == [(0, 6)] for i in range(12))
    assert got[12] == [(len(texts[12]) - 6, len(texts[12]))] and got[13] == []
    clean = {r.doc_id: r._clean for r in rows}
    assert clean[0].startswith("[name] [email] ") and clean[12].endswith(" [word]") and clean[13] == texts[13]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert tuple(pii.estimates(df).first()) == (13, 0, 13, 0)


def test_classes_are_narrow_to_wide():
    text = "a@x.y.example 10.2.3.4 +49 30 1234567"
    chains = [pii.classes(text, k, a, b) for a, k, b in pii.base_spans(text)]
    other = "b@y.example 10.2.9.9 +49 30 9999999"
    others = [pii.classes(other, k, a, b) for a, k, b in pii.base_spans(other)]
    shared = [len(set(x) & set(y)) for x, y in zip(chains, others, strict=True)]
    assert [len(c) for c in chains] == [4, 4, 5]
    assert all(s >= 2 for s in shared) and all(x[0] != y[0] for x, y in zip(chains, others, strict=True))
