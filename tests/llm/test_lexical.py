"""Ranked lexical search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from quantloom.llm import lexical
from quantloom.llm.queries import ORACLES, QUERIES

RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), run) for run in RUN.findall(text or "")]


def brute(docs, items, k=10):
    held = [(doc_id, Counter(split(text))) for doc_id, text in docs]
    held = [(doc_id, tf, sum(tf.values())) for doc_id, tf in held if tf]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item_id, text in items:
        asked = Counter(split(text))
        scored = []
        for doc_id, tf, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, q in asked.items() if t in tf)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id if doc_id is not None else 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size,splits,seed", [(200, 1, 1), (2000, 4, 2), (8 << 20, 256, 3)])
def test_ranks_are_those_of_a_full_scan(spark, monkeypatch, size, splits, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(lexical, "SPLITS", splits)
    vocabulary = [rng.choice(["ab", "Ñu", "x9", "日本", "É"]) + str(rng.randint(0, 60)) for _ in range(90)]
    prose = lambda n: " ".join(rng.choice(vocabulary[: rng.randint(5, 90)]) for _ in range(n))
    texts = [prose(rng.randint(0, 50)) for _ in range(150)] + ["Twin twin"] * 30 + [None, "", "  --", "é" * 3000, prose(4000)]
    docs = [(k if k % 17 else None, t, "s", k, 1) for k, t in enumerate(texts)] + [(3, texts[3], "s", 0, 1)] * 2
    items = [(k, prose(rng.randint(1, 12)), 0) for k in range(12)] + [(3, "twin TWIN", 0), (None, "twin", 0), (77, None, 0), (78, "unheard", 0), (79, "", 0), (3, "twin TWIN", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, term string, shard long, rank int").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string, score int")
    index = lexical.build(frame, size=size)
    found = sorted(map(tuple, lexical.search(index, asked).collect()), key=str)
    assert found == brute([d[:2] for d in docs], [i[:2] for i in items])


def test_empty_tables(spark):
    docs, none = [spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "a b")], [])]
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(none), items).collect() == []
    assert lexical.search(lexical.build(docs), items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(lexical.build(docs), items).select("item_id", "rank", "doc_id").collect()] == [(1, 1, 1)]


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.01"
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    expected = base.execute(ORACLES["op13_lexical"]).fetchall()
    assert sorted(map(tuple, QUERIES["op13_lexical"](spark, data).collect())) == sorted(expected)
