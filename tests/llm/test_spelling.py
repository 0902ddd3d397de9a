"""Spelling neighbours, forms and roots against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from quantloom.llm import spelling
from quantloom.llm.queries import QUERIES
from quantloom.sources.shared import shared_dir


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, factor=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-counts[v], v.encode()))
            if counts[best] >= factor * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (n, len(near[w]), form.get(w), counts.get(form.get(w)), root(w)) for w, n in counts.items()}


def result(frame):
    rows = frame.collect()
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed,letters,longest", [(1, "ab", 7), (2, "abcé", 9), (3, "añ", 40)])
def test_equal_to_all_pairs(spark, seed, letters, longest):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(150)}
    for w in sorted(words)[::2]:
        k = rng.randrange(len(w))
        words |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]}
    words |= {"a", "", "a" * 500, "a" * 501, "a" * 250 + "b" + "a" * 249}
    counts = {w: rng.choice([1, 2, 20, 300, 5000]) for w in words}
    frame = spark.createDataFrame([(w, n, "x", 0) for w, n in counts.items()], "word string, n long, near string, form int")
    assert result(spelling.group(frame)) == brute(counts)


def test_repeats_nulls_and_an_empty_table(spark):
    rows = [("kitten", 2), ("kitten", 30), ("kitte", None), ("kitte", 3), (None, 9), ("smitten", None)]
    found = result(spelling.group(spark.createDataFrame(rows, "word string, n long")))
    assert found == brute({"kitten": 32, "kitte": 3, "smitten": 0})
    assert spelling.group(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query_over_the_table(spark):
    data = "/root/testdata/sf0.001"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for row in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{row['doc_id']}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = {}
    for w in counts:  # all words that lack the same place, or that one deletion leads to
        for k in range(len(w)):
            near.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    found = result(QUERIES["op12_spelling"](spark, data))
    assert found.keys() == counts.keys()
    for w, (n, n_near, form, form_n, root) in found.items():
        close = {v for k in range(len(w)) for v in near[(k, w[:k] + w[k + 1 :])] if v != w}
        close |= {w[:k] + w[k + 1 :] for k in range(len(w)) if w[:k] + w[k + 1 :] in counts}
        close |= {v for (k, short), group in near.items() if short == w for v in group}
        assert (n, n_near) == (counts[w], len(close))
        best = min(close, key=lambda v: (-counts[v], v.encode()), default=None)
        assert form == (best if best and counts[best] >= 10 * n else None)
        assert form_n == counts.get(form) and (root == w if form is None else root in counts)


def test_superseded_tables_are_deleted_and_states_are_narrow(spark):
    words = spark.createDataFrame([("pattern", 50), ("patern", 20), ("pattren", 3), ("battern", 2), ("patt", 1)], "word string, n long")
    assert len(spelling._without_edits(words).columns) <= 6
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    held = lambda: {f.getPath().getName() for f in store.listStatus(folder)}
    before = held()
    found = {r.word: (r.n_near, r.form, r.root) for r in spelling.group(words, 2).collect()}
    assert found["patern"] == (1, "pattern", "pattern") and found["battern"] == (1, "pattern", "pattern") and found["patt"] == (0, None, "patt")
    assert sorted(name.rsplit("-", 1)[0] for name in held() - before) == ["llm-forms", "llm-roots"]
