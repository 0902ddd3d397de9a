"""Short benchmark items, broken pages, long ranges, overlapping mixes, contradicting labels and carried names."""

import math
import random
import time
import tracemalloc
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from quantloom.llm import decontaminate, extract, language, mixing, perplexity, toxicity, warc
from quantloom.llm import textscan as scan

LONG = "words of an article that stand here and are long enough " * 4


# --- decontamination ---------------------------------------------------------------------------------------------------------


def stands(doc, item):
    """Some alignment in which enough tokens of some run agree."""
    n = len(item)
    run = min(n, decontaminate.RUN)
    need = math.ceil(run * decontaminate.AGREE)
    for shift in range(-n + 1, len(doc)):
        same = [0 <= shift + j < len(doc) and doc[shift + j] == item[j] for j in range(n)]
        if any(sum(same[k : k + run]) >= need for k in range(n - run + 1)):
            return True
    return False


def test_short_items_are_found_as_by_trying_every_alignment(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in range(1, 14) for _ in range(2)]
    docs = []
    for item in items:
        for changes in range(4):
            copy = list(item)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "other"
            docs.append([rng.choice(vocabulary) for _ in range(rng.randint(0, 9))] + copy + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))])
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, bench).collect()}
    assert found == {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if stands(doc, item)}
    long_enough = {d for d, i in found if len(items[i]) >= decontaminate.LEAST_TOKENS}
    assert {r.doc_id for r in decontaminate.clean(frame, bench).collect()} == set(range(len(docs))) - long_enough


# --- extraction --------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page,lines", [
    (f"<article><h1>Head</h1><p>Lead of it</p><div class=body><p>{LONG * 5}</p></div></article>", ["Head", "Lead of it", (LONG * 5).strip()]),
    (f"<div><section class=a><p>{LONG * 3}</p></section><section class=b><p>{LONG}</p></section></div>", [(LONG * 3).strip(), LONG.strip()]),
    (f"<article><header><h1>Head</h1></header><p>{LONG}</p><figure><figcaption>Caption</figcaption></figure></article>", ["Head", LONG.strip(), "Caption"]),
    (f"<article><p class=share-price>Price {LONG}</p><p>One <span class=related>kept</span> word</p></article>", [f"Price {LONG}".strip(), "One kept word"]),
    (f"<article><p>{LONG}<math><mi>x</mi></math></p></article>", [f"{LONG}x"]),
    (f"<main><p>Lead</p><div class=t><p>{LONG * 2}</p></div><aside><p>side</p></aside></main>", ["Lead", (LONG * 2).strip()]),
    (f"<body><nav><a href=x>Menu</a></nav><div class=ad><p>Buy</p></div><article><p>{LONG}</p><footer>foot</footer></article><div id=comments><p>{LONG}</p></div></body>", [LONG.strip()]),
    (f"<div class=x><p>{LONG}</p></div><div class=y><a href=q>{LONG}</a></div>", [LONG.strip()]),
])
def test_an_article_keeps_all_its_text(page, lines):
    assert extract.main_text(page, None).split("\n") == lines


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<!" * 500_000, "<b>" * 150_000 + "</div>" * 90_000, "<div>" * 200_000, "<div>" + "<i>" * 170_000 + "</b>" * 120_000, "<p><b>" * 160_000])
def test_broken_pages_are_read_in_linear_time(page):
    def took(text):
        start = time.process_time()
        extract.main_text(text, None)
        return time.process_time() - start

    took(page[: len(page) // 8])
    assert took(page) < 40 * max(took(page[: len(page) // 8]), 0.02)


def test_carried_names_of_extraction(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", f"<article><p>{LONG}</p></article>", "h", "w", "t")], "page_id long, url string, html string, host string, winner string, text string")
    row = extract.extract(pages, "host", "winner", "html", "text", "page_id").first().asDict()
    assert (row["host"], row["winner"], row["text"], row["page_id"]) == ("h", "w", LONG.strip(), 1) and row["html"].startswith("<article>")


# --- archives ----------------------------------------------------------------------------------------------------------------


def test_one_large_range_is_scanned_in_linear_time(tmp_path):
    members = [warc.record(k, f"http://a/{k}", b"x" * (k % 900), "D", True, None) + warc.GAP for k in range(9_000)]
    data = b"junk \x1f\x8b\x08 junk" + b"".join(members)
    file = tmp_path / "a.warc.gz"
    file.write_bytes(data)
    start = time.process_time()
    found = [warc._parse(body) for body in warc._members(f"file://{file}", 0, len(data))]
    assert time.process_time() - start < 2 and [int(f["X-Page-Id"]) for f, _ in found] == list(range(9_000))
    cut = len(data) // 3
    parts = [body for a, b in ((0, cut), (cut, 2 * cut), (2 * cut, len(data))) for body in warc._members(f"file://{file}", a, b)]
    assert len(parts) == 9_000


# --- mixing ------------------------------------------------------------------------------------------------------------------


def test_overlapping_constraints_meet_their_targets(spark):
    rng = np.random.default_rng(3)
    docs = [(int(rng.integers(1, 200)), sorted({int(rng.integers(0, 3)), 10 + int(rng.integers(0, 2))})) for _ in range(600)]
    start = {k: sum(s for s, g in docs if k in g) for k in (0, 1, 2, 10, 11)}
    goal = {0: start[0] * 1.4, 1: start[1] * 0.6, 10: start[10] * 1.2}
    rows = spark.createDataFrame([(g, s) for s, g in docs], "groups array<long>, size long")
    rows = rows.withColumn("groups", F.filter("groups", lambda g: g.isin(list(goal)))).where(F.size("groups") > 0)
    solved = {r["number"]: r["x"] for r in mixing.balance(rows, spark.createDataFrame(list(goal.items()), "number long, target double")).collect()}
    rate = lambda g: math.exp(sum(solved.get(k, 0.0) for k in g))
    for k, wanted in goal.items():  # the conditions of the optimum: tilted rates that meet every target
        assert sum(s * rate([x for x in g if x in goal]) for s, g in docs if k in g) == pytest.approx(wanted, rel=1e-6)
    assert mixing.balance(rows.where("false"), spark.createDataFrame([], "number long, target double")).collect() == []


def test_many_sources_are_balanced_by_division(spark):
    rows = spark.createDataFrame([(f"s{k}", 10 + k, float((10 + k) * (1 + k % 3))) for k in range(300)] + [(None, 7, 3.5), ("z", 0, 0.0)], "source string, source_size long, target double")
    for r in mixing.multipliers(rows).collect():
        assert r["multiplier"] == (pytest.approx(math.log(r["target"] / r["source_size"]), abs=1e-9) if r["source_size"] else None)


def test_carried_names_of_mixing(spark):
    docs = spark.createDataFrame([(k, "a b c", "s", "own", k, "t") for k in range(5)], "doc_id long, text string, source string, bucket string, size long, target string")
    rows = mixing.mix(docs, "bucket", "size", "target", "source", "text", "doc_id").collect()
    assert all(r["bucket"] == "own" and r["size"] == 3 and r["target"] == 15.0 and r["text"] == "a b c" and r["source"] == "s" for r in rows) and len(rows) == 5
    none = spark.createDataFrame([(None, f"w{k} x", "s") for k in range(4000)], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 4000


# --- classifiers -------------------------------------------------------------------------------------------------------------


def test_contradicting_labels_of_equal_texts_do_not_depend_on_row_order(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(words, k=20)) + (" vilest" if k % 4 == 0 else "")) for k in range(160)]
    rows += [(1000 + k, t) for k, t in rows[:80]]
    marks = [(k, int(k % 4 == 0)) for k, _ in rows[:160]] + [(1000 + k, 1 - int(k % 4 == 0)) for k in range(80)]
    scores = []
    for order in (1, 2, 3):
        random.Random(order).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(order)
        model = toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), F.lit(True))
        scores.append({r.doc_id: round(r.score, 6) for r in toxicity.score(docs, model, "doc_id").collect()})
    assert scores[0] == scores[1] == scores[2]


def test_carried_names_of_scores(spark):
    docs = spark.createDataFrame([(k, "the words of a plain text " * 4, "en", "mine") for k in range(12)], "doc_id long, text string, lang string, score string")
    model = toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(docs, model, "doc_id", "score").columns == ["doc_id", "score"]
    assert language.predict(docs, language.train(docs), "doc_id", "score").columns == ["doc_id", "lang_pred", "score", "rejected"]
    judged = perplexity.judge(docs, "doc_id", "lang")
    assert judged.columns.count("lang") == 1 and judged.count() == 12


def test_labels_that_are_not_broadcast_give_the_same_verdicts(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re") for b in ("na", "sol", "du", "ker")]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, k=30)), "en") for k in range(60)] + [(None, "a b", "en"), (5, None, "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 3)], "doc_id long, quality int")
    found = []
    for bound in (1_000_000, 0):
        monkeypatch.setattr(perplexity, "BROADCAST_LABELS", bound)
        monkeypatch.setattr(perplexity, "BROADCAST_ROWS", bound)
        found.append(sorted((str(r.doc_id), r.kept, round(r.perplexity, 9)) for r in perplexity.judge(docs, "doc_id", labels=labels).collect()))
    assert found[0] == found[1] and len(found[0]) == 62


# --- base measures of the quality rules --------------------------------------------------------------------------------------


def test_lines_and_words_are_compared_exactly_in_every_text():
    signs = "".join("ab"[k.bit_count() % 2] for k in range(4096))  # and its mirror: polynomials of them agree modulo 2 ** 64
    mirror = signs.translate(str.maketrans("ab", "ba"))
    texts = ["x\nx", "x\nx", None, "", "y\nx\ny\nx\n", "\n\nz\n\nz", f"{signs}\n{mirror}", f"a b c d {signs} a b c d {mirror}", f"a b c d {signs} a b c d {signs}"]
    got = perplexity._measures(*scan.text_bytes(pa.array(texts, pa.string())))
    assert got["n_dup_lines"].tolist() == [1, 1, 0, 0, 2, 1, 0, 0, 0]
    assert got["n_repeat_words"].tolist() == [0, 0, 0, 0, 0, 0, 0, 0, 10]


def test_counting_needs_memory_for_a_small_portion_of_the_texts(spark):
    docs = MagicMock()
    perplexity.count_grams(docs)
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 400, "text": ["the words of a text " * 500] * 400})  # 4 MB
    tracemalloc.start()
    try:
        n = sum(pa.compute.sum(part.column("n")).as_py() for part in run([batch]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 400 * 500 * len("the words of a text ") and peak < 100 << 20


def test_scores_of_ngrams_are_made_by_short_plans(spark, monkeypatch):
    joins, stored = [], perplexity.stored
    monkeypatch.setattr(perplexity, "stored", lambda df, name: joins.append(df._jdf.queryExecution().analyzed().toString().count("Join ")) or stored(df, name))
    docs = spark.createDataFrame([(k, f"some words of the text number {k}", "en", k % 2 == 0) for k in range(20)], "doc_id long, text string, lang string, trusted boolean")
    table = perplexity.train(docs)
    assert max(joins) <= 4
    counts = perplexity.count_grams(docs)
    assert table.count() == counts.count()
    model = perplexity.Model.load(perplexity.kneser_ney(counts))
    rows = table.toArrow()
    want = model.log_prob("en", rows.column("gram").to_numpy().astype(np.uint64))
    assert np.allclose(rows.column("all").to_numpy(), want, atol=1e-5)


def test_few_texts_without_a_label_are_joined_with_the_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(2000)] + [(7, "another text"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k,) for k in range(0, 2000, 20)] + [(7,), (-5,)], "doc_id long")
    own = lambda rows: sorted(rows.join(labels, "doc_id").select("text").toPandas()["text"])
    want = own(docs)
    near = toxicity.maybe_labelled(docs, labels)
    assert near.columns == docs.columns and near.count() < 120 and own(near) == want and len(want) == 102
    monkeypatch.setattr(toxicity, "BITMAP", 1)  # with hardly any bits, still no labelled text is lost
    assert own(toxicity.maybe_labelled(docs, labels)) == want
    assert own(toxicity.maybe_labelled(docs, labels.select(F.col("doc_id").cast("int")))) == want
    assert toxicity.maybe_labelled(docs, labels.limit(0)).count() == 0


def test_only_words_whose_features_have_weight_are_counted(monkeypatch):
    words = [f"w{k:04d}x" for k in range(400)]
    texts = [" ".join(words[k:]) + " " + "hit " * k + "No? YES!!" for k in range(40)] + ["", None, "hit"]
    data, offsets = scan.text_bytes(pa.array(texts, pa.string()))
    lexicons = [(len(toxicity.STEMS) - 1, np.sort(toxicity.entries(*scan.text_bytes(pa.array(["hit w0399x"])))[0][-1]), np.array([2, 2])), (0, np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    voters = toxicity.Voters(lexicons)
    weight = np.zeros(toxicity.FEATURES)
    key = toxicity.entries(*scan.text_bytes(pa.array(["hit"])))[0][-1]
    weight[(key % np.uint64(toxicity.FEATURES)).astype(int)] = 0.25
    weight[(scan.mixed(key) % np.uint64(toxicity.FEATURES)).astype(int)] = 0.5
    _, feature, text = toxicity._features(data, offsets, voters)
    votes = np.array([[(t or "").split().count("hit") > 1, False, (t or "").count("!") + (t or "").count("?") > 0.02 * max(len(t or ""), 1), False, "!!" in (t or "")] for t in texts])
    add = np.array([1.0, 2.0, 0.5, 0.25, 0.125])
    expected = 1 / (1 + np.exp(-(-1 + votes @ add + np.bincount(text, weights=weight[feature], minlength=len(texts)))))
    counted = []
    distinct = toxicity.Words.distinct
    monkeypatch.setattr(toxicity.Words, "distinct", lambda *a: counted.append(distinct(*a)) or counted[-1])
    assert np.allclose(toxicity.Classifier(voters, -1.0, add, weight).score(data, offsets), expected, rtol=1e-12)
    assert 0 < sum(len(keys) for keys, _, _ in counted) < len(feature) / 20


def test_prefix_hashes_are_the_segments_hashes():
    words = ["a", "ab", "straße", "abcdefghij", "zz", "ab"]
    data, offsets = scan.text_bytes(pa.array(words))
    for most, got in zip((1, 3, 7, None), scan.prefix_hashes(data, offsets, (1, 3, 7, None))):
        assert (got == scan.segment_hash(data, offsets[:-1], offsets[1:], most)).all()
    assert [len(x) for x in scan.prefix_hashes(data[:0], offsets[:1], (1, None))] == [0, 0]


def test_owners_and_counts_with_empty_texts():
    data, offsets = scan.text_bytes(pa.array(["", "ab", None, "", "c", ""]))
    assert scan.owner(offsets, np.arange(3)).tolist() == [1, 1, 4]
    assert scan.per_text(data != ord("b"), offsets).tolist() == [0, 1, 0, 0, 1, 0]


def test_toxicity_gives_memory_back_after_every_batch(monkeypatch):
    released, sizes = [], []
    monkeypatch.setattr(toxicity, "PORTION", 100)
    monkeypatch.setattr(scan, "release", lambda: released.append(len(sizes)))
    batch = pa.RecordBatch.from_pydict({"text": ["x" * 30] * 20})
    for part in toxicity._portions(iter([batch, batch])):
        sizes.append(part.num_rows)
    assert sum(sizes) == 40 and max(sizes) <= 4 and released == [len(sizes) // 2, len(sizes)]
