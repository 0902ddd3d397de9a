"""The training-data operators against brute force, round trips and held-out labels, and their edge cases."""

from __future__ import annotations

import base64
import hashlib
import itertools
import inspect
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quantloom.llm import decontaminate, extract, jaccard, language, mixing, perplexity, queries, reputation, tokencounts, toxicity, warc
from quantloom.llm import textscan as scan
from quantloom.llm.shared import fold, new_path

SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, key int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs(spark, texts, langs=None, sources=None):
    rows = [(i, t, (langs or ["en"])[i % len(langs or ["en"])], (sources or ["s"])[i % len(sources or ["s"])], len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]


EDGES = [None, "", "   \n\t", "one", "a b c d", "é" * 50_000, "x " * 30_000, "same text here for all of us", "same text here for all of us", "\n\n!!\n!!\n", "\x85 \xa0 odd\x1fspace"]


# --- scans and quality rules ----------------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(vocabulary):
    rng = random.Random(2)
    texts = EDGES + [prose(rng, rng.randint(0, 60), vocabulary[:6]) + "\n" + "#|\n" * rng.randint(0, 3) for _ in range(60)]
    got = perplexity._measures(*scan.text_bytes(pa.array(texts, pa.string())))
    want = [brute_measures(t) for t in texts]
    for k, name in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
        assert got[name].tolist() == [w[k] for w in want], name


def test_portions_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * n for n in (0, 5, 9, 1, 30, 2)] + [None])})
    parts = list(scan.portions(batch, most=10))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist() and len(parts) > 1


def brute_kneser_ney(stream, order, grams):
    """Interpolated modified Kneser-Ney, plainly: probability of each n-gram's last byte."""
    level = {order: Counter(grams)}
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])

    def discount(n, c):
        t = Counter(level[n].values())
        if not (t[1] and t[2] and t[min(c, 3)]):
            return (0.5, 1.0, 1.5)[min(c, 3) - 1]
        k, y = min(c, 3), t[1] / (t[1] + 2 * t[2])
        return max(0, min(k, k - (k + 1) * y * t[k + 1] / t[k]))

    def p(gram):
        n = len(gram)
        below = p(gram[1:]) if n > 1 else 1 / 256
        seen = {g: c for g, c in level[n].items() if g[:-1] == gram[:-1]}
        if not seen:
            return below
        total = sum(seen.values())
        own = seen.get(gram, 0)
        return (own - discount(n, own) if own else 0) / total + sum(discount(n, c) for c in seen.values()) / total * below

    return p


def test_kneser_ney_matches_brute_force_and_sums_to_one(spark):
    texts = ["abra cadabra  abracad", "banana bandana\tcabana", "a", None, "ab ab abc"]
    docs = make_docs(spark, texts)
    model = perplexity.Model.load(perplexity.kneser_ney(perplexity.count_grams(docs, 3), 3, 1e-12), 3)
    grams = []
    for t in texts:
        stream = b"\n\n" + b" ".join((t or "").encode().split())
        grams += [stream[i - 2 : i + 1] for i in range(2, len(stream))]
    p = brute_kneser_ney(None, 3, grams)
    some = [*set(grams), b"zzz", b"abz", b"zab"]
    packed = np.array([int.from_bytes(g, "big") for g in some], np.uint64)
    assert np.allclose(np.exp(model.log_prob("en", packed)), [max(p(g), 1e-12) for g in some], rtol=1e-4)
    every = np.array([int.from_bytes(b"ab" + bytes([b]), "big") for b in range(256)], np.uint64)
    assert abs(np.exp(model.log_prob("en", every)).sum() - 1) < 1e-4


def test_quality_rules_edges_and_clean_documents(spark):
    docs = make_docs(spark, EDGES, langs=["en", None])
    rows = perplexity.judge(docs, "doc_id").collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(EDGES)))
    assert {r.doc_id for r in rows if r.base_failed} >= {0, 1, 2, 3, 4, 6} and not any(r.kept and r.base_failed for r in rows)
    assert perplexity.judge(docs.where("false"), "doc_id").collect() == []
    judged = queries.op5_perplexity(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = judged.join(labels, "doc_id").where("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97


def test_rare_ngrams_of_a_small_language_count_beside_a_large_one(spark):
    texts = ["abcd efgh " * 300_000, "seltene worte stehen hier nur einmal", "andere worte stehen dort einmal"]
    docs = make_docs(spark, texts, langs=["en", "de", "de"])
    got = {r.doc_id: r.perplexity for r in perplexity.judge(docs, "doc_id").collect()}
    model = perplexity.Model.load(perplexity.kneser_ney(perplexity.count_grams(docs), keep_share=0.0))
    for i in (1, 2):
        grams, _ = scan.byte_grams(*scan.text_bytes(pa.array([texts[i]])), perplexity.ORDER)
        assert abs(got[i] / np.exp(-model.log_prob("de", grams).mean()) - 1) < 1e-3 and got[i] < 20


def test_quality_rules_reject_held_out_junk_that_is_frequent(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.1/documents.parquet")
    judged = queries.op5_perplexity(spark, f"{SMALL}/../sf0.1").join(docs.select("doc_id", "lang"), "doc_id")
    labels = spark.read.parquet(f"{SMALL}/../sf0.1/labels.parquet").where(fold("doc_id", 5) == 0)
    held = judged.join(labels, "doc_id").where("not base_failed").groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()
    share = lambda quality: sum(r.kept * r.n for r in held if r.quality == quality) / sum(r.n for r in held if r.quality == quality)
    assert share(1) > 0.97 and share(0) < 0.2


# --- toxicity ---------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out_and_edges(spark, vocabulary):
    rng = random.Random(3)
    texts, labels = list(EDGES), []
    for i in range(len(EDGES), 900):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "grumble" + rng.choice(vocabulary))
        texts.append(" ".join(words))
        labels.append((i, 1, toxic))
    docs = make_docs(spark, texts)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), labels[0]], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks, fold("doc_id", 5) != 0)
    got = {r.doc_id: (r.held_out, r.score) for r in toxicity.score(docs.withColumn("held_out", fold("doc_id", 5) == 0), model, "doc_id", "held_out").collect()}
    assert len(got) == len(texts) and all(0 <= s <= 1 for _, s in got.values())
    held = [(t, got[i][1] >= 0.5) for i, _, t in labels if got[i][0]]
    assert sum(t == p for t, p in held) / len(held) > 0.97
    assert toxicity.score(docs.where("false"), model, "doc_id").collect() == []
    none = toxicity.train(docs.where("false"), marks.where("false"), F.lit(True))
    assert toxicity.score(docs.limit(3), none, "doc_id").count() == 3


def test_toxicity_held_out_recall_in_every_language(spark):
    large = f"{SMALL}/../sf0.1"
    docs, labels = (spark.read.parquet(f"{large}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op6_toxicity(spark, large).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.groupBy("lang", "toxic").agg(F.avg("predicted").alias("flagged"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.flagged > 0.7 for r in rows if r.toxic == 1) and len([r for r in rows if r.toxic == 1]) == 4, rows
    assert all(r.flagged < 0.05 for r in rows if r.toxic == 0), rows


def test_all_labelled_rows_suggest_entries(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_ROWS", 60)
    rng = random.Random(8)
    texts = [prose(rng, 20, vocabulary) + (" zorglubs" if i % 80 == 0 else "") for i in range(800)]
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(800)], "doc_id long, toxic int")
    model = toxicity.train(make_docs(spark, texts), marks, F.lit(True))
    word = toxicity.entries(*scan.text_bytes(pa.array(["zorglubs"])))[0][-1][0]
    assert any(word in keys for _, keys, _ in model.voters.lexicons)


def test_the_classifier_is_not_cut_to_save_memory():
    assert toxicity.FEATURES >= 1 << 18 and inspect.signature(toxicity.fit).parameters["rounds"].default >= 20


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.3
    vote = lambda yes, no: np.where(truth, rng.random(4000) < yes, rng.random(4000) < no)
    first = vote(0.8, 0.05)
    votes = np.stack([first, first, vote(0.8, 0.05), vote(0.7, 0.1), vote(0.5, 0.5)], 1).astype(float)
    model = toxicity.fit_label_model(votes, np.ones(4000), np.clip(votes.mean(1), 0.05, 0.95))
    assert model.weight[0] < 0.7 < model.weight[2]
    assert abs(model.rate[1][2] - 0.8) < 0.1 and abs(model.share - 0.3) < 0.08
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.88


# --- near duplicates --------------------------------------------------------------------------------------------------------


def brute_links(texts):
    sets = []
    for t in texts:
        words = WORDS.findall(t or "")
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    links = Counter()
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-12:
            links[a] += 1
            links[b] += 1
            x, y = sorted((group[a], group[b]))
            group = [x if g == y else g for g in group]
    return links, group


@pytest.mark.parametrize("block", [512, 8])
def test_jaccard_join_matches_brute_force(spark, vocabulary, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(5)
    texts = EDGES[:5] + ["a b c d"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + rng.choice(["", " "]))
    links, group = brute_links(texts)
    rows = {r.doc_id: r for r in jaccard.join(make_docs(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i in range(len(texts)):
        assert (rows[i].n_links, rows[i].class_id) == (links[i], group[i]), (i, texts[i])


def test_jaccard_join_edges(spark):
    docs = make_docs(spark, EDGES)
    assert jaccard.join(docs.where("false")).collect() == []
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert jaccard.join(unnamed.unionByName(docs)).count() == 2 * len(EDGES)
    least = jaccard.least_matches()
    assert all(np.diff(least) > 0) and least[-1] < 0.8 * jaccard.VALUES


# --- decontamination --------------------------------------------------------------------------------------------------------


def test_decontamination_finds_substituted_passages(spark, vocabulary):
    rng = random.Random(6)
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(14, 40))] for _ in range(6)]
    texts, want = list(EDGES), set()
    for k, item in enumerate(items):
        for changes in (0, 1, 3):
            copy = list(item)
            for at in rng.sample(range(len(copy)), min(changes, len(copy) // 7)):
                copy[at] = "changed"
            texts.append(prose(rng, 30, vocabulary) + " " + " ".join(copy).upper() + ", " + prose(rng, 20, vocabulary))
            want.add((len(texts) - 1, k))
        texts.append(" ".join(w for w in rng.sample(item, len(item))))
        texts.append(prose(rng, 80, vocabulary))
    bench = spark.createDataFrame([(k, " ".join(x), 7) for k, x in enumerate(items)] + [(98, None, 7), (99, "", 7), (97, "too short", 7)], "item_id long, text string, shift int")
    docs = make_docs(spark, texts)
    rows = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want)
    assert all(r.first_token == 30 for r in rows)
    left = decontaminate.clean(docs, bench)
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {d for d, _ in want} and left.columns == docs.columns
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0 and decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_decontamination_plan_has_no_python(spark):
    plan = queries.op1_decontaminate(spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow|CartesianProduct", plan)


# --- mixing -----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = {}
    while True:
        left = sum(sizes.values()) - sum(capped.values())
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_meets_targets(spark, vocabulary):
    rng = random.Random(7)
    texts = [None, ""] + [prose(rng, rng.choice([3, 20, 200]), vocabulary) for _ in range(900)]
    docs = make_docs(spark, texts, sources=["b", "a", None, "c", "b", "b", "d", "b", "Z", "b"])
    rows = mixing.mix(docs, "source", "score").collect()
    assert len(rows) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r.size == len(WORDS.findall(texts[r.doc_id] or "")) and 0 <= r.taken <= 3 * r.size and r.score == "x"
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = brute_targets(sizes)
    for s in want:
        assert abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 210
    again = mixing.mix(docs.repartition(3)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}
    assert mixing.mix(docs.where("false")).collect() == []


# --- hosts ------------------------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [("http://A.Example.ORG/en/1?x#y", "a.example.org", "/en/1"), ("x://h#f/a", "h", ""), ("nothing", "", ""), (None, "", ""), ("http://ÄB.com/de/a://b/c", "Äb.com", "/de/a://b/c"), ("://", "", ""), ("http://com/fr/", "com", "/fr/"), ("https://notexample.org/en/1", "notexample.org", "/en/1")]
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rows = {r.page_id: r for r in reputation.judge(pages, none, queries.URL_RULES).collect()}
    assert [(rows[i].host, rows[i].path) for i in range(len(urls))] == [u[1:] for u in urls]
    assert (rows[0].rule, rows[0].verdict) == ("example.org/en/1", "block") and (rows[6].rule, rows[6].verdict) == ("com/fr/", "allow")
    assert rows[4].rule == "com/de/" and rows[7].rule == "org/" and rows[1].rule is None and rows[1].verdict == "allow"
    assert reputation.judge(pages.where("false"), none, {}).collect() == []


def test_reputation_shrinks_towards_the_hierarchy(spark):
    hosts = [(f"h{i}.good{i % 5}.com", 40, 1 + i % 2) for i in range(20)] + [(f"h{i}.bad.org", 40, 36 - i % 2) for i in range(10)] + [("new.bad.org", 0, 0), ("new.good1.com", 0, 0), ("a.b.co.uk", 2, 2), ("10.0.0.1:80", 0, 0), ("", 1, 0)]
    rows = {r.host: r for r in reputation.reputation(spark.createDataFrame(hosts, "host string, n long, bad long")).collect()}
    assert len(rows) == len(hosts) and all(abs(r.rate - r.a / (r.a + r.b)) < 1e-12 for r in rows.values())
    assert rows["new.bad.org"].rate > 0.7 > 0.2 > rows["new.good1.com"].rate and rows["h0.bad.org"].bound > 0.6
    assert rows["a.b.co.uk"].rate < 1 and (rows["a.b.co.uk"].domain, rows["a.b.co.uk"].suffix) == ("b.co.uk", "co.uk")
    assert rows["10.0.0.1:80"].domain == "10.0.0.1"


# --- archives and token files -------------------------------------------------------------------------------------------------


def test_warc_round_trip_over_small_ranges(spark):
    rng = random.Random(8)
    bodies = ["", None, "<p>é</p>", "same", "same", "same", "\x1f\x8b\x08 not a member", "".join(chr(rng.randint(32, 0x2FF)) for _ in range(20_000)), "big " * 9000]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n" if i % 2 else None, b, "x") for i, b in enumerate(bodies)] + [(None, None, "lost", "x"), (3, "http://h/3\n", "same", "x")], "page_id long, url string, html string, digest string")
    path = new_path(spark, "warc")
    warc.write(pages, path)
    digest = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    want = sorted((i, len((b or "").encode()), digest(b), *(("revisit", {0: 1, 3: 5, 4: 5}[i]) if i in (0, 3, 4) else ("response", -1))) for i, b in [*enumerate(bodies), (-1, "lost"), (3, "same")])
    for size in (97, 5000, warc.RANGE):
        rows = warc.read(spark, path, size).collect()
        got = sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in rows)
        assert got == want, size
    payloads = {r.page_id: r.payload for r in rows if r.record_type == "response"}
    assert bytes(payloads[7]).decode() == bodies[7]


def test_token_counts_over_small_blocks(spark):
    rng = random.Random(9)
    lengths = [0, 1, 0, 700, 3, 0, 0, 12] + [rng.randint(0, 30) for _ in range(200)]
    docs = spark.createDataFrame([(i, "t" * n if n or i else None, 1) for i, n in enumerate(lengths)], "doc_id long, text string, number int").coalesce(3)
    make = lambda: lambda texts: [[ord(c) for c in t] for t in texts]
    for width in (2, 4):
        path = new_path(spark, "tokens")
        tokencounts.write(docs, path, make, 50_256, width)
        for size in (4, 50, 1 << 20):
            counted = tokencounts.count(spark, path, 50_256, width, size).withColumn("part", tokencounts.part_of())
            rows = tokencounts.manifest(docs, "doc_id").join(counted, ["part", "number"]).collect()
            assert {r.doc_id: r.n_tokens for r in rows} == dict(enumerate(lengths)) and counted.count() == len(lengths)


def test_token_counts_match_the_tokenizer(spark):
    make = tokencounts.byte_pairs(queries.TOKENIZER, queries.PATTERN)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: len(t) for d, t in zip(docs, make()([d.text or "" for d in docs]))}
    assert {r.doc_id: r.n_tokens for r in queries.op9_token_counts(spark, "/root/testdata/sf0.001").collect()} == want


# --- language and pages -------------------------------------------------------------------------------------------------------


def test_language_held_out_and_edges(spark):
    got = queries.op4_language(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.98
    docs = make_docs(spark, EDGES + ["the cat and the dog", "der Hund und die Katze"] * 3, langs=["en", "de", None])
    rows = {r.doc_id: r for r in language.predict(docs, language.train(docs), "doc_id").collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert {rows[i].lang_pred for i in (0, 1, 2, 9)} == {"und"} and rows[5].lang_pred in ("en", "de")
    nothing = language.train(docs.where("false"))
    assert {r.lang_pred for r in language.predict(docs, nothing, "doc_id").collect()} == {"und"}
    assert language.predict(docs.where("false"), nothing, "doc_id").collect() == []


def page(body, menu="Home"):
    return f'<html><head><title>T &amp; t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">{menu}</a></li></ul></nav><div class="ad ad-3">Buy now, it is cheap today only</div>{body}<footer>(c) all rights reserved by us</footer></body></html>'


def test_extraction(spark):
    long = "This is a long sentence of the article, with some words in it."
    pages = [
        page(f"<article><h1>Head&#x21;</h1><p>{long}<p>Tom &amp\n <b>Jerry</b> &lt;3<br>end<script>var x='</p>';</script></article>"),
        page(f'<article><p>{long}</p><div class="comments"><p>{long} says a reader</p></div><form>Sign up</form></article><aside>{long}</aside>'),
        page("<article><p>Short.</p></article><div class=teaser><p>" + long * 3 + "</p></div>"),
        page(f"<div><p>{long}</p></div>"),
        None,
        "",
        "plain < text",
    ]
    urls = ["http://h.org/1", "http://h.org/2", "http://h.org/3", None, None, "http://x/", "http://y/"]
    frame = spark.createDataFrame([(i, u, h, "w") for i, (u, h) in enumerate(zip(urls, pages))], "page_id long, url string, html string, winner string")
    rows = {r.page_id: r for r in extract.extract(frame).collect()}
    assert rows[0].text == f"Head!\n{long}\nTom & Jerry <3 end" and rows[1].text == long and rows[2].text == "Short." and rows[3].text == long
    assert (rows[4].text, rows[5].text, rows[6].text) == ("", "", "plain < text") and all(r.n_chars == len(r.text) for r in rows.values())
    assert extract.extract(frame.where("false")).collect() == []


def test_extraction_of_the_page_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    squeezed = lambda t: [" ".join(x.split()) for x in t.split("\n") if x.split()]
    same = total = 0
    for r in queries.op8_extract(spark, SMALL).collect():
        number = int(re.search(r"/(\d+)", r.url.split("://")[1])[1])
        same += squeezed(docs[number]) == r.text.split("\n")[1:]
        total += 1
    assert same / total > 0.97


# --- pipeline -----------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = corpus_pipeline.COLUMNS
    before = docs.select(*columns)
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, before, SMALL), name)
        a, b = {r.doc_id for r in before.collect()}, [r.doc_id for r in after.collect()]
        assert set(b) <= a and len(b) == len(set(b)), name
        if name == "quality_rules":
            failed = {i for i, t in texts.items() for m in [brute_measures(t)] if m[0] < 10 or 100 * m[4] > 20 * m[0]}
            assert not failed & set(b) and len(a - failed - set(b)) < 0.03 * len(a)
        if name == "near_duplicates":
            ids = sorted(a)
            _, group = brute_links([texts[i] for i in ids])
            assert Counter(group[ids.index(i)] for i in b) == Counter(set(group))
        if name == "decontamination":
            gone = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert a - set(b) == gone
        if name == "mixing":
            assert {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies} == {r.doc_id: r.copies for r in after.collect()}
        else:
            assert after.columns == columns
        before = after
    assert corpus_pipeline.STAGES[0][1](spark, docs.where("false"), SMALL).collect() == []


def test_near_duplicates_keep_the_same_document_in_any_row_order(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text, "en", "a", 1), (4, text + " more", "en", "b", 1), (None, text, "en", "a", 1), (7, "quite another text of some words", "en", "a", 1), (8, None, "en", "a", 0), (5, "", None, None, 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, rows[::-1]):
        kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(given, schema).coalesce(1), SMALL)
        assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8]
