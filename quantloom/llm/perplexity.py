"""Quality rules with an n-gram language model: documents of odd perplexity go.

`base_measures` counts what the plain rules need, `count_grams` / `kneser_ney` build one interpolated modified Kneser-Ney
model of byte n-grams per language from counts over all documents, and `judge` adds the verdict by language-specific bands and,
where quality labels are given, by how much harder a document is for a model of the documents labelled good.
Byte n-grams keep the set of types small in every alphabet, so one model serves words never seen before.

Null texts count as empty, a null language is a language of its own, repeated rows are counted and judged one by one, an
empty table gives an empty result, and further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm import textscan as scan
from quantloom.llm.rawfiles import opened
from quantloom.llm.shared import fold, forget, stored

ORDER = 5
#: n-grams that make up a smaller share of all bytes than this are left to back-off: none, whatever the size of the input.
KEEP_SHARE = 0.0
#: Bytes of text whose distinct n-grams a task looks up together; the table is read once for each so many.
CHUNK = 16 << 20
#: Bytes of text that are cut into n-grams at a time: about a hundred bytes of memory for each.
PORTION = 1 << 18
#: Half-widths of the accepted band, in scaled median absolute deviations of the language.
LOWER, UPPER = 8.0, 9.0
#: A text of n bytes has its deviation divided by sqrt(1 + SHORT / n): short texts vary more.
SHORT = 400.0
#: The scaled deviation counts as at least this many nats a byte, so that a few equal documents make no zero-width band.
LEAST_SPREAD = 0.01
#: Bounds of the excess over the good documents' model: steps in nats a byte, and labels of each kind that a language needs.
STEP, LEAST_LABELS = 0.02, 10
#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Partial counts that a task holds before it emits them.
HELD = 2_000_000
#: Discounts of at most so many languages and orders are broadcast, and at most so many labels (about 16 bytes each).
BROADCAST_ROWS, BROADCAST_LABELS = 100_000, 1_000_000

#: Columns of the result of `judge`, besides the carried ones.
MADE = (
    "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bytes", "nats", "good_nats", "middle", "spread", "base_failed",
    "perplexity", "deviation", "bound", "kept", "quality", "learned",
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, text = scan.words(data, offsets)
    key, at = scan.windows(scan.segment_numbers(data, starts, ends).astype(np.uint64), text, WINDOW)
    twice = at[scan.repeated(key, text[at])]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    first, stop, of = scan.lines(data, offsets)
    _, again = np.unique(of * np.int64(len(of) + 1) + scan.segment_numbers(data, first, stop), return_index=True)
    count = lambda x: np.bincount(x, minlength=n).astype(np.int64)
    return {
        "n_words": count(text),
        "word_chars": scan.per_text(~scan.SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": scan.per_text(_SYMBOL[data], offsets),
        "n_dup_lines": count(of) - count(of[again]),
        "n_repeat_words": count(text[covered]),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


# --- counting -----------------------------------------------------------------------------------------------------------


def _by_lang(batch: pa.RecordBatch, order: int):
    """Language, packed n-grams and their texts of a batch, for each language in it."""
    langs = batch.column("lang").dictionary_encode()
    codes = langs.indices.to_numpy(zero_copy_only=False)
    data, offsets = scan.text_bytes(batch.column("text"))
    grams, text = scan.byte_grams(data, offsets, order)
    of = codes[text] if len(text) else np.zeros(0, np.int64)
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        own = of == code
        yield lang, grams[own], text[own]


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each byte n-gram of the highest order stands in the whole texts. Tasks sum before the shuffle."""

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        keys, where = np.unique(keys, return_inverse=True)
        return keys, np.bincount(where, weights=counts).astype(np.int64)

    def partial(batches):
        held: dict[str, list] = {}

        def emit():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

        for batch in (p for b in batches for p in scan.portions(b, most=PORTION)):
            for lang, grams, _ in _by_lang(batch, order):
                if len(grams):
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    if len(held[lang]) >= 8:
                        held[lang] = [merged(held[lang])]
            if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
                yield from emit()
                held = {}
        yield from emit()
        held.clear()
        scan.release()

    texts = docs.select(F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text")
    return texts.mapInArrow(partial, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, n, gram, c, raw) for all orders n: `raw` occurrences, and the count `c` that Kneser-Ney smoothing takes.

    That is the occurrences at the highest order, and the number of distinct left neighbours below it.
    """
    mask = F.expr("shiftleft(1L, n * 8) - 1")
    wider = F.expr(f"shiftleft(1L, least(n + 1, {order}) * 8) - 1")
    each = counts.select("lang", "gram", F.col("n").alias("raw"), F.explode(F.sequence(F.lit(1), F.lit(order))).alias("n"))
    each = each.groupBy("lang", "n", F.col("gram").bitwiseAND(wider).alias("wide")).agg(F.sum("raw").alias("raw"))
    each = each.groupBy("lang", "n", F.col("wide").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("left_neighbours"), F.sum("raw").alias("raw"))
    return each.select("lang", "n", "gram", F.when(F.col("n") == order, F.col("raw")).otherwise(F.col("left_neighbours")).alias("c"), "raw")


def kneser_ney(counts: DataFrame, order: int = ORDER, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Stored (kind, lang, n, key, value): discounted weights of n-grams (kind "gram") and back-off masses of contexts (kind "context").

    The three discounts of each language and order come from counts of counts. What is pruned, or discounted, goes to the
    context's back-off mass, so each distribution still sums to one.
    """
    level = stored(levels(counts, order), "levels")
    total = counts.agg(F.sum("n").alias("all_n"))
    times = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)]
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
    some = lambda k, d: F.when((F.col("t1") > 0) & (F.col("t2") > 0) & (F.col(f"t{k}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}")))).otherwise(F.lit(d))
    discounts = level.groupBy("lang", "n").agg(*times).select("lang", "n", some(1, 0.5).alias("d1"), some(2, 1.0).alias("d2"), some(3, 1.5).alias("d3"))
    discounts = few = stored(discounts, "discounts")  # a row for each language and order
    if few.count() <= BROADCAST_ROWS:
        discounts = F.broadcast(few)
    less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    frequent = F.col("raw") >= F.lit(keep_share) * F.col("all_n")
    rows = level.join(discounts, ["lang", "n"]).crossJoin(F.broadcast(total))  # the total is one row
    rows = rows.withColumn("context", F.shiftrightunsigned("gram", 8)).withColumn("rest", F.when(frequent, F.col("c") - less).otherwise(F.lit(0.0)))
    sums = rows.groupBy("lang", "n", "context").agg(F.sum("c").alias("sum_c"), F.sum("rest").alias("sum_rest"), F.sum("raw").alias("raw"), F.max("all_n").alias("all_n"))
    sums = stored(sums.where((F.col("sum_rest") > 0) & frequent), "contexts")  # in short plans: see `log_probs`
    grams = rows.where(F.col("rest") > 0).join(sums.select("lang", "n", "context", "sum_c"), ["lang", "n", "context"])
    model = grams.select(F.lit("gram").alias("kind"), "lang", "n", F.col("gram").alias("key"), (F.col("rest") / F.col("sum_c")).alias("value")).unionByName(
        sums.select(F.lit("context").alias("kind"), "lang", "n", F.col("context").alias("key"), (1 - F.col("sum_rest") / F.col("sum_c")).alias("value"))
    )
    model = stored(model, "model")
    forget(counts.sparkSession, level, few, sums)
    return model


@dataclass
class Model:
    """For each language, order and kind: packed n-grams in ascending order (a collision-free hash) and their values."""

    order: int
    arrays: dict[tuple[str, str, int], tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def load(table: DataFrame, order: int = ORDER) -> Model:
        """For small models: the driver holds it. Whole inputs are scored by `log_probs` and `measured` instead."""
        rows = table.toArrow()
        kinds = rows.group_by(["kind", "lang", "n"]).aggregate([]).to_pylist()
        arrays = {}
        for k in kinds:
            own = rows.filter((pc.field("kind") == k["kind"]) & (pc.field("lang") == k["lang"]) & (pc.field("n") == k["n"]))
            key, value = own.column("key").to_numpy().astype(np.uint64), own.column("value").to_numpy().astype(np.float32)
            by_key = np.argsort(key, kind="stable")
            arrays[k["kind"], k["lang"], k["n"]] = key[by_key], value[by_key]
        return Model(order, arrays)

    def _find(self, kind: str, lang: str, n: int, keys: np.ndarray, missing: float) -> np.ndarray:
        have, value = self.arrays.get((kind, lang, n), (np.zeros(0, np.uint64), np.zeros(0, np.float32)))
        if not len(have):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, value[at].astype(np.float64), missing)

    def log_prob(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Log-probability of each n-gram's last byte after the bytes before it."""
        p = np.full(len(grams), 1 / 256)
        for n in range(1, self.order + 1):
            keys = grams & np.uint64((1 << 8 * n) - 1)
            p = self._find("context", lang, n, keys >> np.uint64(8), 1.0) * p + self._find("gram", lang, n, keys, 0.0)
        return np.log(np.maximum(p, 1e-12))


# --- scoring ------------------------------------------------------------------------------------------------------------


def log_probs(grams: DataFrame, model: DataFrame, name: str, order: int = ORDER) -> DataFrame:
    """Stored (lang, gram, `name`): natural log-probability of the last byte of each n-gram of `grams` (lang, gram) by a `kneser_ney` table.

    Each order is stored before the next one reads it: one plan over all orders has dozens of exchanges, which the driver plans
    anew after each stage, and their threads and plans take more of its memory than the rest of the query.
    """
    part = lambda kind, n: model.where((F.col("kind") == kind) & (F.col("n") == n)).select("lang", "key", F.col("value").alias(kind))
    p = None
    for n in range(1, order + 1):
        keys = grams.select("lang", F.expr(f"gram & (shiftleft(1L, {8 * n}) - 1)").alias("gram")) if n < order else grams.select("lang", "gram")
        rows = keys.distinct().withColumn("context", F.shiftrightunsigned("gram", 8)).withColumn("rest", F.expr(f"gram & (shiftleft(1L, {8 * n - 8}) - 1)"))
        rows = rows.join(part("gram", n).toDF("lang", "gram", "own"), ["lang", "gram"], "left")
        rows = rows.join(part("context", n).toDF("lang", "context", "back"), ["lang", "context"], "left")
        below = F.lit(1 / 256)
        if p is not None:
            rows, below = rows.join(p.toDF("lang", "rest", "below"), ["lang", "rest"]), F.col("below")
        own = rows.select("lang", "gram", (F.coalesce("back", F.lit(1.0)) * below + F.coalesce("own", F.lit(0.0))).alias("p"))
        if n == order:
            own = own.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-12))).alias(name))
        own = stored(own, f"order-{n}")
        if p is not None:
            forget(grams.sparkSession, p)
        p = own
    return p


def measured(docs: DataFrame, table: DataFrame, *carry: str) -> DataFrame:
    """Base measures, scored bytes and mean negative log-probabilities a byte of every document, with the `carry` columns.

    `table` is stored and has (lang, gram, all, good) for every n-gram of `docs`. No process holds it whole: a task gathers the
    distinct n-grams of up to CHUNK bytes of text and then picks theirs while it reads the table's files batch by batch.
    """
    files = table.inputFiles()
    kept = [docs.schema[c] for c in carry]

    def flush(held: list, codes: dict[str, int]):
        keys = np.unique(np.concatenate([k for _, k, _, _ in held]))
        value = np.full((2, len(keys)), np.nan, np.float32)
        for file in files if len(keys) else []:
            with opened(file) as source:
                for rows in pq.ParquetFile(source).iter_batches(1 << 19, columns=["lang", "gram", "all", "good"]):
                    langs = rows.column("lang").dictionary_encode()
                    code = np.array([codes.get(lang, -1) for lang in langs.dictionary.to_pylist()], np.int64)[langs.indices.to_numpy()]
                    key = (code.astype(np.uint64) << np.uint64(8 * ORDER)) | rows.column("gram").to_numpy().astype(np.uint64)
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    mine = (keys[at] == key) & (code >= 0)
                    for j, c in enumerate(("all", "good")):
                        value[j, at[mine]] = rows.column(c).to_numpy()[mine]
        if np.isnan(value).any():
            raise ValueError("the texts changed since their n-grams were counted")
        for batch, own, where, n_bytes in held:
            text = np.repeat(np.arange(len(n_bytes)), n_bytes)
            at = np.searchsorted(keys, own)
            nats = [np.bincount(text, weights=-v[at][where].astype(np.float64), minlength=len(n_bytes)) / np.maximum(n_bytes, 1) for v in value]
            data, offsets = scan.text_bytes(batch.column("text"))
            out = {c: batch.column(c) for c in carry} | {"lang": batch.column("lang")} | _measures(data, offsets)
            yield pa.RecordBatch.from_pydict(out | {"n_bytes": n_bytes, "nats": nats[0], "good_nats": nats[1]})

    def score(batches):
        codes: dict[str, int] = {}
        held, size = [], 0
        for batch in (p for b in batches for p in scan.portions(b, most=PORTION)):
            langs = batch.column("lang").dictionary_encode()
            code = np.array([codes.setdefault(lang, len(codes)) for lang in langs.dictionary.to_pylist()], np.uint64)[langs.indices.to_numpy()]
            data, offsets = scan.text_bytes(batch.column("text"))
            grams, text = scan.byte_grams(data, offsets, ORDER)
            own, where = np.unique(grams | (code[text] << np.uint64(8 * ORDER)), return_inverse=True)
            held.append((batch, own, where.astype(np.min_scalar_type(len(own))), np.bincount(text, minlength=batch.num_rows).astype(np.int64)))
            size += len(data)
            if size > CHUNK:
                yield from flush(held, codes)
                held, size = [], 0
                scan.release()
        if held:
            yield from flush(held, codes)
        held.clear()
        scan.release()

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang string", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "n_bytes long", "nats double", "good_nats double"])
    texts = docs.select(*carry, F.coalesce(F.col("lang"), F.lit("")).alias("lang"), "text")
    return texts.mapInArrow(score, schema)


def bands(scores: DataFrame) -> DataFrame:
    """(lang, middle, spread): median and scaled median absolute deviation among the documents that pass the base rules."""
    good = scores.where(~base_failed())
    middle = good.groupBy("lang").agg(F.percentile_approx("nats", 0.5, 10_000).alias("middle"))
    off = F.abs(F.col("nats") - F.col("middle")) / F.sqrt(1 + F.lit(SHORT) / F.col("n_bytes"))
    spread = good.join(middle, "lang").groupBy("lang").agg(F.first("middle").alias("middle"), F.percentile_approx(off, 0.5, 10_000).alias("spread"))
    return spread.select("lang", "middle", F.greatest(F.col("spread") * 1.4826, F.lit(LEAST_SPREAD)).alias("spread"))


def train(docs: DataFrame) -> DataFrame:
    """Stored (lang, gram, all, good): log-probability of every n-gram of `docs`, by the model of all documents.

    `good` is the same by the model of the documents where the column `trusted` holds, and as `all` without such a column.
    """
    if "trusted" not in docs.columns:
        counts = stored(count_grams(docs), "grams")
        model = kneser_ney(counts)
        every = log_probs(counts, model, "all")
        table = stored(every.withColumn("good", F.col("all")), "table")
        forget(docs.sparkSession, counts, model, every)
        return table
    tagged = F.concat(F.when(F.col("trusted"), "+").otherwise("-"), F.coalesce(F.col("lang"), F.lit("")))
    both = stored(count_grams(docs.select(tagged.alias("lang"), "text")), "grams")
    lang = F.expr("substr(lang, 2)").alias("lang")
    counts = stored(both.groupBy(lang, "gram").agg(F.sum("n").alias("n")), "all-grams")
    good = both.where(F.col("lang").startswith("+")).select(lang, "gram", "n")
    spark = docs.sparkSession
    good_model = kneser_ney(good)
    forget(spark, both)
    model = kneser_ney(counts)
    every = log_probs(counts, model, "all")
    forget(spark, model)
    trusted = log_probs(counts, good_model, "good")
    forget(spark, good_model, counts)
    joined = stored(every.join(trusted, ["lang", "gram"]), "table")
    forget(spark, every, trusted)
    return joined


def bounds(scores: DataFrame) -> DataFrame:
    """(lang, bound): the excess that best parts labelled documents of low and of good quality, among those in `learned` that pass
    the base rules. A language with fewer than LEAST_LABELS of either takes the bound of all languages together, if there is one.
    """
    rows = scores.where(F.col("learned") & F.col("quality").isNotNull() & ~base_failed())
    rows = rows.select(F.explode(F.array(F.struct(F.lit(False).alias("any"), "lang"), F.struct(F.lit(True).alias("any"), F.lit("").alias("lang")))).alias("of"), (F.col("quality") == 1).alias("fine"), F.floor((F.col("good_nats") - F.col("nats")) / STEP).cast("long").alias("bin"))
    steps = rows.groupBy("of", "bin").agg(F.count_if("fine").alias("fine"), F.count_if(~F.col("fine")).alias("poor"))
    whole, upto = Window.partitionBy("of"), Window.partitionBy("of").orderBy("bin")
    steps = steps.select("of", "bin", F.sum("fine").over(whole).alias("all_fine"), F.sum("poor").over(whole).alias("all_poor"), F.sum("fine").over(upto).alias("fine"), F.sum("poor").over(upto).alias("poor"), F.lead("bin").over(upto).alias("next"))
    steps = steps.where((F.col("all_fine") >= LEAST_LABELS) & (F.col("all_poor") >= LEAST_LABELS))
    # the geometric mean of the gap to the next document; wrong rejections and wrong acceptances cost their shares of their classes
    error = 1 - F.col("fine") / F.col("all_fine") + F.col("poor") / F.col("all_poor")
    edge = F.greatest(F.col("bin") + 1, F.lit(1))
    best = steps.groupBy("of").agg(F.min(F.struct(error.alias("error"), (F.sqrt(edge * F.greatest(F.coalesce("next", edge), edge)) * STEP).alias("bound")))["bound"].alias("bound"))
    pooled = best.where("of.any").agg(F.max("bound").alias("pooled"))  # one row, also of none
    own = best.where("not of.any").select("of.lang", "bound")
    return scores.select("lang").distinct().join(own, "lang", "left").crossJoin(F.broadcast(pooled)).select("lang", F.coalesce("bound", "pooled").alias("bound"))


def judge(docs: DataFrame, *carry: str, lower: float = LOWER, upper: float = UPPER, labels: DataFrame | None = None) -> DataFrame:
    """Measures and verdict of every document: `base_failed`, `perplexity` (a byte), `deviation` and `kept`.

    Judged by a model of these same documents. A document that fails the base rules is not kept; any other is kept while its
    deviation stays within [-lower, upper]. Junk that is frequent in the documents is no news to that model. With `labels`
    (doc_id, quality), a second model knows only documents labelled good, and a document that is harder for it than for the
    model of all by more than its language's bound is not kept either. Fold 0 of 5 of the ids is never learned from; fold 1
    gives the bounds, the others the model. A carried column named like one of the result gives way to it.
    """
    carry = tuple(c for c in carry if c not in MADE)
    if labels is not None:
        marks = stored(labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "marks")
        # so that the texts stay where they are; beyond that size they are dealt by their ids
        docs = docs.drop("quality").join(F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks, "doc_id", "left")
        of = fold("doc_id", 5)
        docs = docs.withColumn("trusted", F.coalesce((F.col("quality") == 1) & (of > 1), F.lit(False))).withColumn("learned", of == 1)
    extra = () if labels is None else ("quality", "learned")
    table = train(docs)
    scores = stored(measured(docs, table, *dict.fromkeys([*carry, *extra])), "scores")
    forget(docs.sparkSession, table)
    z = (F.col("nats") - F.col("middle")) / (F.col("spread") * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("n_bytes"), F.lit(1))))
    out = scores.join(stored(bands(scores), "bands"), "lang", "left").withColumn("base_failed", base_failed()).withColumn("perplexity", F.exp("nats")).withColumn("deviation", z)
    odd = F.coalesce((z < -lower) | (z > upper), F.lit(False))
    if labels is not None:
        out = out.join(F.broadcast(stored(bounds(scores), "bounds")), "lang", "left")
        odd = odd | F.coalesce(F.col("good_nats") - F.col("nats") > F.col("bound"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~odd)
