"""Ranked lexical search over an inverted index, by best-first splitting of document intervals.

`build` cuts the documents into shards of bounded size, each written as posting lists: for every term the places of its documents in
the shard, which are ordered by id, and how often the term stands in each. `search` shuffles the lists of the terms asked for to one
task a shard. There every list gets a sparse table of range maxima over its impacts. The sum of an item's range maxima bounds every
score in an interval of documents. From the interval of all documents on, the one of the highest bound is split at the document of
its largest single impact, which is scored; what lies on either side goes back with its own bound, until no bound can enter the
best k. Each shard gives at most k documents an item; the best of all of them are ranked. A sixteenth of the shards comes first, and the
scores found there are bounds for the others; this saves work and changes no result.

Terms are maximal runs of ASCII letters and digits and of all other characters from U+0080 on, with A-Z lower-cased. A null or empty
text has no terms: it counts in no statistic and is never found. Every row is a document or an item of its own, also when ids or texts
repeat; of equal scores the smaller id comes first, a null one last. Empty tables give an empty result, further columns are ignored.
A text of any length lies in one shard, whose memory it alone then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quantloom.llm.shared import stored
from quantloom.llm.textscan import owner, portions, text_bytes

#: Bytes of text in a shard of documents, and in a block of items, whose terms and weights go to every task.
SHARD, BLOCK = 8 << 20, 1 << 20
#: One shard in so many is searched first. Intervals that are split at a time, at most.
WAVES, SPLITS = 16, 256

TERM = np.zeros(256, bool)
TERM[0x80:] = True
for _range in ("09", "AZ", "az"):
    TERM[ord(_range[0]) : ord(_range[1]) + 1] = True


def terms(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts, and for each occurrence the number of its term and of its text."""
    data, offsets = text_bytes(column)
    inside = TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1]))
    letters = data[inside]
    letters = np.where((letters >= 0x41) & (letters <= 0x5A), letters | 0x20, letters).astype(np.uint8)
    # runs follow one another in `letters` without a gap
    cuts = np.concatenate((np.cumsum(inside)[starts] - 1, [len(letters)])).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(letters)).dictionary_encode()
    return found.dictionary.cast(pa.string()), found.indices.to_numpy(), owner(offsets, starts)


def build(docs: DataFrame, doc_id: str = "doc_id", size: int = SHARD) -> DataFrame:
    """The stored index: rows (shard, term, places, counts, ids).

    The row of a shard without a term holds the documents: their ids, and in `counts` how many terms each has.
    """
    rows = docs.select(F.col(doc_id).alias("id"), "text")
    kind = rows.schema["id"].dataType
    schema = StructType().add("shard", LongType()).add("term", StringType()).add("places", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType())).add("ids", ArrayType(kind))

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in portions(batch, "text", size):
                part = part.take(pa.compute.array_sort_indices(part.column("id")))  # nulls last
                n, ids = part.num_rows, part.column("id")
                words, term, text = terms(part.column("text"))
                key, counts = np.unique(term.astype(np.int64) * n + text, return_counts=True)
                cuts = np.searchsorted(key, np.arange(len(words) + 1) * n)
                length = np.bincount(text, minlength=n)
                head = [pa.array([number], pa.int64()), pa.array([None], pa.string()), pa.array([[]], pa.list_(pa.int32())), _lists([0, n], length), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)]
                yield pa.RecordBatch.from_arrays(head, schema.names)
                none = pa.array([None] * len(words), pa.list_(ids.type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), number)), words, _lists(cuts, key % max(n, 1)), _lists(cuts, counts), none], schema.names)
                number += 1

    return stored(rows.mapInArrow(run, schema), "postings")


def _lists(cuts, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32()))


class Postings:
    """The posting lists of a shard with their impacts and a sparse table of range maxima."""

    def __init__(self, places: list[np.ndarray], counts: list[np.ndarray], length: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(length)
        self.start = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
        place = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        tf = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        # one sorted array of (list, place) lets a single search look into all lists
        self.keys = np.repeat(np.arange(len(places), dtype=np.int64) * self.size, np.diff(self.start)) + place
        mean = 100 - 75 + (75 * length.astype(np.int64) * n_docs) // max(n_terms, 1)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * mean[place])
        # table[j][p]: where the largest impact of the 2 ** j postings from p on lies; ranges never leave a list
        self.table = [np.arange(len(tf), dtype=np.int32)]
        longest = int(np.diff(self.start).max(initial=0))
        for j in range(1, longest.bit_length()):
            below, half = self.table[-1], 1 << (j - 1)
            one, two = below[: len(below) - half], below[half:]
            self.table.append(np.where(self.impact[one] >= self.impact[two], one, two))
        self.flat = np.concatenate([np.pad(level, (0, len(tf) - len(level))) for level in self.table])
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(2, longest + 1):
            self.log[k] = self.log[k >> 1] + 1

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest impact in each range [a, b) of postings, and its posting; 0 in an empty range."""
        level = self.log[b - a]
        full = b > a
        n = len(self.keys)
        one = self.flat[np.where(full, level * n + a, 0)]
        two = self.flat[np.where(full, level * n + b - (1 << level), 0)]
        at = np.where(self.impact[one] >= self.impact[two], one, two)
        return np.where(full, self.impact[at], 0), at

    def best(self, lists: np.ndarray, weight: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
        """The k best (score, place) of at least `least`, highest first, of equals the first place."""
        base = lists * self.size
        found = np.zeros((0, 2), np.int64)

        def bounded(a, b, low):
            value, at = self.maxima(a, b)
            value = value * weight
            bound, top = value.sum(axis=1), value.argmax(axis=1)
            rows = np.arange(len(top))
            split = self.keys[at[rows, top]] - base[top]
            keep = bound >= max(least, 1)
            return a[keep], b[keep], low[keep], bound[keep], split[keep]

        a, b, low, bound, split = bounded(self.start[lists][None, :], self.start[lists + 1][None, :], np.zeros(1, np.int64))
        width, last = 1, self.size
        while len(bound):
            # what cannot enter the best k: a lower bound than theirs, or an equal one behind their last place
            keep = (bound > least) | ((bound == least) & (low <= last))
            a, b, low, bound, split = a[keep], b[keep], low[keep], bound[keep], split[keep]
            if not len(bound):
                break
            chosen = np.zeros(len(bound), bool)
            chosen[np.argpartition(-bound, min(width, len(bound)) - 1)[:width]] = True
            ca, cb, clow, at = a[chosen], b[chosen], low[chosen], split[chosen]
            want = base + at[:, None]
            place = np.minimum(np.searchsorted(self.keys, want), cb)  # cb may be the end of all postings
            hit = place < cb
            hit[hit] = self.keys[place[hit]] == want[hit]
            score = (np.where(hit, self.impact[np.where(hit, place, 0)], 0) * weight).sum(axis=1)
            found = np.concatenate([found, np.stack([-score, at], axis=1)])
            found = found[np.lexsort((found[:, 1], found[:, 0]))][:k]
            if len(found) == k and -found[-1, 0] >= least:
                least, last = int(-found[-1, 0]), int(found[-1, 1])
            new = bounded(np.concatenate([ca, place + hit]), np.concatenate([place, cb]), np.concatenate([clow, at + 1]))
            rest = ~chosen
            a, b, low, bound, split = (np.concatenate([old[rest], more]) for old, more in zip((a, b, low, bound, split), new))
            width = min(width * 2, SPLITS)
        return [(-score, place) for score, place in found.tolist() if -score >= max(least, 1)]


def _searched(lists: DataFrame, asked: dict, floors: dict[int, int], n_docs: int, n_terms: int, k: int, kind) -> DataFrame:
    """(place, doc_id, score): the best k of each shard for each item of a block. `asked`: item -> {term: weight}."""
    schema = StructType().add("place", IntegerType()).add("doc_id", kind).add("score", LongType())

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words = table.column("term").to_pylist()
        head = words.index(None)
        length = np.asarray(table.column("counts")[head].values)
        ids = table.column("ids")[head].values
        number = {word: i for i, word in enumerate(w for w in words if w is not None)}
        arrays = [[np.asarray(x.values) for x, w in zip(table.column(c), words) if w is not None] for c in ("places", "counts")]
        index = Postings(*arrays, length, n_docs, n_terms)
        items, docs, scores = [], [], []
        for item, weights in asked.items():
            known = [(number[t], w) for t, w in weights.items() if t in number and w > 0]
            if known:
                of, weight = np.array(known, np.int64).T
                for score, place in index.best(of, weight, k, floors.get(item, 1)):
                    items.append(item)
                    docs.append(place)
                    scores.append(score)
        return pa.table([pa.array(items, pa.int32()), ids.take(pa.array(docs, pa.int64())), pa.array(scores, pa.int64())], names=schema.names)

    return lists.groupBy("shard").applyInArrow(run, schema)


def _top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("place").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame) -> Iterator[tuple[DataFrame, dict[int, dict[str, int]]]]:
    """Items in blocks of bounded text: (place, item_id) as a table, and how often each item has each term."""
    shards = [r["shard"] for r in items.where("term IS NULL").select("shard").toLocalIterator()]
    for shard in shards:
        block = items.where(F.col("shard") == shard)
        asked: dict[int, dict[str, int]] = {}
        for row in block.where("term IS NOT NULL").toLocalIterator():
            for place, count in zip(row["places"], row["counts"]):
                asked.setdefault(place, {})[row["term"]] = count
        yield block.where("term IS NULL").select(F.posexplode("ids").alias("place", "item_id")), asked


def search(index: DataFrame, items: DataFrame, k: int = 10, item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of `build`'s index with the highest scores above 0 for each row of `items`.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))). It counts as often as the item holds it, times its impact
    10^9 tf div (1000 tf + 8 m), where m is 25 + 75 n N div L (N documents with a term, L their terms in all, n the document's).
    """
    spark, kind = index.sparkSession, index.schema["ids"].dataType.elementType
    held = F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)
    total = index.where("term IS NULL").agg(F.sum(F.size(F.filter("counts", lambda c: c > 0))).alias("docs"), F.sum(held).alias("terms")).first()
    n_docs, n_terms = total["docs"] or 0, total["terms"] or 0
    results = []
    item_index = build(items, item_id, BLOCK)
    for block, asked in _blocks(item_index):
        words = sorted({t for terms_of in asked.values() for t in terms_of})
        if not words:
            continue
        # the terms of one block, at most BLOCK bytes of them or one item's
        wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(words, pa.string())})))
        lists = index.join(wanted, "term", "left_semi").select("shard", "term", "places", "counts", "ids")
        frequency = lists.groupBy("term").agg(F.sum(F.size("places")).cast("long").alias("df")).toArrow()
        weight = {t: int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))) for t, df in zip(*(frequency.column(c).to_pylist() for c in ("term", "df")))}
        asked = {item: {t: weight[t] * count for t, count in held_terms.items() if t in weight} for item, held_terms in asked.items()}
        lists = lists.unionByName(index.where("term IS NULL").select("shard", "term", "places", "counts", "ids"))
        early = F.pmod(F.xxhash64("shard"), F.lit(WAVES)) == 0
        first = stored(_top(_searched(lists.where(early), asked, {}, n_docs, n_terms, k, kind), k), "first")
        floors = {r["place"]: r["score"] for r in first.where(F.col("rank") == k).toLocalIterator()}
        others = _searched(lists.where(~early), asked, floors, n_docs, n_terms, k, kind)
        best = _top(first.select("place", "doc_id", "score").unionByName(others), k)
        results.append(stored(best.join(F.broadcast(block), "place").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not results:
        schema = StructType().add("item_id", items.schema[item_id].dataType).add("rank", IntegerType()).add("doc_id", kind).add("score", LongType())
        return spark.createDataFrame([], schema)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
