"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts become sets of five-word shingles. Texts with the same set form one class, so copies never meet each other. Classes
that share a MinHash band are candidates; within a bucket a task compares their MinHash values a few at a time, drops a pair
as soon as the posterior probability of reaching the threshold falls below a tolerance, and verifies the rest on the sets.

No pair leaves a task: a bucket of any size is cut into blocks, each pair belongs to the first band it shares, and a block
only tells each member's number of links and the smallest member that it hangs together with. Connected components of those
stars give the groups.

A text of one to four words is one shingle; null and blank texts have none and no links. Null or repeated ids and further
columns do no harm (copies are told apart by content), an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import textscan as scan
from quantloom.llm.shared import forget, stored

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold misses every band with probability (1 - 0.8^ROWS)^BANDS, below 1e-5.
BANDS, ROWS = 30, 5
VALUES = BANDS * ROWS
#: MinHash values compared before each decision.
STEP = 15
#: A pair is dropped when its posterior probability of reaching the threshold is below this.
TOLERANCE = 1e-6
#: Members of a block; a bucket of more is cut into blocks, and each pair of blocks goes to a task.
BLOCK = 512
#: Pairs compared at a time.
CHUNK = 1 << 14

_RNG = np.random.default_rng(20_240_501)
_FACTOR = _RNG.integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFT = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and where each text's begin and end."""
    starts, ends, text = scan.words(data, offsets)
    hashes = scan.segment_hash(data, starts, ends)
    size = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(size) - size
    key, at = scan.windows(hashes, text, n)
    of = text[at]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = []
        for t in short:
            h = np.array([size[t]], np.uint64)
            for k in range(size[t]):
                h = scan.mixed(h * np.uint64(scan.MULTIPLIER) + hashes[first[t] + k])
            whole.append(h[0])
        key, of = np.concatenate((key, np.array(whole, np.uint64))), np.concatenate((of, short))
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    if len(key):
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        key, of = key[new], of[new]
    ends = np.cumsum(np.bincount(of, minlength=len(offsets) - 1))
    return key, np.concatenate(([0], ends)).astype(np.int64)


def minhash(keys: np.ndarray) -> np.ndarray:
    """MinHash values of one sorted set; a part of the set at a time, so that its length costs no memory."""
    out = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    x = (keys >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        y = x[None, at : at + 2048] * _FACTOR[:, None] + _SHIFT[:, None]
        np.minimum(out, (y ^ (y >> np.uint32(15))).min(1), out=out)
    return out


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For 1 * STEP, 2 * STEP, ... compared values, the fewest matches that keep a pair.

    With a flat prior on the similarity, m matches of n leave a Beta(m + 1, n - m + 1) posterior; its upper tail at the
    threshold is a sum of binomial terms.
    """
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        terms = [math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)]
        # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        out.append(next(m for m in range(n + 1) if sum(terms[: m + 1]) >= tolerance))
    return np.array(out)


def sketched(docs: DataFrame, sets: bool) -> DataFrame:
    """(doc_id, key, size, values[, keys]): content key of the shingle set, its size and MinHash values, and the set itself."""

    def run(batches):
        for batch in batches:
            for part in scan.portions(batch):
                keys, ends = shingles(*scan.text_bytes(part.column("text")))
                own = [keys[a:b] for a, b in zip(ends[:-1], ends[1:])]
                out = {c: part.column(c) for c in part.schema.names if c != "text"}
                out |= {"key": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary()), "size": pa.array([len(x) for x in own], pa.int64())}
                if sets:
                    out |= {"keys": pa.array([x.tobytes() for x in own], pa.binary())}
                else:
                    out |= {"values": pa.array([minhash(x).tobytes() if len(x) else None for x in own], pa.binary())}
                yield pa.RecordBatch.from_pydict(out)

    carry = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in carry] + ["key binary, size long", "keys binary" if sets else "values binary"])
    return docs.mapInArrow(run, schema)


def buckets(classes: DataFrame) -> DataFrame:
    """(band, bucket, one, two, key): members of buckets of several classes, a row for each block pair that a member belongs to."""
    slices = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    part = F.col("values").substr(F.col("band") * (4 * ROWS) + 1, F.lit(4 * ROWS))
    members = classes.select("key", "values", slices.alias("band")).select("key", "band", F.xxhash64("band", part).alias("bucket"))
    several = members.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = members.join(several, ["band", "bucket"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit("block")), blocks).cast("int")
    members = members.select("band", "bucket", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    return members.select("band", "bucket", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "key", F.col("own").alias("part"))


def _groups(batches, names: list[str]):
    """Runs of equal (band, bucket, one, two) of a sorted stream; a run may span batches. No run is larger than two blocks or so."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == 0 and last is not None and first != last and held:
                yield pa.Table.from_batches(held)
                held = []
            elif a > 0 and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(part: np.ndarray, one: int, two: int):
    """Index pairs of a block pair, some at a time: all pairs of a block with itself, or those across two blocks."""
    left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
    for i, a in enumerate(left):
        yield a, (right[i + 1 :] if one == two else right)


def _survivors(values: np.ndarray, part: np.ndarray, band: int, one: int, two: int, least: np.ndarray):
    """Pairs that first meet in this band and that Bayesian pruning keeps."""
    held, n = [], 0

    def judged():
        a, b = np.concatenate([np.full(len(y), x) for x, y in held]), np.concatenate([y for _, y in held])
        for earlier in range(band):
            cols = slice(earlier * ROWS, (earlier + 1) * ROWS)
            fresh = (values[a, cols] != values[b, cols]).any(1)
            a, b = a[fresh], b[fresh]
        matches = np.zeros(len(a), np.int64)
        for step, need in enumerate(least):
            cols = slice(step * STEP, (step + 1) * STEP)
            matches += (values[a, cols] == values[b, cols]).sum(1)
            alive = matches >= need
            a, b, matches = a[alive], b[alive], matches[alive]
        return a, b

    for a, b in _pairs(part, one, two):
        if len(b):
            held.append((a, b))
            n += len(b)
        if n >= CHUNK:
            yield judged()
            held, n = [], 0
    if held:
        yield judged()


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, VALUES)


RUN = ["band", "bucket", "one", "two"]


def _in_runs(rows: DataFrame) -> DataFrame:
    return rows.repartition(*RUN).sortWithinPartitions(*RUN, "key")


def _promising(rows: DataFrame, least: np.ndarray) -> DataFrame:
    """The bucket members that have a pair left after pruning."""

    def run(batches):
        for group in _groups(batches, RUN):
            if group.num_rows < 2:
                continue
            band, one, two = (group.column(c)[0].as_py() for c in ("band", "one", "two"))
            values, part = _values(group.column("values")), group.column("part").to_numpy()
            keep = np.zeros(group.num_rows, bool)
            for a, b in _survivors(values, part, band, one, two, least):
                keep[a] = keep[b] = True
            if keep.any():
                yield from group.filter(pa.array(keep)).select([*RUN, "part", "key"]).combine_chunks().to_batches()

    return _in_runs(rows).mapInArrow(run, "band int, bucket long, one int, two int, part int, key binary")


def _verified(rows: DataFrame, least: np.ndarray, threshold: float) -> DataFrame:
    """(key, root, texts, copies): each member's exact links within its block pair, to so many classes and documents."""

    def run(batches):
        for group in _groups(batches, RUN):
            band, one, two = (group.column(c)[0].as_py() for c in ("band", "one", "two"))
            values, part = _values(group.column("values")), group.column("part").to_numpy()
            copies = group.column("n").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in group.column("keys").to_pylist()]
            size = np.array([len(x) for x in sets])
            m = len(sets)
            # the sets as rows of ids of shared shingles: only those that two members hold can be common
            flat = np.concatenate(sets)
            _, ids, n = np.unique(flat, return_inverse=True, return_counts=True)
            texts, docs, root = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
            ids = np.split(np.where(n[ids] > 1, ids, -1), np.cumsum(size)[:-1])
            mark = np.zeros(len(n) + 1, bool)

            def top(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in _survivors(values, part, band, one, two, least):
                possible = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
                a, b = a[possible], b[possible]
                for x in np.unique(a):
                    mark[ids[x]] = True
                    mark[-1] = False
                    others = b[a == x]
                    common = np.array([np.count_nonzero(mark[ids[y]]) for y in others])
                    mark[ids[x]] = False
                    # integers decide: common / union >= threshold
                    linked = others[common * (1 + threshold) + 1e-9 >= threshold * (size[x] + size[others])]
                    texts[x] += len(linked)
                    docs[x] += copies[linked].sum()
                    texts[linked] += 1
                    docs[linked] += copies[x]
                    for y in linked:
                        p, q = top(x), top(y)
                        root[max(p, q)] = min(p, q)
            at = np.flatnonzero(texts)
            if len(at):
                key = group.column("key").combine_chunks()
                tops = pa.array([top(x) for x in at])
                yield pa.RecordBatch.from_pydict({"key": key.take(pa.array(at)), "root": key.take(tops), "texts": texts[at], "copies": docs[at]})

    return _in_runs(rows).mapInArrow(run, "key binary, root binary, texts long, copies long")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key that each key of (key, root) edges hangs together with.

    Labels spread along edges and jump to their labels' labels until none changes; every round is a stored table.
    """
    both = stored(edges.select("key", "root").unionByName(edges.select(F.col("root").alias("key"), F.col("key").alias("root"))).distinct(), "edges")
    labels = stored(both.groupBy("key").agg(F.least(F.col("key"), F.min("root")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("key").alias("root"), "label"), "root").groupBy("key").agg(F.min("label").alias("near"))
        spread = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("far"))
        new = stored(spread.join(jump, "next").select("key", F.least("next", "far").alias("new"), "label"), "labels")
        forget(edges.sparkSession, labels)
        if new.where("new != label").isEmpty():
            forget(edges.sparkSession, both)
            return new.select("key", F.col("new").alias("root"))
        labels = new.select("key", F.col("new").alias("label"))


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, n_text_links) for every row of docs (doc_id, text).

    `n_links` counts the other documents of similarity `threshold` or more, copies included; `n_text_links` counts different
    texts among them once each. `class_id` is the smallest doc_id of all that hang together by links.
    """
    least = least_matches(threshold)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seen = stored(sketched(docs, sets=False), "sketches")
    classes = stored(seen.where("size > 0").groupBy("key").agg(F.first("values").alias("values"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("shown")), "classes")
    members = stored(seen.select("doc_id", "key", "size"), "members")
    forget(docs.sparkSession, seen)
    near = stored(_promising(buckets(classes).join(classes.select("key", "values"), "key"), least), "near")
    wanted = near.select("key").distinct()
    # the sets of wanted classes only: the texts are scanned again, one document for each class
    shown = classes.join(wanted, "key", "left_semi").select(F.col("shown.doc_id").alias("id"), F.col("shown.text_hash").alias("hash"))
    texts = docs.join(shown, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).dropDuplicates(["text_hash", "doc_id"])
    sets = sketched(texts.select("text"), sets=True).dropDuplicates(["key"]).select("key", "keys")
    stars = stored(_verified(near.join(classes, "key").join(sets, "key"), least, threshold), "stars")
    forget(docs.sparkSession, near)
    links = stars.groupBy("key").agg(F.sum("texts").alias("texts"), F.sum("copies").alias("copies"))
    groups = components(stars.select("key", "root"))
    sized = classes.select("key", "n", "least_id").join(links, "key", "left").join(groups, "key", "left")
    group_id = sized.where("root is not null").groupBy("root").agg(F.min("least_id").alias("group_id"))
    sized = sized.join(group_id, "root", "left").select("key", "n", "texts", "copies", F.coalesce("group_id", "least_id").alias("class_id"))
    out = members.join(sized, "key", "left")
    return out.select(
        "doc_id",
        F.when(F.col("size") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce(F.col("n") - 1 + F.coalesce("copies", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
    )
