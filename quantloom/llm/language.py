"""Language identification by nearest centroid.

Texts become TF-IDF vectors of hashed byte n-grams (lower-cased letters only), normalised to length one. Each language has
several centroids, found by spherical k-means; a text takes the language of the most similar centroid by cosine, and is
rejected when it is farther from it than nearly all that the centroid was made of.

A text without any letter, or null, has no language (`und`). Rows without a language teach nothing. Repeated rows and null
ids are fine, without learned languages all is `und`, an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm import textscan as scan
from quantloom.llm.shared import hash_share, stored

#: Hashed n-gram features, and the n-gram lengths in bytes.
FEATURES, GRAMS = 4096, (2, 3)
#: Centroids of a language, k-means rounds, and about how many texts of a language the centroids are made of.
CENTROIDS, ROUNDS, TRAIN_ROWS = 4, 8, 2_000
#: Share of a centroid's own texts that are nearer to it than its rejection distance.
REACH = 0.999
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) counts of hashed n-grams within and at the edges of words."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES), np.float32)
    letters = _FOLD[data]
    for k in GRAMS:
        if len(letters) < k:
            continue
        # over all texts at once; n-grams that cross into the next text are left out
        key = np.zeros(len(letters) - k + 1, np.uint32)
        for i in range(k):
            key = key * np.uint32(257) + letters[i : len(letters) - k + 1 + i]
        key = (key * np.uint32(2654435761) + np.uint32(k)) >> np.uint32(20)
        blank = (letters[: len(key)] == 0x20) & (letters[k - 1 :] == 0x20)
        for t in range(n):
            a, b = offsets[t], offsets[t + 1] - k + 1
            if b > a:
                out[t] += np.bincount(key[a:b][~blank[a:b]], minlength=FEATURES)
    return out


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    reach: np.ndarray  # least cosine of each centroid's own texts

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return vectors(data, offsets, self.idf)

    def nearest(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the most similar centroid, the cosine, and whether the text is too far from it."""
        cosine = self.vectors(data, offsets) @ self.centroids.T
        best = cosine.argmax(1)
        top = cosine[np.arange(len(best)), best]
        return best, top, top < self.reach[best]


def vectors(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return normal(np.log1p(counts(data, offsets)) * idf)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Number of texts, and of texts that hold each feature: over all rows, FEATURES + 1 sums."""

    def partial(batches):
        seen = np.zeros(FEATURES + 1, np.int64)
        for batch in (p for b in batches for p in scan.portions(b, most=1 << 20)):
            for part in (batch.slice(a, 1024) for a in range(0, batch.num_rows, 1024)):
                seen[:-1] += (counts(*scan.text_bytes(part.column("text"))) > 0).sum(0)
                seen[-1] += part.num_rows
        yield pa.RecordBatch.from_pydict({"feature": pa.array(np.arange(FEATURES + 1), pa.int32()), "n": seen})

    rows = texts.mapInArrow(partial, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES + 1)
    out[rows["feature"].to_numpy(np.int64)] = rows["n"]
    return out


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the centroid of each row. Begins with rows far from each other."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centre = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centre.T).argmax(1)
        centre = normal(np.stack([x[own == c].sum(0) if (own == c).any() else centre[c] for c in range(len(centre))]))
    return centre, (x @ centre.T).argmax(1)


def train(docs: DataFrame) -> Model:
    """Learns from rows (doc_id, text, lang). IDF covers all of them; centroids are made of a hash sample of each language."""
    docs = docs.where("lang is not null").select("doc_id", "text", "lang")
    seen = document_frequencies(docs.select(F.lower("text").alias("text")))
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    sizes = docs.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / F.col("count"))
    keyed = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(1_000_000)) < share * 1_000_000
    sample = docs.join(F.broadcast(sizes), "lang").where(keyed).select("lang", F.lower("text").alias("text"))  # about TRAIN_ROWS of each; sizes is a row a language

    def made(group: pa.Table) -> pa.Table:
        lang = group.column("lang")[0].as_py()
        group = group.sort_by("text").combine_chunks()  # the same order in every run
        parts = [vectors(*scan.text_bytes(p.column("text")), idf).astype(np.float32) for b in group.to_batches() for p in scan.portions(b)]
        x = np.concatenate(parts)
        x = x[(x != 0).any(1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.list_(pa.float32())), "reach": pa.array([], pa.float64())})
        centre, own = _clusters(x, CENTROIDS)
        reach = [float(np.quantile(x[own == c] @ centre[c], 1 - REACH)) if (own == c).any() else 1.0 for c in range(len(centre))]
        return pa.table({"lang": pa.array([lang] * len(centre), pa.string()), "centroid": pa.array(list(centre), pa.list_(pa.float32())), "reach": reach})

    rows = stored(sample.groupBy("lang").applyInArrow(made, "lang string, centroid array<float>, reach double"), "centroids").toPandas().sort_values(["lang", "reach"])
    centroids = np.stack([np.asarray(c, np.float32) for c in rows["centroid"]]) if len(rows) else np.zeros((0, FEATURES), np.float32)
    return Model(idf, rows["lang"].tolist(), centroids, rows["reach"].to_numpy(float))


def predict(docs: DataFrame, model: Model, *carry: str) -> DataFrame:
    """The `carry` columns with `lang_pred`, `score` (cosine) and `rejected` for each whole text; a carried column named like one of
    these gives way to it."""
    carry = tuple(c for c in carry if c not in ("lang_pred", "score", "rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches):
        m = shared.value
        for batch in (p for b in batches for q in scan.portions(b, most=1 << 20) for p in (q.slice(a, 1024) for a in range(0, q.num_rows, 1024))):
            has = batch.column("has_letter").to_numpy(zero_copy_only=False)
            if len(m.langs):
                best, top, far = m.nearest(*scan.text_bytes(batch.column("text")))
            else:
                best, top, far, has = *[np.zeros(batch.num_rows, int)] * 2, np.ones(batch.num_rows, bool), np.zeros(batch.num_rows, bool)
            lang = pa.array([m.langs[b] if h else UNKNOWN for b, h in zip(best, has)], pa.string())
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"lang_pred": lang, "score": np.where(has, np.clip(top, 0, 1), 0.0).astype(float), "rejected": far | ~has})

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["lang_pred string, score double, rejected boolean"])
    kept = [F.col(c) for c in carry if c != "text"]
    return docs.select(*kept, F.lower(F.col("text")).alias("text"), letter.alias("has_letter")).mapInArrow(run, schema)
