"""Toxicity by weak supervision.

Many voters (given lexicons, patterns, and lexicons of words and word stems that the labelled rows suggest) vote on every
document. A generative label model estimates each voter's accuracy in both classes and the voters' correlations, and turns
vote patterns into posterior labels. A linear classifier over words, stems and votes learns those posteriors, with the labels
as further evidence, and scores all.

Null texts count as empty and get the score of an empty text; null or repeated ids and further columns do no harm; without
any labelled row, the given lexicons and patterns alone carry the label model. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm import textscan as scan
from quantloom.llm.shared import forget, hash_share, stored

#: At most about so many labelled rows train the classifier (a hash sample); all of them suggest lexicon entries.
TRAIN_ROWS = 20_000
#: Word stems are the first so many bytes of a lower-cased word; the last kind is the whole word.
STEMS = (3, 4, 5, 6, 7, None)
#: Suggested entries go to so many voters for each kind.
GROUPS = 4
#: How often a text must hold an entry: each entry takes the one of these numbers that tells most.
TIMES = (1, 2, 3, 5)
#: An entry is suggested when so many distinct toxic texts hold it so often and its log-odds are at least this, or are at least
#: SURE_ODDS when one standard error is taken off.
LEAST_TEXTS, LEAST_ODDS, SURE_ODDS = 4, 4.0, 3.0
#: A word or stem that stands so often in a text is another feature of the classifier.
OFTEN = 3
#: Log-odds that a row's own label adds to its posterior when the classifier is fitted.
LABEL_ODDS = 4.0
#: Hashed features of the classifier.
FEATURES = 1 << 18
#: 64-bit words of the bitmap of labelled ids that is broadcast.
BITMAP = 1 << 19

#: Given lexicons (fixed values): common insults.
LEXICONS = {
    "en_person": "idiot moron loser clown scum fool imbecile jerk bastard dumbass scumbag lowlife".split(),
    "en_quality": "stupid pathetic worthless disgusting trash garbage dumb filthy vile repulsive".split(),
    "fr": "connard idiote imbécile salaud crétin abruti débile ordure minable pathétique".split(),
    "de": "idioten dummkopf arschloch trottel depp abschaum wertlos widerlich erbärmlich schwachkopf".split(),
    "es": "idiotas imbécil estúpido estúpida basura escoria patético asqueroso inútil payaso".split(),
}
#: Bytes of text that are scanned at a time: about forty bytes of memory for each.
PORTION = 1 << 20
# bytes that belong to a bare word, letters in lower case, digits and all of multi-byte characters, stay; others become blanks
_BARE = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def _portions(batches):
    """The texts in portions; after each batch and at the end freed memory goes back, for the worker's next task is another stage's."""
    for batch in batches:
        yield from scan.portions(batch, most=PORTION)
        del batch
        scan.release()


def _salt(kind: int) -> np.uint64:
    return scan.mixed(np.array([kind + 1], np.uint64))[0]


@dataclass
class Words:
    """The bare lower-cased words of some texts: which distinct word stands at each place, in which text, and the hash of the
    stem of each kind of every distinct word."""

    code: np.ndarray
    text: np.ndarray
    stems: list[np.ndarray]

    def distinct(self, kind: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each stem of a kind once for each text, its text, and how often it stands there; with `of`, a mask over the distinct
        words, only their stems. A mask that holds for a word holds for all of the same stem."""
        hashes, stem = np.unique(self.stems[kind], return_inverse=True)
        code, text = self.code, self.text
        if of is not None:
            at = np.flatnonzero(of[code])
            code, text = code[at], text[at]
        keys = np.sort((text.astype(np.int64) << 32) | stem.reshape(-1)[code])
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        return hashes[keys[first] & 0xFFFFFFFF], keys[first] >> 32, np.diff(np.append(first, len(keys)))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of some texts; each distinct word is hashed once."""
    blank = np.frombuffer(data.tobytes().translate(_BARE), np.uint8)
    starts, ends, text = scan.words(blank, offsets)
    inside = blank != 0x20
    cuts = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    # words are the runs of such bytes within a text, so without the other bytes they follow one another
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(blank[inside])]).dictionary_encode()
    once, at = scan.text_bytes(found.dictionary)
    stems = [hashes ^ _salt(k) for k, hashes in enumerate(scan.prefix_hashes(once, at, STEMS))]
    return Words(found.indices.to_numpy(), text, stems)


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each kind of stem the hashes of all bare lower-cased words, and the words' texts."""
    found = words_of(data, offsets)
    return [hashes[found.code] for hashes in found.stems], found.text


def _given() -> list[np.ndarray]:
    out = []
    for given in LEXICONS.values():
        data, offsets = scan.text_bytes(pa.array([" ".join(given)]))
        out.append(np.sort(entries(data, offsets)[0][-1]))
    return out


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


@dataclass
class Voters:
    """Lexicon voters (kind of entry, sorted hashes, how often a text must hold each) followed by pattern voters."""

    lexicons: list[tuple[int, np.ndarray, np.ndarray]]

    PATTERNS = 3

    def __len__(self) -> int:
        return len(self.lexicons) + self.PATTERNS

    def votes(self, data: np.ndarray, offsets: np.ndarray, found: Words) -> np.ndarray:
        """(texts, voters) matrix of yes votes."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self)), bool)
        for kind in {kind for kind, _, _ in self.lexicons}:
            own = [(j, keys, least) for j, (of, keys, least) in enumerate(self.lexicons) if of == kind and len(keys)]
            # few words are listed at all, so every lexicon of the kind looks only at those
            listed = _member(np.unique(np.concatenate([keys for _, keys, _ in own])), found.stems[kind]) if own else np.zeros(0, bool)
            at = np.flatnonzero(listed[found.code]) if listed.any() else np.zeros(0, np.int64)
            text, stem = found.text[at], found.stems[kind][found.code[at]]
            for j, keys, least in own if len(at) else ():
                mine = _member(keys, stem)
                which, times = np.unique(text[mine] * len(keys) + np.searchsorted(keys, stem[mine]), return_counts=True)
                out[which[times >= least[which % len(keys)]] // len(keys), j] = True
        size = np.maximum(np.diff(offsets), 1)
        upper, shout = (data >= 65) & (data <= 90), (data == 33) | (data == 63)
        letters = np.maximum(scan.per_text(upper | ((data >= 97) & (data <= 122)), offsets), 1)
        out[:, -3] = scan.per_text(shout, offsets) / size > 0.02
        out[:, -2] = scan.per_text(upper, offsets) / letters > 0.5
        double = np.concatenate(([False], (data[1:] == data[:-1]) & shout[1:])) if len(data) else np.zeros(0, bool)
        out[:, -1] = scan.per_text(double, offsets) > 0
        return out


def suggest(sample: DataFrame) -> Voters:
    """Voters from the given lexicons and from entries over-represented in the labelled toxic texts (label column `toxic`)."""

    def partial(batches):
        for batch in _portions(batches):
            data, offsets = scan.text_bytes(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            found = words_of(data, offsets)
            for kind in range(len(STEMS)):
                keys, of, times = found.distinct(kind)
                keys, where = np.unique(keys, return_inverse=True)
                for least in TIMES:
                    often = times >= least
                    n = np.bincount(where[often], minlength=len(keys))
                    bad = np.bincount(where[often], weights=toxic[of[often]], minlength=len(keys)).astype(np.int64)
                    held = n > 0
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * held.sum(), pa.int32()), "least": pa.array([least] * held.sum(), pa.int32()), "key": keys[held].astype(np.int64), "bad": bad[held], "good": (n - bad)[held]})

    counts = sample.select("text", "toxic").mapInArrow(partial, "kind int, least int, key long, bad long, good long").groupBy("kind", "key", "least").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    size = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("all_bad"), F.count(F.lit(1)).alias("size")).first()
    all_bad, all_good = size.all_bad, size.size - size.all_bad
    odds = F.log((F.col("bad") + 0.5) / (all_bad + 1)) - F.log((F.col("good") + 0.5) / (all_good + 1))
    sure = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strong = counts.withColumn("sure", sure).where((F.col("bad") >= LEAST_TEXTS) & ((odds >= LEAST_ODDS) | (F.col("sure") >= SURE_ODDS)))
    strong = stored(strong.groupBy("kind", "key").agg(F.max(F.struct("sure", (-F.col("least")).alias("least")))["least"].alias("least")), "entries")
    lexicons = [(len(STEMS) - 1, keys, np.ones(len(keys), np.int64)) for keys in _given()]
    for kind in range(len(STEMS)):
        got = strong.where(F.col("kind") == kind).select("key", "least").toArrow()
        keys, least = got.column("key").to_numpy().astype(np.uint64), -got.column("least").to_numpy().astype(np.int64)
        group, by_key = scan.mixed(keys) % np.uint64(GROUPS), np.argsort(keys)
        for g in range(GROUPS):
            own = by_key[group[by_key] == g]
            lexicons.append((kind, keys[own], least[own]))
    forget(sample.sparkSession, strong)
    return Voters(lexicons)


# --- generative label model ---------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Share of toxic documents, each voter's yes rate among toxic and clean ones, and its weight after correlations."""

    share: float
    rate: np.ndarray  # (2, voters): clean, toxic
    weight: np.ndarray

    def linear(self) -> tuple[float, np.ndarray]:
        """The posterior's log-odds: what they are without any yes, and what each yes adds."""
        p = np.clip(self.rate, 1e-4, 1 - 1e-4)
        yes, no = np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0]))
        return float(np.log(self.share / (1 - self.share)) + no @ self.weight), (yes - no) * self.weight

    def posterior(self, votes: np.ndarray, more: np.ndarray | float = 0.0) -> np.ndarray:
        """`more` is what is known besides the votes, in log-odds."""
        bias, add = self.linear()
        return 1 / (1 + np.exp(-np.clip(bias + votes @ add + more, -40, 40)))


def fit_label_model(votes: np.ndarray, count: np.ndarray, start: np.ndarray, rounds: int = 40) -> LabelModel:
    """EM over vote patterns and their counts. `start` holds a first posterior for each pattern.

    A voter's weight is one over one plus its positive correlations with the others within the classes, so that voters which
    repeat each other count as one.
    """
    n, post = count.sum(), start
    weight = np.ones(votes.shape[1])
    model = None
    for _ in range(rounds):
        own = np.stack((count * (1 - post), count * post))
        mass = own.sum(1)
        share = float(np.clip(mass[1] / n, 1e-4, 0.5))
        rate = (own @ votes + np.array([[0.01], [0.5]])) / (mass[:, None] + 1)
        spread = np.zeros((votes.shape[1],) * 2)
        for c in (0, 1):
            off = votes - rate[c]
            spread += (off * own[c][:, None]).T @ off / n
        sd = np.sqrt(np.diag(spread))
        both = sd * sd[:, None] * (votes.any(0) & votes.any(0)[:, None])  # a voter that never votes goes with none
        together = np.clip(np.divide(spread, both, out=np.zeros_like(spread), where=both > 0), 0, 1)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + together.sum(1))
        model = LabelModel(share, rate, weight)
        new = model.posterior(votes)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def _bits(votes: np.ndarray) -> np.ndarray:
    return votes @ (1 << np.arange(votes.shape[1], dtype=np.int64))


def label_model(texts: DataFrame, labelled: DataFrame, voters: Voters) -> LabelModel:
    """Fitted to the vote patterns of all `texts`, counted by Spark; the labelled sample's patterns give the start."""
    shared = texts.sparkSession.sparkContext.broadcast(voters)

    def vote(batches):
        for batch in _portions(batches):
            data, offsets = scan.text_bytes(batch.column("text"))
            got = _bits(shared.value.votes(data, offsets, words_of(data, offsets)))
            yield pa.RecordBatch.from_pydict({"pattern": got, "toxic": batch.column("toxic")})

    def patterns(df: DataFrame) -> DataFrame:
        return df.mapInArrow(vote, "pattern long, toxic int")

    # as many patterns as voters' subsets at most, and in practice few: see the README for the bound
    seen = patterns(texts.select("text", F.lit(0).alias("toxic"))).groupBy("pattern").count().toPandas()
    known = patterns(labelled.select("text", F.col("toxic").cast("int"))).groupBy("pattern").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("size")).toPandas()
    rows = seen.merge(known, on="pattern", how="left").fillna({"bad": 0, "size": 0}).sort_values("pattern")
    votes = (rows["pattern"].to_numpy(np.int64)[:, None] >> np.arange(len(voters)) & 1).astype(float)
    base = (known["bad"].sum() + 1) / (known["size"].sum() + 10)
    hint = np.where(votes[:, : len(voters) - voters.PATTERNS].any(1), 0.5, base / 2)
    start = (rows["bad"].to_numpy(float) + 2 * hint) / (rows["size"].to_numpy(float) + 2)
    if not len(rows):
        return LabelModel(0.1, np.full((2, len(voters)), 0.1), np.ones(len(voters)))
    return fit_label_model(votes, rows["count"].to_numpy(float), start)


# --- classifier ---------------------------------------------------------------------------------------------------------


def _features(data: np.ndarray, offsets: np.ndarray, voters: Voters, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vote matrix, and hashed distinct features with their texts; with `wanted`, a mask over features, at least the wanted ones."""
    found = words_of(data, offsets)
    votes = voters.votes(data, offsets, found)
    of = [None if wanted is None else wanted[k % np.uint64(FEATURES)] | wanted[scan.mixed(k) % np.uint64(FEATURES)] for k in found.stems]
    parts = [found.distinct(kind, of[kind]) for kind in range(len(STEMS))]
    parts += [(scan.mixed(k[n >= OFTEN]), t[n >= OFTEN], n) for k, t, n in parts]
    keys, text = np.concatenate([k for k, _, _ in parts]), np.concatenate([t for _, t, _ in parts])
    return votes, (keys % np.uint64(FEATURES)).astype(np.int64), text


@dataclass
class Classifier:
    voters: Voters
    bias: float
    vote_weight: np.ndarray
    weight: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        # features without weight add nothing, so their words are not counted
        votes, feature, text = _features(data, offsets, self.voters, self.weight != 0)
        logit = self.bias + votes @ self.vote_weight + np.bincount(text, weights=self.weight[feature], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(sample: DataFrame, voters: Voters, labels: LabelModel, rounds: int = 20, rate: float = 0.5, shrink: float = 2e-3) -> Classifier:
    """Logistic regression on the posterior labels of the sample: distributed gradients, summed by Spark, with AdaGrad steps.

    Proximal steps drop features that do not pay for themselves; each round is one Spark job over the bounded sample.
    """
    spark = sample.sparkSession
    tools = spark.sparkContext.broadcast((voters, labels))

    def encode(batches):
        for batch in _portions(batches):
            data, offsets = scan.text_bytes(batch.column("text"))
            votes, feature, text = _features(data, offsets, tools.value[0])
            own = LABEL_ODDS * (2.0 * batch.column("toxic").to_numpy(zero_copy_only=False) - 1)
            order = np.argsort(text, kind="stable")
            ends = np.cumsum(np.bincount(text, minlength=len(offsets) - 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(feature[order].astype(np.int32)))
            yield pa.RecordBatch.from_pydict({"feature": lists, "votes": _bits(votes), "label": tools.value[1].posterior(votes.astype(float), own)})

    rows = stored(sample.select("text", "toxic").mapInArrow(encode, "feature array<int>, votes long, label double"), "features")
    size = max(rows.count(), 1)
    dims = FEATURES + len(voters) + 1
    model, square = np.zeros(dims), np.full(dims, 1e-4)  # so that rare features take small steps
    # half of what the label model gives to votes is given, so that words and stems have the other half to explain
    model[-1], add = labels.linear()
    model[FEATURES:-1] = add / 2
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model.astype(np.float32))

        def gradient(batches, now=now):
            slope, some = np.zeros(dims), False
            for batch in batches:
                lists = batch.column("feature")
                feature = lists.flatten().to_numpy()
                text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                votes = (batch.column("votes").to_numpy()[:, None] >> np.arange(len(tools.value[0])) & 1).astype(float)
                w = now.value
                logit = w[-1] + votes @ w[FEATURES:-1] + np.bincount(text, weights=w[feature], minlength=len(lists))
                off = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - batch.column("label").to_numpy()
                slope += np.concatenate((np.bincount(feature, weights=off[text], minlength=FEATURES), off @ votes, [off.sum()]))
                some = True
            at = np.flatnonzero(slope)
            if some:
                yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "slope": slope[at]})

        got = rows.mapInArrow(gradient, "at int, slope double").groupBy("at").agg(F.sum("slope").alias("slope")).toArrow()
        slope = np.zeros(dims)
        slope[got.column("at").to_numpy()] = got.column("slope").to_numpy() / size
        now.destroy()
        square += slope**2
        step = rate / np.sqrt(square)
        model = model - step * slope
        model[:FEATURES] = np.sign(model[:FEATURES]) * np.maximum(np.abs(model[:FEATURES]) - step[:FEATURES] * shrink, 0)
    forget(spark, rows)
    return Classifier(voters, float(model[-1]), model[FEATURES:-1], model[:FEATURES])


def maybe_labelled(docs: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of `docs` whose id has its bit in a bitmap of the ids of `allowed`: all that `allowed` holds and few others.

    So an exact join with `allowed` shuffles few other texts. The bitmap has BITMAP words at most, however many labels there are.
    """
    if docs.schema["doc_id"].dataType != allowed.schema["doc_id"].dataType:  # equal ids of two types have unequal hashes
        return docs
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(64 * BITMAP))
    words = allowed.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    at = docs.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6))
    return at.join(F.broadcast(words), "word").where("(shiftrightunsigned(bits, cast(bit & 63 as int)) & 1) = 1").select(*docs.columns)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Classifier:
    """`labels` (doc_id, toxic) are read only for documents where `may_learn` (over doc_id) holds."""
    allowed = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # of contradicting labels of equal texts the toxic one counts, whatever the order of the rows
    known = maybe_labelled(docs.select("doc_id", "text"), allowed).join(allowed, "doc_id").groupBy(F.xxhash64("text").alias("hash"), "text").agg(F.max("toxic").alias("toxic"))
    known = stored(known.select("text", "toxic"), "labelled")
    voters = suggest(known)
    model = label_model(docs.select("text"), known, voters)
    share = min(1.0, TRAIN_ROWS / max(known.count(), 1))
    fitted = fit(known.where(hash_share(F.xxhash64("text"), share)), voters, model)
    forget(docs.sparkSession, known)
    return fitted


def score(docs: DataFrame, model: Classifier, *carry: str) -> DataFrame:
    """The `carry` columns with `score`, the probability that the whole text is toxic; a carried `score` gives way to it."""
    carry = tuple(c for c in carry if c != "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in _portions(batches):
            data, offsets = scan.text_bytes(batch.column("text"))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in carry} | {"score": shared.value.score(data, offsets)})

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry] + ["score double"])
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)
