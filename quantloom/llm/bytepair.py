"""Byte-level BPE encoding and decoding by relational contraction.

`encode` cuts texts into pieces by the vocabulary's pattern. A piece that is a token is that token. Every other distinct
piece becomes (word, pos, tok) rows, one for each byte, in an in-process DuckDB of the task: a recursive query joins adjacent
rows with the merge table, finds each word's pair of least rank, the leftmost of equals, and contracts it, until no pair is
left. `decode` joins ids with the vocabulary and puts their bytes together by an ordered aggregation.

A null text is an empty one, which has no tokens; repeated rows give repeated rows, an empty table an empty one, further
columns are ignored. Texts are cut only where every match of the pattern ends, so a text may have any length; ids and bytes of
one text must fit in memory. Pieces of up to LONG bytes contract a pair a round. Longer ones contract all pairs of the least
rank at once wherever that is provably the same; the time of one such piece grows with its length times the number of ranks
that it uses. Distinct pieces and their ids are kept by the worker for later texts; beyond KNOWN of them, and beyond RESTING
after a partition, only those that came again.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructType

from quantloom.llm.textscan import portions, release

#: Bytes above which a piece contracts equal pairs together.
LONG = 64
#: Distinct pieces that a worker remembers before it drops those that came in one portion only, and so many between partitions.
KNOWN, RESTING = 200_000, 100_000
#: Characters of a text that are cut into pieces at a time.
CHARS = 1 << 20
#: Bytes of text that are encoded, and token ids that are decoded, by one query.
PORTION, IDS = 1 << 20, 1 << 18
#: Portions whose new pieces are contracted together, and bytes of pieces that one query starts with.
TOGETHER, ROWS = 8, 1 << 18

# A row's place is its word's number and its position, so one order serves all words. A pair's key has its rank above its
# position, so the least key is the leftmost pair of least rank.
_SHORT = """
WITH RECURSIVE state(place, tok, done) AS (
  SELECT word::BIGINT << 32 | pos, tok, false FROM start
  UNION ALL
  SELECT place, tok, done FROM (
    WITH pairs AS MATERIALIZED (
      SELECT place, tok, lead(tok) OVER next AS next_tok, lead(place) OVER next AS next_place, lag(place) OVER next AS before
      FROM state WHERE NOT done WINDOW next AS (ORDER BY place)),
    best AS (
      SELECT place >> 32 AS word, min(id::BIGINT << 32 | (place & 4294967295)) AS least
      FROM pairs JOIN merges ON (tok::BIGINT << 32 | next_tok) = pair AND place >> 32 = next_place >> 32 GROUP BY place >> 32)
    SELECT place, CASE WHEN place & 4294967295 = least & 4294967295 THEN (least >> 32)::INTEGER ELSE tok END AS tok, least IS NULL AS done
    FROM pairs LEFT JOIN best ON place >> 32 = word
    WHERE least IS NULL OR before IS DISTINCT FROM (word << 32 | (least & 4294967295))))
SELECT (place >> 32)::INTEGER AS word, list(tok ORDER BY place) AS ids FROM state WHERE done GROUP BY place >> 32 ORDER BY word
"""

# Of pairs of the least rank in a row, the first, third, ... are contracted, since each uses up the next one's left token. Where
# the new token could form a pair of a lower rank, only the first of the word is.
_LONG = """
WITH RECURSIVE state(word, pos, tok, done) AS (
  SELECT word, pos, tok, false FROM start
  UNION ALL
  SELECT word, pos, tok, done FROM (
    WITH live AS (SELECT word, pos, tok FROM state WHERE NOT done),
    pairs AS (
      SELECT word, pos, tok, lead(pos) OVER next AS next_pos, lead(tok) OVER next AS next_tok, row_number() OVER next AS k
      FROM live WINDOW next AS (PARTITION BY word ORDER BY pos)),
    hits AS (SELECT word, pos, next_pos, k, id, safe FROM pairs JOIN merges ON (tok::BIGINT << 32 | next_tok) = pair),
    least AS (SELECT word, min(id) AS id FROM hits GROUP BY word),
    equal AS (
      SELECT hits.*, row_number() OVER (PARTITION BY hits.word ORDER BY k) AS n FROM hits JOIN least ON hits.word = least.word AND hits.id = least.id),
    best AS (
      SELECT word, pos, next_pos, id FROM equal
      QUALIFY CASE WHEN safe THEN row_number() OVER (PARTITION BY word, k - n ORDER BY k) % 2 = 1 ELSE n = 1 END)
    SELECT live.word, live.pos, coalesce(best.id, live.tok) AS tok, least.word IS NULL AS done
    FROM live LEFT JOIN least ON live.word = least.word LEFT JOIN best ON live.word = best.word AND live.pos = best.pos
    WHERE NOT EXISTS (SELECT 1 FROM best AS b WHERE b.word = live.word AND b.next_pos = live.pos)))
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE done GROUP BY word ORDER BY word
"""

_DECODE = """
SELECT text, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocabulary ON tok = id GROUP BY text ORDER BY text
"""


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ranks, which are their ids too, and the pattern that cuts a text before bytes are merged."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a file of lines: a token in base64, its rank. It is read once, on the driver; tasks get the tokens."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    @cached_property
    def key(self) -> str:
        """Tells vocabularies apart."""
        digest = hashlib.sha256(self.pattern.encode())
        for token, rank in self.ranks.items():
            digest.update(b"%d:%d:" % (rank, len(token)) + token)
        return digest.hexdigest()

    def merges(self) -> pa.Table:
        """(pair, id, safe): every pair of tokens that joins to a token, left << 32 | right. It is safe if that token forms none of a lower rank."""
        found = [(left, right, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        left, right, made = np.array(found, np.int32).reshape(-1, 3).T
        unsafe = np.union1d(left[made <= left], right[made <= right])
        return pa.table({"pair": left.astype(np.int64) << 32 | right, "id": made, "safe": ~np.isin(made, unsafe)})


def _strings(pieces: list[str]) -> pa.Array:
    """The pieces as an Arrow column, encoded all at once."""
    text, cuts = "".join(pieces), np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)), out=cuts[1:])
    raw = text.encode()
    if len(raw) > len(text):  # from characters to bytes
        data = np.frombuffer(raw, np.uint8)
        cuts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[cuts]
    return pa.LargeStringArray.from_buffers(len(pieces), pa.py_buffer(cuts), pa.py_buffer(raw))


class _Coder:
    """The vocabulary as tables of an in-process database, and the ids of the pieces met so far."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import regex

        self.ranks, self.find = vocabulary.ranks, regex.compile(vocabulary.pattern).findall
        self.gap = regex.compile(r"(?<=\S)(?=\s)")
        self.base = duckdb.connect()
        self.base.execute("SET threads = 1; SET temp_directory = ''; SET memory_limit = '200MB'")
        self._table("merges", vocabulary.merges())
        self._table("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [token.hex() for token in self.ranks]}))
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.forget()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.base.register("given", rows)
        self.base.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def _run(self, query: str, name: str, rows: pa.Table) -> pa.Table:
        self.base.register(name, rows)
        found = self.base.sql(query).to_arrow_table().combine_chunks()
        self.base.unregister(name)
        return found

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.waiting: list[str] = []
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)  # portions that held the piece, those of earlier rounds for half

    def slim(self, most: int) -> None:
        """Beyond `most` pieces, forgets those met in one portion only; if more than half of `most` are left, the least met too."""
        if len(self.number) <= most:
            return
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > most // 2:
            kept = np.sort(kept[np.argsort(-self.met[kept], kind="stable")[: most // 2]])
        pieces, begins = list(self.number), np.cumsum(self.size) - self.size
        self.number = {pieces[k]: n for n, k in enumerate(kept.tolist())}
        size = self.size[kept]
        self.ids = self.ids[np.repeat(begins[kept] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.size, self.met = size, self.met[kept] >> 1

    def pieces(self, text: str) -> list[str]:
        """All matches; a long text is cut between a character and white space after it, where every match ends."""
        out, at = [], 0
        while len(text) - at > CHARS:
            cut = self.gap.search(text, at + CHARS)
            if cut is None:
                break
            out += self.find(text, at, cut.start())
            at = cut.start()
        return out + self.find(text, at)

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces, and where each text's begin and end; pieces never met before wait to be learned."""
        found = [self.pieces(text) if text else [] for text in texts]
        ends = np.cumsum([0, *map(len, found)])
        every = _strings(list(chain.from_iterable(found))).dictionary_encode()
        once = every.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [piece for piece in once if piece not in self.number]
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.waiting += new
        return np.fromiter(map(self.number.__getitem__, once), np.int32, len(once))[every.indices.to_numpy()], ends

    def learn(self) -> None:
        """Ids of the pieces that wait: the rank of the whole piece, or what contraction leaves of its bytes."""
        raw = [piece.encode() for piece in self.waiting]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = np.fromiter((self.ranks.get(piece, -1) for piece in raw), np.int32, len(raw))
        whole_at = np.flatnonzero(whole >= 0)
        counts, owners, made = np.ones(len(raw), np.int64), [whole_at], [whole[whole_at]]
        for query, chosen in ((_SHORT, length <= LONG), (_LONG, length > LONG)):
            wanted = np.flatnonzero(chosen & (whole < 0))
            wanted = wanted[np.argsort(length[wanted], kind="stable")]  # so that few queries go through the rounds of long pieces
            sizes = length[wanted]
            slices = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // ROWS)) + 1
            for first, last in zip([0, *slices.tolist()], [*slices.tolist(), len(wanted)]):
                at = np.sort(wanted[first:last])
                size = length[at]
                if not len(at):
                    continue
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                start = pa.table({"word": np.repeat(at.astype(np.int32), size), "pos": pos.astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint8)]})
                found = self._run(query, "start", start).column("ids").chunk(0)  # a row for each of `at`, in its order
                counts[at] = np.diff(found.offsets.to_numpy())
                owners.append(np.repeat(at, counts[at]))
                made.append(found.flatten().to_numpy())
        self.size = np.concatenate([self.size, counts])
        self.ids = np.concatenate([self.ids, np.concatenate(made)[np.argsort(np.concatenate(owners), kind="stable")]])
        self.waiting = []

    def encode(self, portions: list[list[str | None]]) -> Iterator[pa.Array]:
        """For each portion of texts a list of ids for each text."""
        self.slim(KNOWN)
        found = [self.numbered(texts) for texts in portions]
        if self.waiting:
            self.learn()
        self.met = np.concatenate([self.met, np.zeros(len(self.number) - len(self.met), np.int32)])
        for codes, _ in found:
            self.met[codes] += 1  # numpy adds one to each distinct code
        sizes, every = self.size, self.ids
        begins = np.cumsum(sizes) - sizes
        for codes, ends in found:
            size = sizes[codes]
            stop = np.cumsum(size)
            ids = every[np.repeat(begins[codes] - (stop - size), size) + np.arange(int(size.sum()))]
            offsets = np.concatenate(([0], stop))[ends]
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        size = np.diff(offsets)
        rows = pa.table({"text": np.repeat(np.arange(len(size)), size), "pos": np.arange(int(size.sum())), "tok": flat[offsets[0] : offsets[-1]]})
        out = [b""] * len(size)
        found = self._run(_DECODE, "ids", rows)
        for text, digits in zip(found.column("text").to_pylist(), found.column("hex").to_pylist()):
            out[text] = bytes.fromhex(digits)
        return out


_CODERS: dict[str, _Coder] = {}


def _coder(vocabulary: Vocabulary) -> _Coder:
    """The worker's coder of a vocabulary, made once; a worker keeps only the last vocabulary's."""
    if vocabulary.key not in _CODERS:
        _CODERS.clear()
        _CODERS[vocabulary.key] = _Coder(vocabulary)
    return _CODERS[vocabulary.key]


def _mapped(df: DataFrame, source: str, result: str, kind, run, carry: tuple[str, ...]) -> DataFrame:
    """`run` over batches of column `source`, which gives column `result`; carried columns may have any names."""
    inner = [f"c{k}" for k in range(len(carry))]
    rows = df.select(*(F.col(c).alias(i) for c, i in zip(carry, inner)), F.col(source).alias("value"))
    schema = StructType([f for f in rows.schema.fields if f.name != "value"]).add("made", kind)
    made = rows.mapInArrow(run, schema)
    return made.select(*(F.col(i).alias(c) for c, i in zip(carry, inner)), F.col("made").alias(result))


def _with(batch: pa.RecordBatch, made: pa.Array) -> pa.RecordBatch:
    """The carried columns of a batch with the column made of its last one."""
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "made"])


def encode(docs: DataFrame, vocabulary: Vocabulary, *carry: str) -> DataFrame:
    """(carry, ids): the token ids of every whole text, without special tokens."""

    def run(batches):
        parts = (part for batch in batches for part in portions(batch, "value", PORTION))
        while some := list(islice(parts, TOGETHER)):
            for part, ids in zip(some, _coder(vocabulary).encode([part.column("value").to_pylist() for part in some])):
                yield _with(part, ids)
            release()
        _coder(vocabulary).slim(RESTING)
        release()

    return _mapped(docs, "text", "ids", ArrayType(IntegerType()), run, carry)


def decode(tokens: DataFrame, vocabulary: Vocabulary, *carry: str) -> DataFrame:
    """(carry, bytes): the bytes of every row's `ids`; null ids are none. An id that the vocabulary lacks has no bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            size = np.asarray(lists.value_lengths().fill_null(0))
            part = (np.cumsum(size) - size) // IDS
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                plain = pa.array([x or [] for x in piece.column("value").to_pylist()], pa.list_(pa.int32())) if lists.null_count else piece.column("value")
                yield _with(piece, pa.array(_coder(vocabulary).decode(plain), pa.binary()))
            release()

    return _mapped(tokens, "ids", "bytes", BinaryType(), run, carry)
