"""Spelling variants: words that differ by one inserted, deleted or replaced character, found by a frontier over tries.

Words of one length make a trie, and their reversals another one. Both lie in a distributed table of edges: an edge goes from a
node by a first character and a few following ones (`stride`) to a node further down. A state is (word, position, node,
edits). The states without edits of a word are its own prefixes, so all of them enter the frontier at once; each joins the edges
of its node, with a first character that is not the word's (replaced, in the trie of its length) or that stands before
the word's next one (inserted, in the trie of words one longer), and has one edit afterwards. A state with an edit follows the
edge that spells the rest. Level by level the frontier joins the edges again, and a state that reaches the end of its trie is a
pair of neighbours. A deletion is an insertion seen from the other word.

An edit in the second half of a word is found in the trie of words, one in the first half in that of reversals, so no state
starts near a root, where most edges lie. Edges and states meet by a hash of (trie, prefix, following characters), which
splits the nodes that very many words pass; every pair is checked by a join with the words, so chance hits of the hash count for nothing.

`words` has (word, n); null words are left out, rows of equal words are added up (a null n adds nothing), an empty table gives an
empty result, further columns are ignored. Words may have any length: the levels are three at most, as the stride grows with
the length; a word of L characters has about L edges with prefixes of up to L characters to hash. Ties between forms of equal n go to the
smallest in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.shared import forget, stored


def _stride(length: Column) -> Column:
    """Characters that an edge of the trie of this length spells: 3, or a sixth of a long word."""
    return F.greatest(F.lit(3), F.ceil(length / 6).cast("int"))


def _node(backward: Column, length: Column, prefix: Column) -> Column:
    return F.xxhash64(backward, length, prefix)


def _texts(words: DataFrame) -> DataFrame:
    """Each word forwards and backwards."""
    both = F.array(F.struct(F.lit(False).alias("backward"), F.col("word").alias("text")), F.struct(F.lit(True).alias("backward"), F.reverse("word").alias("text")))
    return words.select("n", F.inline(both)).withColumn("size", F.char_length("text"))


def edges(words: DataFrame) -> DataFrame:
    """(key, first, child, hop): the edges of all tries from the depths where states can stand.

    `key` tells the node and the characters after the first; states meet an edge at their level `hop` at the latest.
    """
    size, stride, depth = F.col("size"), F.col("stride"), F.col("depth")
    start = F.when(F.col("backward"), size - F.floor(size / 2)).otherwise(F.floor((size - 1) / 2)).cast("int")
    rows = _texts(words).where(size > 0).withColumn("stride", _stride(size)).withColumn("start", start)
    rows = rows.where(F.col("start") < size).select("*", F.explode(F.sequence("start", size - 1)).alias("depth"))
    node = _node(F.col("backward"), size, F.left("text", depth))
    key = F.xxhash64(node, F.substr("text", depth + 2, stride - 1))
    child = _node(F.col("backward"), size, F.left("text", depth + stride))
    hop = F.floor((depth - F.col("start")) / stride).cast("int")
    return rows.select(key.alias("key"), F.substr("text", depth + 1, F.lit(1)).alias("first"), child.alias("child"), hop.alias("hop")).distinct()


def _without_edits(words: DataFrame) -> DataFrame:
    """(n, backward, text, at, replaced, key): the states without an edit from which one can be made, with the key of the edges
    that it would follow. What follows from these columns is left to `_edited`, so that the shuffle of the states stays small.
    """
    size, half, at, back = F.col("size"), F.col("half"), F.col("at"), F.col("backward")
    rows = _texts(words).withColumn("half", F.floor(size / 2).cast("int"))
    first = F.when(back, size - half).otherwise(half)
    # positions of replaced characters: from `first` to the last one; of inserted ones: up to the end of the word
    rows = rows.withColumn("first_at", first).select("*", F.explode(F.sequence("first_at", size)).alias("at"))
    inserted = F.struct(F.lit(False).alias("replaced"), (size + 1).alias("length"), (at + 1).alias("rest_at"))
    replaced = F.struct(F.lit(True).alias("replaced"), size.alias("length"), (at + 2).alias("rest_at"))
    # backwards an insertion begins one further on: one place of the middle belongs to the forward trie
    kinds = F.filter(F.array(F.when(~back | (at > F.col("first_at")), inserted), F.when(at < size, replaced)), lambda k: k.isNotNull())
    rows = rows.select("n", "backward", "text", "at", F.inline(kinds))
    stride = _stride(F.col("length"))
    node = _node(back, F.col("length"), F.left("text", at))
    return rows.select("n", "backward", "text", "at", "replaced", F.xxhash64(node, F.substr("text", F.col("rest_at"), stride - 1)).alias("key"))


def _edited(states: DataFrame) -> DataFrame:
    """The states with an edit, (n, backward, text, near, node, depth), that edges (first, child) make of states without one.

    The edge must not begin with the character that it replaces or is inserted beside. Of two words that differ by a replaced
    character only the one with the smaller finds the other. Inserted into a run of its own kind, a character stands last.
    """
    at, replaced = F.col("at"), F.col("replaced")
    length = F.char_length("text") + F.when(replaced, 0).otherwise(1)
    beside = F.substr("text", at + F.when(F.col("backward") & ~replaced, 0).otherwise(1), F.lit(1))
    made = states.withColumn("beside", beside).where((F.col("first") != F.col("beside")) & (~replaced | (F.col("first") > F.col("beside"))))
    near = F.concat(F.left("text", at), "first", F.substr("text", at + F.when(replaced, 2).otherwise(1)))
    return made.select("n", "backward", "text", near.alias("near"), F.col("child").alias("node"), F.least(at + _stride(length), length).alias("depth"))


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words at one edit, each in both directions. `words` is a stored table of distinct words."""
    table = stored(edges(words), "edges")
    frontier = stored(_edited(_without_edits(words).join(table.select("key", "first", "child"), "key")), "frontier")
    ended, level = [], 0
    while True:
        size = F.char_length("near")
        ended.append(frontier.where(F.col("depth") == size))
        alive = frontier.where(F.col("depth") < size)
        if alive.isEmpty():
            break
        level += 1
        key = F.xxhash64("node", F.substr("near", F.col("depth") + 2, _stride(size) - 1))
        steps = table.where(F.col("hop") >= level).select("key", F.col("first").alias("spelt"), "child")
        alive = alive.withColumn("key", key).withColumn("spelt", F.substr("near", F.col("depth") + 1, F.lit(1))).join(steps, ["key", "spelt"])
        depth = F.least(F.col("depth") + _stride(size), size)
        frontier = stored(alive.select("n", "backward", "text", "near", F.col("child").alias("node"), depth.alias("depth")), "frontier")
    forget(words.sparkSession, table)
    pairs = ended[0]
    for more in ended[1:]:
        pairs = pairs.union(more)
    forward = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(forward("text").alias("word"), "n", forward("near").alias("near"))
    pairs = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    sides = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(sides))


def group(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word.

    `form` is the neighbour of largest n if that is at least `factor` times the word's own n; `root` follows forms to the last one.
    """
    words = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "words")
    # the least of (-n, word) is the largest n, and of equal ones the first word
    near = neighbours(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    wins = -F.col("best.less") >= F.lit(factor) * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.near")).alias("form"), F.when(wins, -F.col("best.less")).alias("form_n")), "forms")
    forget(words.sparkSession, near)  # the words and the frontiers
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    superseded = None
    while True:  # each round doubles the steps that a word has followed
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        joined = stored(joined, "roots")
        if superseded is not None:
            forget(words.sparkSession, superseded)
        superseded, roots = joined, joined.select("word", "root")
        if joined.where("moved").isEmpty():
            break
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
