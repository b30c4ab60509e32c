"""Message templates mined with a prefix tree of fixed depth.

A message is a sentence with its numbers masked.  Its path in the tree is its number of
words and its first three words; masked words share a branch.  Below a leaf, messages
are gathered into templates: a message joins the template with which it agrees in the most
words, at least ``agree`` of them, and words in which its members differ become ``<*>``.
The tree knows nothing of what a template may later be taken for.

Candidates in a leaf are looked up, not compared one by one: if at most m of n words may
differ, a message agrees fully with its template in one of m + 1 blocks of words.

Distribution: distinct messages are sorted by (leaf, message); a task mines what of a leaf
it holds, ``block`` messages at a time.  Templates of leaves that were cut, by a block or by
the end of a task, are gathered once more among themselves, until no leaf is cut or no more
of them come together, so that a template stands once however large its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqjoin.scratch import materialize

ANY = "<*>"


def leaf_of(first: Sequence[str], n_words: int) -> str:
    """The path of a message in the tree: number of words, then the first words; as many as are given."""
    return " ".join([str(n_words), *(ANY if w[0] == "<" else w for w in first)])


class Leaf:
    """The templates under one leaf; all messages have the same number of words."""

    def __init__(self, n_words: int, agree: float):
        self.templates: list[list[str]] = []
        self.may_differ = int(n_words * (1 - agree) + 1e-9)
        n_blocks = min(n_words, self.may_differ + 1)
        edges = [n_words * i // n_blocks for i in range(n_blocks + 1)]
        self.blocks = list(zip(edges, edges[1:]))
        self.index: dict[tuple, list[int]] = {}

    def _enter(self, i: int, words: Sequence[str], old: Sequence[str] | None = None) -> None:
        for a, b in self.blocks:
            if old is None or list(words[a:b]) != list(old[a:b]):
                self.index.setdefault((a, *words[a:b]), []).append(i)

    def place(self, words: list[str]) -> int:
        """Number of the template that takes ``words`` in, which may be a new one."""
        seen: set[int] = set()
        best, least = -1, self.may_differ + 1
        for a, b in self.blocks:
            for i in self.index.get((a, *words[a:b]), ()):
                if i not in seen:
                    seen.add(i)
                    differ = sum(x != y for x, y in zip(self.templates[i], words))
                    if differ < least or differ == least and best > i:
                        best, least = i, differ
        if best < 0:
            self.templates.append(words)
            self._enter(len(self.templates) - 1, words)
            return len(self.templates) - 1
        if least:
            old = self.templates[best]
            self.templates[best] = [x if x == y else ANY for x, y in zip(old, words)]
            self._enter(best, self.templates[best], old)
        return best


def mine_leaf(messages: Sequence[str], agree: float = 0.8) -> list[str]:
    """The template of each message of one leaf (messages of as many words)."""
    if not messages:
        return []
    split = [m.split(" ") for m in messages]
    leaf = Leaf(len(split[0]), agree)
    at = [leaf.place(words) for words in split]
    return [" ".join(leaf.templates[i]) for i in at]


def _mined(rows: DataFrame, agree: float, block: int) -> DataFrame:
    """(leaf, message, n, template, cut) of rows (leaf, message, n) sorted by leaf and message within partitions."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, counts, cut = None, [], [], True  # the first leaf may have begun in the task before

        def close(more: bool) -> pa.RecordBatch:
            columns = [pa.array([leaf] * len(held), pa.string()), pa.array(held, pa.string()), pa.array(counts, pa.int64())]
            columns += [pa.array(mine_leaf(held, agree), pa.string()), pa.array([cut or more] * len(held), pa.bool_())]
            return pa.record_batch(columns, ["leaf", "message", "n", "template", "cut"])

        for batch in batches:
            done = []
            for path, message, n in zip(*(c.to_pylist() for c in batch.columns)):
                if path != leaf or len(held) >= block:
                    if held:
                        done.append(close(path == leaf))
                    cut = path == leaf or leaf is None
                    leaf, held, counts = path, [], []
                held.append(message)
                counts.append(n)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if held:
            yield close(True)  # the last leaf may go on in the next task

    return rows.mapInArrow(mine, "leaf string, message string, n bigint, template string, cut boolean")


def mine_templates(messages: DataFrame, *, agree: float = 0.8, block: int = 5_000, rounds: int = 8) -> DataFrame:
    """(leaf, message, n, template) of every distinct message of ``messages`` (leaf, message); ``n`` counts its rows.

    An empty table gives an empty result.  ``rounds`` only bounds the loop; it ends as soon
    as fewer than a hundredth of the templates of cut leaves came together.
    """
    counted = messages.groupBy("leaf", "message").agg(F.count(F.lit(1)).alias("n"))
    mined = materialize(_mined(counted.repartitionByRange("leaf", "message").sortWithinPartitions("leaf", "message"), agree, block), "templates")
    whole = mined.where(~F.col("cut")).select("leaf", "message", "n", "template")
    rest = mined.where("cut").select("leaf", "message", "n", "template")
    before = None
    for i in range(rounds):
        parts = rest.groupBy("leaf", F.col("template").alias("message")).agg(F.sum("n").alias("n"))
        # sorted from the other end, so that those meet that a block's edge kept apart
        ordered = parts.repartitionByRange("leaf", F.reverse("message")).sortWithinPartitions("leaf", F.reverse("message")) if i % 2 == 0 else (
            parts.repartitionByRange("leaf", "message").sortWithinPartitions("leaf", "message")
        )
        again = materialize(_mined(ordered, agree, block * 4), "templates")
        made = again.agg(F.count(F.lit(1)).alias("old"), F.countDistinct("leaf", "template").alias("new"), F.max(F.col("cut").cast("int")).alias("cut")).head()
        joined = again.select("leaf", F.col("message").alias("template"), F.col("template").alias("__wider"))
        rest = rest.join(joined, ["leaf", "template"]).select("leaf", "message", "n", F.col("__wider").alias("template"))
        if not made.cut or made.new > 0.99 * made.old or made.new == before:
            break
        before = made.new
    return whole.unionByName(rest)
