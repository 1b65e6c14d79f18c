"""Exact deduplication by Patricia-trie owners.

Each input task puts its normalised texts into a radix trie, so that a text leaves the task once however many copies
the task has read. The shuffle deals (text, owner, copies) by length and content hash; each of its partitions is put
into a radix trie again, whose terminal nodes hold the group's owner and size. A hot text thus costs a row for each
input task, not for each copy. Documents then learn their group's owner by a join on length and digest, where Spark
splits the partition of a hot group.

A trie takes a bounded number of bytes. In the first pass a full trie is emitted and emptied: partial groups meet
again after the shuffle. After the shuffle a full trie spills its largest subtree to Spark's own scratch folder,
as Spark's sorts and aggregates do; subtrees that have spilled are put together again one at a time.

Texts are equal when identical after lower-casing A to Z only. Defined cases: a null text counts as an empty one;
null identifiers never own a group unless it has no other; rows that repeat identifier and text are one document, so
each carries the same ``kept`` while ``group_size`` counts them all; an empty table gives an empty result; only the
identifier and text columns are read, so further columns may have any names and are not carried along.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sahifa.llm.arrow import SLICE, field, map_slices, map_stream

#: Bytes of texts and nodes that a trie may hold.
BUDGET = 192 << 20
#: What a node takes besides its label, roughly.
NODE_BYTES = 300
#: Parts that a spilled subtree is read back in.
PARTS = 16


def normalise(text: str | None) -> bytes:
    """``bytes.lower`` changes A to Z and nothing else."""
    return (text or "").encode().lower()


class Node:
    __slots__ = ("children", "copies", "label", "owner")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.copies = label, None, None, 0


def shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """A compressed trie of byte strings. ``better(a, b)`` picks the owner of two; either may be None."""

    def __init__(self, better):
        self.better, self.root, self.size = better, Node(b""), {}

    def add(self, key: bytes, owner, copies: int) -> None:
        node, at, end, grown = self.root, 0, len(key), 0
        while at < end:
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                grown += end - at + NODE_BYTES
                node, at = child, end
            elif key.startswith(child.label, at):
                at += len(child.label)
                node = child
            else:
                n = shared(child.label, key, at)
                upper = Node(child.label[:n])
                upper.children = {child.label[n]: child}
                child.label = child.label[n:]
                node.children[key[at]] = upper
                grown += NODE_BYTES
                node, at = upper, at + n
        node.owner = self.better(node.owner, owner) if node.copies else owner
        node.copies += copies
        top = key[0] if key else -1
        self.size[top] = self.size.get(top, 0) + grown

    def bytes(self) -> int:
        return sum(self.size.values())

    def subtree(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, object, int]]:
        todo = [(node, prefix)]
        while todo:
            node, key = todo.pop()
            if node.copies:
                yield key, node.owner, node.copies
            todo += [(c, key + c.label) for c in (node.children or {}).values()]

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        return self.subtree(self.root, b"")

    def cut_largest(self) -> tuple[int, list[tuple[bytes, object, int]]]:
        """Take out the largest subtree below the root: its first byte and what it held."""
        top = max((t for t in self.size if t >= 0), key=self.size.get)
        node = self.root.children.pop(top)
        del self.size[top]
        return top, list(self.subtree(node, node.label))


def scratch() -> str:
    """A folder among those that Spark itself spills to."""
    homes = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")
    return tempfile.mkdtemp(prefix="trie-", dir=homes[os.getpid() % len(homes)] or None)


class SpillingTrie:
    """A trie that moves its largest subtree to disk when it holds more than ``budget`` bytes."""

    def __init__(self, better, budget: int = BUDGET, level: int = 0):
        self.better, self.budget, self.level, self.trie, self.folder, self.spilled = better, budget, level, RadixTrie(better), None, {}
        self.count = 0

    def add(self, key: bytes, owner, copies: int) -> None:
        self.trie.add(key, owner, copies)
        self.count += 1
        if self.count % 64 == 0 and len(self.trie.size) and self.trie.bytes() > self.budget and self.trie.root.children:
            top, held = self.trie.cut_largest()
            self.spill(top, held)

    def part(self, key: bytes) -> int:
        return hashlib.blake2b(key, digest_size=8, salt=bytes([self.level % 256])).digest()[0] % PARTS

    def spill(self, top: int, held: list) -> None:
        self.folder = self.folder or scratch()
        files = self.spilled.setdefault(top, {})
        for entry in held:
            part = self.part(entry[0])
            if part not in files:
                files[part] = open(os.path.join(self.folder, f"{top}-{part}"), "w+b")  # noqa: SIM115
            pickle.dump(entry, files[part], protocol=5)

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Everything once; subtrees that spilled are read back part by part."""
        try:
            for top in list(self.spilled):
                if self.trie.root.children and top in self.trie.root.children:
                    node = self.trie.root.children.pop(top)
                    self.spill(top, list(self.trie.subtree(node, node.label)))
            yield from self.trie.items()
            self.trie = RadixTrie(self.better)
            for files in self.spilled.values():
                for f in files.values():
                    f.seek(0)
                    again = SpillingTrie(self.better, self.budget, self.level + 1)
                    with contextlib.suppress(EOFError):
                        while True:
                            again.add(*pickle.load(f))
                    f.close()
                    yield from again.items()
        finally:
            if self.folder:
                shutil.rmtree(self.folder, ignore_errors=True)


def chooser(keep: str):
    pick = {"largest": max, "smallest": min}[keep]
    return lambda a, b: b if a is None else a if b is None else pick(a, b)


def emitted(items, id_name: str, with_text: bool) -> Iterator[dict[str, list]]:
    """Columns of at most SLICE groups, or a few MB, at a time."""
    out, held = [], 0
    for entry in items:
        out.append(entry)
        held += len(entry[0])
        if len(out) >= SLICE or held > 4 << 20:
            yield columns(out, id_name, with_text)
            out, held = [], 0
    if out:
        yield columns(out, id_name, with_text)


def columns(entries: list, id_name: str, with_text: bool) -> dict[str, list]:
    keys = [k for k, _, _ in entries]
    out = {"length": [len(k) for k in keys], "digest": [hashlib.sha256(k).digest() for k in keys], id_name: [o for _, o, _ in entries], "copies": [c for _, _, c in entries]}
    return out | ({"content": keys} if with_text else {})


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per group of equal texts: length in bytes, SHA-256 digest, owner's identifier, number of rows."""
    head = [T.StructField("length", T.LongType()), T.StructField("digest", T.BinaryType()), field(df, id_col, "owner"), T.StructField("copies", T.LongType())]

    def local(batches):
        trie = RadixTrie(chooser(keep))
        for batch in batches:
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                trie.add(normalise(text), owner, 1)
            if trie.bytes() > budget:
                yield from emitted(trie.items(), "owner", True)
                trie = RadixTrie(chooser(keep))
        yield from emitted(trie.items(), "owner", True)

    def merged(batches):
        trie = SpillingTrie(chooser(keep), budget)
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (4, 2, 3)), strict=True):
                trie.add(*row)
        yield from emitted(trie.items(), "owner", False)

    partial = map_stream(df.select(id_col, text_col), local, T.StructType([*head, T.StructField("content", T.BinaryType())]))
    return map_stream(partial.repartition("length", "digest"), merged, T.StructType(head))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier (``_id``), length and digest of the normalised text."""
    schema = T.StructType([field(df, id_col, "_id"), T.StructField("length", T.LongType()), T.StructField("digest", T.BinaryType())])

    def run(batch):
        keys = [normalise(t) for t in batch.column(1).to_pylist()]
        return {"_id": batch.column(0), "length": [len(k) for k in keys], "digest": [hashlib.sha256(k).digest() for k in keys]}

    return map_slices(df.select(id_col, text_col), run, schema)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", budget: int = BUDGET) -> DataFrame:
    """One row per input row: identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    groups = owners(df, id_col, text_col, keep, budget)
    rows = digests(df, id_col, text_col)
    return rows.join(groups.hint("merge"), ["length", "digest"]).select(
        F.col("_id").alias(id_col), F.col("owner").alias("keep_id"), F.col("copies").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("owner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
