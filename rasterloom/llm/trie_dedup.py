"""Exact duplicates by Patricia tries: partitions by length class and bits of the content hash hold compressed
radix tries of the full byte strings, and each terminal node stores the smallest identifier.

Two levels keep hot texts apart: every input partition first inserts its own rows, so that a text copied a
billion times leaves one row per input partition, and only those rows meet in the second tries.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import arrow_map, staged
from .text import SPACES

#: Memory that a task's tries may take, by their own count, before the largest subtree is spilled; and what a
#: node counts for besides its label.
SPILL_BYTES, NODE = 64 << 20, 500
#: Strings that a trie of the second level holds on average, by its bits of the content hash.
STRINGS = 512


class _Node:
    __slots__ = ("label", "children", "value", "file")

    def __init__(self, label: bytes, value=None):
        self.label, self.children, self.value, self.file = label, {}, value, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings; ``merge(old, new)`` combines the values of equal keys.

    Beyond ``limit`` bytes of labels and nodes, the largest subtree below the topmost fork moves to a temporary
    file of the task. Later keys of that subtree are appended to the file, and each subtree is rebuilt alone when the
    trie is read, spilling again at deeper forks if it must.
    """

    def __init__(self, merge: Callable, limit: int = SPILL_BYTES):
        self.merge, self.limit, self.root, self.bytes, self.spills, self.forks = merge, limit, _Node(b""), 0, 0, 0

    def insert(self, key: bytes, value):
        """Returns what the key's terminal now holds; None if it went to a file."""
        node, at = self.root, 0
        while True:
            if node.file is not None:
                pickle.dump((key, value), node.file)
                return None
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return node.value
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.bytes += len(key) - at + NODE
                break
            label = child.label
            if not key.startswith(label, at):
                k = _common(label, key[at : at + len(label)])
                self.bytes, self.forks = self.bytes + NODE, self.forks + 1
                fork = _Node(label[:k])
                child.label = label[k:]
                fork.children[child.label[0]] = child
                node.children[key[at]] = child = fork
                label = fork.label
            node, at = child, at + len(label)
        while self.bytes > self.limit and self._spill():
            pass
        return value

    @staticmethod
    def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[bytes, _Node]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None or node.file is not None:
                yield prefix, node
            stack += [(c, prefix + c.label) for c in node.children.values()]

    @staticmethod
    def _size(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + NODE
            stack += node.children.values()
        return total

    def _spill(self) -> bool:
        """Move the largest subtree of the topmost fork to a file; False if one string is all there is."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.value is None:
            (node,) = node.children.values()
            prefix += node.label
        live = [c for c in node.children.values() if c.file is None]
        if not live or node.value is None and len(node.children) < 2:
            return False
        top = max(live, key=self._size)
        stub = _Node(top.label[:1])
        stub.file = tempfile.TemporaryFile()
        for key, n in self._walk(top, prefix + top.label):
            if n.file is not None:
                n.file.seek(0)
                stub.file.write(n.file.read())
                n.file.close()
            else:
                pickle.dump((key, n.value), stub.file)
        self.bytes -= self._size(top)
        self.spills += 1
        node.children[stub.label[0]] = stub
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for key, node in self._walk(self.root, b""):
            if node.file is None:
                yield key, node.value
                continue
            node.file.seek(0)
            sub = PatriciaTrie(self.merge, self.limit)
            while True:
                try:
                    sub.insert(*pickle.load(node.file))
                except EOFError:
                    break
            node.file.close()
            yield from sub.items()
            self.spills, self.forks = self.spills + sub.spills, self.forks + sub.forks


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _owners(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """First level: tries by length class and hash bits of this input partition, whose terminals hold the local
    class, the hash, the smallest id and the number of rows. Every row leaves with the key of its local class;
    classes leave with their text at the end. Past ``limit`` they leave at once and the tries start anew, which
    only makes more local classes."""
    from pyspark import TaskContext

    part, serial, tries = TaskContext.get().partitionId(), 0, {}

    def merge(a, b):
        return (a[0], a[1], _least(a[2], b[2]), a[3] + b[3])

    for batch in batches:
        local, held = [], sum(t.bytes for t in tries.values())
        for doc_id, sha, text in zip(batch["doc_id"].to_pylist(), batch["sha"].to_pylist(), batch["norm"].cast(pa.binary()).to_pylist()):
            trie = tries.get((len(text).bit_length(), sha[0] >> 4))
            if trie is None:  # never spills by itself: the sum of all tries is bounded here
                trie = tries[len(text).bit_length(), sha[0] >> 4] = PatriciaTrie(merge, float("inf"))
            held -= trie.bytes
            own = trie.insert(text, ((part << 33) + serial, sha, doc_id, 1))[0]
            held += trie.bytes
            serial += own == (part << 33) + serial
            local.append(own)
            if held > limit:
                yield from _leaving(tries)
                tries, held = {}, 0
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "sha": batch["sha"], "local": local, "bytes": pa.nulls(len(local), pa.binary()), "count": pa.nulls(len(local), pa.int64())}, _ROWS)
    yield from _leaving(tries)


_ROWS = pa.schema([("doc_id", pa.int64()), ("sha", pa.binary()), ("local", pa.int64()), ("bytes", pa.binary()), ("count", pa.int64())])


def _leaving(tries: dict) -> Iterator[pa.RecordBatch]:
    """Rows of the local classes, a few MB of text at a time; here doc_id is the smallest of the class."""
    rows, size = [], 0
    for trie in tries.values():
        for text, (local, sha, least, count) in trie.items():
            rows.append((least, sha, local, text, count))
            size += len(text)
            if size > 4 << 20 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)


def _classes(batches: Iterator[pa.RecordBatch], limit: int, forks=None, spills=None) -> Iterator[pa.RecordBatch]:
    """Second level: rows come sorted by (length class, hash bits); each run is one trie whose terminals gather
    the smallest id, the number of rows and the local classes. The accumulators take what the tries did."""

    def merge(a, b):
        a[2].extend(b[2])
        return (_least(a[0], b[0]), a[1] + b[1], a[2])

    def closed(trie):
        rows = []
        for _, (least, count, locals_) in trie.items():
            rows += [(x, least, count) for x in locals_]
            if len(rows) >= 10_000:
                yield rows
                rows = []
        yield rows
        if forks is not None:
            forks.add(trie.forks)
            spills.add(trie.spills)

    def leaving(trie):
        for rows in closed(trie):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["local", "keep_id", "group_size"])

    trie, key = None, None
    for batch in batches:
        for run, text, local, least, count in zip(zip(batch["n"].to_pylist(), batch["h"].to_pylist()), *(batch[c].to_pylist() for c in ("bytes", "local", "least", "count"))):
            if run != key:
                if trie:
                    yield from leaving(trie)
                trie, key = PatriciaTrie(merge, limit), run
            trie.insert(text, (least, count, [local]))
    if trie:
        yield from leaving(trie)


def exact_owners(docs: DataFrame, limit: int = SPILL_BYTES, strings: int = STRINGS, forks=None, spills=None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text, ...).

    Texts are equal when identical after replacing each run of ASCII white space by one space. A null text
    counts as empty, and empty texts are equal to each other. The smallest doc_id of a group stays; a null
    doc_id is larger than all others and stays only in a group that has no other. Repeated rows of one
    doc_id count in group_size and share their fate. Very long texts are inserted whole. Other columns,
    whatever their names, are ignored; an empty table gives none. A trie of the second level holds about
    ``strings`` texts; the accumulators ``forks`` and ``spills`` tell what its tries did.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    rows = docs.select(F.col("doc_id").cast("long"), norm.alias("norm")).withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    seen = staged(arrow_map(rows, lambda it: _owners(it, limit), "doc_id long, sha binary, local long, bytes binary, count long"), "trie")
    owners = seen.where("bytes is not null")
    bits = 1 << max(0, -(-owners.count() // strings) - 1).bit_length()
    length = F.length(F.bin(F.length("bytes")))  # the class of its highest bit
    head = F.conv(F.substring(F.hex("sha"), 1, 8), 16, 10).cast("long") % bits
    owners = owners.select(length.alias("n"), head.alias("h"), "bytes", "local", F.col("doc_id").alias("least"), "count")
    owners = owners.repartition("n", "h").sortWithinPartitions("n", "h")
    classes = arrow_map(owners, lambda it: _classes(it, limit, forks, spills), "local long, keep_id long, group_size long")
    seen = seen.where("bytes is null")
    return seen.select("doc_id", "sha", "local").join(classes, "local").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
