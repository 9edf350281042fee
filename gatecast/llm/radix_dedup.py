"""Exact dedup: compressed radix tries that own the byte strings of a length-and-hash partition.

A text is normalised (A-Z in lower case) and becomes its UTF-8 bytes. One pass writes (id, length, content hash, SHA-256)
per document. A length and hash that occurs once is the text of one document. The texts of the others, and the few that
pass the key filter by chance, are compared byte by byte:

1. Every task that reads them inserts them into a trie of its own, so a text with many copies leaves a task once. A trie
   above ``MEMORY`` is handed on and started anew.
2. They are dealt by (length, hash), and every partition inserts its full byte strings into one trie. A terminal node
   holds the identifier that owns the text and the number of its rows.
3. A trie above ``MEMORY`` spills its heaviest subtree: the subtree's strings go, with what their terminals hold, to the
   next round, and so does every later string that ends below the cut. A round settles all that it keeps, at least one
   string per partition, so rounds end. A round is a table in the shared folder, never a file of one executor.

Two texts of equal length and hash that differ carry their bytes in the result, and documents find them by the bytes
themselves; so no hash decides.

Memory per task: ``MEMORY`` and one text. What is exchanged: one copy per task of each text that may have copies, and some
100 bytes per document. Each text moves with its length and hash, so a group of copies that holds a third of all rows
arrives as one row per task that read it. Its documents meet their owner in a join that AQE splits.

Nulls: a null text is the empty text. A null id owns a text only if all its ids are null. Ties: rows that repeat the id of
the row that stays are copies of it; exactly one of them is kept. Texts of any length are compared whole. An empty
table gives an empty result. Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm.common import per_text
from gatecast.operators.joins import key_filter, may_match
from gatecast.session import materialize

MEMORY = 64 << 20  # bytes of a trie
NODE = 400  # bytes counted for a node beside its label
CHUNK = 8 << 20  # bytes of texts that a task gives out at a time

Entry = list  # [owner or None, rows, length, hash]


def larger(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else max(a, b)


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class Node:
    """The bytes on the edge to it, its children by their first byte (None: spilled), what ends here, bytes of the subtree."""

    __slots__ = ("label", "children", "entry", "weight")

    def __init__(self, label: bytes, entry: Entry | None = None):
        self.label, self.children, self.entry, self.weight = label, {}, entry, len(label) + NODE


def common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, whose first bytes agree."""
    low, high = 1, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self, better: Callable = larger):
        self.root, self.better, self.spilled = Node(b""), better, False

    @property
    def size(self) -> int:
        return self.root.weight

    def insert(self, key: bytes, entry: Entry) -> bool:
        """Add a string, or join its entry with the one of an equal string; False if its place has been spilled."""
        node, at = self.root, 0
        path = [node]
        while at < len(key):
            child = node.children.get(key[at], node)
            if child is None:
                return False
            if child is node:  # nothing starts with this byte
                leaf = Node(key[at:], entry)
                node.children[key[at]] = leaf
                for above in path:
                    above.weight += leaf.weight
                return True
            if not key.startswith(child.label, at):  # cut the edge where the string leaves it
                shared = common(child.label, key, at)
                upper = Node(child.label[:shared])
                upper.children[child.label[shared]] = child
                child.label = child.label[shared:]
                upper.weight, child.weight = child.weight + NODE, child.weight - shared
                node.children[key[at]] = upper
                for above in path:
                    above.weight += NODE
                child = upper
            node, at = child, at + len(child.label)
            path.append(node)
        if node.entry is None:
            node.entry = entry
        else:
            node.entry[0], node.entry[1] = self.better(node.entry[0], entry[0]), node.entry[1] + entry[1]
        return True

    def entries(self, node: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, Entry]]:
        """All strings at and below a node, with their entries."""
        open_nodes = [(node or self.root, before)]
        while open_nodes:
            node, before = open_nodes.pop()
            whole = before + node.label
            if node.entry is not None:
                yield whole, node.entry
            open_nodes += [(child, whole) for child in node.children.values() if child is not None]

    def spill(self) -> Iterator[tuple[bytes, Entry]] | None:
        """Cut off the heaviest subtree at the first fork and give out its strings; None if only one string is left."""
        node, before, path = self.root, b"", []
        while True:
            path.append(node)
            before += node.label
            live = {first: child for first, child in node.children.items() if child is not None}
            if len(live) + (node.entry is not None) > 1:
                break
            if not live:
                return None
            node = next(iter(live.values()))
        first = max(live, key=lambda f: live[f].weight)
        cut = live[first]
        node.children[first] = None
        for above in path:
            above.weight -= cut.weight
        self.spilled = True
        return self.entries(cut, before)


STRINGS = "length long, hash long, body binary, owner long, rows long"


def frames(strings: Iterator[tuple[bytes | None, Entry]], **more: object) -> Iterator[pd.DataFrame]:
    """Rows of ``STRINGS``, and constant columns, some ``CHUNK`` bytes at a time."""
    rows, held = [], 0
    for body, (owner, n, length, value) in strings:
        rows.append((length, value, body, owner, n))
        held += len(body or b"") + NODE
        if held > CHUNK:
            yield framed(rows, more)
            rows, held = [], 0
    if rows:
        yield framed(rows, more)


def framed(rows: list[tuple], more: dict) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["length", "hash", "body", "owner", "rows"])
    made["owner"] = pd.array([row[3] for row in rows], "Int64")
    return made.assign(**more)


def read(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[bytes, Entry]]:
    for batch in batches:
        for length, value, body, owner, missing, n in zip(batch["length"], batch["hash"], batch["body"], batch["owner"], batch["missing"], batch["rows"]):
            yield bytes(body), [None if missing else int(owner), int(n), int(length), int(value)]


def with_flags(strings: DataFrame) -> DataFrame:
    """Rows of ``STRINGS`` with a flag for null owners: a column with nulls would turn whole numbers into floats."""
    return strings.select("length", "hash", "body", F.coalesce("owner", F.lit(0)).alias("owner"), F.col("owner").isNull().alias("missing"), "rows")


def combined(strings: DataFrame, better: Callable, memory: int) -> DataFrame:
    """Rows of ``STRINGS`` with the equal ones of a task joined, as far as its memory goes."""

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(better)
        for body, entry in read(batches):
            trie.insert(body, entry)
            if trie.size > memory:
                yield from frames(trie.entries())
                trie = Trie(better)
        yield from frames(trie.entries())

    return with_flags(strings).mapInPandas(combine, STRINGS)


def settled(strings: DataFrame, better: Callable, memory: int) -> list[DataFrame]:
    """One row of ``STRINGS`` for every different string, as stored tables; ``body`` only where another string may share length and hash."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(better)
        for body, entry in read(batches):
            if not trie.insert(body, entry):
                yield from frames(iter([(body, entry)]), open=True)
            while trie.size > memory and (cut := trie.spill()):
                yield from frames(cut, open=True)
        sharing = Counter((entry[2], entry[3]) for _, entry in trie.entries())
        kept = ((body if trie.spilled or sharing[entry[2], entry[3]] > 1 else None, entry) for body, entry in trie.entries())
        yield from frames(kept, open=False)

    done = []
    while True:
        dealt = with_flags(strings).repartition("length", "hash")
        stored = materialize(dealt.mapInPandas(own, f"{STRINGS}, open boolean"), "radix-round")
        done.append(stored.where("NOT open").drop("open"))
        strings = stored.where("open").drop("open")
        if strings.isEmpty():
            return done


def body_of(text: str) -> bytes:
    return text.encode("utf-8", "replace").lower()  # bytes: only A-Z change


def content_hash(body: bytes) -> int:
    value = xxhash.xxh64_intdigest(body)
    return value - (value >> 63 << 64)


def exact_groups(docs: DataFrame, text: Column, keep: str = "largest", memory: int = MEMORY, hashed: Callable[[bytes], int] = content_hash) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id (the id that owns its text), group_size, kept, text_sha256."""
    better = {"largest": larger, "smallest": smaller}[keep]

    def digests(whole: str) -> tuple:
        body = body_of(whole)
        return len(body), hashed(body), hashlib.sha256(body).hexdigest()

    def places(whole: str) -> tuple:
        body = body_of(whole)
        return len(body), hashed(body)

    def bodies(whole: str) -> tuple:
        return (body_of(whole),)

    light = docs.select("doc_id", per_text(digests, "length long, hash long, text_sha256 string")(text).alias("d")).select("doc_id", "d.*")
    rows = materialize(light.withColumn("row", F.monotonically_increasing_id()), "radix-rows")
    repeated = materialize(rows.groupBy("length", "hash").count().where("count > 1").select("hash"), "radix-keys")
    count = repeated.count()
    whole = docs.select("doc_id", text.alias("text")).select("doc_id", "text", per_text(places, "length long, hash long")(F.col("text")).alias("p"))
    whole = whole.select("doc_id", "text", "p.*")
    likely = may_match(whole, key_filter(repeated, F.col("hash"), count), whole["hash"], count)
    strings = likely.select("length", "hash", per_text(bodies, "body binary")(F.col("text"))["body"].alias("body"), F.col("doc_id").alias("owner"), F.lit(1).cast("long").alias("rows"))
    owners = settled(combined(strings, better, memory), better, memory)
    groups = owners[0]
    for more in owners[1:]:
        groups = groups.unionByName(more)
    clashes = groups.groupBy("length", "hash").count().where("count > 1").select("length", "hash")
    done = rows
    if clashes.isEmpty():
        done = rows.join(groups.drop("body"), ["length", "hash"], "left")
    else:  # documents with such a length and hash find their string by its bytes
        clashes = materialize(clashes, "radix-clashes")
        numbered = materialize(groups.withColumn("string", F.monotonically_increasing_id()), "radix-strings")
        unique = numbered.join(clashes, ["length", "hash"], "left_anti")
        shared = numbered.join(clashes, ["length", "hash"]).withColumnRenamed("body", "bytes")
        asked = whole.join(clashes, ["length", "hash"], "left_semi").select(F.col("doc_id").alias("id"), "length", "hash", per_text(bodies, "body binary")(F.col("text"))["body"].alias("body"))
        found = asked.join(shared.select("length", "hash", "bytes", "owner", "rows"), ["length", "hash"]).where("body = bytes")
        found = found.select(F.col("id").alias("doc_id"), F.lit(None).cast("long").alias("row"), "length", "hash", F.sha2("body", 256).alias("text_sha256"), "owner", "rows")
        alone = rows.join(clashes, ["length", "hash"], "left_anti").join(unique.drop("body", "string"), ["length", "hash"], "left")
        done = alone.unionByName(found.withColumn("row", F.monotonically_increasing_id() + F.lit(1 << 60)))
    done = done.select("doc_id", "row", "length", "hash", "text_sha256", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"), F.coalesce("rows", F.lit(1)).alias("group_size"))
    done = materialize(done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))), "radix-owned")
    # Of rows that repeat the owner's id the first stays; normally there are none, and the join has nothing on its right.
    again = done.where("kept AND group_size > 1").groupBy("text_sha256", "length", "hash", "keep_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = again.select(F.col("text_sha256").alias("sha"), F.col("length").alias("size"), F.col("hash").alias("value"), F.col("keep_id").alias("id"), "first")
    same = (done["text_sha256"] == first["sha"]) & (done["length"] == first["size"]) & (done["hash"] == first["value"]) & done["keep_id"].eqNullSafe(first["id"])
    marked = done.join(first, same, "left")
    kept = F.col("kept") & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return marked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
