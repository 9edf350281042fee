"""Token-ID output in Simple-8b words, with shards, blocks and an index.

Word: 4 bits of selector above 60 bits of payload. A selector says how many ids of which width
the word holds (``SELECTORS``). An id wider than 20 bits is escaped: selector 15, one id in the
60 bits, so any id below 2**60 can be written. The writer always takes the widest count that
fits; the last word of a block may hold fewer ids than its selector says.

Shard file (little-endian): magic, then blocks of words (``BLOCK`` ids each, the last fewer),
then the block table (byte offset, words, ids per block), the document table (id, whether it is
null, tokens), and a tail with the place and length of both. Every block can be decoded without the others; its
selectors give the counts, their running sum the places, so decoding is a few array operations
per selector, not a loop over ids.

Order: documents are range partitioned and sorted by id (null first, then by text), one shard
per partition. Each task attempt writes its own file name, and only the rows of attempts that
succeeded reach the stored list of shards, so lost executors and repeated attempts leave
unlisted files, never wrong ones. Files go through Arrow's file systems to the folder that all
executors share.

Nulls and empty texts hold only the end id. Repeated ids and rows are kept. A text is encoded
whole, however long. An empty table writes no shard. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.fragments import encoder
from gatecast.session import materialize, new_path

# The format's fixed values: (selector, ids in a word, bits of each). 0 is not used; 15 is the escape.
SELECTORS = [(1, 60, 1), (2, 30, 2), (3, 20, 3), (4, 15, 4), (5, 12, 5), (6, 10, 6), (7, 8, 7), (8, 7, 8), (9, 6, 10), (10, 5, 12), (11, 4, 15), (12, 3, 20)]
ESCAPE = 15
COUNT = np.zeros(16, np.int64)
for _selector, _count, _bits in SELECTORS:
    COUNT[_selector] = _count
COUNT[ESCAPE] = 1
BLOCK = 65_536
MOST_KNOWN = 700_000  # words per generation of a worker's table, some 140 MB
MAGIC = b"S8BTOK01"
TAIL = struct.Struct("<QQQ8s")
BLOCKS = np.dtype([("offset", "<u8"), ("words", "<u4"), ("ids", "<u4")])
DOCUMENTS = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
PAYLOAD = np.uint64((1 << 60) - 1)


def pack(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of the ids."""
    ids = np.asarray(ids, np.uint64)
    total = len(ids)
    if not total:
        return np.empty(0, np.uint64)
    if int(ids.max()) >> 60:
        raise ValueError("an id must be below 2**60")
    choice = np.full(total, ESCAPE, np.uint8)
    narrow = np.ones(total + 60, bool)  # what lies beyond the end limits no word
    for selector, count, bits in reversed(SELECTORS):  # the narrowest that fits is written last
        np.less(ids, np.uint64(1 << bits), out=narrow[:total])
        # fits[i]: the ids i..i+width-1 are narrow; widths double until they reach the count.
        fits, width = narrow, 1
        while width < count:
            step = min(width, count - width)
            fits = fits[:-step] & fits[step:]
            width += step
        np.putmask(choice, fits[:total], selector)
    # The words' starts: from each place the next word begins behind the ids that fit.
    following, at, listed = (np.arange(total) + COUNT[choice]).tolist(), 0, []
    add = listed.append
    while at < total:
        add(at)
        at = following[at]
    starts = np.array(listed)
    chosen = choice[starts]
    padded = np.append(ids, np.zeros(60, np.uint64))
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector, count, bits in [*SELECTORS, (ESCAPE, 1, 60)]:
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            first = starts[mine]
            payload = padded[first]
            for k in range(1, count):
                payload |= padded[first + k] << np.uint64(k * bits)
            words[mine] |= payload
    return words


def unpack(words: np.ndarray, total: int) -> np.ndarray:
    """The ``total`` ids of a block's words."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNT[chosen])
    ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for selector, count, bits in [*SELECTORS, (ESCAPE, 1, 60)]:
        mine = np.flatnonzero(chosen == selector)
        if len(mine):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = ((words[mine] & PAYLOAD)[:, None] >> shifts) & np.uint64((1 << bits) - 1)
            ids[(ends[mine] - count)[:, None] + np.arange(count)] = values
    return ids[:total]


def file_system(path: str):
    """Arrow's file system and the path in it, for a URI or a plain local path."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def write_shard(path: str, documents: Iterator[tuple[int | None, np.ndarray]]) -> tuple[int, int]:
    """Write one shard from (id, token ids); returns its documents and tokens. Holds one block, one document and the tables."""
    system, place = file_system(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    blocks: list[tuple[int, int, int]] = []
    table: list[tuple[int, int, int]] = []
    waiting: list[np.ndarray] = []
    held, offset = 0, len(MAGIC)
    with system.open_output_stream(place) as out:
        out.write(MAGIC)

        def flush(ids: np.ndarray) -> int:
            words = pack(ids)
            out.write(words.astype("<u8").tobytes())
            blocks.append((offset, len(words), len(ids)))
            return offset + 8 * len(words)

        for doc_id, ids in documents:
            table.append((doc_id or 0, doc_id is None, len(ids)))
            waiting.append(ids)
            held += len(ids)
            if held >= BLOCK:
                joined = np.concatenate(waiting)
                for a in range(0, held - held % BLOCK, BLOCK):
                    offset = flush(joined[a : a + BLOCK])
                waiting, held = [joined[held - held % BLOCK :]], held % BLOCK
        if held:
            offset = flush(np.concatenate(waiting))
        out.write(np.array(blocks, BLOCKS).tobytes())
        out.write(np.array(table, DOCUMENTS).tobytes())
        out.write(TAIL.pack(offset, len(blocks), len(table), MAGIC))
    return len(table), sum(n for _, _, n in blocks)


def read_shard(path: str) -> Iterator[tuple[int | None, Iterator[np.ndarray], int]]:
    """(id, pieces of its token ids, tokens) per document; one block is in memory at a time. Take all pieces before the next document."""
    system, place = file_system(path)
    size = system.get_file_info(place).size
    with system.open_input_file(place) as file:
        offset, n_blocks, n_documents, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        tables = file.read_at(size - TAIL.size - offset, offset)
        blocks = np.frombuffer(tables, BLOCKS, n_blocks)
        documents = np.frombuffer(tables, DOCUMENTS, n_documents, n_blocks * BLOCKS.itemsize)

        def all_blocks() -> Iterator[np.ndarray]:
            for block in blocks:
                yield unpack(np.frombuffer(file.read_at(8 * int(block["words"]), int(block["offset"])), "<u8"), int(block["ids"]))

        source, rest = all_blocks(), np.empty(0, np.uint64)

        def pieces(want: int) -> Iterator[np.ndarray]:
            nonlocal rest
            while want:
                if not len(rest):
                    rest = next(source)
                piece, rest = rest[:want], rest[want:]
                want -= len(piece)
                yield piece

        for document in documents:
            yield None if document["null"] else int(document["doc_id"]), pieces(int(document["tokens"])), int(document["tokens"])


def word_fragments(raw: bytes) -> list[bytes]:
    """Pieces that the word-level tokenizer codes on their own: it drops white space and lower-cases (ASCII is done here, unless a special token may occur)."""
    return (raw if b"<|" in raw else raw.lower()).split()


def token_ids(text: str, path: str, end_id: int) -> np.ndarray:
    """Ids of a whole text and the end id."""
    coded = encoder(path, MOST_KNOWN).encode(word_fragments(text.encode("utf-8", "replace")))
    return np.append(np.frombuffer(coded, "<u4"), np.uint32(end_id))


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write all documents as shards below ``folder``; returns the stored list of shards (shard, path, documents, tokens)."""
    folder = folder or new_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc_id, missing, text in zip(batch["id"], batch["missing"], batch["text"]):
                    yield None if missing else int(doc_id), token_ids("" if text is None else text, path, end_id)

        shard = TaskContext.get().partitionId()
        source = documents()
        first = next(source, None)
        if first is None:
            return
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.s8b"

        def chained() -> Iterator[tuple[int | None, np.ndarray]]:
            yield first
            yield from source

        n_documents, n_tokens = write_shard(name, chained())
        yield pd.DataFrame({"shard": [shard], "path": [name], "documents": [n_documents], "tokens": [n_tokens]})

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text")
    ranged = rows.repartitionByRange(F.desc("missing"), "id").sortWithinPartitions(F.desc("missing"), "id", F.asc_nulls_first("text"))
    return materialize(ranged.mapInPandas(write, "shard long, path string, documents long, tokens long"), "shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                rows = []
                for doc_id, pieces, tokens in read_shard(path):
                    crc = 0
                    for piece in pieces:
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, start, tokens, crc))
                    start += tokens
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
        return made.astype({"doc_id": "Int64"})

    # The list has one row per shard, whatever the documents.
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    listed = shards.select("path", F.coalesce(before, F.lit(0)).alias("start"))
    spread = listed.repartition(max(1, shards.count()))
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
