"""Packing of token ids into windows by multiway differencing.

Every document is encoded, ended with the id END, and cut: each full window's worth of ids fills a
sequence of its own, and the rest is cut into pieces of at most PIECE ids. The pieces of a run of
documents are dealt to windows by Karmarkar-Karp differencing: the two partial partitions of the
largest spread are merged so that the fullest window of one meets the emptiest of the other. The
window count starts at the least possible and rises by one whenever a window exceeds its capacity.

Runs are cut from each input partition in order, so nothing is shuffled, a lost task is done again
alike, and a sequence id (partition number, then a counter) is met once. At most one window a run and
partition is poorly filled.

Defined results: a null or empty text is the single id END. Repeated rows and null ids are packed like
any other row. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, ships

ships(__name__)

WINDOW = 2048
PIECE = 256
RUN_IDS = 128 * WINDOW
END = 1
# The split rule of the byte-level vocabulary (possessive form) and its special token.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SPECIAL = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level vocabulary as native unsigned 32-bit bytes, END included.

    The rank file holds the same vocabulary and is encoded faster; a text that holds the special
    token's own string goes through the full tokenizer file, which knows it.
    """

    def __init__(self, ranks: str, full: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        self.core = tiktoken.Encoding("ids", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})._core_bpe
        self.full_path, self.full = full, None

    def __call__(self, text: str) -> array:
        if SPECIAL in text:
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.full_path)
            ids = array("I", self.full.encode(text, add_special_tokens=False).ids)
        else:
            ids = array("I", self.core.encode_ordinary(text))
        ids.append(END)
        return ids


def differencing(sizes: list[int], ways: int) -> tuple[np.ndarray, int]:
    """Window of each item and the largest window, by differencing into `ways` windows."""
    parts: list[tuple] = []  # (left, right, order) of each merge, after the items
    heap = []
    for k, size in enumerate(sizes):
        vector = np.zeros(ways, np.int64)
        vector[0] = size
        heap.append((-size if ways > 1 else 0, k, vector))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, u = heapq.heappop(heap)
        _, b, v = heapq.heappop(heap)
        both = u + v[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        parts.append((a, b, order))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sizes) + len(parts) - 1, both))
    where = np.zeros(len(sizes), np.int64)
    if not sizes:
        return where, 0
    _, top, vector = heap[0]
    stack = [(top, np.arange(ways))]
    while stack:
        k, windows = stack.pop()
        if k < len(sizes):
            where[k] = windows[0]
            continue
        a, b, order = parts[k - len(sizes)]
        left, right = np.empty(ways, np.int64), np.empty(ways, np.int64)
        left[order] = windows
        right[ways - 1 - order] = windows
        stack += [(a, left), (b, right)]
    return where, int(vector[0])


def windows_of(sizes: list[int], capacity: int = WINDOW) -> np.ndarray:
    """Window of each item; the count of windows rises until none exceeds the capacity."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        where, most = differencing(sizes, ways)
        if most <= capacity:
            return where
        ways += 1


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
NAMES = [x.split()[0] for x in PIECES.split(", ")]


def pack(docs: list[tuple[int | None, array]], first: int, capacity: int = WINDOW, piece: int = PIECE) -> tuple[list[tuple], int]:
    """Pieces of one run of documents in the columns of PIECES, and the next free sequence id."""
    rows, cuts = [], []
    for doc, ids in docs:
        raw, n = ids.tobytes(), len(ids)
        for start in range(0, n - n % capacity, capacity):
            rows.append((doc, start, capacity, zlib.crc32(raw[4 * start : 4 * (start + capacity)]), n, first, 0))
            first += 1
        for start in range(n - n % capacity, n, piece):
            stop = min(n, start + piece)
            cuts.append((doc, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), n))
    where = windows_of([c[2] for c in cuts], capacity)
    filled: dict[int, int] = {}
    for cut, window in zip(cuts, where.tolist()):
        at = filled.get(window, 0)
        rows.append((*cut, first + window, at))
        filled[window] = at + cut[2]
    return rows, first + (max(filled) + 1 if filled else 0)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, full: str | None = None) -> DataFrame:
    """One row per piece, in the columns of PIECES (doc_id is id_col)."""
    arrow_rows(docs.sparkSession, 256)
    ranks, full = ranks or vocabulary("byte_bpe_50k.tiktoken"), full or vocabulary("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks, full)
        first = TaskContext.get().partitionId() << 36
        held: list[tuple] = []
        size = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], NAMES)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                held.append((doc, ids))
                size += len(ids)
                if size >= RUN_IDS:
                    rows, first = pack(held, first)
                    held, size = [], 0
                    yield out(rows)
        if held:
            yield out(pack(held, first)[0])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, PIECES).withColumnRenamed("doc_id", id_col)
