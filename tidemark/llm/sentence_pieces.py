"""SentencePiece encoding and decoding with a weighted finite-state transducer.

Three machines are compiled from the model file. The normaliser writes a space as the piece mark and
puts one mark before a text that is not empty. The pieces are arcs that read their characters and write
their id; a character that no piece holds is read by byte arcs. Arcs carry tropical weights: the model
is a byte-pair model, whose segmentation is the one in which every two neighbouring pieces would be
left apart if they stood alone, so following a piece by another weighs 0 if the merge rules keep the
two apart and infinity otherwise. Composed with an input, the machine's states are (place, last piece),
and the shortest path of weight 0 is the library's own segmentation.

No piece crosses from a character to a following mark (checked when the model is read), so an input is
composed unit by unit - marks, then the characters up to the next mark - and frequent units are kept in
a table of bounded size. Should a model have crossing pieces, the whole text is one unit.

Decoding writes each piece's characters or byte and turns marks to spaces, less the leading one; bytes
that are no UTF-8 become the replacement character.

Defined results: null and empty texts have no ids. The mark's own character in a text decodes as a
space. Repeated rows are encoded alike.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_rows, record, ships

ships(__name__)

MARK = "▁"
KEPT_UNITS = 400_000
KEPT_WEIGHTS = 1_000_000
DIGESTS = "doc_id bigint, n_ids bigint, ids_crc32 bigint, n_bytes bigint, exact boolean"
INFINITE = float("inf")


class Transducer:
    """Normaliser, pieces and byte fallback of one model, as arcs."""

    def __init__(self, model: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.pieces = [library.id_to_piece(k) for k in range(library.vocab_size())]
        self.bytes_ = {}
        self.arcs: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for k, piece in enumerate(self.pieces):
            if library.is_byte(k):
                self.bytes_[int(piece[3:5], 16)] = k
            elif not (library.is_control(k) or library.is_unknown(k) or library.is_unused(k)):
                self.arcs[piece] = k
                self.score[piece] = library.get_score(k)
        self.byte_of = {k: b for b, k in self.bytes_.items()}
        self.unknown = library.unk_id()
        self.surface = [bytes((self.byte_of[k],)) if k in self.byte_of else p.replace(MARK, " ").encode() for k, p in enumerate(self.pieces)]
        self.single = [k in self.byte_of for k in range(len(self.pieces))]
        crossing = any(MARK in piece.lstrip(MARK) for piece in self.arcs)
        self.unit = re.compile(r"(?s).+" if crossing else rf"{MARK}*[^{MARK}]+|{MARK}+")
        # What each arc reads: the pieces, and any character of theirs that is no piece itself.
        self.reads = [*self.arcs, *sorted({c for piece in self.arcs for c in piece} - set(self.arcs))]
        # Arcs read backwards from a place, as states (next states by character, number of the arc read or -1).
        self.tails: tuple[dict, int] = ({}, -1)
        for k, text in enumerate(self.reads):
            state = self.tails
            for at in range(len(text) - 1, 0, -1):
                state = state[0].setdefault(text[at], ({}, -1))
            state[0][text[0]] = (state[0].get(text[0], ({}, -1))[0], k)
        self.written = [self.ids_of(text) for text in self.reads]
        self.weights: dict[int, float] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        return (MARK + text).replace(" ", MARK) if text else ""

    def merged(self, text: str) -> list[str]:
        """The merge rules on a short string: the best-scored neighbours first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -INFINITE, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1], -INFINITE)
                if score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, left: int, right: int) -> float:
        """Of following one arc by another; kept by number, since every pair is met again and again."""
        if len(self.weights) > KEPT_WEIGHTS:
            self.weights.clear()
        a, b = self.reads[left], self.reads[right]
        found = self.weights[left * len(self.reads) + right] = 0.0 if self.merged(a + b) == [a, b] else INFINITE
        return found

    def ids_of(self, piece: str) -> bytes:
        """What an arc writes: the piece's id, else its bytes."""
        k = self.arcs.get(piece)
        ids = [k] if k is not None else [self.bytes_[b] for b in piece.encode()] if self.bytes_ else [self.unknown]
        return array("I", ids).tobytes()

    def unit_ids(self, unit: str) -> bytes:
        """Ids along the least-weight path through the machine composed with the unit.

        Weights are 0 or infinite, so a state is either reached at weight 0 or not at all, and the
        first arc that reaches a place ends the search for it: a place has one canonical last piece.
        """
        n, size = len(unit), len(self.reads)
        last, step = [-1] * (n + 1), [0] * (n + 1)
        tails, weight = self.tails[0], self.weights.get
        for stop in range(1, n + 1):
            start, states = stop, tails
            while start:
                start -= 1
                state = states.get(unit[start])
                if state is None:  # no arc ends like this; a character no piece holds merges with nothing
                    if start + 1 == stop:
                        step[stop] = 1
                    break
                states, arc = state
                if arc < 0:
                    continue
                if start and last[start] >= 0:
                    found = weight(last[start] * size + arc)
                    if found is None:
                        found = self.weight(last[start], arc)
                    if found:
                        continue
                last[stop], step[stop] = arc, stop - start
                break
            if not step[stop]:  # no canonical neighbours, which a model's own merge order excludes
                return b"".join(map(self.ids_of, self.merged(unit)))
        path, at = [], n
        while at:
            path.append(self.written[last[at]] if last[at] >= 0 else self.ids_of(unit[at - 1]))
            at -= step[at]
        return b"".join(path[::-1])

    def looked_up(self, unit: str) -> bytes:
        """Ids of a unit outside the younger table; units of the older one that are met again move over."""
        ids = self.older.get(unit)
        if ids is None:
            ids = self.unit_ids(unit)
        if len(unit) <= 64:
            if len(self.known) >= KEPT_UNITS:
                self.older, self.known = self.known, {}
            self.known[unit] = ids
        return ids

    def encode(self, text: str) -> array:
        units = self.unit.findall(self.normalise(text))
        parts = list(map(self.known.get, units))
        if None in parts:
            parts = [self.looked_up(u) if p is None else p for u, p in zip(units, parts)]
        out = array("I")
        out.frombytes(b"".join(parts))
        return out

    def decode(self, ids: array) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids, text: the ids of each text and the text they decode to."""
    arrow_rows(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for batch in batches:
            ids = [machine.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([machine.decode(x) for x in ids])], [id_col, "ids", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` bigint, ids array<int>, text string")


def encoding_digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), n_bytes (ids of single bytes), exact (decodes to the text)."""
    arrow_rows(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(model)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = machine.encode(text or "")
                rows.append((key, len(ids), zlib.crc32(ids.tobytes()), sum(map(machine.single.__getitem__, ids)), machine.decode(ids) == (text or "")))
            yield record(rows, DIGESTS)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(run, DIGESTS).withColumnRenamed("doc_id", id_col)
