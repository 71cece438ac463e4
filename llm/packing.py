"""Cost-balanced packing of tokenised documents into training sequences.

Every sequence's cost is estimated as its documents' tokens plus their squares over ``SQUARE`` (attention).
Documents in descending length each go to the lowest-cost sequence with the capacity left; full pieces of a
long document are sequences of their own.  A group of documents gets sequences whose capacities add up to
exactly its tokens (all full but a tail of powers of two), and a piece that fits nowhere is cut, so nothing
is padded.  Groups are runs of one input partition, so tokens never cross the network and a lost task is
simply run again with the same result.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import kept, tidy

SQUARE = 4096
#: Tokens held in a task before they are packed (16 MB of ids).
GROUP_TOKENS = 4 << 20
#: Words whose ids a worker remembers, and how long such a word may be.
REMEMBERED, WORD = 200_000, 24
_RUN, _CUT = re.compile(r"\s ").search, re.compile(r"(?<=\S) (?=\S)").split

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_cost double"


class Words(dict):
    """Ids of words with the space before them."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self._encode(" " + word)
        if len(word) <= WORD and len(self) < REMEMBERED:
            self[word] = ids
        return ids


def byte_ranks(tokenizer) -> dict[bytes, int]:
    """The vocabulary of a byte-level tokenizer of the tokenizers library by bytes; its ids are its merge ranks.

    The library writes bytes as printable letters: printable ones as themselves, the others, in order, as those from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(letters[c] for c in token): rank for token, rank in tokenizer.get_vocab(with_added_tokens=False).items() if all(c in letters for c in token)}


class Encoder:
    """Ids of texts as bytes (little-endian unsigned 32-bit), equal to those of the tokenizers library's ``encode`` (tested).

    The library's own encoder takes more than the CPU that the check tool allows, so its vocabulary is handed to tiktoken's; a text that
    holds a special token's string is encoded by the library itself.  The vocabulary's pattern never joins a space with what
    stands before it unless that is white space too, so a text may be cut before each single space.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        library = self._loaded(path)
        ranks, special = byte_ranks(library), [t.content for t in library.get_added_tokens_decoder().values()]
        for token in special:
            ranks.pop(token.encode(), None)
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self._ids = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced = Words(self.whole)
        self._path, self._library = path, None  # loaded again only where a text needs it, as a worker keeps its encoder

    @staticmethod
    def _loaded(path: str):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def whole(self, text: str) -> bytes:
        return array("I", self._ids(text)).tobytes()

    def document(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._special(text):
            self._library = self._library or self._loaded(self._path)
            return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = _CUT(text) if _RUN(text) else text.split(" ")
        return self.whole(first) + b"".join(map(self._spaced.__getitem__, words))


def capacities(tokens: int, length: int) -> list[int]:
    """Capacities that add up to ``tokens``: full sequences, then powers of two."""
    whole, rest = divmod(tokens, length)
    return [length] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balance(lengths: list[int], length: int, square: int = SQUARE) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Assign documents, given by their lengths, to sequences: (document, start, length, sequence, offset) and each sequence's cost."""
    room = capacities(sum(lengths), length)
    cost, filled = [0.0] * len(room), [0] * len(room)
    by_cost, full = [(0.0, k) for k in range(len(room))], []  # full: too little room for the document at hand, by room
    out = []

    def place(doc, start, size, k):
        out.append((doc, start, size, k, filled[k]))
        filled[k] += size
        room[k] -= size
        cost[k] += size + size * size / square
        if room[k]:
            heapq.heappush(full, (-room[k], k))

    waiting = [(-size, doc, 0) for doc, size in enumerate(lengths)]
    heapq.heapify(waiting)
    while waiting:
        size, doc, start = heapq.heappop(waiting)
        size = -size
        while full and -full[0][0] >= size:
            k = heapq.heappop(full)[1]
            heapq.heappush(by_cost, (cost[k], k))
        while by_cost and room[by_cost[0][1]] < size:
            k = heapq.heappop(by_cost)[1]
            heapq.heappush(full, (-room[k], k))
        k = heapq.heappop(by_cost if by_cost else full)[1]
        now = min(size, room[k])
        place(doc, start, now, k)
        if now < size:
            heapq.heappush(waiting, (now - size, doc, start + now))
    return out, cost


def _packer(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = kept(("encoder", path), lambda: Encoder(path)), array("I", [end_id]).tobytes()
        sequence = TaskContext.get().partitionId() << 40
        full_cost = length + length * length / SQUARE
        held, rows, tokens = [], [], 0

        def flush():
            nonlocal held, rows, tokens, sequence
            pieces, cost = balance([len(ids) // 4 for _, _, ids, _ in held], length)
            for doc, start, size, k, offset in pieces:
                doc_id, before, ids, total = held[doc]
                rows.append((doc_id, before + start, size, ids[4 * start : 4 * (start + size)], total, sequence + k, offset, cost[k]))
            sequence += len(cost)
            out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
            held, rows, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_cost"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.document(text.as_py()) + end
                total = len(ids) // 4
                whole = total - total % length
                for start in range(0, whole, length):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], total, sequence, 0, full_cost))
                    sequence += 1
                if total > whole:
                    held.append((doc_id, whole, ids[4 * whole :], total))
                tokens += total
                if tokens >= GROUP_TOKENS:
                    yield flush()
        if held or rows:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer: str, text: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenise ``docs(doc_id, text)`` and pack them into sequences of at most ``length`` tokens.

    ``tokenizer`` is the path of a byte-level vocabulary of the tokenizers library, read by each task; ids are those of
    its ``encode`` without added special tokens (a special token's own string in a text is its id).  Each document's
    ids end with ``end_id``; a null or empty text is that id alone.  Texts are taken whole, however long.  Other columns are ignored.  Returns one row for each piece: doc_id,
    start (ids of the document before it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset in the sequence and the sequence's estimated cost.  Every id is in exactly one piece; sequences shorter
    than ``length`` have a power of two of tokens.  Repeated rows are separate documents; an empty table gives none.
    """
    return docs.select("doc_id", text).mapInArrow(tidy(_packer(tokenizer, length, end_id)), PIECES)
