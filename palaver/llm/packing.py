"""Best-fit packing of token sequences by bounded-space online best-fit.

Documents become token ids plus one closing id; longer ones than a sequence are cut into full
pieces, all but the first.  Each task packs its stream of pieces into a fixed number of open bins.
The bins are kept in a bitset with one bit for each amount of free space: the best fit of a piece
of length L is the lowest set bit at or above L, found by one shift.  When a bin more than the
fixed number would be open, the fullest one (the lowest set bit) closes.  Pieces reach the packer
in chunks of bounded number, longest first within a chunk, which brings the online rule close to
best-fit decreasing.

Scale: no shuffle.  A task packs what its own input split holds, so the work is spread as the
input is, and no key, source or group of copies can gather in one task.  Memory is bounded: open
bins, one chunk of pieces and one slice of texts.  At the end of a split at most the last open
bins stay part-filled.  Everything is a function of the split's rows in their order, so a retried
task gives the same numbers.

Edge cases: null and empty texts give one piece that holds the closing id alone; repeated rows are
packed again; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tokens of a sequence.
SEQUENCE = 2048
#: Bins that a task holds open at once.
OPEN_BINS = 16_384
#: Pieces that are sorted together before they reach the packer.
CHUNK_PIECES = 16_384
#: Bytes of text that are tokenized at once.
TEXT_SLICE = 2 << 20

#: Texts of these characters alone are cut alike by both libraries' patterns.
_PLAIN = regex.compile(r"[\n\r\t\x20-\x7e¡-ɏͰ-ͳΆ-ϿЀ-ԯ‐-‧‰-⁞€]*")


class BitsetPacker:
    """Online best-fit with a fixed number of open bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # bit f is set while some open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin that takes a piece, and the offset in it."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            at = self.bins[space].pop()
            if not self.bins[space]:
                self.free ^= 1 << space
            self.n_open -= 1
        else:
            at, space = self.n_bins, self.capacity
            self.n_bins += 1
        left = space - length
        if left:
            if self.n_open >= self.limit:  # the fullest closes
                fullest = (self.free & -self.free).bit_length() - 1
                self.bins[fullest].pop(0)
                if not self.bins[fullest]:
                    self.free ^= 1 << fullest
                self.n_open -= 1
            self.bins[left].append(at)
            self.free |= 1 << left
            self.n_open += 1
        return at, self.capacity - space


class ByteTokenizer:
    """Token ids under a byte-level vocabulary file of the library ``tokenizers``.

    Where the same vocabulary lies beside it as a rank file, texts of plain characters go through
    the faster library, which gives the same ids for them; all others through ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_level", pat_str=_pattern(), mergeable_ranks=table, special_tokens={})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
                out[i] = np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.slow.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, np.uint32)
        return out


def _pattern() -> str:
    # fixed value: the published pre-token pattern of byte-level vocabularies
    return r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """The pieces of one document and their starts: full ones, but for the first."""
    first = len(ids) % capacity or capacity
    if len(ids) <= capacity:
        yield 0, ids
        return
    yield 0, ids[:first]
    for start in range(first, len(ids), capacity):
        yield start, ids[start : start + capacity]


def pack_documents(
    docs: DataFrame, path: str, *, capacity: int = SEQUENCE, end_id: int = 0, open_bins: int = OPEN_BINS, with_ids: bool = True
) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``, and ``ids`` (unless ``with_ids`` is false).

    ``docs`` needs ``doc_id`` and ``text``.  Sequence ids are unique over all tasks.
    """
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
            *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
        ]
    )
    chunk_pieces = CHUNK_PIECES // 4 if with_ids else CHUNK_PIECES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        packer = BitsetPacker(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []

        def flush() -> pa.RecordBatch:
            waiting.sort(key=lambda p: -p[3])
            placed = [packer.place(p[3]) for p in waiting]
            columns = list(zip(*waiting, strict=True))
            arrays = [
                pa.array(columns[0], pa_id),
                pa.array(columns[1], pa.int32()),
                *(pa.array(columns[k], pa.int64()) for k in (2, 3, 4)),
                pa.array([base + at for at, _ in placed], pa.int64()),
                pa.array([offset for _, offset in placed], pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            waiting.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            pa_id = batch.column("doc_id").type
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for start, stop in _text_slices(texts):
                part = [t or "" for t in texts[start:stop].to_pylist()]
                for doc_id, ids in zip(doc_ids[start:stop], tokenizer.ids(part), strict=True):
                    whole = np.append(ids, np.uint32(end_id))
                    for k, (at, piece) in enumerate(cut(whole, capacity)):
                        crc = zlib.crc32(piece.astype("<u4").tobytes())
                        waiting.append((doc_id, k, at, len(piece), crc, *([piece] if with_ids else [])))
                while len(waiting) >= chunk_pieces:
                    yield flush()
        if waiting:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(pack, schema)


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    from .words import slices

    return slices(texts, TEXT_SLICE)
