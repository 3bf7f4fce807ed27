"""Encoding of a corpus with a public byte-level BPE tokenizer.

The work is one map over the documents: no shuffle, no driver step beyond reading the vocabulary file (of fixed size),
which is broadcast. Within a task a text is cut at blanks that always begin a pre-token, equal pieces are encoded once
as long as they stay in a bounded cache, and pre-tokens are merged through a rank queue."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: Pre-token pattern of this vocabulary (fixed value); blanks are Unicode White_Space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces up to this many characters are kept once encoded, in caches of at most so many pieces, which start anew when full.
CACHED_CHARS, CACHED_PIECES = 48, 150_000

#: Ids in one Arrow batch of the result, unless a single document has more.
BATCH_IDS = 1_000_000


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 itself, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Byte ids and merges (left id, right id, merged id; in rank order) of a `tokenizers` JSON file with byte-level BPE."""
    with open(path, encoding="utf8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return {
        "bytes": np.array([vocab[c] for c in byte_letters()], dtype=np.int32),
        "left": np.array([vocab[a] for a, _ in merges], dtype=np.int32),
        "right": np.array([vocab[b] for _, b in merges], dtype=np.int32),
        "merged": np.array([vocab[a + b] for a, b in merges], dtype=np.int32),
    }


class RankQueue:
    """Buckets of linked-list positions, one per merge rank, under a bitmap of two levels: a bit per rank in words of
    WORD ranks, and a bit per word above. The next rank is the first set bit of the first word with one."""

    WORD = 256

    def __init__(self, ranks: int) -> None:
        self.words = [0] * (ranks // self.WORD + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        w = rank >> 8
        self.words[w] |= 1 << (rank & 255)
        self.top |= 1 << w

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right. Merges only ever push ranks above the one they carry
        out, so the bucket is complete."""
        w = (self.top & -self.top).bit_length() - 1
        bits = self.words[w]
        low = bits & -bits
        self.words[w] = bits ^ low
        if bits == low:
            self.top ^= 1 << w
        rank = (w << 8) | (low.bit_length() - 1)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class Encoder:
    def __init__(self, vocabulary: dict[str, np.ndarray]) -> None:
        left, right = vocabulary["left"].tolist(), vocabulary["right"].tolist()
        self.byte_ids = vocabulary["bytes"].tolist()
        self.merged = vocabulary["merged"].tolist()
        self.left, self.right = left, right
        self.rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(left, right))}
        self.pieces: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.queue = RankQueue(len(left))

    def merge(self, pre_token: str) -> bytes:
        """Ids of one pre-token: symbols in a doubly linked list, merged rank by rank; entries of the queue whose symbols
        have changed since are stale and skipped. O(n log n) in the length n, with no scan per merge."""
        byte_ids, rank_of, queue = self.byte_ids, self.rank.get, self.queue
        symbols = [byte_ids[b] for b in pre_token.encode("utf8", "replace")]
        n = len(symbols)
        if n > 1:
            push = queue.push
            for i in range(n - 1):
                r = rank_of((symbols[i] << 20) | symbols[i + 1])
                if r is not None:
                    push(r, i)
            if queue.top:
                after, before = list(range(1, n + 1)), list(range(-1, n))
                while queue.top:
                    rank, positions = queue.pop()
                    a, b, new = self.left[rank], self.right[rank], self.merged[rank]
                    for i in positions:
                        if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                            continue
                        symbols[i], symbols[j] = new, -1
                        after[i] = k = after[j]
                        if k < n:
                            before[k] = i
                            r = rank_of((new << 20) | symbols[k])
                            if r is not None:
                                push(r, i)
                        h = before[i]
                        if h >= 0:
                            r = rank_of((symbols[h] << 20) | new)
                            if r is not None:
                                push(r, h)
                symbols = [s for s in symbols if s >= 0]
        return array("i", symbols).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece that begins and ends at pre-token boundaries."""
        found, known = [], self.pre_tokens
        for pre_token in self.find(text):
            ids = known.get(pre_token)
            if ids is None:
                ids = self.merge(pre_token)
                if len(pre_token) <= CACHED_CHARS:
                    if len(known) >= CACHED_PIECES:
                        known.clear()
                    known[pre_token] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers. A blank before a character that is no white space always begins a
        pre-token, so the text is cut there. It is read from the end, for a part that begins with white space (or is
        empty, between two blanks) belongs to the part before it."""
        pieces, found, rest = self.pieces, [], ""
        parts = text.split(" ")
        first = parts[0]
        for part in reversed(parts[1:]):
            if not rest:
                ids = pieces.get(part)
                if ids is not None:
                    found.append(ids)
                    continue
            if not part or part[0].isspace():
                rest = f" {part}{rest}"
                continue
            whole, rest = part + rest, ""
            ids = self.piece(" " + whole)
            if len(whole) <= CACHED_CHARS and "  " not in whole:
                if len(pieces) >= CACHED_PIECES:
                    pieces.clear()
                pieces[whole] = ids
            found.append(ids)
        found.append(self.piece(first + rest))
        found.reverse()
        return b"".join(found)


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: Broadcast) -> Encoder:
    """One encoder per vocabulary and worker process, kept between its tasks."""
    key = int(vocabulary.value["left"].size), int(vocabulary.value["left"].astype(np.int64).sum()), int(vocabulary.value["right"].astype(np.int64).sum())
    if hash(key) not in _encoders:
        _encoders.clear()
        _encoders[hash(key)] = Encoder(vocabulary.value)
    return _encoders[hash(key)]


def broadcast_vocabulary(spark: SparkSession, path: str = DEFAULT_VOCABULARY) -> Broadcast:
    """The vocabulary, read on the driver: about 50,000 merges of three integers, whatever the corpus."""
    return spark.sparkContext.broadcast(load_vocabulary(path))


def _ids_of(vocabulary: Broadcast, counts_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode
        for batch in source:
            keys, texts = batch.column(0), batch.column(1)
            start, held, total = 0, [], 0
            for i, text in enumerate(chain(texts, (None,))):
                text = text.as_py() if text is not None else None
                if i == len(texts) or total > BATCH_IDS:
                    sizes = np.array([len(x) // 4 for x in held], dtype=np.int32)
                    part = keys.slice(start, len(held))
                    if counts_only:
                        yield pa.RecordBatch.from_arrays([part, pa.array(sizes)], ["key", "n_tokens"])
                    else:
                        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                        values = pa.array(np.frombuffer(b"".join(held), dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([part, pa.ListArray.from_arrays(pa.array(offsets), values)], ["key", "ids"])
                    start, held, total = i, [], 0
                if i < len(texts):
                    ids = encode(text) if text else b""
                    held.append(b"" if counts_only and not ids else ids)
                    total += len(ids) // 4

    return batches


def encode_corpus(documents: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and ids (array<int>) of every row, without special tokens; text that looks like a special token is ordinary
    text. Null and empty texts give an empty list; a null key stays null; repeated rows are each encoded; an empty table
    gives an empty result; other columns are not read. Only rows with the same text share work, none is cut or dropped."""
    vocabulary = broadcast_vocabulary(documents.sparkSession, vocabulary_path)
    kind = documents.schema[key].dataType.simpleString()
    return (
        documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(_ids_of(vocabulary, False), f"key {kind}, ids array<int>")
        .withColumnRenamed("key", key)
    )


def count_tokens(documents: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and n_tokens of every row, 0 for null and empty texts; else as encode_corpus."""
    vocabulary = broadcast_vocabulary(documents.sparkSession, vocabulary_path)
    kind = documents.schema[key].dataType.simpleString()
    return (
        documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInArrow(_ids_of(vocabulary, True), f"key {kind}, n_tokens int")
        .withColumnRenamed("key", key)
    )
