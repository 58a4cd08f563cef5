"""Operator 10: byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents are cut into blocks of some hundred thousand distinct pre-tokens ("words").
A block keeps its documents as sequences of word positions (the word's slot in the
block) and sends each of its distinct words, once, to the bucket of the word's hash.
A bucket holds all occurrences of its words in all blocks, encodes each distinct word
once and sends the ids back; a block's documents and its encoded words then meet and
the ids are put together by position.  A word that is in every document travels once
per block, so no bucket is hot.  Decoding looks ids up in the token-byte table, which
has one row per rank and goes to every task.

The blocks are cut twice in one query (for their words and for their documents), so
``docs`` should be a stored table, which is read alike both times; a block is named by
a hash of its documents, and one whose words are missing is an error, never a gap.

Defined results: null and empty texts have no ids; repeated rows and repeated or null
doc_ids give a row each; texts are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin.llm.chunks import ChunkTable
from sigwin.llm.common import pack, unpack

#: A block ends with the document that brings it to so many distinct chunks of text.
BLOCK_CHUNKS = 300_000
#: Positions that are packed to one row.
RUN = 1 << 16
#: White space next to a space, or of a rare kind: such a text is not cut at its spaces.
PAIRS = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class Block:
    """Documents as runs of slots, and the distinct words in slot order."""

    def __init__(self, pattern: regex.Pattern) -> None:
        self.pattern, self.slots, self.table = pattern, {}, ChunkTable()
        self.name = hashlib.blake2b(digest_size=8)
        self.runs: list[tuple[list, list, list]] = []

    def _words(self, chunk: str) -> list[str]:
        letters = chunk[1:] if chunk[0] == " " else chunk
        if letters.isalpha():  # the commonest cases: a space and letters are one word
            return [chunk]
        if letters[:-1].isalpha() and letters[-1] in ".,":
            return [chunk[:-1], chunk[-1]]
        return self.pattern.findall(chunk)

    def _make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words of new chunks; words get slots in order of appearance."""
        words = list(map(self._words, chunks))
        slots = np.fromiter((self.slots.setdefault(w, len(self.slots)) for ws in words for w in ws), np.uint32)
        return slots, np.fromiter(map(len, words), np.int64, len(words))

    def add(self, doc_ids: list[int | None], texts: list[str]) -> None:
        """Add some documents.  No match of the pattern goes on over a space with no white
        space beside it, so such texts are cut before their spaces; others are split whole."""
        odd = [any(p in t for p in PAIRS) or bool(RARE.search(t)) for t in texts]
        joined = [b"" if o else t.encode("utf-8") for o, t in zip(odd, texts, strict=True)]
        data = b"".join(joined)
        begins = np.cumsum([0] + [len(j) for j in joined])
        start = np.union1d(begins[:-1], np.flatnonzero(np.frombuffer(data, np.uint8) == 32))
        start = start[start < len(data)]
        slots, upto = self.table.values(data, start, np.r_[start[1:], len(data)] if len(start) else start, self._make)
        cuts = np.r_[0, upto][np.searchsorted(start, begins)]
        for doc_id, text, whole, a, b in zip(doc_ids, texts, odd, cuts[:-1], cuts[1:], strict=True):
            self._put(doc_id, len(text), self._make([text])[0] if whole else slots[a:b])

    def _put(self, doc_id: int | None, size: int, slots: np.ndarray) -> None:
        if not self.runs or sum(self.runs[-1][1]) >= RUN:
            self.runs.append(([], [], []))
        for held, value in zip(self.runs[-1], (doc_id, len(slots), slots), strict=True):
            held.append(value)
        self.name.update(f"{doc_id},{size},{len(slots)};".encode())

    def full(self) -> bool:
        return len(self.table) >= BLOCK_CHUNKS or len(self.slots) >= BLOCK_CHUNKS

    def key(self) -> int:
        return int.from_bytes(self.name.digest(), "little", signed=True)


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Documents by about half a mebibyte of text."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= 1 << 19:
                yield doc_ids, texts
                doc_ids, texts, size = [], [], 0
    if doc_ids:
        yield doc_ids, texts


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[Block]:
    compiled, block, number = regex.compile(pattern), None, 0
    for doc_ids, texts in _some(batches):
        if block is None:
            block = Block(compiled)
            block.name.update(f"{TaskContext.get().partitionId()}/{number}:".encode())
            number += 1
        block.add(doc_ids, texts)
        if block.full():
            yield block
            block = None
    if block is not None:
        yield block


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte planes, compressed."""
    return pack(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _from_planes(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(unpack(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


@lru_cache(1)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    # The pattern is not used: each word is encoded as a single piece.
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=_ranks(ranks), special_tokens={})


@lru_cache(1)
def _token_bytes(ranks: bytes) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    table = _ranks(ranks)
    by_id = [b""] * (max(table.values(), default=-1) + 1)
    for token, i in table.items():
        by_id[i] = token
    return by_id


def _decoded(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


DOCS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()),
                  ("slots", pa.binary())])
WORDS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("slots", pa.binary()), ("lengths", pa.binary()),
                   ("words", pa.binary())])
IDS = pa.schema([("block", pa.int64()), ("slots", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("bytes", pa.binary())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)`` with ids as little-endian unsigned 32-bit integers.

    With ``decoded``, the ids just put together are decoded by the token-byte table in
    the same task, as ``decode`` does, and ``bytes`` follows.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:  # a vocabulary file of the driver's machine, of fixed size
        ranks = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    buckets = 2 * docs.rdd.getNumPartitions()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            for ids, counts, parts in block.runs:
                yield pa.RecordBatch.from_pydict({
                    "block": [block.key()], "doc_ids": [ids], "counts": [_planes(np.array(counts))],
                    "slots": [_planes(np.concatenate(parts))]}, schema=DOCS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, pattern):
            encoded = [w.encode() for w in block.slots]
            # The bucket depends on the word alone.
            bucket = np.fromiter(map(crc32, encoded), np.int64, len(encoded)) % buckets
            order = np.argsort(bucket, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
                own = [encoded[i] for i in at]
                yield pa.RecordBatch.from_pydict({
                    "block": [block.key()], "bucket": [int(bucket[at[0]])],
                    "slots": [_planes(np.diff(at, prepend=0))],
                    "lengths": [_planes(np.fromiter(map(len, own), np.int64, len(own)))],
                    "words": [pack(b"".join(own))]}, schema=WORDS)

    def encode_bucket(bucket: pa.Table) -> pa.Table:
        encoding = _encoding(ranks.value)
        known: dict[bytes, list[int]] = {}
        out: dict[str, list] = {"block": [], "slots": [], "counts": [], "ids": []}
        for row in bucket.to_pylist():
            ends = np.cumsum(_from_planes(row["lengths"])).tolist()
            joined, start, got = unpack(row["words"]), 0, []
            for end in ends:
                word = joined[start:end]
                start = end
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encoding._encode_single_piece(word)
                got.append(ids)
            out["block"].append(row["block"])
            out["slots"].append(row["slots"])
            out["counts"].append(_planes(np.fromiter(map(len, got), np.int64, len(got))))
            out["ids"].append(_planes(np.fromiter(chain.from_iterable(got), np.int64)))
        return pa.table(out, schema=IDS)

    def reassemble(documents: pa.Table, encoded: pa.Table) -> pa.Table:
        slots, counts, ids = [], [], []
        for row in encoded.to_pylist():
            slots.append(np.cumsum(_from_planes(row["slots"]).astype(np.int64)))
            counts.append(_from_planes(row["counts"]).astype(np.int64))
            ids.append(_from_planes(row["ids"]))
        n = sum(map(len, slots))
        size, first = np.full(n, -1), np.zeros(n, dtype=np.int64)
        if n:
            flat = np.concatenate(ids)
            by_row = np.concatenate(counts)
            size[np.concatenate(slots)] = by_row
            first[np.concatenate(slots)] = np.cumsum(by_row) - by_row
        out: dict[str, list] = {"doc_id": [], "ids": [], "bytes": []}
        table = _token_bytes(ranks.value) if decoded else []
        for row in documents.to_pylist():
            words = _from_planes(row["slots"]).astype(np.int64)
            if len(words) and (words.max() >= n or (size < 0).any()):
                raise RuntimeError("a block's words are missing: the input was not read alike twice; store it first")
            times = size[words] if n else words
            ends = np.cumsum(times)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
            got = flat[np.repeat(first[words], times) + at] if n else np.zeros(0, "<u4")
            last = np.cumsum(_from_planes(row["counts"]).astype(np.int64))
            cut = np.r_[0, ends][last]
            out["doc_id"] += row["doc_ids"]
            for a, b in pairwise([0, *cut.tolist()]):
                out["ids"].append(got[a:b].tobytes())
                out["bytes"].append(_decoded(got[a:b], table) if decoded else None)
        return pa.table(out, schema=OUT)

    encoded = (docs.mapInArrow(words, "block long, bucket int, slots binary, lengths binary, words binary")
               .groupBy("bucket").applyInArrow(encode_bucket, "block long, slots binary, counts binary, ids binary"))
    out = (docs.mapInArrow(documents, "block long, doc_ids array<long>, counts binary, slots binary")
           .groupBy("block").cogroup(encoded.groupBy("block"))
           .applyInArrow(reassemble, "doc_id long, ids binary, bytes binary"))
    return out if decoded else out.drop("bytes")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``bytes`` appended: each id joined with its row of the token-byte table."""
    with open(ranks_path, "rb") as f:
        ranks = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks.value)
        for b in batches:
            texts = [_decoded(np.frombuffer(x, "<u4"), table) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(texts, pa.binary())],
                                             names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs, ranks_path, pattern, decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
