"""Operator 2: token ids in files, coded by a canonical length-limited Huffman code.

File format: a folder with two Parquet tables.  ``codes`` has a row (id, length) for
each id that occurs; the canonical code follows from the lengths.  ``blocks`` has one
row for each block of whole documents: its place (shard, number), the ids before it
in its shard, the documents' doc_ids and id counts, a bit offset for every
``CHECKPOINT`` ids, and the bits.  A block is decoded by itself; its checkpoints
are decoded side by side through one table that is indexed by the next ``LONGEST``
bits.  Shards follow each other in doc_id order, and so do blocks and documents.

Documents are sorted by doc_id, then text hash, then text, so a rerun of a lost task
writes the same block.  Lengths come from counts over all documents.

Defined results: null and empty texts are the end id alone; a null doc_id comes first;
repeated rows are written one after the other; very long texts make one large block;
an empty table gives no rows and no codes; other columns are not read.  A corpus with
more than ``2 ** LONGEST`` distinct ids raises a ValueError: its codes would be longer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigwin.llm.chunks import SortedChunkTable, bounds
from sigwin.llm.common import arrow_schema, pack, scratch_path, stored, text_or_empty, unpack

END_ID = 2
#: Longest code in bits, ids for each checkpoint, and ids that end a block.
LONGEST = 16
CHECKPOINT = 256
BLOCK_IDS = 1 << 18
#: Chunks of text whose ids a worker keeps, and how many of them stay when there are more.
CACHED = 1_500_000
KEPT = 750_000
#: How the vocabulary marks the last token of a word, and the letters that all versions of Unicode agree on.
WORD_END = "</w>"
LATIN_END = "\u0250"
#: Documents of a batch, and characters, that are split at a time.
DOCS_AT_ONCE = 1024
AT_ONCE = 1 << 20
#: White space on which the tokenizer and str.split might differ.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE, SIGN, LETTER = (np.isin(np.arange(256), list(x)) for x in (
    b" \t\n\r", b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", bytes(range(97, 123))))
#: The small letters of Latin-1 beyond ASCII are two bytes: this one and one of these (no division sign).
ACCENTED, ACCENT = 0xC3, np.isin(np.arange(256), sorted({*range(0xA0, 0xC0)} - {0xB7}))


class TokenCache:
    """Ids of texts by the tokenizers library, each distinct chunk of text encoded once.

    A chunk ends at white space, or between a small Latin letter and an ASCII sign that is no
    apostrophe.  The tokenizer drops white space and splits there itself, so a text's
    ids are its chunks' ids one after the other.  Its lower-casing is done before, where
    that is sure to be the same, so that fewer chunks are distinct.
    """

    def __init__(self, vocabulary: bytes) -> None:
        self.tokenizer, self.table = tokenizers.Tokenizer.from_buffer(vocabulary), SortedChunkTable()
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        # Which ids end a word; the tokenizer marks them.
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for word, i in words.items() if word.endswith(WORD_END)]] = True

    def _make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and how many each has.

        A chunk of letters is one word of the tokenizer, so such chunks are encoded together
        without positions and told apart where words end.
        """
        plain = np.array([c.isalpha() and (c.isascii() or max(c) < LATIN_END) for c in chunks], bool)
        letters = [c for c, p in zip(chunks, plain.tolist(), strict=True) if p]
        others = [c for c, p in zip(chunks, plain.tolist(), strict=True) if not p]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
        upto = np.flatnonzero(self.ends[ids]) + 1
        if len(upto) != len(letters):  # a tokenizer that does not mark words
            return self._make_each(chunks)
        other_ids, other_sizes = self._make_each(others)
        sizes = np.zeros(len(chunks), np.int64)
        sizes[plain], sizes[~plain] = np.diff(upto, prepend=0), other_sizes
        flat, of_letters = np.empty(sizes.sum(), "<u4"), np.repeat(plain, sizes)
        flat[of_letters], flat[~of_letters] = ids, other_ids
        return flat, sizes

    def _make_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Encode chunks as one sequence of single words."""
        if not chunks:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        found = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(chunks))
        return np.array(found.ids, dtype="<u4"), sizes

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _split(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut at their white space."""
        joined = [t.encode("utf-8") for t in texts]
        data = b" " + b" ".join(joined) + b" "
        raw = np.frombuffer(data, np.uint8)
        space = SPACE[raw]
        cut = np.zeros(len(raw), bool)
        letter = LETTER[raw]
        letter[1:] |= (raw[:-1] == ACCENTED) & ACCENT[raw[1:]]
        cut[1:] = SIGN[raw[1:]] & letter[:-1]
        start, end = bounds(raw, space, cut)
        ids, upto = self.table.values(data, start, end, self._make)
        begins = 1 + np.cumsum([0] + [len(j) + 1 for j in joined])
        cuts = np.r_[0, upto][np.searchsorted(start, begins)].tolist()
        return [ids[a:b].tobytes() for a, b in pairwise(cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > CACHED:
            self.table.keep(KEPT)
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, text in enumerate(texts):
            if ODD.search(text) or "<|" in text or len(text) > AT_ONCE:
                out[i] = b"".join(map(self._whole, pieces(text)))
                continue
            if text.isascii() or (unicodedata.is_normalized("NFC", text) and "İ" not in text and "Σ" not in text):
                text = text.lower()
            held.append((i, text))
            size += len(text)
            if size > AT_ONCE:
                self._flush(held, out)
                held, size = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, str]], out: list[bytes]) -> None:
        for (i, _), ids in zip(held, self._split([t for _, t in held]), strict=True):
            out[i] = ids


def pieces(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of a very long text, cut before spaces."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@lru_cache(1)
def _cache(vocabulary: bytes) -> TokenCache:
    return TokenCache(vocabulary)


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Best code lengths of at most ``longest`` bits (package-merge)."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    if len(counts) > 1 << longest:
        raise ValueError(f"{len(counts)} ids need codes of more than {longest} bits")
    ids = sorted(counts, key=lambda i: (counts[i], i))
    weight = np.array([counts[i] for i in ids], dtype=np.int64)
    # Items of a level: the ids (in order of weight) and pairs of the level below, merged by weight.
    levels, below = [], np.zeros(0, dtype=np.int64)
    for _ in range(longest):
        merged = np.concatenate([weight, below])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(ids))
        both = merged[order]
        even = len(both) // 2 * 2
        below = both[0:even:2] + both[1:even:2]
    # Of the top level 2n - 2 items are taken; pairs among them take twice as many below.
    lengths, take = np.zeros(len(ids), dtype=np.int64), 2 * len(ids) - 2
    for is_id in reversed(levels):
        n = int(is_id[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    return {i: int(n) for i, n in zip(ids, lengths, strict=True)}


class Code:
    """The canonical code of lengths: codes by (length, id), and the decoding table."""

    def __init__(self, lengths: dict[int, int], longest: int = LONGEST) -> None:
        ids = sorted(lengths, key=lambda i: (lengths[i], i))
        n = np.array([lengths[i] for i in ids], dtype=np.int64)
        span = 1 << (longest - n)
        start = np.cumsum(span) - span
        self.longest = longest
        size = max(ids, default=-1) + 1
        self.bits, self.length = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.bits[ids], self.length[ids] = start >> (longest - n), n
        self.table_id, self.table_length = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.int64)
        used = int(span.sum())
        self.table_id[:used], self.table_length[:used] = np.repeat(ids, span), np.repeat(n, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits, first bit of a byte highest, and the bit offset of each ``CHECKPOINT``-th id."""
        n = self.length[ids]
        end = np.cumsum(n)
        at = end - n
        total = int(end[-1]) if len(ids) else 0
        # A code of up to 16 bits lies in three bytes; bits of different codes never meet, so sums are unions.
        placed = self.bits[ids] << (24 - n - (at & 7))
        byte, size = at >> 3, (total + 7 >> 3) + 3
        out = sum(np.bincount(byte + k, (placed >> (16 - 8 * k)) & 255, minlength=size) for k in range(3))
        return out[:size].astype(np.uint8).tobytes(), at[::CHECKPOINT].astype("<u4")

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids; the stretches between checkpoints are decoded side by side."""
        data = np.frombuffer(bits, np.uint8).astype(np.int64)
        at, lanes = checkpoints.astype(np.int64), len(checkpoints)
        out, mask = np.zeros((min(n, CHECKPOINT), lanes), np.uint32), (1 << self.longest) - 1
        last = len(data) - 3
        for k in range(len(out)):
            byte = np.minimum(at >> 3, last)
            window = (data[byte] << 16) | (data[byte + 1] << 8) | data[byte + 2]
            window = (window >> (24 - self.longest - (at & 7))) & mask
            out[k] = self.table_id[window]
            at = at + self.table_length[window]
        return out.T.ravel()[:n] if lanes else out.ravel()


PLACE = "shard int, number int, before long, total long, doc_ids binary, nulls binary, counts binary"
PLAIN = f"{PLACE}, ids binary"
CODED = f"{PLACE}, checkpoints binary, bits binary"


def tokenized_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Blocks of plain ids (``PLAIN``) in doc_id order, stored."""
    arrow = arrow_schema(PLAIN)
    with open(tokenizer_path, "rb") as f:  # a vocabulary file of the driver's machine, of fixed size
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    ordered = (docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
               .withColumn("h", F.xxhash64("text"))
               .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h"))
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard = _cache(vocabulary.value), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number = before = 0
        doc_ids, payloads, held = [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(payloads), "<u4")
            wide = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
            nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
            counts = np.array([len(p) // 4 for p in payloads], "<u4").tobytes()
            packed = pack(ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\0" + ids.tobytes())
            return pa.RecordBatch.from_pydict({
                "shard": [shard], "number": [number], "before": [before], "total": [len(ids)], "doc_ids": [pack(wide)],
                "nulls": [pack(nulls)], "counts": [pack(counts)], "ids": [packed]}, schema=arrow)

        parts = (b.slice(k, DOCS_AT_ONCE) for b in batches for k in range(0, b.num_rows, DOCS_AT_ONCE))
        for part in parts:
            for doc_id, ids in zip(part.column(0).to_pylist(), cache.encode(part.column(1).to_pylist()), strict=True):
                doc_ids.append(doc_id)
                payloads.append(ids + end)
                held += len(ids) // 4 + 1
                if held >= BLOCK_IDS:
                    yield block()
                    number, before = number + 1, before + held
                    doc_ids, payloads, held = [], [], 0
        if doc_ids:
            yield block()

    return stored(ordered.mapInArrow(run, PLAIN), "token-ids", "uncompressed")


def _plain_ids(packed: bytes) -> np.ndarray:
    """Ids of two bytes each, or of four after a byte that makes the length odd."""
    raw = unpack(packed)
    return np.frombuffer(raw[1:], "<u4") if len(raw) % 2 else np.frombuffer(raw, "<u2")


def id_counts(blocks: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most one row per id of the vocabulary reaches the driver."""
    arrow = arrow_schema("id int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for packed in b.column(0).to_pylist():
                n = np.bincount(_plain_ids(packed))
                if len(n) < len(total):
                    n, total = total, n
                n[:len(total)] += total
                total = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": at, "n": total[at]}, schema=arrow)

    rows = blocks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r["id"]: r["n"] for r in rows}


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID) -> None:
    """Write the tables ``codes`` and ``blocks`` below ``folder``."""
    spark = docs.sparkSession
    plain = tokenized_blocks(docs, tokenizer_path, end_id)
    lengths = code_lengths(id_counts(plain))
    spark.createDataFrame(sorted(lengths.items()), "id int, length int").coalesce(1).write.parquet(f"{folder}/codes")
    code, arrow = spark.sparkContext.broadcast(Code(lengths)), arrow_schema(CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                bits, checkpoints = code.value.encode(_plain_ids(row.pop("ids")).astype(np.int64))
                row |= {"bits": bits, "checkpoints": checkpoints.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    plain.mapInArrow(run, CODED).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    lengths = {r["id"]: r["length"] for r in spark.read.parquet(f"{folder}/codes").collect()}
    code = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.parquet(f"{folder}/blocks")
    # A row for each shard, that is for each task that wrote: its ids, and those of all shards before it.
    per = blocks.groupBy("shard").agg(F.sum("total").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("shard_start"))
    schema = "doc_id long, start long, n_tokens long, ids binary"
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                counts = np.frombuffer(unpack(row["counts"]), "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                ids = code.value.decode(row["bits"], np.frombuffer(row["checkpoints"], "<u4"), int(ends[-1]))
                ids = ids.astype("<u4")
                doc_ids = np.frombuffer(unpack(row["doc_ids"]), "<i8")
                nulls = np.frombuffer(unpack(row["nulls"]), np.uint8).astype(bool)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, mask=nulls), "start": row["shard_start"] + row["before"] + ends - counts,
                    "n_tokens": counts, "ids": [ids[e - n:e].tobytes() for e, n in zip(ends, counts, strict=True)],
                }, schema=arrow)

    return blocks.join(F.broadcast(starts), "shard").mapInArrow(run, schema)


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write files, read them back; per document: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-files")
    write_token_files(docs, tokenizer_path, folder)
    return read_token_files(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
