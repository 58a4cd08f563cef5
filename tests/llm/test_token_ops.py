"""Token files and byte-level BPE against the tokenizer libraries, the code against its definition."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from sigwin.llm import byte_bpe, token_files

from .conftest import TEXTS

WORD = P.path("word_bpe_49k.json")
with open(WORD, "rb") as file:
    CACHE = token_files.TokenCache(file.read())
RANKS = P.path("byte_bpe_50k.tiktoken")


def test_token_files(docs, no_docs):
    rows = sorted(token_files.token_report(docs, WORD).collect(), key=lambda r: r.start)
    library, start = tokenizers.Tokenizer.from_file(WORD), 0
    assert [r.doc_id for r in rows] == sorted([i for i, _ in TEXTS], key=lambda i: (i is not None, i or 0))
    want = sorted((i or -1, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in (
        (i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in rows) == want
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert token_files.token_report(no_docs, WORD).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="aAbBéÉΣσİ.,'<|> \n\t\x1c\u00a0\u0301x1#-_?’ñÿ÷×ªß中", max_size=40), max_size=5))
def test_token_cache_is_the_library(texts):
    cache = CACHE
    want = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert cache.encode(texts) == want


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=3000), st.integers(9, 16))
def test_code_round_trip(ids, longest):
    values, n = np.unique(ids, return_counts=True)
    lengths = token_files.code_lengths(dict(zip(values.tolist(), n.tolist(), strict=True)), longest)
    assert max(lengths.values()) <= longest and sum(2.0 ** -k for k in lengths.values()) <= 1
    code = token_files.Code(lengths, longest)
    bits, at = code.encode(np.array(ids))
    assert code.decode(bits, at, len(ids)).tolist() == ids


def test_code_lengths_are_limited_and_best():
    fibonacci = {i: n for i, n in enumerate([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])}
    assert token_files.code_lengths(fibonacci, 16)[0] == 9 and max(token_files.code_lengths(fibonacci, 5).values()) == 5
    assert sorted(token_files.code_lengths({1: 1, 2: 1, 3: 2, 4: 4}, 3).values()) == [1, 2, 3, 3]


def _encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _want(encoding, i, t):
    ids = np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()
    return i or -1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


def test_byte_bpe(docs, no_docs, monkeypatch):
    encoding = _encoding()
    got = byte_bpe.round_trip(docs, RANKS, P.PATTERN).collect()
    want = sorted(_want(encoding, i, t) for i, t in TEXTS)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert byte_bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((t or "").encode() for _, t in TEXTS)


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet="aé .,'s\n\t\r\x1c\u00a0\u20031日\u0301!", max_size=40), min_size=1, max_size=5))
def test_words_are_the_patterns_matches(texts):
    import regex

    block = byte_bpe.Block(regex.compile(P.PATTERN))
    block.add(list(range(len(texts))), texts)
    words = list(block.slots)
    got = [[words[s] for s in slots] for run in block.runs for slots in run[2]]
    assert got == [regex.findall(P.PATTERN, t) for t in texts]


def test_all_code_points_split_as_tiktoken_does():
    encoding = _encoding()
    text = "".join(f"a{chr(c)}b {chr(c)} 1{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000)
    import regex

    ids = [i for w in regex.findall(P.PATTERN, text) for i in encoding._encode_single_piece(w)]
    assert ids == encoding.encode_ordinary(text)


def test_texts_of_many_lines_and_over_a_mebibyte_are_the_library():
    texts = ["don't stop... l'été, naïve# " * 60_000, "word " * 3 + "x" * 1_100_000, "a-b_c d.e's " * 9]
    library = tokenizers.Tokenizer.from_file(WORD)
    for text, got in zip(texts, CACHE.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_sorted_chunk_table_forgets_and_finds():
    from sigwin.llm.chunks import SortedChunkTable
    table, rng = SortedChunkTable(), np.random.default_rng(1)
    make = lambda chunks: (np.array([len(c) for c in chunks for _ in c], "<u4"), np.array([len(c) for c in chunks]))
    for step in range(30):
        words = ["w" * int(n) for n in rng.integers(1, 40, 50)]
        data = " ".join(words).encode()
        end = np.cumsum([len(w) + 1 for w in words]) - 1
        start = end - [len(w) for w in words]
        flat, upto = table.values(data, start, end, make)
        assert flat.tolist() == [len(w) for w in words for _ in w] and upto[-1] == len(flat)
        if step % 7 == 6:
            table.keep(10)
            assert len(table) == 10
