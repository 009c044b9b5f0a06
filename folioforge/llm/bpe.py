"""Byte-level BPE encoding and decoding over a public rank file.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over all tokens finds
every token inside a piece. The encoder walks the piece from the longest match at each place and
backtracks to the next shorter one while two adjacent tokens could not stand side by side in the
result of the merges; that test on pairs is memoised. Each place is entered at most once for each
token length, so the work is linear in the piece, and the tokens are exactly those of the merges.

Pieces are the matches of the tokenizer's pattern. A single space between two characters that are
not white space always starts a piece, so a text is cut there, and the results for the parts are
memoised in a table of bounded size.

Defined results: a null text is empty and has no ids. Extra columns are ignored, repeated rows
give repeated results, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import Memo, map_batches, strings

#: Entries of the memo tables of a Python worker: words, other pieces, pairs of adjacent tokens.
MEMO_WORDS, MEMO_PIECES, MEMO_PAIRS = 100_000, 60_000, 60_000
_MARKS = ".,;:!?%$#&*()"
_USUAL = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
_ODD_SPACE = re.compile(r" \s|\s |^ | $")


class BytePairCoder:
    """Encodes and decodes texts by the ranks of ``vocabulary`` (lines of base64 token, rank)."""

    def __init__(self, vocabulary: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        self.pattern, self.usual = regex.compile(pattern), _USUAL in pattern
        self.ids = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.size = [len(t) for t in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.shorter = self._shorter()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes_of))]
        for rank, token in enumerate(self.bytes_of):
            if len(token) > 1:
                self._split(rank, token)
        self.fits = Memo(lambda pair: self._adjacent(pair >> 32, pair & 0xFFFFFFFF), MEMO_PAIRS)
        self.words = Memo(self._encode_word, MEMO_WORDS)
        self.pieces = Memo(self._encode_piece, MEMO_PIECES)

    def _shorter(self) -> list[int]:
        """For each token, the longest other token that starts it, or -1."""
        out = []
        for token in self.bytes_of:
            n = len(token) - 1
            while n > 0 and token[:n] not in self.ids:
                n -= 1
            out.append(self.ids[token[:n]] if n > 0 else -1)
        return out

    def _split(self, rank: int, token: bytes) -> None:
        """Find the two tokens whose merge makes ``token``."""
        left = self.shorter[rank]
        while left >= 0:
            right = self.ids.get(token[self.size[left] :], -1)
            if 0 <= right < rank and left < rank and self._adjacent(left, right):
                self.merged[left, right] = rank
                self.parts[rank] = (left, right)
                return
            left = self.shorter[left]

    def _adjacent(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side.

        Undo the later merge of the two again and again; if at some time the tokens that meet at
        the border could have been merged before the merge just undone, they would have been.
        """
        merged, parts, limit = self.merged, self.parts, 1 << 40
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            inner_l, inner_r = parts[left][1], parts[right][0]
            whole_l, whole_r = inner_l == left, inner_r == right
            if whole_l and whole_r:
                return True
            if not whole_l and (whole_r or left > right):
                limit, left = left, inner_l
            else:
                limit, right = right + 1, inner_r

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ids.get(raw)
        if whole is not None:
            return struct.pack("<I", whole)
        size, shorter, fits = self.size, self.shorter, self.fits
        longest = [0] * len(raw)
        for end, token in self.automaton.iter(raw.decode("latin-1")):
            longest[end + 1 - size[token]] = token  # ends rise, so the longest comes last
        n, at, out = len(raw), 0, []
        closed = bytearray(n + 1)
        token = longest[0]
        while at < n:
            while token >= 0 and (closed[at + size[token]] or (out and not fits[out[-1] << 32 | token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
        return struct.pack(f"<{len(out)}I", *out)

    def _encode_word(self, word: str) -> bytes:
        """A word with the space before it. Letters and a tail of marks are a piece each."""
        stem = word.rstrip(_MARKS)
        if stem.isalpha() and self.usual:
            tail = word[len(stem) :]
            return self._encode_piece(" " + stem) + (self.pieces[tail] if tail else b"")
        return self._encode_part(" " + word)

    def _encode_part(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._encode_part(text)
        first, *rest = text.split(" ")
        return self._encode_part(first) + b"".join(map(self.words.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


_coders: dict[tuple[int, str], BytePairCoder] = {}


def coder(vocabulary: bytes, pattern: str) -> BytePairCoder:
    """The coder of this Python worker, made once."""
    key = (hash(vocabulary), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = BytePairCoder(vocabulary, pattern)
    return _coders[key]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """One row per document: doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256, decoded_sha256.

    ``vocabulary`` is the path of a rank file on the driver; its content, a few MB whatever the
    corpus, is broadcast. ``ids=False`` leaves the ids out.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = coder(shared.value, pattern)
        Memo.keep_only(c.words, c.pieces, c.fits)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded, counts, digests, decoded = [], [], [], []
            for text in strings(batch.column(1)):
                x = c.encode(text)
                if ids:
                    coded.append(x)
                counts.append(len(x) // 4)
                digests.append(hashlib.sha256(x).hexdigest())
                decoded.append(hashlib.sha256(c.decode(x)).hexdigest())
            own = [pa.array(coded, pa.binary())] if ids else []
            names = ["doc_id", *(["ids"] if ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
            return pa.RecordBatch.from_arrays([batch.column(0), *own, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=names)

        return run

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, {'ids binary, ' if ids else ''}n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")), make, schema)
    return out.withColumnRenamed("doc_id", id_col)


def decode_ids(coded: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per document: doc_id, decoded (the bytes its ids stand for)."""
    with open(vocabulary, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())

    def make():
        c = coder(shared.value, pattern)
        Memo.keep_only(c.words, c.pieces, c.fits)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            decoded = [c.decode(x or b"") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

        return run

    kind = dict(coded.dtypes)[id_col]
    return map_batches(coded.select(F.col(id_col).alias("doc_id"), ids_col), make, f"doc_id {kind}, decoded binary").withColumnRenamed("doc_id", id_col)
