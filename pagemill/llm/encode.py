"""Encoding of whole texts with a public byte-level BPE vocabulary.

Short texts are encoded as they are. A long text is split into chunks at the pattern's own boundaries, and a part that the
pattern leaves unsplit (one long run of letters, say) is cut into segments; all are encoded in parallel. The encodings of
a part's segments are concatenated as a tree: around each join, a window of tokens of both sides is encoded again, and
grows until its first token is the left side's own and its last one the right side's own. A BPE encoding is right exactly
if each pair of neighbours is, so that agreement makes the joined encoding that of the whole part.

Defined results: null and empty texts give an empty list; blank texts are encoded; special tokens' strings are ordinary
text; rows are kept as they are, repeated or not; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are on every executor; a parameter of the operator.
VOCABULARIES = "/opt/tokenizers"
#: The split pattern of the vocabulary (a fixed value of the published format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text of more characters than this is encoded in chunks of about this many.
CHUNK_CHARS = 8_192
#: A part without a split of more bytes than this is cut into segments of at most that many.
SEGMENT_BYTES = 1_024

_PIECES = regex.compile(PATTERN)
#: What the pattern takes for white space; Python's own isspace has four control characters more.
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
_BLANKS = re.compile(r"\s{%d}" % (SEGMENT_BYTES // 4))


class Codec:
    """One vocabulary, with the encoding of unsplit parts by tree concatenation."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}

    def plain(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def segment(self, part: bytes) -> list[int]:
        """The encoding of bytes inside one unsplit part."""
        return self.encoding._encode_single_piece(part)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings of neighbouring bytes of one part."""
        if not left or not right:
            return left or right
        size = 2
        while True:
            i, j = min(size, len(left)), min(size, len(right))
            window = self.segment(b"".join(map(self.bytes_of.__getitem__, left[-i:] + right[:j])))
            if (i == len(left) or window[0] == left[-i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[: len(left) - i] + window + right[j:]
            size *= 2

    def tree(self, encodings: list[list[int]]) -> list[int]:
        """Neighbouring encodings of one part joined pairwise, level by level."""
        while len(encodings) > 1:
            pairs = [encodings[k : k + 2] for k in range(0, len(encodings), 2)]
            encodings = [self.join(*p) if len(p) == 2 else p[0] for p in pairs]
        return encodings[0] if encodings else []

    def encode(self, text: str, limit: int = SEGMENT_BYTES) -> list[int]:
        """The encoding of a whole text, by the tree where a part is long."""
        if max(map(len, text.split()), default=0) < SEGMENT_BYTES // 4 and not _BLANKS.search(text):
            return self.plain(text)
        out: list[int] = []
        for _, part, codes in sorted_parts((k, p, self.segment(b) if p >= 0 else self.plain(b.decode())) for k, p, b in split(text, len(text) + 1, limit)):
            out += self.tree(codes) if part >= 0 else codes[0]
        return out


def sorted_parts(rows) -> Iterator[tuple[int, int, list[list[int]]]]:
    """Encoded chunks in order, those of one unsplit part together: (first number, part or -1, encodings)."""
    held: tuple[int, int, list[list[int]]] | None = None
    for number, part, ids in sorted(rows, key=lambda r: r[0]):
        if held and part >= 0 and held[1] == part:
            held[2].append(ids)
            continue
        if held:
            yield held
        held = (number, part, [ids])
    if held:
        yield held


def split(text: str, chunk: int = CHUNK_CHARS, limit: int = SEGMENT_BYTES) -> list[tuple[int, int, bytes]]:
    """Chunks ``(number, part, bytes)`` of a text; ``part`` numbers the unsplit part a segment belongs to, -1 for chunks of whole parts."""
    chunks: list[tuple[int, int, bytes]] = []
    # safe: the end of the last piece before which no later text can change the pieces
    begin = end = safe = 0
    parts = 0

    def put(start: int, stop: int) -> None:
        if stop > start:
            chunks.append((len(chunks), -1, text[start:stop].encode()))

    for m in _PIECES.finditer(text):
        if m.end() - m.start() > limit // 4 and len(raw := m[0].encode()) > limit:
            # of several blanks before the part, the last is a piece of its own; at a chunk's end it would join the others
            last = end - 1 if end > begin and text[end - 1] in _SPACES else end
            put(begin, last)
            put(last, end)
            for at in range(0, len(raw), limit):
                chunks.append((len(chunks), parts, raw[at : at + limit]))
            parts += 1
            begin = end = m.end()
            continue
        if m.end() - begin > chunk and safe > begin:
            put(begin, safe)
            begin = safe
        end = m.end()
        if text[end - 1] not in _SPACES:
            safe = end
    put(begin, end)
    return chunks


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, once per Python worker; a file that isn't at its path is taken from the installed package of vocabularies."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(os.path.basename(path))
    return Codec(path)


def _ids(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def _encode_short(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), _ids([c.encode(t) if t else [] for t in texts])], names=["doc_id", "ids"])


def _split_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each row with a key of its id and text, so that rows of one id stay apart; equal rows have equal chunks."""
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            chunks = split(text)
            key = xxhash.xxh3_128_digest(f"{doc} {text}".encode("utf-8", "surrogatepass"))
            columns = [pa.array([key] * len(chunks), pa.binary()), pa.array([doc] * len(chunks), pa.int64()), *(pa.array(x, t) for x, t in zip(zip(*chunks, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "number", "part", "bytes"])


def _encode_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = codec(path)
    for batch in batches:
        ids = [c.segment(b) if p >= 0 else c.plain(b.decode()) for p, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], _ids(ids)], names=["key", "doc_id", "number", "part", "ids"])


def _join_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Joined rows; chunks that come more than once are those of as many equal rows."""
    c = codec(path)
    for batch in batches:
        docs, done = [], []
        for doc, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids: list[int] = []
            for _, part, codes in sorted_parts({x["number"]: (x["number"], x["part"], x["ids"]) for x in chunks}.values()):
                ids += c.tree(codes) if part >= 0 else codes[0]
            copies = sum(x["number"] == 0 for x in chunks)
            docs += [doc] * copies
            done += [ids] * copies
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), _ids(done)], names=["doc_id", "ids"])


def encoded(documents: DataFrame, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken", chunk: int = CHUNK_CHARS) -> DataFrame:
    """doc_id and ids of each document."""
    docs = documents.select("doc_id", "text")
    is_long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = docs.where(~is_long).mapInArrow(lambda b: _encode_short(b, vocabulary), "doc_id bigint, ids array<int>")
    chunks = docs.where(is_long).mapInArrow(_split_long, "key binary, doc_id bigint, number int, part int, bytes binary").repartition("key", "number")
    codes = chunks.mapInArrow(lambda b: _encode_chunks(b, vocabulary), "key binary, doc_id bigint, number int, part int, ids array<int>")
    whole = codes.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("number", "part", "ids")).alias("chunks"))
    return short.unionByName(whole.select("doc_id", "chunks").mapInArrow(lambda b: _join_chunks(b, vocabulary), "doc_id bigint, ids array<int>"))
