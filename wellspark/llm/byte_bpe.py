"""Byte-level BPE: texts to token ids and back, with a rank file and the tokenizers library."""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from wellspark.llm.common import Remembered

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Pieces of text that a task remembers the ids of (twice this many), and the longest such piece in bytes.
REMEMBERED = 400_000
LONGEST = 64

# A piece is white space and the run of other characters after it. The pattern never matches across the end of
# such a run, so pieces may be encoded one by one.
_PIECE = re.compile(rb"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
# White space beyond ASCII, and what Python calls so: a text with any of it is not taken apart.
_RARE_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")
_SEPARATORS = re.compile(rb"[\x1c-\x1f]")
# ASCII marks without the apostrophe, which may begin a match of its own kind.
_MARKS = ".,!?;:#$%&*+-/=@^_`~\"()[]{}\\<|>"
# The last letter of the Latin blocks, which every Unicode version knows as letters.
_LATIN = "\u024f"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str = RANKS) -> list[bytes]:
    """The tokens of a rank file, in order of their ids."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError(f"ranks in {path} have gaps")
    return tokens


def _parents(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens that the merge with this rank joins: what merges of lower ranks leave of the token."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joined = [rank.get(a + b, len(rank)) for a, b in zip(parts, parts[1:])]
        at = min(range(len(joined)), key=joined.__getitem__)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


def tokenizer_from_ranks(tokens: list[bytes], pattern: str = PATTERN) -> str:
    """A tokenizer of the tokenizers library with these tokens as its vocabulary, as JSON."""
    characters = byte_characters()
    rank = {t: i for i, t in enumerate(tokens)}

    def written(token: bytes) -> str:
        return "".join(characters[b] for b in token)

    merges = [tuple(map(written, _parents(t, rank))) for t in tokens if len(t) > 1]
    model = models.BPE({written(t): i for t, i in rank.items()}, merges)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer.to_str()


class PieceIds(Remembered):
    """piece of text -> its token ids as little-endian 32-bit bytes; remembers short pieces.

    Marks after a letter or digit, and one line break or tab before a word, are matches of their own and
    looked up by themselves. A word of Latin letters with at most one space before is one match: it goes to the
    merges at once, written in the characters that stand for its bytes."""

    def __init__(self, json: str):
        super().__init__(REMEMBERED, LONGEST)
        self.tokenizer = Tokenizer.from_str(json)
        self.merges = self.tokenizer.model
        self.characters = dict(enumerate(byte_characters()))

    def made(self, piece: bytes) -> bytes:
        if piece[:1] in (b"\n", b"\t", b"\r") and not piece[1:2].isspace() and len(piece) > 1:
            return self[piece[:1]] + self[piece[1:]]
        text = piece.decode()
        stem = text.rstrip(_MARKS)
        if stem != text and stem and stem[-1].isalnum() and stem[-1] <= _LATIN:
            cut = len(stem.encode())
            return self[piece[:cut]] + self[piece[cut:]]
        word = text.removeprefix(" ")
        if word.isalpha() and max(word) <= _LATIN:
            ids = [t.id for t in self.merges.tokenize(piece.decode("latin-1").translate(self.characters))]
            return array("I", ids).tobytes()
        return self.whole(piece)

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def of(self, text: bytes) -> bytes:
        if _SEPARATORS.search(text) or not text.isascii() and _RARE_SPACE.search(text.decode()):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _PIECE.findall(text)))


_encoders: dict[str, PieceIds] = {}


def encoded(spark: SparkSession, text: str | Column, path: str = RANKS, pattern: str = PATTERN) -> Column:
    """Token ids (array of int) of whole texts; null and empty texts have none. Strings that look like special
    tokens are ordinary text. The rank file is read on the driver only."""
    json = spark.sparkContext.broadcast(tokenizer_from_ranks(read_ranks(path), pattern))

    @F.arrow_udf("array<int>")
    def token_ids(texts: pa.Array) -> pa.Array:
        # One per Python worker, so that its memory of pieces lasts.
        if json.value not in _encoders:
            _encoders.clear()
            _encoders[json.value] = PieceIds(json.value)
        pieces = _encoders[json.value]
        ids = [pieces.of(t.as_py() or b"") for t in texts.cast(pa.binary())]
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))

    return token_ids(text)


def decoded(spark: SparkSession, ids: str | Column, path: str = RANKS) -> Column:
    """The bytes that token ids stand for (binary). A character may be split over tokens: bytes are joined first, and it
    is for the caller to read them as text (`decode_text`) once no token is missing. Unknown ids are an error."""
    tokens = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("binary")
    def token_bytes(lists: pa.Array) -> pa.Array:
        token, flat = tokens.value.__getitem__, lists.flatten().to_numpy()
        if flat.size and flat.min() < 0:
            raise ValueError("negative token id")
        ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())]).tolist()
        return pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in zip(ends, ends[1:])], pa.binary())

    return token_bytes(ids)


def decode_text(data: bytes) -> str:
    """Decoded bytes as text; a character whose bytes are not all there becomes one replacement character."""
    return data.decode("utf-8", "replace")


def offsets(spark: SparkSession, ids: str | Column, path: str = RANKS) -> Column:
    """For every token the place of its first byte, and of the character that this byte belongs to."""
    tokens = spark.sparkContext.broadcast(read_ranks(path))

    @F.arrow_udf("array<struct<byte:int,char:int>>")
    def places(lists: pa.Array) -> pa.Array:
        out = []
        for one in lists.to_pylist():
            parts = [tokens.value[i] for i in one or ()]
            begin = np.cumsum([0, *map(len, parts)])[:-1]
            data = np.frombuffer(b"".join(parts), np.uint8)
            characters = np.cumsum((data & 0xC0) != 0x80) - 1
            out.append([{"byte": b, "char": c} for b, c in zip(begin.tolist(), characters[begin].tolist())])
        return pa.array(out, pa.list_(pa.struct([("byte", pa.int32()), ("char", pa.int32())])))

    return places(ids)
