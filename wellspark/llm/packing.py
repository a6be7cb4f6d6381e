"""Documents packed into sequences of fixed length by minimum bin slack."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wellspark.llm.byte_bpe import byte_characters
from wellspark.llm.common import Remembered, stored

CAPACITY = 2048
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEPARATOR = 0
# ASCII marks that never belong to a token with letters or digits: no apostrophe, and none of <|> for special tokens.
CLOSING = b".,!?;:#$%&*+-/=@^_`~\"()[]{}\\"
# The last letter of the Latin blocks: up to it, lower-case letters are in normal form.
LATIN = "\u024f"
# Words that a task remembers the ids of (twice this many), and the longest such word in bytes.
REMEMBERED = 400_000
LONGEST = 64
# Pieces of one length that one task ranks.
RANKED = 1_000_000


class WordIds(Remembered):
    """word -> its token ids as little-endian 32-bit bytes.

    The vocabulary never merges across white space, so a text's ids are those of its words one after the
    other. ASCII words are looked up in lower case, and marks after a letter or digit by themselves: both are what the
    vocabulary's normalizer and pattern do. Words of lower-case Latin
    letters, which these leave as they are, go to its merges at once. The names of special tokens inside a text
    are read as those tokens, as the library does by default."""

    def __init__(self, path: str):
        super().__init__(REMEMBERED, LONGEST)
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.characters = dict(enumerate(byte_characters()))

    def made(self, word: bytes) -> bytes:
        if word.isalpha():
            if not word.islower():
                return self[word.lower()]
            ids = [t.id for t in self.merges.tokenize(word.decode())]
        elif (stem := word.rstrip(CLOSING)) != word and stem and (last := stem.decode()[-1].lower()).isalnum() and last <= LATIN:
            return self[stem] + self[word[len(stem) :]]
        elif (text := word.decode()).isalpha() and text == text.lower() and max(text) <= LATIN:
            ids = [t.id for t in self.merges.tokenize(word.decode("latin-1").translate(self.characters))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            docs, pieces, starts, lengths, sums, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary())):
                tokens = words.of(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    part = tokens[at : at + 4 * capacity]
                    docs.append(doc_id)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [
                pa.array(docs, pa.int64()),
                pa.array(pieces, pa.int32()),
                *(pa.array(c, pa.int64()) for c in (starts, lengths, sums)),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def tokenized(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document, closed by one separator; `ids` if asked for."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, with_ids), schema)


class Pattern(NamedTuple):
    """`bins` sequences that each hold the same lengths: (length, how many) from the longest down."""

    bins: int
    lengths: list[tuple[int, int]]


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within `room`, by bitset subset-sum.

    Bit s of `reach` says that some lengths add up to s. Each length enters in parts of 1, 2, 4, ... copies, so
    the steps grow with the logarithm of its count; the walk back through the steps finds the lengths."""
    reach, within, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        copies = 1
        while left > 0 and not reach >> room & 1:
            take = min(copies, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & within
            left -= take
            copies *= 2
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def minimum_slack(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all lengths: the longest left, and with it the fullest combination of the rest.

    A pattern is used as often as its lengths last, so the work depends on the number of different
    lengths (at most `capacity`), not on how many pieces there are."""
    left = {length: n for length, n in counts.items() if n}
    patterns = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        chosen = fullest({length: n for length, n in rest.items() if n}, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(left[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            left[length] -= bins * n
            if not left[length]:
                del left[length]
        patterns.append(Pattern(bins, sorted(chosen.items(), reverse=True)))
    return patterns


def _places(patterns: list[Pattern]) -> pa.Table:
    """For each pattern and length: the ranks that it takes, and where they go."""
    rows, used, first = [], {}, 0
    for bins, lengths in patterns:
        offset = 0
        for length, copies in lengths:
            start = used.get(length, 0)
            used[length] = start + bins * copies
            rows.append((length, start, used[length], copies, first, offset))
            offset += length * copies
        first += bins
    names = ["length", "first_rank", "end_rank", "copies", "first_sequence", "first_offset"]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id (from 0) and offset in it.

    Only the count of pieces per length reaches the driver: at most `capacity` numbers. The plan made of
    them is a table of ranks per length, small for the same reason. Ranks are counted in parts of about a
    million pieces, so one length that holds a third of all rows is no task of its own."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(_places(minimum_slack(counts, capacity)))
    parts = spark.createDataFrame(
        pa.table({"length": pa.array(list(counts), pa.int64()), "parts": pa.array([n // RANKED + 1 for n in counts.values()], pa.int64())})
    )
    # Both tables are bounded by the capacity: a few rows for each of at most `capacity` lengths.
    dealt = pieces.join(F.broadcast(parts), "length").withColumn(
        "_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    )
    before = Window.partitionBy("length").orderBy("_part")
    ahead = (
        dealt.groupBy("length", "_part")
        .agg(F.count("*").alias("n"))
        .select("length", "_part", (F.sum("n").over(before) - F.col("n")).alias("ahead"))
    )
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(inside)).join(ahead, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("ahead")).withColumnRenamed("length", "_length")
    plan = F.broadcast(plan)
    spot = (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("end_rank"))
    nth = F.col("_rank") - F.col("first_rank")
    return ranked.join(plan, spot).select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(nth, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset for every piece of `docs`.

    Only doc_id and text are read. A null or empty text is the separator alone; rows that repeat a doc_id
    are packed each; null ids stay null; an empty table gives no pieces."""
    return packed(stored(tokenized(docs, path, capacity, with_ids), "pieces"), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its token ids, from packed pieces with ids: at most one sequence's tokens per group."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))
