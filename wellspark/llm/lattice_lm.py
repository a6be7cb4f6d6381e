"""Language-model scores from a lattice of subword pieces: the probability of a text over all its segmentations."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellspark.llm.common import LOWER, stored

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
START = "▁"
# Rounds of expectation and maximisation that fit the pieces' weights.
ROUNDS = 2
# Words whose values every task holds, the most frequent ones; the others are joined. A bound on a broadcast only.
FREQUENT = 200_000
# Different words that one task fits or spells.
WORDS_IN_PART = 50_000
# Words of one task that are counted together before their rows are sent.
TOGETHER = 300_000
LOG10 = math.log(10)
# Words of one length that are solved together, and the longest that are; longer ones go one by one.
BATCH = 4096
TOGETHER_LENGTH = 64
# Fixed odd factor of the rolling hash, and the bits of the table that finds pieces by it.
FACTOR = 0x9E3779B97F4A7C15
TABLE_BITS = 20
# The end of a text, a token of its own; no word holds white space.
END = "\n"


def read_pieces(path: str = VOCABULARY) -> dict[str, float]:
    """Log-weights of the vocabulary's pieces from the scores it comes with.

    Its scores are negative ranks of merges; a rank r stands for a weight in proportion to 1 / (r + 1), as ranks of words
    do. Byte pieces are written <0xNN>."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            score = model.get_score(i)
            if score > -1e8:
                rank = model.get_piece_size() if model.is_byte(i) else -score
                pieces[model.id_to_piece(i)] = 1 / (rank + 1)
    pieces.setdefault(START, min(pieces.values()))
    total = sum(pieces.values())
    return {p: math.log(w / total) for p, w in pieces.items()}


class Lattice:
    """All segmentations of a word into pieces, and their weights.

    A character that is no piece has one arc, its bytes one after the other."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.bytes = [pieces.get(f"<0x{b:02X}>", -50.0) for b in range(256)]

    def arcs(self, word: str) -> list[list[tuple[int, float]]]:
        """For every end in START + word the arcs (start, log-weight) into it."""
        text, get = START + word, self.pieces.get
        into: list[list[tuple[int, float]]] = [[]]
        for end in range(1, len(text) + 1):
            found = [
                (start, weight)
                for start in range(max(0, end - self.longest), end)
                if (weight := get(text[start:end])) is not None
            ]
            if not found or found[-1][0] != end - 1:
                found.append((end - 1, sum(self.bytes[b] for b in text[end - 1].encode())))
            into.append(found)
        return into

    @staticmethod
    def forward(into: list[list[tuple[int, float]]]) -> list[float]:
        """Log of the total weight of all paths to each place."""
        reach = [0.0]
        for arcs in into[1:]:
            if len(arcs) == 1:
                reach.append(reach[arcs[0][0]] + arcs[0][1])
                continue
            paths = [reach[start] + weight for start, weight in arcs]
            best = max(paths)
            reach.append(best + math.log(sum([math.exp(p - best) for p in paths])))
        return reach

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the word's probability over all segmentations."""
        return self.forward(self.arcs(word))[-1]

    def expected(self, word: str, counts: dict[str, float], times: float) -> None:
        """Adds `times` the expected uses of each piece in the word, by a backward pass over the same arcs."""
        into = self.arcs(word)
        reach = self.forward(into)
        text = START + word
        share = [0.0] * len(into)
        share[-1] = times
        for end in range(len(into) - 1, 0, -1):
            if not share[end]:
                continue
            arcs = into[end]
            for start, weight in arcs:
                part = share[end] if len(arcs) == 1 else share[end] * math.exp(reach[start] + weight - reach[end])
                share[start] += part
                piece = text[start:end]
                if piece in self.pieces:
                    counts[piece] = counts.get(piece, 0.0) + part
                else:
                    for b in piece.encode():
                        name = f"<0x{b:02X}>"
                        counts[name] = counts.get(name, 0.0) + part


class Lattices:
    """Lattice for many words at once: words of one length are rows of arrays.

    Pieces are found by a 64-bit rolling hash in an open table; the recursions are the same, in log space."""

    def __init__(self, pieces: dict[str, float]):
        self.single = Lattice(pieces)
        self.names = list(pieces)
        self.none = len(self.names)
        self.weights = np.append(np.array(list(pieces.values())), -np.inf)
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.ids = np.full(1 << TABLE_BITS, self.none)
        self.powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(self.single.longest, FACTOR, np.uint64)])
        self.probes = 1
        for number, name in enumerate(self.names):
            key = 0
            for character in name:
                key = (key * FACTOR + ord(character) + 1) % (1 << 64)
            slot, probe = self._slot(key), 1
            while self.keys[slot]:
                if self.keys[slot] == key:
                    raise ValueError("two pieces have one hash")
                slot, probe = (slot + 1) % (1 << TABLE_BITS), probe + 1
            self.keys[slot], self.ids[slot] = key, number
            self.probes = max(self.probes, probe)

    @staticmethod
    def _slot(key):
        if isinstance(key, int):
            return (key * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> (64 - TABLE_BITS)
        return ((key * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ids[slot], self.none)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        for _ in range(1, self.probes):
            if not open_.size:
                break
            slot[open_] = (slot[open_] + 1) % (1 << TABLE_BITS)
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.ids[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out

    def _characters(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different characters, which of them each place has, and their weights and pieces as arcs of one character."""
        kinds, place = np.unique(codes, return_inverse=True)
        numbers = self._find(kinds.astype(np.uint64) + np.uint64(1))
        weights = self.weights[numbers]
        for k in np.flatnonzero(numbers == self.none):
            weights[k] = sum(self.single.bytes[b] for b in chr(kinds[k]).encode())
        return kinds, place.reshape(codes.shape), weights, numbers

    def _solve(self, words: list[str], uses: np.ndarray | None, spelled: dict[str, float]) -> np.ndarray:
        """Log-probabilities of words of one length; adds the expected uses of the pieces to `uses` if given."""
        length = len(words[0]) + 1
        codes = np.frombuffer("".join(START + w for w in words).encode("utf-32-le"), "<u4").reshape(len(words), length)
        kinds, place, weights, numbers = self._characters(codes)
        sums = [np.zeros(len(words), np.uint64)]
        for k in range(length):
            sums.append(sums[-1] * np.uint64(FACTOR) + codes[:, k] + np.uint64(1))
        arcs, reach = {}, [np.zeros(len(words))]
        for end in range(1, length + 1):
            paths = []
            for start in range(max(0, end - self.single.longest), end):
                if end - start == 1:
                    arcs[start, end] = numbers[place[:, start]], weights[place[:, start]]
                else:
                    found = self._find(sums[end] - sums[start] * self.powers[end - start])
                    if (found == self.none).all():
                        continue
                    arcs[start, end] = found, self.weights[found]
                paths.append(reach[start] + arcs[start, end][1])
            reach.append(_log_sum(paths))
        if uses is None:
            return reach[-1]
        ahead: list = [None] * length + [np.zeros(len(words))]
        for start in range(length - 1, -1, -1):
            ends = [end for end in range(start + 1, length + 1) if (start, end) in arcs]
            ahead[start] = _log_sum([arcs[start, end][1] + ahead[end] for end in ends])
        for (start, end), (found, weight) in arcs.items():
            share = np.exp(reach[start] + weight + ahead[end] - reach[-1])
            uses += np.bincount(found, weights=share, minlength=self.none + 1)
            if end - start == 1 and (spelt := np.flatnonzero(found == self.none)).size:
                for k, part in zip(place[spelt, start], share[spelt]):
                    for b in chr(kinds[k]).encode():
                        name = f"<0x{b:02X}>"
                        spelled[name] = spelled.get(name, 0.0) + part
        return reach[-1]

    def _groups(self, words: list[str]) -> Iterator[np.ndarray]:
        sizes = np.array(list(map(len, words)))
        for size in np.unique(sizes[sizes < TOGETHER_LENGTH]):
            at = np.flatnonzero(sizes == size)
            yield from np.array_split(at, len(at) // BATCH + 1)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for at in self._groups(words):
            out[at] = self._solve([words[i] for i in at], None, {})
        for i in np.flatnonzero([len(w) >= TOGETHER_LENGTH for w in words]):
            out[i] = self.single.log_probability(words[i])
        return out

    def expected(self, words: list[str], counts: dict[str, float]) -> None:
        """Adds the expected uses of each piece in the words, each counted once."""
        uses = np.zeros(self.none + 1)
        for at in self._groups(words):
            self._solve([words[i] for i in at], uses, counts)
        for i in np.flatnonzero(uses[:-1]):
            counts[self.names[i]] = counts.get(self.names[i], 0.0) + float(uses[i])
        for word in words:
            if len(word) >= TOGETHER_LENGTH:
                self.single.expected(word, counts, 1.0)


def _log_sum(paths: list[np.ndarray]) -> np.ndarray:
    rows = np.stack(paths)
    best = rows.max(axis=0)
    return best + np.log(np.exp(rows - best).sum(axis=0))


def _words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count in training texts) of what a task reads, counted together; zero for words of other texts only."""
    counts: dict[bytes, int] = {}
    ends = 0

    def rows() -> pa.RecordBatch:
        words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text, held in zip(batch["text"].cast(pa.binary()), batch["held_out"].to_pylist()):
            words = _words(text.as_py() or b"")
            if held:
                for word in set(words):
                    counts.setdefault(word, 0)
            else:
                ends += 1
                get = counts.get
                for word in words:
                    counts[word] = get(word, 0) + 1
            if len(counts) >= TOGETHER:
                yield rows()
                counts.clear()
    counts[END.encode()] = ends
    yield rows()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often the training texts of (text, held_out) rows have each word of all texts, and END."""
    return docs.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fitted(spark: SparkSession, words: DataFrame, pieces: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Log-weights of the pieces after `rounds` of expectation and maximisation over all training words.

    Every different word counts once: the lattice has to spell new words, which are like rare ones. Each task sends a
    number per piece; the driver sees the vocabulary only."""
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(pieces)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattices, counts = Lattices(shared.value), {}
            for batch in batches:
                lattices.expected(batch["word"].to_pylist(), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.float64())], ["piece", "uses"]
            )

        found = words.where("n > 0").select("word").mapInArrow(expect, "piece string, uses double")
        uses = {r["piece"]: r["uses"] for r in found.groupBy("piece").agg(F.sum("uses").alias("uses")).collect()}
        # One use more, spread by the old weights, keeps every piece possible.
        total = math.fsum(uses.values()) + 1
        pieces = {p: math.log((uses.get(p, 0.0) + math.exp(w)) / total) for p, w in pieces.items()}
    return pieces


def _valued(spark: SparkSession, words: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """`words` with `spelled`, the natural logarithm of the lattice's probability of each."""
    shared = spark.sparkContext.broadcast(pieces)

    @F.arrow_udf("double")
    def spelled(words: pa.Array) -> pa.Array:
        return pa.array(_lattices(shared.value).log_probabilities(words.to_pylist()), pa.float64())

    return words.withColumn("spelled", spelled("word"))


_known: dict[int, Lattices] = {}


def _lattices(pieces: dict[str, float]) -> Lattices:
    """The lattices of these pieces, made once per Python worker."""
    if id(pieces) not in _known:
        _known.clear()
        _known[id(pieces)] = Lattices(pieces)
    return _known[id(pieces)]


def _partial(spark: SparkSession, words: list[str], values: np.ndarray):
    """Sums over the frequent words of each text, and the words that are not among them with their counts.

    `values` has for each of `words` the count, the base and the value."""
    shared = spark.sparkContext.broadcast(({w.encode(): i for i, w in enumerate(words)}, np.append(values, np.zeros((1, 3)), axis=0)))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = shared.value
        for batch in batches:
            n, known, sums, rare, times = [], [], [], [], []
            for text in batch["text"].cast(pa.binary()):
                tokens = _words(text.as_py() or b"")
                n.append(len(tokens) + 1)
                # The last row of the table, all zero, stands for the others.
                at = np.array([places.get(w, -1) for w in tokens], np.int64)
                hit = table[at]
                known.append(int((hit[:, 0] > 0).sum()))
                sums.append(hit[:, 1:].sum(axis=0))
                left = Counter([tokens[i] for i in np.flatnonzero(at < 0)])
                rare.append(list(left))
                times.append(list(left.values()))
            base, score = np.array(sums).reshape(-1, 2).T
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch[c] for c in names),
                    *(pa.array(c, pa.int64()) for c in (n, known)),
                    *(pa.array(c, pa.float64()) for c in (base, score)),
                    pa.array(rare, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array(times, pa.list_(pa.int64())),
                ],
                [*names, "n_tokens", "n_known", "base_score", "score", "rare", "times"],
            )

    return partial


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; rows without an id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def lattice_scores(docs: DataFrame, path: str = VOCABULARY, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row of `docs`.

    A word's probability sums over all ways to make it: as one whole-word arc, weighted by its count, or piece by piece. The
    pieces' arcs share the part of the mass that words seen once had (Good-Turing), the END takes its count's share. Counts
    cover all training texts; words are counted in each task before the shuffle, so no word is a hot key. Values
    of the `frequent` most frequent words are broadcast and the rest joined, with the same result.

    Only doc_id and text are read. Null texts count as empty and have the end alone; repeated rows are texts each;
    an empty table gives an empty result."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = stored(word_counts(texts.select("text", "held_out")), "words")
    totals = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count_if(F.col("n") > 0).alias("kinds"), F.count_if(F.col("n") == 1).alias("once")
    ).first()
    tokens, kinds = totals["tokens"], totals["kinds"]
    # The part of the mass that goes to the lattice, never none and never all.
    new = (totals["once"] + 1) / (tokens + 2)
    # Words are few bytes and much work: more and smaller parts than a scan would make.
    words = counts.where(F.col("word") != END).repartition(counts.count() // WORDS_IN_PART + 1)
    pieces = fitted(spark, words, read_pieces(path), rounds)
    valued = _valued(spark, words, pieces)
    base = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / (tokens + 0.1 * (kinds + 1)))
    whole = F.log(F.lit(1 - new)) + F.log(F.col("n") / max(tokens, 1))
    part = F.col("spelled") + math.log(new)
    high, low = F.greatest(whole, part), F.least(whole, part)
    both = F.when(F.col("n") > 0, high + F.log1p(F.exp(low - high))).otherwise(part)
    values = stored(valued.select("word", "n", base.alias("base"), (both / LOG10).alias("value")), "values")

    top = values.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    table = np.stack([top[c].to_numpy().astype(float) for c in ("n", "base", "value")], axis=1)
    ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    end_base = math.log10((ends + 0.1) / (tokens + 0.1 * (kinds + 1)))
    end_value = math.log10((ends + 0.5) / (tokens + 1)) + math.log10(1 - new)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<string>, times array<long>"
    partial = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text")
    partial = stored(partial.mapInArrow(_partial(spark, top["word"].to_pylist(), table), schema), "partial")
    each = partial.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    each = each.select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    sums = (
        each.join(values, "word")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
            F.sum(F.col("times") * F.col("base")).alias("_base"),
            F.sum(F.col("times") * F.col("value")).alias("_value"),
        )
    )
    zero = F.lit(0.0)
    return partial.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("_base", zero) + end_base).alias("base_score"),
        (F.col("score") + F.coalesce("_value", zero) + end_value).alias("score"),
    )
