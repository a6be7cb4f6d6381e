"""Phrase collocations from a weighted de Bruijn graph: its edges are the longest grams, shorter counts are the flow of its nodes."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspark.llm.common import LOWER, stored

LONGEST = 3
LEAST = 10
TOP = 2000
# A candidate goes if a longer one that holds it has at least this percentage of its count.
INSIDE = 50
# Bytes of text behind one bucket of grams, about; it bounds a task's memory.
BUCKET = 8_000_000
# Words (and ends) that a task counts at once, different ones among them, and bytes of text that it splits at once.
WORDS, KINDS, PART = 4_000_000, 1 << 20, 1 << 21
# Rounds in which pieces of unary paths are joined: a piece has at most 2 ** ROUNDS nodes.
ROUNDS = 6
# Parts of a language that are ranked by themselves first.
RANKED = 64
# The characters that end a piece, all told as a full stop, and the blank that a tab is.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(_ENDS + b"\t", b"." * len(_ENDS) + b" ")
_BREAK = re.compile(rb"[ .]")
_RUN = "bucket int, lang string, grams string, counts array<long>"


def _runs(lang: str, grams: pa.Array, counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Grams of one language dealt to their buckets: per bucket a row that holds them line by line, with their counts."""
    lines = grams.to_pylist()
    seed = crc32(lang.encode())
    bucket = np.fromiter((crc32(g, seed) for g in lines), np.uint32, len(lines)) % buckets
    order = np.argsort(bucket, kind="stable")
    ends = np.flatnonzero(np.r_[bucket[order][1:] != bucket[order][:-1], True]) + 1 if lines else []
    start = 0
    for end in ends:
        at = order[start:end]
        start = end
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([bucket[at[0]]], pa.int32()),
                pa.array([lang], pa.string()),
                pa.array([b"\n".join([lines[i] for i in at])], pa.binary()).cast(pa.string()),
                pa.array([counts[at]], pa.list_(pa.int64())),
            ],
            names=["bucket", "lang", "grams", "counts"],
        )


class _Counter:
    """Counts the grams of a task's words: each word with the two that follow it in its piece, or as many as there are."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        # Number 0 is the end of a piece.
        self.numbers: dict[bytes, int] = defaultdict(count(1).__next__)
        self.numbers[b"."] = 0
        self.words: dict[str, list[np.ndarray]] = defaultdict(list)
        self.size = 0

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(text):
            to = at + PART
            if to < len(text):
                # Words stay whole: a part ends before a blank or a mark, or with the text.
                cut = _BREAK.search(text, to)
                to = cut.start() if cut else len(text)
            yield from self._add(lang, text[at:to])
            at = to
        self._put(lang, [b".", b"."])

    def _add(self, lang: str, plain: bytes) -> Iterator[pa.RecordBatch]:
        self._put(lang, plain.replace(b".", b" . ").split())
        if self.size >= WORDS or len(self.numbers) >= KINDS:
            yield from self.flushed(False)

    def _put(self, lang: str, words: list[bytes]) -> None:
        self.words[lang].append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def flushed(self, last: bool) -> Iterator[pa.RecordBatch]:
        names = pa.array(self.numbers.keys(), pa.binary())
        order = np.fromiter(self.numbers.values(), np.int64, len(self.numbers))
        names = names.take(pa.array(np.argsort(order)))
        # What is numbered needs neither the numbers' table nor, once counted, the numbers themselves.
        self.numbers.clear()
        rest = {}
        for lang in list(self.words):
            ids = np.concatenate(self.words.pop(lang))
            # The last two words of a text that goes on are counted with what follows them.
            rest[lang] = [names[i].as_py() for i in ids[-2:].tolist()]
            first, second, third = ids[:-2], ids[1:-1], ids[2:]
            third = np.where(second == 0, 0, third)
            codes = (first << 42) | (second << 21) | third
            codes, counts = np.unique(codes[first > 0], return_counts=True)
            del ids, first, second, third
            sizes = 1 + ((codes >> 21) & (KINDS * 2 - 1) > 0) + (codes & (KINDS * 2 - 1) > 0)
            found, much = [], []
            for size in range(1, LONGEST + 1):
                mine = codes[sizes == size]
                words = [names.take(pa.array((mine >> shift) & (KINDS * 2 - 1))) for shift in (42, 21, 0)[:size]]
                found.append(pc.binary_join_element_wise(*words, b" ") if size > 1 else words[0])
                much.append(counts[sizes == size])
            grams, much = pa.concat_arrays(found), np.concatenate(much)
            del codes, counts, sizes, mine, words, found
            yield from _runs(lang, grams, much, self.buckets)
        self.clear()
        if not last:
            for lang, words in rest.items():
                self._put(lang, words)


def _counted(buckets: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(buckets)
        for batch in batches:
            texts = batch["text"].cast(pa.binary())
            for lang, text in zip(batch["lang"].to_pylist(), texts):
                # UTF-8 has no byte of A to Z, a blank or a mark inside another character.
                plain = text.as_py().translate(LOWER).translate(_PLAIN)
                yield from counter.add(lang, plain)
        yield from counter.flushed(True)

    return runs


def _merged(size: int, buckets: int):
    """Counts of the grams of a bucket; out come those of `size` words and the flow of the nodes that they start with."""

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        heavy: list[pa.RecordBatch] = []
        for lang in pc.unique(runs["lang"]).to_pylist():
            mine = runs.filter(pc.equal(runs["lang"], lang))
            grams = pc.split_pattern(mine["grams"].combine_chunks().cast(pa.binary()), b"\n").flatten()
            counts = mine["counts"].combine_chunks().flatten()
            total = pa.table({"g": grams, "n": counts}).group_by("g").aggregate([("n", "sum")])
            whole = pc.equal(pc.count_substring(total["g"], b" "), size - 1)
            full = total.filter(whole)
            if size > 1:
                nodes = pc.list_element(pc.split_pattern(full["g"].combine_chunks(), b" ", max_splits=1, reverse=True), 0)
                flow = pa.concat_tables([pa.table({"g": nodes, "n": full["n_sum"]}), total.filter(pc.invert(whole)).rename_columns(["g", "n"])])
                flow = flow.group_by("g").aggregate([("n", "sum")]).combine_chunks()
                if len(flow):
                    heavy += _runs(lang, flow["g"].combine_chunks(), flow["n_sum"].to_numpy(), buckets)
            elif len(full):
                # All word occurrences, under no gram.
                heavy.append(_row(lang, b"", [pc.sum(full["n_sum"]).as_py()]))
            full = full.filter(pc.greater_equal(full["n_sum"], LEAST))
            if len(full):
                heavy.append(_row(lang, b"\n".join(full["g"].to_pylist()), full["n_sum"].to_pylist()))
        return pa.Table.from_batches(heavy, schema=_SCHEMA)

    return merge


_SCHEMA = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("grams", pa.string()), ("counts", pa.list_(pa.int64()))])


def _row(lang: str, grams: bytes, counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([None], pa.int32()), pa.array([lang]), pa.array([grams.decode()]), pa.array([counts], pa.list_(pa.int64()))], schema=_SCHEMA
    )


def _listed(runs: DataFrame) -> DataFrame:
    """lang, gram, n of the counted grams of all buckets."""
    lines = F.arrays_zip(F.split("grams", "\n").alias("gram"), F.col("counts").alias("n"))
    return runs.where("bucket IS NULL").select("lang", F.explode(lines).alias("x")).select("lang", "x.gram", "x.n")


def graph(docs: DataFrame, bucket: int = BUCKET) -> list[DataFrame]:
    """Tables (lang, gram, n) of the phrases of 1, 2 and 3 words that occur LEAST times or more in their language, and, under the
    empty gram in the first, all word occurrences.

    Only the longest grams are counted in the texts: every word with the two that follow it is an edge of the graph from
    the node of its first two words to that of its last two, and the last words of a piece are kept as shorter grams. The
    count of a node is the flow of the edges that leave it and of the pieces that end in it, that of a word the flow
    of its nodes likewise. Grams travel as sorted runs, one row per task and bucket; a gram has one bucket, whatever
    it starts with, so frequent words and pairs are dealt over all buckets."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = size // bucket + 1
    runs = texts.mapInArrow(_counted(buckets), _RUN)
    levels = []
    for words in range(LONGEST, 0, -1):
        runs = stored(runs.groupBy("bucket").applyInArrow(_merged(words, buckets), _RUN), f"grams{words}")
        levels.append(_listed(runs))
        runs = runs.where("bucket IS NOT NULL")
    return levels[::-1]


def _part(gram: str, first: int, last: int | None = None) -> Column:
    """Words first to last of a gram."""
    words = F.split(gram, " ")
    return F.array_join(F.slice(words, first, (last - first + 1) if last else F.size(words)), " ")


def nodes(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """lang, gram and n of every pair of words, and of its heaviest edges: into_n, into_word (the word before) and out_n, out_word."""
    none = F.lit(None).cast("struct<n:bigint,word:string>")
    rows = pairs.select("lang", "gram", F.col("n").alias("own"), none.alias("into"), none.alias("out"))
    out = F.struct("n", _part("gram", 3).alias("word"))
    rows = rows.unionAll(edges.select("lang", _part("gram", 1, 2), F.lit(None).cast("long"), none, out))
    into = F.struct("n", _part("gram", 1, 1).alias("word"))
    rows = rows.unionAll(edges.select("lang", _part("gram", 2, 3), F.lit(None).cast("long"), into, none))
    found = rows.groupBy("lang", "gram").agg(F.max("own").alias("n"), F.max("into").alias("into"), F.max("out").alias("out"))
    return found.select(
        *("lang", "gram", "n", F.col("into.n").alias("into_n"), F.col("into.word").alias("into_word")),
        *(F.col("out.n").alias("out_n"), F.col("out.word").alias("out_word")),
    )


def unary_paths(placed: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Compacted pieces of unary paths: lang, n, head, next and words, the piece's words in order and then the word that follows.

    A node is unary if all its occurrences come by one edge and leave by one. Its edges have its count, so a path of such
    nodes has one count throughout. In each round a piece may take the one that follows it: which of the two
    asks and which is asked is drawn by hash, so every piece has a part in one joining at most and no piece is
    gathered anywhere but from two. Pieces that ask where no piece starts stay as they are; many may do so at one node, which
    is not unary then. Pieces stay below 2 ** rounds nodes; what is not joined stays a piece of its own."""
    unary = placed.where("into_n = n AND out_n = n")
    following = F.concat_ws(" ", _part("gram", 2, 2), F.col("out_word"))
    pieces = unary.select("lang", "n", F.col("gram").alias("head"), following.alias("next"), F.concat(F.split("gram", " "), F.array("out_word")).alias("words"))
    for number in range(rounds):
        asks = F.pmod(F.xxhash64("head", F.lit(number)), F.lit(2)) == 0
        piece = F.struct("n", "head", "next", "words")
        asking = pieces.where(asks).select("lang", F.col("next").alias("at"), piece.alias("p"))
        asked = pieces.where(~asks).select("lang", F.col("head").alias("at"), piece.alias("q"))
        met = asking.join(asked, ["lang", "at"], "full")
        # A piece's last two words are the head of the next one.
        words = F.when(F.col("p").isNull(), F.col("q.words")).when(F.col("q").isNull(), F.col("p.words"))
        words = words.otherwise(F.concat("p.words", F.slice("q.words", 3, F.size("q.words"))))
        pieces = stored(
            met.select(
                *("lang", F.coalesce("p.n", "q.n").alias("n"), F.coalesce("p.head", "q.head").alias("head")),
                *(F.coalesce("q.next", "p.next").alias("next"), words.alias("words")),
            ),
            "paths",
        )
    return pieces


def _triples(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """lang, gram, n of every edge with the counts of its nodes, `front` and `back`.

    Edges that leave a unary node come from the compacted paths: front is the path's count, and so is back, but for the last
    edge of a piece, whose end is looked up like those of all other edges."""
    unary = F.col("into_n").eqNullSafe(F.col("n")) & F.col("out_n").eqNullSafe(F.col("n"))
    counts = placed.select("lang", F.col("gram").alias("node"), F.col("n").alias("node_n"), F.coalesce(unary, F.lit(False)).alias("unary"))
    at = F.explode(F.sequence(F.lit(1), F.size("words") - 2))
    path = unary_paths(placed).select("lang", "n", "words", at.alias("i"))
    path = path.select(
        *("lang", F.array_join(F.slice("words", F.col("i"), 3), " ").alias("gram"), "n", F.col("n").alias("front")),
        F.when(F.col("i") < F.size("words") - 2, F.col("n")).alias("back"),
    )
    start = edges.withColumn("node", _part("gram", 1, 2)).join(counts, ["lang", "node"])
    plain = start.where("NOT unary").select("lang", "gram", "n", F.col("node_n").alias("front"), F.lit(None).cast("long").alias("back"))
    known = path.where("back IS NOT NULL")
    open_ends = path.where("back IS NULL").unionAll(plain).drop("back").withColumn("node", _part("gram", 2, 3))
    ended = open_ends.join(counts.drop("unary"), ["lang", "node"])
    return known.unionAll(ended.select("lang", "gram", "n", "front", F.col("node_n").alias("back")))


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: products have up to 38 digits."""
    wide = [x.cast("decimal(16,0)") for x in (a, l, r)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide[0] * wide[0]).cast("decimal(31,0)"), wide[1] * wide[2])


def phrases(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 and 3 words.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score, floor(1000000 a a / (l r)), of cuts
    with equal scores the first; n all words of the language. A phrase inside a longer one that has half its count or
    more is left out. Ranks go by score and count descending, then by phrase. Null languages are `und`; null and empty texts have no
    words; repeated rows count each time; texts of any length are read in parts; an empty table, or one without a
    phrase that occurs ten times, gives an empty result. Only lang and text are read."""
    words, pairs, edges = graph(docs)
    # The three tables are small beside the text, and read several times.
    total = words.where("gram = ''").groupBy("lang").agg(F.sum("n").alias("total"))
    words = words.where("gram <> ''")
    placed = stored(nodes(pairs, edges), "nodes")
    inside = F.greatest(F.coalesce("into_n", F.lit(0)), F.coalesce("out_n", F.lit(0)))
    free = placed.where(100 * inside < INSIDE * F.col("n"))
    none = F.lit(None).cast("long")
    rows = free.select("lang", "gram", "n", none.alias("front"), none.alias("back"))
    rows = rows.unionAll(_triples(edges, placed).select("lang", "gram", "n", "front", "back"))
    ends = rows.withColumns({"first": _part("gram", 1, 1), "last": F.element_at(F.split("gram", " "), -1)})
    for end in ("first", "last"):
        ends = ends.join(words.select("lang", F.col("gram").alias(end), F.col("n").alias(f"{end}_n")), ["lang", end])
    # Cut 1 leaves the back (or the last word), cut 2 the front.
    early = F.struct(_score(F.col("n"), F.col("first_n"), F.coalesce("back", "last_n")).alias("score"), F.col("first_n").alias("l"), F.coalesce("back", "last_n").alias("r"))
    late = F.struct(_score(F.col("n"), F.col("front"), F.col("last_n")).alias("score"), F.col("front").alias("l"), F.col("last_n").alias("r"))
    cut = F.when(late["score"] < early["score"], late).otherwise(early)
    scored = ends.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    best = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    best = best.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    best = best.where(F.col("rank") <= top).join(total, "lang")
    return best.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


# The same result in SQL: all grams of all sizes counted as rows.
SQL = f"""
WITH text AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
piece AS (SELECT row_number() OVER () AS p, lang, list_filter(regexp_split_to_array(x, '[\\x20\\x09]+'), lambda w: w <> '') AS ws
  FROM (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS x FROM text)),
word AS (SELECT p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM piece),
run AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM word WINDOW x AS (PARTITION BY p ORDER BY i)),
gram AS (
  SELECT lang, 1 AS size, w1 AS g, w1 AS h, '' AS t, w1 AS first, w1 AS last, count(*) AS n FROM run GROUP BY lang, w1
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, w1, w2, w1, w2, count(*) FROM run WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, w1 || ' ' || w2, w2 || ' ' || w3, w1, w3, count(*) FROM run
    WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
candidate AS (SELECT * FROM gram WHERE size > 1 AND n >= {LEAST}),
kept AS (
  SELECT * FROM candidate c WHERE NOT EXISTS (
    SELECT 1 FROM candidate b WHERE b.size = 3 AND c.size = 2 AND b.lang = c.lang AND (b.h = c.g OR b.t = c.g) AND 100 * b.n >= {INSIDE} * c.n)),
cut AS (
  SELECT c.lang, c.g, c.n AS a, 1 AS k, l.n AS l, r.n AS r FROM kept c
  JOIN gram l ON l.lang = c.lang AND l.size = 1 AND l.g = c.first JOIN gram r ON r.lang = c.lang AND r.size = c.size - 1 AND r.g = c.t
  UNION ALL SELECT c.lang, c.g, c.n, 2, l.n, r.n FROM kept c
  JOIN gram l ON l.lang = c.lang AND l.size = 2 AND l.g = c.h JOIN gram r ON r.lang = c.lang AND r.size = 1 AND r.g = c.last WHERE c.size = 3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best)
SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM ranked JOIN (SELECT lang, count(*) AS n FROM word GROUP BY lang) USING (lang) WHERE rank <= {TOP}
"""
