"""Removal of long passages that an earlier document holds, found by difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 50
# Every residue of 31 is a difference of two of these, so for any two positions some shift below 31
# takes both to a cover position.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
# A common window of 50 words therefore holds, at one shift, a common anchor of 20 words.
ANCHOR = WINDOW - PERIOD + 1
# Characters of text that one group of documents holds about; it bounds a task's memory.
BUCKET = 4_000_000
# Fixed odd factors of the two rolling hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
# Documents without an id come after all others.
LAST = np.iinfo(np.int64).max


class _Powers:
    """factor ** i and its inverse modulo 2 ** 64, for as many i as the longest text needs."""

    def __init__(self, factor: int):
        self.factors = factor, pow(factor, -1, 1 << 64)
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            size = 1 << (n - 1).bit_length()
            for k, factor in enumerate(self.factors):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                self.tables[k] = np.multiply.accumulate(steps)
        return [t[:n] for t in self.tables]


_POWERS = [_Powers(f) for f in FACTORS]


class _Text:
    """The words of a text and the rolling hashes of its windows: 64 bits, and 32 more of a second lane."""

    def __init__(self, text: bytes | None):
        self.words = (text or b"").split()
        self.n = len(self.words)
        self.sums: list[np.ndarray] = []

    def _lane(self, lane: int) -> np.ndarray:
        if not self.sums:
            digests = np.frombuffer(b"".join(map(xxhash.xxh128_digest, self.words)), "<u8").reshape(-1, 2)
            for k in (0, 1):
                powers, _ = _POWERS[k].upto(self.n)
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(digests[:, k] * powers)]))
        return self.sums[lane]

    def hashes(self, at: np.ndarray, size: int, lane: int) -> np.ndarray:
        sums = self._lane(lane)
        _, inverse = _POWERS[lane].upto(self.n)
        found = (sums[at + size] - sums[at]) * inverse[at]
        return (found >> np.uint64(32)).astype(np.uint32) if lane else found

    def anchors(self) -> np.ndarray:
        """Cover positions at which an anchor starts; none in a text without a window."""
        if self.n < WINDOW:
            return np.zeros(0, np.int64)
        starts = np.arange(0, self.n - ANCHOR + 1, PERIOD)
        at = (starts[:, None] + np.array(COVER)).ravel()
        return at[at <= self.n - ANCHOR]

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the anchors."""
        marks = np.zeros(self.n + 2, np.int64)
        np.add.at(marks, np.maximum(anchors - (WINDOW - ANCHOR), 0), 1)
        np.add.at(marks, np.minimum(anchors, self.n - WINDOW) + 1, -1)
        return np.flatnonzero(np.cumsum(marks)[: self.n - WINDOW + 1] > 0)

    def covered(self, starts: np.ndarray) -> np.ndarray:
        marks = np.zeros(self.n + 1, np.int64)
        marks[starts] += 1
        marks[starts + WINDOW] -= 1
        return np.cumsum(marks)[:-1] > 0


def _rows(table: pa.Table):
    ids = table["doc_id"].fill_null(int(LAST)).to_numpy()
    for doc_id, text in zip(ids, table["text"]):
        yield doc_id, _Text(text.cast(pa.binary()).as_py())


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _anchor_rows(key: tuple, table: pa.Table) -> pa.Table:
    """Each anchor of a bucket once, and whether two documents of the bucket hold it."""
    hashes, ids = [], []
    for doc_id, text in _rows(table):
        at = text.anchors()
        if at.size:
            hashes.append(np.unique(text.hashes(at, ANCHOR, 0)))
            ids.append(np.full(len(hashes[-1]), doc_id))
    anchor, doc = _joined(hashes, np.uint64), _joined(ids, np.int64)
    order = np.argsort(anchor, kind="stable")
    anchor, doc = anchor[order], doc[order]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]) if anchor.size else np.zeros(0, np.int64)
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if first.size else np.zeros(0, bool)
    return pa.table(
        {
            "_bucket": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "anchor": anchor[first].view(np.int64),
            "several": several,
        }
    )


def _window_rows(key: tuple, docs: pa.Table, shared: pa.Table) -> pa.Table:
    """Windows around shared anchors, each once per bucket, with the lowest document that has it and whether others have."""
    known = np.sort(shared["anchor"].to_numpy().view(np.uint64))
    lanes: tuple[list, list] = [], []
    ids = []
    for doc_id, text in _rows(docs) if known.size else ():
        at = text.anchors()
        if not at.size:
            continue
        hashes = text.hashes(at, ANCHOR, 0)
        spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        starts = text.around(at[known[spot] == hashes])
        for lane in (0, 1):
            lanes[lane].append(text.hashes(starts, WINDOW, lane))
        ids.append(np.full(len(starts), doc_id))
    low, high, doc = _joined(lanes[0], np.uint64), _joined(lanes[1], np.uint32), _joined(ids, np.int64)
    order = np.lexsort((high, low))
    low, high, doc = low[order], high[order], doc[order]
    new = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(np.r_[True, new]) if low.size else np.zeros(0, np.int64)
    lowest = np.minimum.reduceat(doc, first) if first.size else doc
    return pa.table(
        {
            "_bucket": pa.array(np.full(len(first), key[0].as_py()), pa.int64()),
            "h0": low[first].view(np.int64),
            "h1": high[first].view(np.int32),
            "lowest": lowest,
            "several": np.maximum.reduceat(doc, first) > lowest if first.size else np.zeros(0, bool),
        }
    )


class _Earlier:
    """The windows that start in an earlier document, with the smallest id of such a document."""

    def __init__(self, rows: pa.Table):
        low, high = rows["h0"].to_numpy().view(np.uint64), rows["h1"].to_numpy().view(np.uint32)
        order = np.lexsort((high, low))
        self.low, self.high, self.owner = low[order], high[order], rows["owner"].to_numpy()[order]
        # A table of the low 20 bits answers most questions without a search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(low & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def starts(self, text: _Text, doc_id: int) -> np.ndarray:
        at = np.arange(max(0, text.n - WINDOW + 1)) if self.low.size else np.zeros(0, np.int64)
        if not at.size:
            return at
        low = text.hashes(at, WINDOW, 0)
        at = at[self.seen[(low & np.uint64((1 << 20) - 1)).astype(np.int64)]]
        low, high = low[at], text.hashes(at, WINDOW, 1)
        spot = np.searchsorted(self.low, low)
        owner = np.full(len(at), LAST)
        while True:
            inside = np.minimum(spot, len(self.low) - 1)
            same = (spot < len(self.low)) & (self.low[inside] == low)
            hit = same & (self.high[inside] == high)
            owner[hit] = self.owner[inside[hit]]
            if not (same & ~hit).any():
                return at[owner < doc_id]
            spot = np.where(same & ~hit, spot + 1, len(self.low))


def _kept_rows(key: tuple, docs: pa.Table, earlier: pa.Table) -> pa.Table:
    known = _Earlier(earlier)
    kept, words, removed = [], [], []
    for doc_id, text in _rows(docs):
        gone = text.covered(starts) if (starts := known.starts(text, doc_id)).size else None
        words.append(text.n)
        removed.append(0 if gone is None else int(gone.sum()))
        left = text.words if gone is None else [w for w, g in zip(text.words, gone.tolist()) if not g]
        kept.append(b" ".join(left))
    return (
        docs.append_column("n_words", pa.array(words, pa.int64()))
        .append_column("n_removed", pa.array(removed, pa.int64()))
        .append_column("kept_text", pa.array(kept, pa.binary()).cast(pa.string()))
    )


def substring_dedup(docs: DataFrame, bucket_chars: int = BUCKET) -> DataFrame:
    """`docs` with n_words, n_removed and kept_text, the kept words joined by one space.

    A word goes if it lies in a window of 50 words that also starts in a document with a smaller doc_id.
    Documents are shuffled once, into buckets of bounded size, and that shuffle is read three times:
    (1) every anchor once per bucket; anchors that two documents hold are shared; (2) the windows
    around shared anchors, once per bucket and with 96-bit hashes, give the smallest document of each; (3)
    the words are removed. A passage in a third of all documents costs one row per bucket.

    Null texts have no words; rows without doc_id come after all others and lose nothing to each other,
    nor do rows that repeat a doc_id; short texts have no window and stay. Extra columns pass through; columns
    with the names of results are refused.
    """
    if clash := {"n_words", "n_removed", "kept_text", "_bucket"} & set(docs.columns):
        raise ValueError(f"columns have names of results: {sorted(clash)}")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = chars // bucket_chars + 1
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))
    dealt = docs.withColumn("_bucket", place).repartition("_bucket")

    anchors = dealt.groupBy("_bucket").applyInArrow(_anchor_rows, "_bucket long, anchor long, several boolean")
    same = Window.partitionBy("anchor")
    shared = (
        anchors.select("*", F.count("*").over(same).alias("buckets"))
        .where("buckets > 1 OR several")
        .select("_bucket", "anchor")
    )
    windows = (
        dealt.groupBy("_bucket")
        .cogroup(shared.groupBy("_bucket"))
        .applyInArrow(_window_rows, "_bucket long, h0 long, h1 int, lowest long, several boolean")
    )
    same = Window.partitionBy("h0", "h1")
    earlier = (
        windows.select("*", F.min("lowest").over(same).alias("owner"))
        .where("several OR owner < lowest")
        .select("_bucket", "h0", "h1", "owner")
    )
    schema = T.StructType(
        [
            *dealt.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    return dealt.groupBy("_bucket").cogroup(earlier.groupBy("_bucket")).applyInArrow(_kept_rows, schema).drop("_bucket")


# The same result in SQL: every window as a text.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
spot AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d),
run AS (SELECT r, doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM spot),
lowest AS (SELECT g, min(doc_id) AS owner FROM run GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM run JOIN lowest USING (g) WHERE owner < doc_id),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
