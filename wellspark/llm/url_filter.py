"""URL filter: host and path rules, and for the rest the ratio of two character language models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Symbols of the models: letters, any digit, the marks of URLs, other ASCII, other bytes, and the edge of a URL.
MARKS = "/.-_:?=&#%"
EDGE, DIGIT, OTHER, FOREIGN = 0, 27, 38, 39
SYMBOLS = 40
# Context length. SYMBOLS ** (ORDER + 1) counters, 2.56 million, bound what is counted, collected and broadcast.
ORDER = 3
GRAMS = SYMBOLS ** (ORDER + 1)
# URLs whose checksum this divides train no model: the threshold is set on them.
FOLDS = 5
# Width of the bins in which scores are counted to set the threshold, and the largest score told apart.
BIN = 0.005
FARTHEST = 16.0


def _symbol_table() -> np.ndarray:
    table = np.full(256, OTHER)
    table[128:] = FOREIGN
    table[0] = EDGE
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[ord("0") : ord("9") + 1] = DIGIT
    for i, mark in enumerate(MARKS):
        table[ord(mark)] = DIGIT + 1 + i
    return table


_TABLE = _symbol_table()


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or end, ASCII lower case; then up to ? or #. Else both empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null without one. Of equally long rules the first counts."""
    fits, rule, verdict = [], F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits.append(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest))
        rule, verdict = F.when(fits[-1], F.lit(text)).otherwise(rule), F.when(fits[-1], F.lit(action)).otherwise(verdict)
    return rule, verdict


def _grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of symbol and context at every byte of a batch, and where each URL's codes start and end.

    Each URL counts with one edge after it; the edges before it are its first context."""
    values = [(u or b"").replace(b"\0", b"\1") for u in urls.cast(pa.binary()).to_pylist()]
    gap = b"\0" * ORDER
    symbols = _TABLE[np.frombuffer(gap + gap.join(values) + gap, np.uint8)]
    codes = np.zeros(len(symbols) - ORDER, np.int64)
    for i in range(ORDER + 1):
        codes = codes * SYMBOLS + symbols[i : len(symbols) - ORDER + i]
    sizes = np.array([len(v) for v in values])
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    return codes, starts, starts + sizes + 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per class (0 rejected, 1 accepted) of what a task reads, sent once at its end."""
    counts = np.zeros((2, GRAMS), np.int64)
    for batch in batches:
        codes, starts, ends = _grams(batch["url"])
        accepted = np.array(batch["accepted"].to_pylist(), np.int64)
        edges = np.zeros((2, len(codes) + 1), np.int64)
        for kind in (0, 1):
            np.add.at(edges[kind], starts[accepted == kind], 1)
            np.add.at(edges[kind], ends[accepted == kind], -1)
            counts[kind] += np.bincount(codes[np.cumsum(edges[kind])[:-1] > 0], minlength=GRAMS)
    kind, gram = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(gram, pa.int64()), pa.array(counts[kind, gram], pa.int64())], ["kind", "gram", "n"]
    )


def _model(counts: np.ndarray) -> np.ndarray:
    """log p(symbol | up to ORDER symbols before), Witten-Bell: each context backs off to the next shorter one by as
    much as it has shown new symbols."""
    by_order = [counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)]
    for _ in range(ORDER):
        by_order.append(by_order[-1].sum(axis=0))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for c in reversed(by_order):
        total, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).astype(np.float32).ravel()


def ratio_table(urls: DataFrame) -> np.ndarray:
    """Difference of the two models' log-probabilities for every gram, from (url, accepted) rows.

    At most 2 * GRAMS counts reach the driver."""
    counted = urls.select("url", F.col("accepted").cast("int").alias("accepted")).mapInArrow(_count, "kind int, gram long, n long")
    table = counted.groupBy("kind", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, GRAMS), np.int64)
    counts[table["kind"].to_numpy(), table["gram"].to_numpy()] = table["n"].to_numpy()
    return _model(counts[1]) - _model(counts[0])


def _scorer(spark, ratio: np.ndarray):
    shared = spark.sparkContext.broadcast(ratio)  # 4 * GRAMS bytes

    @F.arrow_udf("double")
    def log_ratio(urls: pa.Array) -> pa.Array:
        codes, starts, ends = _grams(urls)
        sums = np.concatenate([[0.0], np.cumsum(shared.value[codes], dtype=np.float64)])
        return pa.array((sums[ends] - sums[starts]) / (ends - starts), pa.float64())

    return log_ratio


def _threshold(scored: DataFrame) -> float | None:
    """The score with the best mean of both classes' accuracies; of several in a row the middle one. None unless both classes
    have rows."""
    place = F.floor(F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.col("score"))) / BIN).cast("int")
    rows = scored.groupBy("accepted", place.alias("place")).agg(F.count("*").alias("n")).collect()
    first = int(-FARTHEST / BIN)
    counts = np.zeros((2, 2 * -first + 2))
    for r in rows:
        counts[int(r["accepted"]), r["place"] - first] += r["n"]
    if not counts.sum(axis=1).all():
        return None
    share = counts / counts.sum(axis=1, keepdims=True)
    below = np.concatenate([np.zeros((2, 1)), np.cumsum(share, axis=1)], axis=1)
    quality = below[0] - below[1]
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    # The middle of the first unbroken stretch.
    stretch = best[: np.argmax(np.append(np.diff(best) > 1, True)) + 1]
    return float((stretch[0] + stretch[-1]) / 2 + first) * BIN


def url_filter(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """`pages` with host, path, rule, score (log-likelihood ratio per symbol) and verdict (allow or block).

    Of the URLs that a rule decides, those whose crc32 modulo FOLDS is not 0 train two smoothed variable-order Markov models, one of
    accepted and one of rejected URLs. The held-out rest sets the threshold: the score that best parts its two kinds; if it
    lacks a kind, the training URLs do. Unruled URLs are allowed if their score reaches the threshold, and all of them
    if there are no ruled URLs of both kinds. Null URLs count as empty ones; equal URLs get equal
    verdicts; all text is scored; columns with the names of results are refused."""
    if clash := {"host", "path", "rule", "score", "verdict"} & set(pages.columns):
        raise ValueError(f"columns have names of results: {sorted(clash)}")
    host, path = url_parts(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    rule, decided = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": rule, "_decided": decided})
    decided_urls = ruled.where("_decided IS NOT NULL").select(F.col(url).alias("url"), (F.col("_decided") == "allow").alias("accepted"))
    held_out = F.crc32(F.coalesce("url", F.lit(""))) % FOLDS == 0
    training, rest = decided_urls.where(~held_out), decided_urls.where(held_out)
    score = _scorer(pages.sparkSession, ratio_table(training))
    thresholds = (_threshold(part.withColumn("score", score("url"))) for part in (rest, training))
    threshold = next((t for t in thresholds if t is not None), -np.inf)
    judged = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    scored = ruled.withColumn("score", score(url))
    return scored.withColumn("verdict", F.coalesce("_decided", judged)).drop("_decided")
