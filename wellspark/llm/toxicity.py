"""Toxicity from a weighted finite-state grammar over clauses, with weights learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that the weights are fitted on, taken in the order of a hash of doc_id; a bound, not a sample of scores.
TRAINING_ROWS = 20_000
# A stem joins the insults if at least this part of the toxic training texts has a word that starts with it, words of toxic
# texts start with it this many times as often as others, and the log-likelihood ratio statistic is at least this.
STEM_SHARE = 0.01
STEM_ODDS = 20.0
STEM_EVIDENCE = 25.0
STEM_LENGTHS = range(3, 11)
STEMS = 100
STEM_KEEPS = 0.9
CLEAN_SHARE = 3

# Word lists of the grammar, English, German, French, Spanish.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile loser losers pathetic scum trash garbage "
    "worthless disgusting vermin filth filthy clown clowns pig pigs bastard bastards jerk jerks freak freaks coward cowards "
    "retard retarded scumbag bitch asshole dummkopf blöd blöder dumm dummer abschaum arschloch wertlos ekelhaft versager "
    "imbécile crétin crétine connard connasse débile ordure minable dégoûtant tonto tonta estúpido estúpida imbécil "
    "escoria basura inútil asqueroso asquerosa patético patética"
).split()
THREATS = (
    "kill murder destroy hurt hang shoot stab beat burn strangle umbringen töten vernichten verletzen erschießen tuer "
    "détruire frapper brûler matar matarte destruir golpear quemar"
).split()
TARGETS = (
    "you your you're youre u he she they them him her these those people everyone du dich dir ihr euch sie er tu te toi vous il "
    "elle ils elles tú ti usted ustedes él ella ellos ellas"
).split()
NEGATIONS = (
    "not no never nobody isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine keiner nie niemals pas "
    "jamais aucun nunca jamás ningún ninguna tampoco"
).split()
REPORTS = (
    "said says say saying wrote writes reported reports called calls claimed claims quoted alleged sagte sagt schrieb nannte "
    "berichtete dit disait écrit appelé rapporte dijo dice escribió llamó"
).split()
QUOTES = '"“”„«»'
# Classes of words: the input alphabet of the clause machine.
INSULT, STEM, THREAT, TARGET, NEGATION, REPORT = range(6)
# How many words a negation reaches.
REACH = 4

_TOKEN = re.compile(rf"[^\W\d_]+(?:['’][^\W\d_]+)*|[.,;:!?\n]|[{QUOTES}]")
_BREAKS = frozenset(".,;:!?\n")
# Letters in lower case, blanks for all other bytes of ASCII.
_LETTERS = bytes(c | 0x20 if chr(c).isalpha() else 0x20 for c in range(128)) + bytes(range(128, 256))


def _lexical() -> dict[str, int]:
    """The lexical transducer: word to class. Insults win over other classes."""
    out: dict[str, int] = {}
    for words, kind in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, INSULT)):
        out |= dict.fromkeys(words, kind)
    return out


# Kinds of matched clauses, the output alphabet: what is said, aimed at somebody, denied, reported.
# An insult that only a learned stem finds is a kind of its own, as other words may start like it.
WHAT = ("insult", "stem", "threat")
KINDS = [(what, aimed, told) for what in WHAT for aimed in (False, True) for told in ("plain", "denied", "reported")]
_INDEX = {k: i for i, k in enumerate(KINDS)}
FEATURES = len(KINDS) + len(WHAT)


@dataclass
class Grammar:
    """The composed transducers, and the weight of each kind of clause; learned stems join the insults."""

    stems: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0

    def __post_init__(self):
        self.words = _lexical()
        self.triggers = frozenset(w.encode() for w, kind in self.words.items() if kind in (INSULT, THREAT))
        self.starts = tuple(self.stems)
        self.beginnings = [stem.encode() for stem in self.stems]

    def clauses(self, tokens: list[str]) -> Iterator[tuple[str, bool, str]]:
        """Kinds of the clauses that hold an insult or a threat against somebody.

        States: inside quotes or not; words left under a negation; in the clause so far: a target, a reporting
        verb (which holds through the sentence), insults and threats with and without negation. A break
        ends the clause and emits."""
        quoted = reporting = aimed = False
        denied = 0
        # For each of WHAT in the clause: seen without and with negation, and seen in reported speech.
        seen: dict[int, list[bool]] = {}
        for token in [*tokens, "\n"]:
            if token in _BREAKS:
                for kind in sorted(seen):
                    plain, reported = seen[kind]
                    if kind != THREAT or aimed:
                        yield WHAT[kind], aimed, "reported" if reported else "plain" if plain else "denied"
                seen, aimed, denied = {}, False, 0
                if token not in ",;:":
                    reporting = quoted and reporting
                continue
            if token in QUOTES:
                quoted = not quoted
                continue
            word = token.lower()
            kind = self.words.get(word)
            if kind is None and word.startswith(self.starts):
                kind = STEM
            if kind == NEGATION:
                denied = REACH + 1
            elif kind == REPORT:
                reporting = True
            elif kind == TARGET:
                aimed = True
            elif kind is not None:
                plain, reported = seen.get(kind, (False, False))
                seen[kind] = [plain or not denied, reported or reporting]
            denied = max(0, denied - 1)

    def features(self, text: bytes) -> np.ndarray | None:
        """log(1 + matched clauses per thousand words) for each kind and log(1 + matched clauses) for each of WHAT.

        Of a whole text; None without any match. Rates tell a text full of insults from a long one in which a word
        happens to start like one."""
        if not self._triggered(text):
            return None
        tokens = _TOKEN.findall(text.decode())
        counts = np.zeros(len(KINDS))
        for kind in self.clauses(tokens):
            counts[_INDEX[kind]] += 1
        words = sum(t[0].isalpha() for t in tokens)
        totals = counts.reshape(len(WHAT), -1).sum(axis=1)
        return np.log1p(np.concatenate([counts * 1000 / max(words, 1), totals])) if counts.any() else None

    def _triggered(self, text: bytes) -> bool:
        """Whether a text has an insulting or threatening word or stem at all; most have none and need no machine."""
        if text.isascii():
            # Every word that the machine could find is a run of letters; runs that an apostrophe joins it sorts out.
            low = text.translate(_LETTERS)
            return any(stem in low for stem in self.beginnings) or not self.triggers.isdisjoint(low.split())
        words = [t.lower() for t in _TOKEN.findall(text.decode())]
        return any(w.startswith(self.starts) for w in words) or not self.triggers.isdisjoint(w.encode() for w in words)

    def score(self, text: bytes) -> float:
        found = self.features(text)
        logit = self.bias if found is None else self.bias + float(found @ np.array(self.weights))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def _features(grammar: Grammar):
    @F.arrow_udf("array<double>")
    def clause_features(texts: pa.Array) -> pa.Array:
        rows = (grammar.features(t.as_py() or b"") for t in texts.cast(pa.binary()))
        return pa.array([None if r is None else r.tolist() for r in rows], pa.list_(pa.float64()))

    return clause_features


def score(grammar: Grammar, text: str | Column) -> Column:
    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        return pa.array([grammar.score(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.float64())

    return toxicity(text)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton steps. The ridge pulls to a weight of 1.5 for plain and 0.5 for other clauses, so
    kinds that no label shows still count, denied and reported ones less."""
    prior = np.array([1.5 if told == "plain" else 0.5 for _, _, told in KINDS] + [0.0] * len(WHAT) + [-3.0])
    x, w = np.c_[x, np.ones(len(x))], prior.copy()
    strength = np.full(len(w), ridge)
    strength[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1].tolist(), float(w[-1])


def _stems(training: DataFrame) -> list[str]:
    """Beginnings of words that mark toxic texts, each with toxic texts that no stronger one explains.

    Compared are all toxic training texts with CLEAN_SHARE as many others. Stems are taken greedily: the one in most
    toxic texts that are left, made longer while that keeps nearly all of these texts, until none has enough. So words that toxic
    texts share only as copies of each other, or beside a true mark, are not learned."""
    sizes = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    part = F.pmod(F.xxhash64("doc_id", F.lit("stems")), F.lit(1000)) < 1000 * CLEAN_SHARE * toxic / clean
    words = F.split(F.lower("text"), r"[^\p{L}]+")
    starts = F.array(*(F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEM_LENGTHS))
    chosen = training.where((F.col("toxic") == 1) | part).select("doc_id", "toxic", F.explode(words).alias("w"))
    each = chosen.select("doc_id", "toxic", F.explode(starts).alias("stem")).where("stem IS NOT NULL")
    n = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = each.groupBy("stem").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, bad, good = F.col("a") + 0.5, F.col("b") + 0.5, n.get(1, 1), n.get(0, 1)
    share = (F.col("a") + F.col("b") + 1) / (bad + good)
    evidence = 2 * (a * F.log(a / (bad * share)) + b * F.log(b / (good * share)))
    strong = counted.where((F.col("a") >= STEM_SHARE * toxic) & (a / bad >= STEM_ODDS * b / good) & (evidence >= STEM_EVIDENCE))
    # Stems of at least one in a hundred toxic texts: their number is bounded by the training rows.
    ids = F.collect_set("doc_id").alias("ids")
    found = each.where("toxic = 1").join(strong.select("stem"), "stem").groupBy("stem").agg(ids).collect()
    left = {r["stem"]: set(r["ids"]) for r in found}
    stems: list[str] = []
    while left and len(stems) < STEMS:
        best = max(left, key=lambda stem: (len(left[stem]), len(stem), stem))
        if len(left[best]) < STEM_SHARE * toxic:
            break
        while longer := [s for s in left if s != best and s.startswith(best) and len(left[s]) >= STEM_KEEPS * len(left[best])]:
            best = max(longer, key=lambda stem: (len(left[stem]), stem))
        stems.append(best)
        explained = left.pop(best)
        left = {stem: rest for stem, texts in left.items() if (rest := texts - explained)}
    return stems


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Grammar:
    """A grammar fitted on at most `rows` labelled documents; labels without a doc_id or a verdict are not used.

    Learned are stems of insults that the lists lack and the weights of the clause kinds. Of documents with one doc_id the
    one with the smallest hash of its text is learned from, so what reaches the driver is bounded by `rows`."""
    labelled = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # At most `rows` pairs of numbers.
    named = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id")
    one = named.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first")).select("doc_id", "first.text")
    training = one.join(F.broadcast(chosen), "doc_id")
    grammar = Grammar(stems=_stems(training))
    found = training.select("toxic", _features(grammar)("text").alias("x")).collect()
    # Without labelled rows: the prior alone.
    x = np.array([r["x"] or [0.0] * FEATURES for r in found] or [[0.0] * FEATURES])
    grammar.weights, grammar.bias = _fit(x, np.array([r["toxic"] for r in found] or [0], float))
    return grammar


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from; those without a doc_id have no label and are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """`docs` with held_out, score (0 to 1) and predicted, from a grammar fitted on the labels that are not held out.

    Texts are scored whole, by their matched clauses only; null and empty texts have none and get the score of a
    text without matches. Every row is scored for itself, so repeated rows and ties need nothing. Without usable labels the
    grammar keeps its prior weights. Columns with the names of results are refused."""
    if clash := {"held_out", "score", "predicted"} & set(docs.columns):
        raise ValueError(f"columns have names of results: {sorted(clash)}")
    grammar = fit(docs, labels.where(~held_out(F.col("doc_id"))), rows)
    scored = docs.withColumns({"held_out": held_out(F.col("doc_id")), "score": score(grammar, F.col("text"))})
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
