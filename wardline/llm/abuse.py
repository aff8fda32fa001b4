"""Severity of abusive, hateful or sexual content by cumulative-link ordinal regression.

Reviewers' flags on a sample of documents become ordered grades. A text is cut into
segments; each gets a linear score from sparse hashed features of its words and
characters, and a document has the score of its worst segment. One weight vector is
shared by all grades, ordered thresholds cut the score into them, and a document gets
the probability of every grade and its expected severity. The sample is fitted at
once; features and scores of all documents are computed inside Spark tasks.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most labelled documents that a fit takes; of more, those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Most characters of their texts together; the next document in that order and all after it are left out.
MAX_CHARACTERS = 50_000_000
#: Hash space of the features.
FEATURES = 1 << 18
#: Grades: 0 nobody flagged it, 1 reviewers disagree, 2 one reviewer flagged it, 3 several did and nobody objected.
GRADES = 4
#: Expected severity from which a document counts as found.
FOUND_SEVERITY = 1.0
#: A feature counts fully if flagged documents hold this many times more of its occurrences in the corpus than of an average feature's.
FULL_LIFT = 8.0
LEAST_WORTH = 0.02
#: Features added to a segment's number of them before its score is divided by the root of it: a word alone weighs little.
SHORT = 10
#: Segment scores kept in a worker's memory.
SEGMENTS_KEPT = 200_000

# Letters that look like Latin ones, and signs that stand for letters.
_LOOKALIKES = str.maketrans("абвгеёзіїјкмнорстухѕԁԛԝαεικνορτυχ", "abbreeziijkmhopctyxsdqwaeikvoptux")
_SIGNS = str.maketrans("013457$@", "oieastsa")

_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_](?:[ _.*\-]|\s)){3,}[^\W\d_](?!\w)")
_GAP = re.compile(r"[\s_.*\-]+")
_INNER = re.compile(r"(?<=[^\W_])[_.*#'’\-](?=[^\W_])")
_INVISIBLE = re.compile("[" + "".join(re.escape(c) for c in map(chr, range(0x10000)) if unicodedata.category(c) == "Cf") + "\U000e0001-\U000e007f]")
_END = re.compile(r"(?:[.!?。…]+(?=\s|$)|[\n\r]+)\s*")
_WORD = re.compile(r"[\w$@]+|['\"`‘’“”]")
_RUN = re.compile(r"(.)\1+")
_NUMBERED = re.compile(r"[^\W\d_]+\d+")
_DIGITS = re.compile(r"\d+")
_HANGUL = re.compile(r"[가-힣ㄱ-ㆎ]")


def segments(text: str | None) -> list[tuple[str, ...]]:
    """The folded words of each distinct segment of a text.

    Compatibility forms, case, invisible signs, look-alike letters, digits and signs in
    the place of letters, spaced-out words, signs within words and repeated letters are
    folded away; numbers become 0 and quotation marks words.
    """
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_LOOKALIKES)
    text = _SPACED.sub(lambda m: _GAP.sub("", m.group()), text)
    seen: dict[tuple[str, ...], None] = {}
    for part in _END.split(text):
        words = tuple(map(_word, _WORD.findall(_INNER.sub("", part))))
        if words:
            seen[words] = None
    return list(seen)


@lru_cache(100_000)
def _word(word: str) -> str:
    if not any(c.isalpha() for c in word) or _NUMBERED.fullmatch(word) or 2 * sum(map(str.isdigit, word)) > len(word):
        return _DIGITS.sub("0", word)
    return _RUN.sub(r"\1", word.translate(_SIGNS))


def _key(word: str) -> str:
    """A word up to the order of its letters, so that swapped letters leave it as it is."""
    return word if len(word) < 4 or _HANGUL.search(word) else "".join(sorted(set(word)))


def _hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


@lru_cache(100_000)
def _grams(*keys: str) -> int:
    """The feature of two or three words in a row."""
    return _hashed(f"{len(keys)}{' '.join(keys)}")


def _features_of_word(word: str) -> tuple[str, tuple[int, ...]]:
    """A word's key, and its features: itself and the characters within it."""
    key = _key(word)
    names = {f"1{key}"}
    if _HANGUL.search(word):
        names.update(f"k{word[i : i + 2]}" for i in range(len(word) - 1))
        names.update(f"s{c}" for c in word)
    elif len(word) > 3:
        marked = f"<{word}>"
        names.update(f"c{marked[i : i + 4]}" for i in range(len(marked) - 3))
    return key, tuple({_hashed(n) for n in names})


_short_word = lru_cache(100_000)(_features_of_word)


def features(words: tuple[str, ...]) -> np.ndarray:
    """Hashed features of a segment: words, their pairs and triples, and characters within words."""
    keys, found = ["<"], set()
    for word in words:
        key, own = _short_word(word) if len(word) <= 50 else _features_of_word(word)
        keys.append(key)
        found.update(own)
    keys.append(">")
    found.update(map(_grams, keys, keys[1:]))
    found.update(map(_grams, keys, keys[1:], keys[2:]))
    return np.fromiter(found, np.int32)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class SeverityModel:
    """Weights shared by all grades and the ordered thresholds between them."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds
        self._kept: dict[tuple[str, ...], float] = {}

    def segment_score(self, words: tuple[str, ...]) -> float:
        score = self._kept.get(words)
        if score is None:
            f = features(words)
            score = float(self.weights[f].sum() / np.sqrt(len(f) + SHORT)) if len(f) else 0.0
            if len(self._kept) >= SEGMENTS_KEPT:
                self._kept.clear()
            self._kept[words] = score
        return score

    def score(self, text: str | None) -> float:
        """The worst segment's score; that of an empty or null text is minus infinity."""
        return max(map(self.segment_score, segments(text)), default=-np.inf)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        upto = _logistic(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.hstack([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))]))

    def __getstate__(self):
        return {"weights": self.weights, "thresholds": self.thresholds, "_kept": {}}


def fit(texts: list[list[tuple[str, ...]]], grades: np.ndarray, steps: int = 250, penalty: float = 0.03, rate: float = 0.05, mistaken: float = 0.08, counts: np.ndarray | None = None, documents: int = 0) -> SeverityModel:
    """Maximum penalized likelihood of the grades by gradient steps (Adam).

    The worst segment of a document is chosen anew in each step; before that, in the
    first tenth of the steps, all of its segments share the gradient. A share
    ``mistaken`` of the grades is taken as drawn at random (in the later steps), so
    that documents whose grade nothing in their text explains lose their pull.

    ``counts`` are the features' occurrences in the segments of all ``documents``: the
    sample is small, but a feature that the corpus holds far more often than flagged
    documents do cannot be what they are flagged for, and gets a small scale.
    """
    distinct: dict[tuple[str, ...], int] = {}
    owner, segment = [], []
    for i, parts in enumerate(texts):
        for words in parts:
            owner.append(i)
            segment.append(distinct.setdefault(words, len(distinct)))
    owner, segment = np.array(owner, np.int64), np.array(segment, np.int64)
    feats = [features(w) for w in distinct]
    lengths = np.array([len(f) for f in feats], np.int64)
    columns = np.concatenate(feats) if feats else np.zeros(0, np.int32)
    rows = np.repeat(np.arange(len(feats), dtype=np.int32), lengths)
    norm = 1 / np.sqrt(lengths + SHORT)
    worth = np.ones(FEATURES)
    if counts is not None and documents:
        flagged = np.zeros(FEATURES)
        for i in np.flatnonzero(grades >= 2):
            if texts[i]:
                flagged[np.unique(np.concatenate([feats[distinct[w]] for w in texts[i]]))] += 1
        lift = (flagged + 0.05) / (counts * (np.sum(grades >= 2) / documents) + 1)
        worth = np.clip(np.sqrt(lift / FULL_LIFT), LEAST_WORTH, 1)
    values = worth[columns]
    n = len(texts)
    weights, cuts = np.zeros(FEATURES), np.array([0.5] + [np.log(0.7)] * (GRADES - 2))
    m, v = np.zeros(FEATURES + GRADES - 1), np.zeros(FEATURES + GRADES - 1)
    chance = np.bincount(grades, minlength=GRADES)[grades] / max(n, 1)
    per_doc = np.maximum(np.bincount(owner, minlength=n), 1)
    for step in range(1, steps + 1):
        scores = np.bincount(rows, weights[columns] * values, minlength=len(feats)) * norm
        eta, share = np.full(n, -4.0), np.zeros(len(owner))
        if step <= steps // 10:
            eta = np.bincount(owner, scores[segment], minlength=n) / per_doc
            share = 1 / per_doc[owner]
        elif len(owner):
            order = np.lexsort((segment, -scores[segment], owner))
            first = order[np.r_[True, np.diff(owner[order]) > 0]]
            eta[owner[first]] = scores[segment[first]]
            share[first] = 1
        thresholds = np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])])
        edges = np.hstack([np.full((n, 1), -30.0), thresholds[None, :] - eta[:, None], np.full((n, 1), 30.0)])
        s = _logistic(edges)
        at = np.arange(n)
        high, low = s[at, grades + 1], s[at, grades]
        mass = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
        if step > 0.4 * steps:
            trust = (1 - mistaken) * mass / ((1 - mistaken) * mass + mistaken * chance)
            d_high, d_low = d_high * trust, d_low * trust
        d_eta = (d_high - d_low) / n  # of the negative log likelihood
        d_thresholds = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            d_thresholds[k] = (-(d_high[grades == k].sum()) + d_low[grades == k + 1].sum()) / n
        d_cuts = np.r_[d_thresholds.sum(), [d_thresholds[k:].sum() * np.exp(cuts[k]) for k in range(1, GRADES - 1)]]
        d_segment = np.bincount(segment, share * d_eta[owner], minlength=len(feats)) * norm
        gradient = np.r_[np.bincount(columns, d_segment[rows] * values, minlength=FEATURES) + penalty / n * weights, d_cuts]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, cuts = weights - move[:FEATURES], cuts - move[FEATURES:]
    return SeverityModel((weights * worth).astype(np.float32), np.cumsum(np.r_[cuts[0], np.exp(cuts[1:])]))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade`` from reviewers' rows ``doc_id, flagged``; rows with nulls say nothing.

    A reviewer's repeated rows on a document count each.
    """
    said = labels.where(F.col("doc_id").isNotNull() & F.col("flagged").isNotNull()).groupBy("doc_id").agg(F.sum((F.col("flagged") > 0).cast("int")).alias("yes"), F.count("*").alias("all"))
    grade = F.when(F.col("yes") == 0, 0).when(F.col("yes") < F.col("all"), 1).when(F.col("all") == 1, 2).otherwise(3)
    return said.select("doc_id", grade.alias("grade"))


def feature_counts(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Occurrences of each feature in the segments of all documents, and the number of documents.

    Counted in the tasks and summed by feature; what reaches the driver is one number
    per feature of the fixed hash space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, n = np.zeros(FEATURES, np.int64), Counter(), 0

        def empty() -> None:
            for words, times in seen.items():
                counts[features(words)] += times
            seen.clear()

        for batch in batches:
            n += batch.num_rows
            for t in batch.column(0).to_pylist():
                seen.update(segments(t))
            if len(seen) >= SEGMENTS_KEPT:
                empty()
        empty()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int32()), pa.array(np.r_[n, counts[at]], pa.int64())], names=["feature", "n"])

    sums = docs.select(text).mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(FEATURES)
    known = sums[sums.feature >= 0]
    counts[known.feature.to_numpy()] = known.n.to_numpy()
    return counts, int(sums.n[sums.feature < 0].sum())


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_characters: int = MAX_CHARACTERS) -> SeverityModel:
    """A model from the labelled documents, at most ``max_labelled`` and ``max_characters`` of them, and the feature counts of all documents.

    Both bound what reaches the driver; whole documents are taken, in the order of a
    hash of their ids. Without any usable label all documents get severity 0.
    """
    sample = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    known = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = known.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).withColumn("upto", F.sum("n").over(upto))  # at most max_labelled rows
    taken = sizes.where(F.col("upto") <= max_characters).select("doc_id")
    known = known.join(F.broadcast(taken), "doc_id", "left_semi").toPandas().sort_values("doc_id")
    if known.empty:
        return SeverityModel(np.zeros(FEATURES, np.float32), np.full(GRADES - 1, 30.0))
    counts, documents = feature_counts(docs)
    return fit([segments(t) for t in known.text], known.grade.to_numpy(np.int64), counts=counts, documents=documents)


def severity(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``p_grade_0 .. p_grade_3``, ``severity`` (their mean grade, 0 to 3) and ``found``.

    Whole texts are scored. An empty, blank or null text has severity 0. Rows and other
    columns are kept, but those named like a new one are replaced.
    """
    added = [f"p_grade_{g}" for g in range(GRADES)] + ["severity"]
    kept = [f for f in docs.schema.fields if f.name != text and f.name.lower() not in {*added, "found"}]
    names = [f.name for f in kept]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker = shared.value
        for frame in frames:
            p = worker.probabilities(np.array([worker.score(t) for t in frame[text]], float))
            out = frame[names].copy()
            for g in range(GRADES):
                out[f"p_grade_{g}"] = p[:, g]
            out["severity"] = p @ np.arange(GRADES)
            yield out

    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in added])
    return docs.mapInPandas(run, schema).withColumn("found", F.col("severity") >= FOUND_SEVERITY)
