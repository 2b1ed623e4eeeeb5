"""Quality classifier from weak labels.

Several heuristic labellers look at whole texts and vote good, bad or nothing.  Expectation-maximisation over
all documents estimates how often each labeller is right, without any given label; what it needs is the count
of every combination of votes, of which there are at most ``3 ** len(LABELLERS)``.  The posterior of a
document's votes is its weak label.  A linear scorer over hashed features of the text is then fitted to weak
labels of ``SAMPLE`` documents, and scores all documents; so documents on which no labeller votes get a score,
too.  The rejection threshold is set on that sample: at most ``MOST_LOST`` of the documents that the labellers
hold good may fall under it, and it is never above one half.

Features: a text is mapped to character classes, and the hashed n-grams of classes are counted; the share of
words equal to the word before and the share of different words enter as hashed bins.  Neither ids, sources,
languages nor given labels are inputs.

Every text with a word has n-grams and votes.  Of texts of fewer than ``FEWEST_WORDS`` words the shares of words
say little: they are neither features nor votes.  Counts per word are then taken per ``MEAN_WORD`` characters, if
the text has more of these than words, so a long text with little white space is judged like any other.

Defined results: a null text is empty; texts without words have no votes and score by the scorer's intercept
alone, which is above the threshold, so they are kept.  Repeated rows get equal scores.  An empty table
gives no rows.  Extra columns are carried along by ``accepted``.
Texts are read whole, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, private, query, stored, table
from soundalike.llm.kernels import text_blocks, word_hashes

#: Documents whose weak labels fit the scorer; a bounded sample, chosen by hash of the text and the id.
SAMPLE = 4000
MOST_LOST = 0.0005
CLASS_BUCKETS = 2048
BINS = 16
FEATURES = CLASS_BUCKETS + 2 * BINS
FEWEST_WORDS = 5
MEAN_WORD = 8
#: Prior bounds of EM: of good documents at most so many get a labeller's bad vote; of bad ones so many do.
MOST_FALSE = 0.005
SEEN = (0.1, 0.4)

#: (statistic, bad from, good up to); a labeller votes bad at or above the first and good up to the second.
LABELLERS = (
    ("symbols", 0.15, 0.02),      # characters of #*$%&|<> per word
    ("echoes", 0.30, 0.05),       # words equal to the word before
    ("capitals", 0.50, 0.20),     # upper-case letters among letters
    ("marks", 0.50, 0.10),        # second of two equal punctuation marks, per word
    ("bare", 0.10, 0.01),         # words without a letter or digit
    ("sameness", 0.85, 0.65),     # words that occurred before, in texts of 50 words or more
    ("unlettered", 0.30, 0.10),   # characters of words that are neither letters nor digits
)

#: Labellers that abstain on texts of fewer than FEWEST_WORDS words, and on those shorter than as many mean words.
OF_WORDS, PER_WORD = [1, 4, 5], [0, 3]

# Character classes of bytes: space, line feed, lower, upper, digit, byte of a longer code point, and each
# kind of punctuation by itself.
_CLASS = np.zeros(256, "u1")
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (1 if _b == 10 else 0 if _b in (32, 9, 11, 12, 13) else 2 if "a" <= _c <= "z" or _b >= 128
                  else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9" else 5 + _b % 27)


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype="i8")))
    return np.diff(total[ends], prepend=0)


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics of the labellers (NaN where one abstains), numbers of words, and features of a block of texts."""
    texts = [t or "" for t in texts]
    hashes, words = word_hashes(texts)
    ends = np.cumsum(words)
    doc = np.repeat(np.arange(len(texts)), words)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    n_same, n_again = _sums(same, ends), _sums(again, ends)
    stats = np.zeros((len(texts), len(LABELLERS)))
    features = np.zeros((len(texts), FEATURES), "f4")
    for i, text in enumerate(texts):
        data = np.frombuffer((text + "\n").encode("utf-8"), "u1")
        kinds = _CLASS[data]
        n = max(1, words[i])
        counts = np.bincount(data, minlength=256)
        by_kind = np.bincount(kinds, minlength=32)
        upper = by_kind[3]
        letters = by_kind[2] + upper
        ink = max(1, len(data) - by_kind[0] - by_kind[1])
        gap = kinds < 2
        known = (kinds >= 2) & (kinds <= 4)
        # A word is bare if no letter or digit lies between the white space around it.
        upto = np.concatenate(([0], np.cumsum(known)))
        stop = np.flatnonzero(gap)
        begin = np.concatenate(([0], stop[:-1] + 1))
        bare = ((upto[stop] == upto[begin]) & (stop > begin)).sum()
        doubled = ((kinds[1:] > 4) & (data[1:] == data[:-1])).sum()
        per = n if words[i] >= FEWEST_WORDS else max(n, ink // MEAN_WORD)
        stats[i] = (counts[list(b"#*$%&|<>")].sum() / per, n_same[i] / n, upper / max(1, letters),
                    doubled / per, bare / n, n_again[i] / n if words[i] >= 50 else 0.0,
                    1 - (letters + by_kind[4]) / ink)
        if not words[i]:
            stats[i] = np.nan
            continue
        if words[i] < FEWEST_WORDS:
            stats[i, OF_WORDS] = np.nan
        if per < FEWEST_WORDS:
            stats[i, PER_WORD] = np.nan
        # Runs of lower-case letters count as one, so features do not depend on the language.
        short = kinds[np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (kinds[1:] != 2)))].astype("u4")
        if len(short) < 3:
            short = np.concatenate((np.uint32([1]), short))
        grams = short[2:] + short[1:-1] * np.uint32(32) + short[:-2] * np.uint32(1024)
        bucket = (grams * np.uint32(2654435761)) >> np.uint32(21)
        found = np.bincount(bucket, minlength=CLASS_BUCKETS).astype("f4")
        features[i, :CLASS_BUCKETS] = np.sqrt(found / max(1, len(grams)))
        if words[i] >= FEWEST_WORDS:
            for k, share in enumerate((n_same[i] / n, n_again[i] / n)):
                features[i, CLASS_BUCKETS + BINS * k + min(BINS - 1, int(share * BINS))] = 1.0
    return stats, words, features


def vote(stats: np.ndarray, words: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 no vote."""
    votes = np.full(stats.shape, 2)
    for j, (_, bad, good) in enumerate(LABELLERS):
        votes[stats[:, j] <= good, j] = 1
        votes[stats[:, j] >= bad, j] = 0
    votes[words == 0] = 2
    return votes


@dataclass
class WeakModel:
    """Chance of a good document, and of each vote of each labeller given good or bad."""

    prior: float
    table: np.ndarray  # labeller, truth, vote

    @classmethod
    def fit(cls, votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> WeakModel:
        """Expectation-maximisation over combinations of votes with their counts."""
        k = len(LABELLERS)
        model = cls(0.8, np.empty((k, 2, 3)))
        model.table[:] = [[0.5, 0.2, 0.3], [0.1, 0.7, 0.2]]  # a bad vote is rarer and says more
        if not len(votes):
            return model
        for _ in range(rounds):
            good = model.posterior(votes)
            old = model.table.copy()
            model.prior = float(np.clip((good * counts).sum() / counts.sum(), 0.01, 0.99))
            for truth, weight in ((0, (1 - good) * counts), (1, good * counts)):
                for v in range(3):
                    # One pseudo-document of each kind, so no chance is 0.
                    model.table[:, truth, v] = ((votes == v) * weight[:, None]).sum(0) + 1.0
            model.table /= model.table.sum(2, keepdims=True)
            model._bound()
            if np.abs(old - model.table).max() < 1e-6:
                break
        return model

    def _bound(self) -> None:
        """Hold what is known beforehand: bad votes are precise, and a labeller sees one kind of bad only.

        Without it, EM takes the most frequent kind of bad document for the whole class, since labellers of
        different kinds rarely agree and their good votes would outweigh two bad ones.
        """
        for truth, low, high in ((1, 0.0, MOST_FALSE), (0, *SEEN)):
            bad = np.clip(self.table[:, truth, 0], low, high)
            rest = self.table[:, truth, 1:]
            self.table[:, truth, 1:] = rest * ((1 - bad) / rest.sum(1))[:, None]
            self.table[:, truth, 0] = bad

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        seen = votes < 2
        logs = np.log(self.table)
        ratio = np.log(self.prior / (1 - self.prior)) + sum(
            np.where(seen[:, j], logs[j, 1][votes[:, j]] - logs[j, 0][votes[:, j]], 0.0)
            for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of the votes given: how often right on bad and on good documents."""
        given = self.table[:, :, :2] / self.table[:, :, :2].sum(2, keepdims=True)
        return {name: (float(given[j, 0, 0]), float(given[j, 1, 1])) for j, (name, *_) in enumerate(LABELLERS)}


@dataclass
class Scorer:
    weights: np.ndarray
    intercept: float
    threshold: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.intercept, -30, 30)))

    @classmethod
    def fit(cls, features: np.ndarray, target: np.ndarray, rounds: int = 40, rate: float = 4.0,
            penalty: float = 1e-5) -> Scorer:
        """Logistic regression on soft labels by stochastic gradient descent in blocks of 64."""
        model = cls(np.zeros(FEATURES, "f4"), 2.0, 0.5)
        rng = np.random.default_rng(5)
        for turn in range(rounds if len(features) else 0):
            for part in np.array_split(rng.permutation(len(features)), -(-len(features) // 64)):
                x = features[part]
                error = target[part] - model.score(x)
                step = rate / (1 + turn / 8)
                model.weights += step * (x.T @ error / len(part) - penalty * model.weights).astype("f4")
                model.intercept = max(1.0, model.intercept + step * float(error.mean()) * 0.1)
        sure = model.score(features)[target >= 0.9] if len(features) else np.ones(0)
        if len(sure):
            model.threshold = float(min(0.5, np.quantile(sure, MOST_LOST)))
        return model


VOTES = "id_hash bigint, votes string, features binary"


def _votes(batches: Iterator[pa.RecordBatch], with_features: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_blocks(batch, "text"):
            stats, words, features = describe(texts)
            votes = ["".join(map(str, row)) for row in vote(stats, words)]
            data = [f.astype("<f2").tobytes() if with_features else b"" for f in features]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("id_hash")), pa.array(votes, pa.string()),
                 pa.array(data, pa.binary())], names=["id_hash", "votes", "features"])


@dataclass
class Classifier:
    weak: WeakModel
    scorer: Scorer


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Votes of all documents, EM over their combinations, scorer from a bounded sample of documents."""
    need(docs, id_col, text_col)
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("id_hash"), F.col(text_col).alias("text"))
    votes = stored(rows.transform(bounded).mapInArrow(lambda b: _votes(b, False), VOTES).select("id_hash", "votes"), "quality-votes")
    found = votes.groupBy("votes").count().collect()  # at most 3 ** len(LABELLERS) rows
    matrix = np.array([[int(c) for c in r["votes"]] for r in found]).reshape(-1, len(LABELLERS))
    weak = WeakModel.fit(matrix, np.array([r["count"] for r in found], float))
    # Repeated rows count once in the sample, which is bounded and broadcast.
    chosen = votes.select("id_hash").distinct().orderBy("id_hash").limit(sample)
    lines = sorted(rows.join(F.broadcast(chosen), "id_hash").dropDuplicates(["id_hash"]).transform(bounded).mapInArrow(
        lambda b: _votes(b, True), VOTES).collect(), key=lambda r: r["id_hash"])
    features = np.array([np.frombuffer(r["features"], "<f2") for r in lines], "f4").reshape(-1, FEATURES)
    target = weak.posterior(np.array([[int(c) for c in r["votes"]] for r in lines]).reshape(
        -1, len(LABELLERS))) if lines else np.zeros(0)
    return Classifier(weak, Scorer.fit(features, target))


def score(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "quality_score",
          kept_col: str = "kept") -> DataFrame:
    """``docs`` with the score and the verdict; nothing is shuffled."""
    need(docs, text_col)
    base = docs.drop(score_col, kept_col)
    schema = base.withColumn(score_col, F.lit(0.0)).withColumn(kept_col, F.lit(True)).schema
    scorer = model.scorer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, text_col):
                scores = scorer.score(describe(texts)[2])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64()), pa.array(scores >= scorer.threshold)],
                    names=[*part.schema.names, score_col, kept_col])
    return base.transform(bounded).mapInArrow(run, schema)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, columns unchanged."""
    score_col, kept_col = private("score"), private("kept")
    scored = score(docs, fit(docs, id_col, text_col), text_col, score_col, kept_col)
    return scored.where(F.col(kept_col)).select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs))
    return scored.select("doc_id", F.round("quality_score", 6).alias("quality_score"), "kept")
