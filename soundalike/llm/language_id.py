"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased ASCII-wise, everything but letters becomes a gap, and the byte n-grams of its words, gaps
at their ends included, are hashed into ``BUCKETS`` embeddings.  Their mean goes through a linear softmax; both
layers are trained by stochastic gradient descent in numpy on at most ``PER_LANGUAGE`` texts of each language,
each whole and as one of its lines, so that short texts are met in training.  Because embedding and softmax are
linear, scoring uses their product: one row of language scores per bucket, gathered and averaged.

A part of the training texts is kept for calibration: the temperature is the one of least log loss on them, and
the rejection threshold the smallest probability above which ``PRECISION`` of them are right.

Only text and language of training rows are learnt from; a prediction sees the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; without any
training rows every text is.  Ties go to the language first in code point order.  Rows with null language are
predicted, not learnt from; rows with a null id are neither held out nor learnt from.  Repeated rows get equal
predictions.  Texts are read whole, in bounded blocks.  Extra columns are carried along unless they have the
name of an output column, which the output then takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, query, stored, table
from soundalike.llm.kernels import text_blocks

PER_LANGUAGE = 300
#: More languages than this are refused: the sample and the table of scores have a part for each.
MOST_LANGUAGES = 256
BUCKETS = 1 << 15
DIMENSIONS = 16
LENGTHS = (2, 3, 4)
PRECISION = 0.99
UNKNOWN = "und"

# Letters: ASCII letters in lower case, and all bytes of longer code points.  0 is a gap.
_LETTER = np.zeros(256, "u4")
_LETTER[128:] = np.arange(128, 256)
for _b in range(26):
    _LETTER[65 + _b] = _LETTER[97 + _b] = 97 + _b


def subwords(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per n-gram length: buckets of all n-grams in order, and their number per text."""
    data = "\n".join(texts).encode("utf-8") + b"\n"
    lengths = np.array([len(t.encode("utf-8")) + 1 for t in texts])
    ends = np.cumsum(lengths)
    letters = _LETTER[np.frombuffer(b"\n" + data, "u1")]
    gap = letters == 0
    buckets, counts = [], []
    for n in LENGTHS:
        many = max(0, len(letters) - n + 1)
        value = np.zeros(many, "u4")
        whole = ~(gap[:many] & gap[n - 1:n - 1 + many])
        for j in range(n):
            value = value * np.uint32(257) + letters[j:j + many]
            if 0 < j < n - 1:
                whole &= ~gap[j:j + many]
        at = np.flatnonzero(whole)
        hashed = value[at] * np.uint32(2654435761)
        buckets.append(((hashed ^ (hashed >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(17)).astype("i4"))
        counts.append(np.diff(np.searchsorted(at, ends), prepend=0))
    return buckets, counts


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text and their shares."""
    found = np.concatenate(subwords([text])[0])
    unique, n = np.unique(found, return_counts=True)
    return unique.astype("u2"), (n / max(1, len(found))).astype("f4")


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket, language: product of embedding and softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for buckets, counts in zip(*subwords(texts)):
            some = np.flatnonzero(counts)
            if len(some):
                starts = (np.cumsum(counts) - counts)[some]
                out[some] += np.add.reduceat(self.table.take(buckets, axis=0), starts, axis=0, dtype="f8")
            total += counts
        return out / np.maximum(1, total)[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is under the threshold."""
        read = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if not self.languages or not read.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        p = self.probabilities(self.logits([t or "" for t in texts]))
        best = p.argmax(1)
        score = np.where(read, p[np.arange(len(texts)), best], 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, read)]
        return names, score, (score < self.threshold) | ~read


def train(bags: list[tuple[np.ndarray, np.ndarray]], truth: np.ndarray, languages: list[str], apart: np.ndarray,
          rounds: int = 12, rate: float = 20.0) -> LanguageModel:
    """Stochastic gradient descent over texts; rows marked ``apart`` calibrate."""
    rng = np.random.default_rng(11)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype("f4")
    weights = rng.normal(0, 0.3, (DIMENSIONS, len(languages))).astype("f4")
    bias = np.zeros(len(languages), "f4")
    rows = np.flatnonzero(~apart)
    for turn in range(rounds):
        step = rate * (1 - turn / rounds)
        for i in rng.permutation(rows):
            at, share = bags[i]
            if not len(at):
                continue
            hidden = share @ embedding[at]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[truth[i]] -= 1
            back = weights @ p
            weights -= 0.05 * step / rate * np.outer(hidden, p)
            bias -= 0.01 * p
            embedding[at] -= step * share[:, None] * back[None, :]
    model = LanguageModel(languages, embedding @ weights, bias)
    held = [i for i in np.flatnonzero(apart) if len(bags[i][0])]
    if held:
        z = np.array([bags[i][1] @ model.table[bags[i][0]] + bias for i in held])
        y = truth[held]

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())
        model.temperature = float(min(np.geomspace(0.05, 20, 61), key=loss))
        p = model.probabilities(z)
        score, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-score)
        good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
        model.threshold = float(score[order[np.flatnonzero(good).max()]]) if good.any() else 1.0
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Model of a bounded sample: ``per_language`` different texts of each language with the lowest hash.

    Rows are hashed with their text, so rows that share an id are rows of their own, and a row that is repeated
    counts once.  Keys of the sample are broadcast, texts that are not in it are not shuffled.
    """
    need(docs, id_col, text_col, lang_col)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                      & ~held_out(id_col)).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 40)).alias("h"))
    narrow = stored(rows.select("lang", "h").distinct(), "language-keys")
    # Three times the wanted rows pass on average; the lowest hashes are among them, and no task ranks a language.
    share = narrow.groupBy("lang").agg((F.lit(3.0 * per_language * (1 << 40)) / F.count("*")).alias("below"))
    found_languages = share.limit(MOST_LANGUAGES + 1).count()
    if found_languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different values in {lang_col}")
    keys = narrow.join(F.broadcast(share), "lang").where(F.col("h") < F.col("below")).withColumn(
        "nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ).where(F.col("nth") <= per_language).select("lang", "h")
    # At most per_language keys for each of MOST_LANGUAGES languages.
    chosen = rows.join(F.broadcast(keys), ["lang", "h"]).dropDuplicates(["lang", "h"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                out = []
                for i, lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    lines = [x for x in text.split("\n") if x.strip()]
                    for k, piece in enumerate([text, *lines[len(text) % max(1, len(lines)):][:1]]):
                        at, share = _bag(piece)
                        out.append((i, lang, k, at.tobytes(), share.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.binary(),
                                                                pa.binary()))],
                    names=["h", "lang", "k", "at", "share"])
    found = chosen.select("h", "lang", "text").transform(bounded).mapInArrow(
        bags, "h long, lang string, k int, at binary, share binary").toArrow().to_pylist()
    found.sort(key=lambda r: (r["h"], r["k"], r["lang"]))
    languages = sorted({r["lang"] for r in found})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), "f4"), np.zeros(0, "f4"))
    truth = np.array([languages.index(r["lang"]) for r in found])
    place = {x: n for n, x in enumerate(sorted({r["h"] for r in found}))}
    apart = np.array([place[r["h"]] % 5 == 0 for r in found])
    return train([(np.frombuffer(r["at"], "u2"), np.frombuffer(r["share"], "f4")) for r in found], truth,
                 languages, apart)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; nothing is shuffled."""
    need(docs, text_col)
    names = [n for n in ("lang_pred", "score", "rejected") if n != text_col]
    base = docs.drop(*names)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema]
    schema = ", ".join([*kinds, "lang_pred string", "score double", "rejected boolean"])
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, one number per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, text_col):
                lang, score, rejected = held.value.predict(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                    names=[*part.schema.names, "lang_pred", "score", "rejected"])
    return base.transform(bounded).mapInArrow(run, schema)


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.round("score", 6).alias("score"),
                        "rejected")
