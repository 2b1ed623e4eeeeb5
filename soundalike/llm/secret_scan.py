"""Secret scans: fixed patterns, and a character convolutional network over every further candidate.

Patterns find assignments, access keys and long hexadecimal runs.  A candidate is a run of 16 or more characters
``[A-Za-z0-9+/_=-]`` with a digit, or with a capital after a small letter; of a run that patterns cover in part, each part of 16 or
more left over is one, too.  The network reads a window of ``BEFORE`` characters of context, the candidate and
``AFTER`` characters of context; a candidate longer than ``INSIDE`` is read in windows that overlap by half, and
has the highest of their outputs.  It is an embedding, convolution, maximum over each of the three parts, logistic output.  It is
trained in numpy on labelled findings: candidates that a pattern covers are secrets, the others are not, at most
``SAMPLE`` of either kind.  Contexts are exchanged between training examples, so that neither a keyword alone
nor its absence decides.  The output is calibrated by a temperature on all labelled findings of the table that were not
trained on (a quarter of the sample, and whatever is not in it), counted in bins of ``1 / BINS`` of the logit, and of the
thresholds that still find ``RECALL`` of these secrets the lowest of best precision is taken, however low that is.

Candidates at or above the threshold that overlap no pattern's span are added as kind ``model``; spans of
patterns always stay.  Offsets are code points, end exclusive.

Defined results: null texts are empty and have no spans; without labelled secrets in the table no span is added.
Matches that fail a length rule are dropped after matching.  Repeated rows are scanned each; very long texts
are scanned whole; an empty table gives no rows; columns other than the id and the text are not carried.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundalike.llm.common import bounded, need, query, stored, table
from soundalike.llm.kernels import text_blocks

ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, LEAST_RUN = 6, 20, 24, 16

BEFORE, INSIDE, AFTER = 24, 48, 8
SAMPLE = 2000
RECALL = 0.98
BINS, MOST_LOGIT = 1000, 30
SYMBOLS, DIMENSIONS, WIDTH, FILTERS = 128, 8, 5, 24
LENGTH = BEFORE + INSIDE + AFTER

_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def long_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of candidate characters of LEAST_RUN or more, as code point spans."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
    if len(data) < LEAST_RUN:
        return []
    inside = _RUN[data]
    edge = np.flatnonzero(np.diff(inside.view("i1"), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    long = end - start >= LEAST_RUN
    start, end = start[long], end[long]
    if len(data) != len(text) and len(start):
        # Bytes of a code point after its first do not count.
        later = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
        start, end = start - later[start], end - later[end]
    return list(zip(start.tolist(), end.tolist()))


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, in order.

    Access keys and hexadecimal strings of the wanted lengths lie in long runs, so only these are searched.
    """
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS) or not text.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for a, b in runs:
        if b - a < LEAST_ACCESS:
            continue
        run = text[a:b]
        if "AKIA" in run:
            found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(run)
                      if m.end() - m.start() >= LEAST_ACCESS]
        found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(run) if m.end() - m.start() >= LEAST_HEX]
    return sorted(found)


def candidates(text: str, runs: list[tuple[int, int]], spans: list[tuple[int, int, int]] = ()
               ) -> list[tuple[int, int, bool]]:
    """(start, end, known) of long runs that look like no plain word, cut where patterns' spans begin and end."""
    found, first = [], 0
    spans = _union(spans)
    for a, b in runs:
        while first < len(spans) and spans[first][1] <= a:
            first += 1
        at, k, parts = a, first, []
        while k < len(spans) and spans[k][0] < b:
            s, e = max(a, spans[k][0]), min(b, spans[k][1])
            parts += [(at, s, False), (s, e, True)]
            at, k = e, k + 1
        for s, e, known in [*parts, (at, b, False)]:
            if (known or e - s >= LEAST_RUN) and _candidate(text[s:e]):
                found.append((s, e, known))
    return found


def _union(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _candidate(run: str) -> bool:
    return any(map(str.isdigit, run)) or _mixed(run)


_MIXED = re.compile(r"[a-z][A-Z]")


def _mixed(run: str) -> bool:
    return _MIXED.search(run) is not None


def window(text: str, start: int, end: int) -> str:
    """Context, at most INSIDE characters of candidate, and context at fixed places; gaps are NUL."""
    end = min(end, start + INSIDE)
    return (text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0")
            + text[end:end + AFTER].ljust(AFTER, "\0"))


def read_windows(text: str, start: int, end: int) -> list[str]:
    """Windows over the whole of a candidate, overlapping by half; the last one ends with it."""
    last = max(start, end - INSIDE)
    return [window(text, a, end) for a in [*range(start, last, INSIDE // 2), last]]


def coded(windows: list[str]) -> np.ndarray:
    """Windows as symbols; characters beyond ASCII share one."""
    flat = "".join(windows).encode("utf-32-le", "surrogatepass")
    return np.minimum(np.frombuffer(flat, "<u4"), SYMBOLS - 1).astype("i4").reshape(-1, LENGTH)


#: Places where a filter may start, by part of the window.
PARTS = ((0, BEFORE - WIDTH + 1), (BEFORE, BEFORE + INSIDE - WIDTH + 1), (BEFORE + INSIDE, LENGTH - WIDTH + 1))


@dataclass
class CharNet:
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((SYMBOLS, DIMENSIONS)))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((WIDTH * DIMENSIONS, FILTERS)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(FILTERS))
    output: np.ndarray = field(default_factory=lambda: np.zeros(len(PARTS) * FILTERS))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(1))
    temperature: float = 1.0
    threshold: float = 2.0  # above every probability: adds nothing

    @classmethod
    def random(cls, seed: int = 7) -> CharNet:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (SYMBOLS, DIMENSIONS)), rng.normal(0, 0.2, (WIDTH * DIMENSIONS, FILTERS)),
                   np.zeros(FILTERS), rng.normal(0, 0.1, len(PARTS) * FILTERS), np.zeros(1))

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest activation of each filter in each part, and its place."""
        e = self.embedding[x]
        n = len(x)
        patches = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2)
        act = patches.reshape(n, LENGTH - WIDTH + 1, -1) @ self.filters + self.shift
        best, place = [], []
        for a, b in PARTS:
            at = act[:, a:b].argmax(1)
            place.append(at + a)
            best.append(np.take_along_axis(act[:, a:b], at[:, None], 1)[:, 0])
        return np.stack(best, 1), np.stack(place, 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [np.maximum(self._pooled(x[i:i + 512])[0], 0).reshape(len(x[i:i + 512]), -1) @ self.output + self.bias
               for i in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        best, place = self._pooled(x)
        n = len(x)
        hidden = np.maximum(best, 0).reshape(n, -1)
        error = (1 / (1 + np.exp(-np.clip(hidden @ self.output + self.bias, -30, 30))) - y) / n
        back = (error[:, None] * self.output).reshape(best.shape) * (best > 0)
        where = place[..., None] + np.arange(WIDTH)  # text, part, filter, offset
        symbols = x[np.arange(n)[:, None, None, None], where]
        read = self.embedding[symbols].reshape(*best.shape, -1)
        d_filters = np.einsum("npf,npfk->kf", back, read)
        d_read = (back[..., None] * self.filters.T).reshape(*best.shape, WIDTH, DIMENSIONS)
        d_embedding = np.zeros_like(self.embedding)
        np.add.at(d_embedding, symbols, d_read)
        return [d_embedding, d_filters, back.sum((0, 1)), hidden.T @ error, np.array([error.sum()])]

    @classmethod
    def fit(cls, secrets: list[str], others: list[str], rounds: int = 12, rate: float = 0.01) -> CharNet:
        """Train on windows of secrets and of other candidates, calibrate and set the threshold."""
        if not secrets:
            return cls()
        rng = np.random.default_rng(3)
        x = coded([*secrets, *others])
        y = np.concatenate((np.ones(len(secrets)), np.zeros(len(others))))
        apart = np.arange(len(x)) % 4 == 3
        net = cls.random()
        weights = [net.embedding, net.filters, net.shift, net.output, net.bias]
        mean, square, turn = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        rows = np.flatnonzero(~apart)
        share = np.where(y == 1, 0.5 / max(1, (y[rows] == 1).sum()), 0.5 / max(1, (y[rows] == 0).sum()))
        for _ in range(rounds):
            drawn = rng.choice(rows, len(rows), p=share[rows] / share[rows].sum())
            for part in np.array_split(drawn, -(-len(drawn) // 64)):
                read = exchanged(x[part], x[rng.choice(rows, len(part))], rng)
                turn += 1
                for w, g, m, s in zip(weights, net.gradients(read, y[part]), mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.999 ** turn)) + 1e-8)
        held, truth = x[apart], y[apart]
        held = np.concatenate((held, exchanged(held, x[rng.choice(rows, len(held))], rng)))
        truth = np.concatenate((truth, truth))
        net.calibrate(net.logits(held), truth, np.ones(len(truth), "i8"))
        return net

    def calibrate(self, z: np.ndarray, truth: np.ndarray, n: np.ndarray) -> None:
        """Temperature and threshold from logits of labelled findings, each counted ``n`` times."""
        if not len(z):
            return

        def loss(t: float) -> float:
            return float(np.average(np.logaddexp(0, np.where(truth == 1, -z, z) / t), weights=n))
        self.temperature = float(min(np.geomspace(1, 20, 41), key=loss))
        if (truth == 1).any():
            self.threshold = chosen_threshold(1 / (1 + np.exp(-np.clip(z / self.temperature, -30, 30))), truth, n)


def chosen_threshold(p: np.ndarray, truth: np.ndarray, n: np.ndarray | None = None) -> float:
    """Of the thresholds that keep the wanted recall the lowest of best precision; an even chance is one if it keeps it.

    ``n`` says how often each finding counts, by default once.
    """
    n = np.ones(len(p), "i8") if n is None else n
    order = np.argsort(p, kind="stable")
    p, truth, n = p[order], truth[order], n[order]
    found = np.concatenate(([0], np.cumsum(np.where(truth == 1, n, 0))))
    every = np.concatenate(([0], np.cumsum(n)))
    most = p[np.searchsorted(found[1:], int((found[-1] - 1) * (1 - RECALL)), side="right")]
    tried = np.unique(np.append(p, 0.5))
    tried = tried[tried <= most]
    at = np.searchsorted(p, tried)
    precision = (found[-1] - found[at]) / (every[-1] - every[at])
    return float(tried[int(precision.argmax())])


def exchanged(x: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Half of the windows get the context of another window."""
    swap = (rng.random(len(x)) < 0.5)[:, None]
    context = np.ones(LENGTH, bool)
    context[BEFORE:BEFORE + INSIDE] = False
    return np.where(swap & context, other, x)


SCAN = "base string, cands array<struct<start:bigint,end:bigint,seen:array<string>,known:boolean>>"


def scan_patterns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base spans, and all candidates with their windows and whether a pattern covers them."""
    need(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seen", pa.list_(pa.string())), ("known", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                base, cands = [], []
                for text in texts:
                    text = text or ""
                    runs = long_runs(text)
                    spans = base_spans(text, runs)
                    base.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))
                    cands.append([{"start": a, "end": b, "seen": read_windows(text, a, b), "known": known}
                                  for a, b, known in candidates(text, runs, spans)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, pa.string()), pa.array(cands, pa.list_(entry))],
                    names=["id", "base", "cands"])
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return stored(narrow.transform(bounded).mapInArrow(run, f"id {kind}, {SCAN}"), "secrets")


def fit(scanned: DataFrame, sample: int = SAMPLE) -> CharNet:
    """Network trained on a bounded sample of labelled findings, lowest hash of the window first.

    Temperature and threshold come from all findings of the table that it was not trained on.
    """
    found = scanned.select(F.explode("cands").alias("c")).select(F.explode("c.seen").alias("seen"), "c.known").distinct()
    kinds = [[r["seen"] for r in found.where(want).orderBy(F.xxhash64("seen"), "seen").limit(sample).collect()]
             for want in (F.col("known"), ~F.col("known"))]
    net = CharNet.fit(*kinds)
    if kinds[0]:
        counted = binned_logits(net, found, [*kinds[0], *kinds[1]]).collect()  # two rows a bin at most
        net.calibrate(*(np.array(x) for x in zip(*[(r["bin"] / BINS, float(r["known"]), r["n"]) for r in counted])))
    return net


def binned_logits(net: CharNet, found: DataFrame, sampled: list[str]) -> DataFrame:
    """known, bin, n: logits of all labelled findings (seen, known) but those trained on, rounded down to bins.

    As in training, each counts once with its own context, and once with that of a sampled window in half the cases.
    """
    trained = {w for i, w in enumerate(sampled) if i % 4 != 3}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = coded(sampled)
        inside = np.zeros(LENGTH, bool)
        inside[BEFORE:BEFORE + INSIDE] = True
        for batch in batches:
            apart = [(w, k) for w, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in trained]
            if not apart:
                continue
            x, known = coded([w for w, _ in apart]), np.array([k for _, k in apart])
            drawn = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w, _ in apart])
            swapped = np.where(inside | (drawn % 2 == 0)[:, None], x, others[drawn // 2 % len(others)])
            z = np.clip(np.concatenate((net.logits(x), net.logits(swapped))), -MOST_LOGIT, MOST_LOGIT)
            bins, n = np.unique(np.stack((np.tile(known, 2).astype("i4"), np.floor(z * BINS).astype("i4"))),
                                axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bins[0] == 1), pa.array(bins[1]), pa.array(n)],
                                             names=["known", "bin", "n"])
    return found.select("seen", "known").mapInArrow(run, "known boolean, bin int, n bigint").groupBy("known", "bin").agg(
        F.sum("n").alias("n"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, base and all spans as text, and the added spans with probabilities."""
    scanned = scan_patterns(docs, id_col, text_col)
    net = fit(scanned)
    kind = docs.schema[id_col].dataType.simpleString()
    entry = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, cands = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            open_ = [(i, c) for i, cs in enumerate(cands) for c in cs if not c["known"]]
            first = np.cumsum([0, *[len(c["seen"]) for _, c in open_]])[:-1]
            every = coded([x for _, c in open_ for x in c["seen"]])
            p = np.maximum.reduceat(net.probabilities(every), first) if open_ else []
            added = [[] for _ in base]
            for (i, c), x in zip(open_, p):
                if x >= net.threshold:
                    added[i].append({"start": c["start"], "end": c["end"], "probability": float(x)})
            spans = []
            for text, more in zip(base, added):
                every = [(int(a), KINDS.index(k), int(b)) for k, a, b in (
                    s.split(":") for s in text.split(",") if s)]
                every += [(c["start"], KINDS.index("model"), c["end"]) for c in more]
                spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(every)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(spans, pa.string()), pa.array(added, pa.list_(entry))],
                names=["id", "base", "spans", "added"])
    return scanned.transform(bounded).mapInArrow(
        run, f"id {kind}, base string, spans string, added array<struct<start:bigint,end:bigint,probability:double>>"
    ).withColumnRenamed("id", id_col)


@query("op6_secret_scan")
def op6(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))
    n = {k: F.regexp_count("base", F.lit(rf"\b{k}:")).cast("long") for k in KINDS[:3]}
    return found.select("doc_id", *[n[k].alias(f"n_{k}") for k in n],
                        F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans",
                        F.size("added").cast("long").alias("n_model"))
