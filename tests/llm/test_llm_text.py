"""Tokens, quality, languages, secrets, pages and chat: contracts, plain versions, awkward rows."""

import base64
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from soundalike.llm import byte_bpe as B
from soundalike.llm import chat_format as C
from soundalike.llm import exact_dedup as X
from soundalike.llm import html_extract as H
from soundalike.llm import language_id as L
from soundalike.llm import near_dedup as N
from soundalike.llm import quality_classifier as Q
from soundalike.llm import quality_rules as R
from soundalike.llm import secret_scan as S
from soundalike.llm.kernels import windows, word_hashes

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------------------- tokens

@pytest.fixture(scope="module")
def bpe():
    return B.ByteBpe(*B.default_vocabulary())


@pytest.fixture(scope="module")
def library():
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", [
    "", "a" * 5000, "ab" * 3000, "xyz" * 999, " " * 2000 + "x", "日本語 😀😀 ß" * 30, "<|endoftext|>", "thth" * 400, "\x00\x01é\r\n"])
def test_encoding_equals_library(bpe, library, text):
    ids = library.encode_ordinary(text)
    assert bpe.encode(text) == ids
    assert [x for p in bpe.pattern.findall(text) for x in bpe.merge(p.encode())] == ids
    assert bpe.decode_bytes(ids) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abthein '1  \n"), st.characters(exclude_categories=["Cs"]))))
def test_encoding_of_any_text(bpe, library, text):
    assert bpe.encode(text) == library.encode_ordinary(text)


def test_encode_decode_frames(awkward, awkward_rows, nothing, library):
    path, pattern = B.default_vocabulary()
    out = B.decode(B.encode(awkward, path, pattern), path, pattern).select("text", "ids", "decoded", "id").collect()
    assert len(out) == len(awkward_rows)
    for r in out:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert B.encode(nothing, path, pattern).count() == 0
    assert B.round_trip(nothing, path, pattern).count() == 0


def test_op3_digests(spark, awkward, library):
    got = B.round_trip(awkward, *B.default_vocabulary(), carried=("doc_id", "text"), with_ids=True).collect()
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.exact and r.ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# ------------------------------------------------------------------------ quality

def test_word_hashes_and_windows():
    texts = ["a b c d e f", "", "x", "  a   b ", "é ß\x0bq\x0cr", "w " * 700_000 + "long" * 300_000, "a b c d e f"]
    hashes, counts = word_hashes(texts)
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    seen = dict(zip(words, hashes.tolist()))
    assert [seen[w] for w in words] == hashes.tolist() and len(set(seen.values())) == len(seen)
    found, n = windows(hashes, counts, 5)
    assert n.tolist()[:5] == [2, 0, 1, 1, 1] and found[:2].tolist() == found[-2:].tolist()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(inside))


def test_quality_rules_counts(awkward, documents, nothing):
    for docs in (awkward.where("doc_id is null or doc_id <> 9"), documents.where("n_chars < 3000")):
        got = R.apply_rules(docs)
        for r in got.collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(r.text)
            assert not (r.base_failed and r.kept)
    assert R.apply_rules(nothing).count() == 0
    assert "odd name" in R.apply_rules(awkward).columns


def test_line_rules():
    assert R.line_fault("A plain sentence stands here.") is None
    assert R.line_fault("Home | News | Contact | About") == "navigation"
    assert R.line_fault("no end at all") == "punctuation"
    assert R.line_fault("LOUD!! WORDS!! HERE!!") == "punctuation"
    assert R.line_fault("This site uses cookies.") == "boilerplate"
    chars, lines, dup, faults, lost, left = R.clean("Good line one.\nMenu | A | B | C\n\nGood line one.")
    assert (lines, dup, faults["navigation"], left) == (3, 1, 1, "Good line one.\n\nGood line one.")


@pytest.mark.parametrize("line", ["यह एक वाक्य है।", "هل هذه جملة؟", "这是一个句子。", "これは文です！", "これは「文です。」", "ይህ ዓረፍተ ነገር ነው።", "Full stop."])
def test_sentence_ends_of_other_scripts(line):
    assert R.line_fault(line) is None


def test_rules_keep_clean_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = R.apply_rules(documents).join(labels, "doc_id")
    assert got.where("quality = 1 and not base_failed and not kept").count() == 0


def spark_hash(i, text):
    """xxhash64(bigint, string) as Spark computes it; nulls leave the seed."""
    h = 42
    if i is not None:
        h = xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), seed=h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text.encode(), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain_quality(rows):
    """The classifier in one process: votes, EM, sample, scorer."""
    rows = sorted(rows, key=lambda r: spark_hash(*r))
    stats, words, features = Q.describe([t for _, t in rows])
    votes = Q.vote(stats, words)
    combos, counts = np.unique(votes, axis=0, return_counts=True)
    weak = Q.WeakModel.fit(combos, counts.astype(float))
    features = features.astype("f2").astype("f4")
    scorer = Q.Scorer.fit(features[:Q.SAMPLE], weak.posterior(votes)[:Q.SAMPLE])
    return {i: float(s) for (i, _), s in zip(rows, scorer.score(features))}, scorer


def test_quality_classifier_against_plain(spark, documents):
    want, scorer = plain_quality([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])
    got = {r.doc_id: r for r in Q.score(documents, Q.fit(documents)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i].quality_score - want[i]) < 0.02 for i in want)
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert not [r.doc_id for r in labels if r.quality == 1 and not got[r.doc_id].kept]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(not got[i].kept for i in bad) >= 0.7 * len(bad)


def test_quality_awkward(awkward, nothing):
    out = Q.accepted(awkward)
    assert out.columns == awkward.columns
    assert {4, 5, 6, 7} <= {r.doc_id for r in out.collect()}  # nothing speaks against a short text
    assert Q.accepted(nothing).count() == 0


def test_repeated_rows_count_once_in_the_sample(spark, documents, monkeypatch):
    sizes = []
    fit = Q.Scorer.fit
    monkeypatch.setattr(Q.Scorer, "fit", classmethod(lambda cls, f, t: (sizes.append(len(f)), fit(f, t, rounds=1))[1]))
    some = documents.select("doc_id", "text").limit(150)
    Q.fit(some.unionByName(spark.createDataFrame([(1, "copy of a row")] * 900, some.schema)), sample=120)
    assert sizes == [120]


def test_short_and_unspaced_texts_are_judged():
    r = np.random.default_rng(2)
    good = [" ".join("".join(r.choice(list("abdeil"), 5)) for _ in range(n)).capitalize() + "." for n in r.integers(2, 30, 300)]
    junk = [" ".join("".join(r.choice(list("abdeil"), 4)) + r.choice(["***", ".###", "&&&"]) for _ in range(n))
            for n in r.integers(2, 20, 60)]
    stats, words, features = Q.describe([*good, *junk])
    votes = Q.vote(stats, words)
    combos, counts = np.unique(votes, axis=0, return_counts=True)
    scorer = Q.Scorer.fit(features, Q.WeakModel.fit(combos, counts.astype(float)).posterior(votes))
    stats, words, features = Q.describe(["That*** atly.###", "abid*** leda&&&", "That atly.", "", " \n", "#", "ab***" * 200_000])
    p, votes = scorer.score(features), Q.vote(stats, words)
    assert (p[:2] < scorer.threshold).all() and (p[2:5] >= scorer.threshold).all()
    assert (features[[0, 1, 2, 5, 6]].any(1)).all() and not features[3:5].any()
    assert (votes[[0, 1, 5, 6]] == 0).any(1).all() and (votes[3:5] == 2).all()
    assert (votes[6] == 0).sum() == 3 and p[6] < p[3]  # below what a text without words gets


# ---------------------------------------------------------------------- languages

def test_language_held_out_accuracy(documents):
    model = L.fit(documents)
    got = L.identify(documents, model).withColumn("held", L.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.93 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_awkward(awkward, nothing, documents):
    model = L.fit(documents)
    got = L.identify(awkward, model).collect()
    assert len(got) == awkward.count()
    for r in got:
        letter = any(map(str.isalpha, r.text or ""))
        assert (r.lang_pred == "und") == (not letter) and (letter or r.score == 0)
    none = L.fit(nothing)
    assert {r.lang_pred for r in L.identify(awkward, none).collect()} == {"und"}
    assert L.identify(nothing, model).count() == 0


def test_languages_of_repeated_ids(spark):
    """Rows that share an id are all learnt from, each once; a repeated row does not crowd out others."""
    shared = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 3 != 1)
    a = [(shared, f"the reading of book {i} and the other things we like", "en") for i in range(300)]
    b = [(1000 + 3 * i, f"das lesen von buch {i} und die anderen dinge die wir mögen", "de") for i in range(300)]
    rows = spark.createDataFrame(a + b + b[:1] * 500, "doc_id long, text string, lang string")
    model = L.fit(rows)
    assert model.languages == ["de", "en"]
    got = {r.text: r.lang_pred for r in L.identify(rows, model).collect()}
    assert sum(got[t] == lang for _, t, lang in a + b) >= 598
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(
        F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError):
        L.fit(many.unionByName(many.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(
            many.withColumn("doc_id", F.col("doc_id") + 5000)))


def test_language_scores_equal_plain():
    model = L.train([(np.array([1, 5], "u2"), np.array([0.5, 0.5], "f4")), (np.array([2, 9], "u2"), np.array([0.5, 0.5], "f4"))] * 20,
                    np.array([0, 1] * 20), ["de", "en"], np.array([False] * 40))
    texts = ["The quick brown fox", "der schnelle Fuchs", "x"]
    lang, score, _ = model.predict(texts)
    for t, n, s in zip(texts, lang, score):
        at, share = L._bag(t)
        z = np.zeros(2)
        for b, w in zip(at, share):
            z += w * model.table[b]
        z = (z + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert n == ["de", "en"][int(p.argmax())] and abs(s - p.max()) < 1e-5


def test_subwords_do_not_depend_on_the_block():
    texts = ["Ab c", "", "élan vital", "x"]
    buckets, counts = L.subwords(texts)
    for n in range(len(L.LENGTHS)):
        parts = np.split(buckets[n], np.cumsum(counts[n])[:-1])
        for t, p in zip(texts, parts):
            assert p.tolist() == L.subwords([t])[0][n].tolist()


# ------------------------------------------------------------------------ secrets

def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "API_KEY", "apikey", "secret", " = ", ":", '"', "abc", "AKIA", "ABCDEF123456", "é", "😀",
                                 "0123456789abcdef", "deadbeef", " ", "\n", "_", "Passwd"]), max_size=14).map("".join))
def test_base_spans(text):
    assert S.base_spans(text, S.long_runs(text)) == plain_spans(text)


def test_scan(spark, documents):
    got = {r.doc_id: r for r in S.scan(documents).collect()}
    for r in documents.select("doc_id", "text").collect():
        base = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(r.text or ""))
        assert got[r.doc_id].base == base
        assert set(filter(None, base.split(","))) <= set(got[r.doc_id].spans.split(","))


def test_network_adds_and_keeps_recall():
    rng = np.random.default_rng(0)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(160)]
    words = [f"plainword{rng.integers(10)}otherplainword" for _ in range(160)]
    secrets = [S.window(f"some text token = {h} and more", 18, 58) for h in hexes]
    others = [S.window(f"some text {w} and more", 10, 10 + len(w)) for w in words]
    net = S.CharNet.fit(secrets[:120], others[:120])
    p = net.probabilities(S.coded([S.window(f"plainly {h} here", 8, 48) for h in hexes[120:]]))
    q = net.probabilities(S.coded(others[120:]))
    assert (p >= net.threshold).mean() >= 0.95 and (q >= net.threshold).mean() <= 0.05
    assert S.CharNet.fit([], others).threshold > 1  # without findings nothing is added


def test_threshold_keeps_recall_below_one_half():
    p, truth = np.array([0.1] * 10 + [0.2] * 10 + [0.4] * 20 + [0.9] * 20), np.array([0.0] * 10 + [1] * 10 + [0] * 20 + [1] * 20)
    t = S.chosen_threshold(p, truth)
    assert t == 0.2 and (p[truth == 1] >= t).mean() >= S.RECALL


def test_threshold_counts_every_finding(spark):
    """findings beyond the sample that was trained on decide on the threshold, too."""
    rng = np.random.default_rng(4)
    rows = [(S.window(f"key = {''.join(rng.choice(list('0123456789abcdef'), 40))} x", 6, 46), True) for _ in range(150)]
    rows += [(S.window(f"see plain{i:03d}plainword x", 4, 21), False) for i in range(150)]
    scanned = spark.createDataFrame([(i, [(0, 1, [w], k)]) for i, (w, k) in enumerate(rows)], f"id long, {S.SCAN.split(', ', 1)[1]}")
    found = spark.createDataFrame(rows, "seen string, known boolean")
    for sample in (8, 40):
        kinds = [[r.seen for r in found.where(want).orderBy(F.xxhash64("seen"), "seen").limit(sample).collect()]
                 for want in (F.col("known"), ~F.col("known"))]
        sampled = kinds[0] + kinds[1]
        trained = {w for i, w in enumerate(sampled) if i % 4 != 3}
        net = S.CharNet.fit(*kinds)
        counted = S.binned_logits(net, found, sampled).collect()
        assert sum(r.n for r in counted) == 2 * (300 - len(trained))
        assert sum(r.n for r in counted if r.known) == 2 * sum(k and w not in trained for w, k in rows)
        net = S.fit(scanned, sample)
        p = np.repeat(1 / (1 + np.exp(-np.array([r.bin for r in counted]) / S.BINS / net.temperature)), [r.n for r in counted])
        truth = np.repeat([float(r.known) for r in counted], [r.n for r in counted])
        assert (p[truth == 1] >= net.threshold - 1e-9).mean() >= S.RECALL


def test_threshold_of_counted_findings():
    rng = np.random.default_rng(2)
    for _ in range(50):
        p, truth, n = rng.integers(0, 20, 30) / 20, rng.integers(0, 2, 30).astype(float), rng.integers(1, 9, 30)
        truth[0] = 1
        assert S.chosen_threshold(p, truth, n) == S.chosen_threshold(np.repeat(p, n), np.repeat(truth, n))


def test_whole_runs_and_what_patterns_leave_are_read():
    text = "x " + "".join(f"a{i}B" for i in range(30)) + "MIDDLE9" + "".join(f"c{i}D" for i in range(30)) + " y"
    (run,) = S.long_runs(text)
    assert any("MIDDLE9" in w[S.BEFORE:S.BEFORE + S.INSIDE] for w in S.read_windows(text, *run))
    assert set(range(*run)) <= {i for a in range(run[0], run[1]) for w in S.read_windows(text, *run)
                                if text.find(w[S.BEFORE:S.BEFORE + S.INSIDE]) == a for i in range(a, a + S.INSIDE)}
    text = "q " + "0123456789abcdef" * 2 + "_Second9SecretGoesHere"
    runs = S.long_runs(text)
    assert S.candidates(text, runs, S.base_spans(text, runs)) == [(2, 34, True), (34, len(text), False)]


def test_gradients():
    net = S.CharNet.random(1)
    rng = np.random.default_rng(4)
    x, y = rng.integers(1, 127, (6, S.LENGTH)).astype("i4"), np.array([1.0, 0, 1, 0, 1, 0])

    def loss():
        z = net.logits(x)
        return np.logaddexp(0, np.where(y == 1, -z, z)).mean()
    for w, g in zip((net.embedding, net.filters, net.shift, net.output, net.bias), net.gradients(x, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        down = loss()
        w[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_secrets_awkward(awkward, nothing):
    got = S.scan(awkward).collect()
    assert len(got) == awkward.count() and all(r.spans == r.base for r in got)
    assert S.scan(nothing).count() == 0


# -------------------------------------------------------------------------- pages

def test_pages_article_text(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in H.extract(pages).collect():
        inner = r.html[r.html.find("<article>") + 9:r.html.find("</article>")]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<b>", "").replace("<br>", " "))
        want = "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)
        assert r.text == want


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &amp; text <", "plain & text <"), ("<p>a<b>b</p>c", "ab\nc"), ("<p>a<!-- c -->b", "ab"),
    ("<div>a<br>b <span class='ad'>zz</span>c</div><table><tr><td>1<td>2</table>", "a b c\n1\n2"),
    ("<main><header><h1>T</h1></header><p>x<aside>s</aside><p>y</main><footer>f", "T\nx\ny"),
    ("<article><p>x</p><section id='comments'><p>no</p></section></article>after", "x"),
    ("<div class='cookieBanner'>no</div><ul><li>a<li>b<ul><li>c</ul></ul>", "a\nb\nc"),
    ("<div class='with-sidebar'><article><p>k</article><div class='sidebar'>s</div></div>", "k"),
    ('<script>if(a<b){"</p>"}</script>ok<style>p{}</style>', "ok"), ("<p hidden>h<p>&nbsp; v &copy", "v ©"),
    ("<form><p>name</p><input></form><p title='a>b'>q", "q"), ("<!-- never closed <p>x", "")])
def test_parse(source, want):
    assert H.parse(source).text() == want


def test_style_tree_removes_templates_only(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class='slot'>Same words on every page.</div><div class='story'><p>Only {i} "
             f"has this {i * 7}.<p>Shared by two {i // 2}.</div></body>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", "<div class='slot'>Same words.</div>") for i in range(12)]  # equal pages
    rows += [(200, None, "<div>alone</div>"), (201, "no url", None), (202, "http://c.example", "")]
    got = {r.page_id: r.text for r in H.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Only 3 has this 21.\nShared by two 1."
    assert got[100] == "Same words." and got[200] == "alone" and got[201] == "" and got[202] == ""


def test_style_tree_reaches_into_articles(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><article><h1>Title {i}</h1><div class='box'>Same words everywhere.</div>"
             f"<p>Only {i} has this {i * 7}.</p><p>Half share this {i % 2}.</p></article></body>") for i in range(40)]
    got = {r.page_id: r.text for r in H.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nOnly {i} has this {i * 7}.\nHalf share this {i % 2}." for i in range(40)}


@pytest.mark.parametrize("source, want", [
    ("<article class='post comments-open'><h1>T</h1><p>x</article>", "T\nx"),
    ("<div class='has-share-buttons'><article><p>x</article></div>", "x"),
    ("<div class='share'><article><p>x</article></div><div class='share'>no</div>", "x"),
    ("<article><h2 id='related-work'>R</h2><h2 id='related'>S</h2><section id='social-notice'><p>x</section></article>", "R\nS\nx"),
    ("<article><p>x<div class='comments'><article>no</article></div></article>", "x"),
    ("<form><main><p>x</main><p>no</form>", "x")])
def test_names_count_whole_and_spare_articles(source, want):
    assert H.parse(source).text() == want


@pytest.mark.parametrize("name", ["post-comments", "comments-area", "user-comments", "reader-comments", "cookie-consent-banner",
                                  "advert-box", "userComments", "article_comments", "top-ad"])
def test_parts_of_names(name):
    assert H.parse(f"<article><p>x</p><div class='{name}'>no <p>no</p></div><p>y</p></article>").text() == "x\ny"
    assert H.parse(f"<div id='{name}'><article><p>x</p></article></div>").text() == "x"


@pytest.mark.parametrize("name", ["comments-open", "no-comments", "has-ads", "with-sidebar", "adventure", "commentary", "consented"])
def test_parts_of_names_that_say_something_else(name):
    assert H.parse(f"<div class='{name}'><p>x</p></div>").text() == "x"


def test_parts_of_names_that_may_be_wrong(spark):
    """The tree removes a notice that all pages share and keeps one that differs."""
    rows = [(i, "http://h.example/x", f"<article><p>Own {i}.</p><div class='site-notice'>We moved.</div>"
             f"<div class='editor-notice'>Corrected {i} times.</div></article>") for i in range(6)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own {i}.\nCorrected {i} times." for i in range(6)}


def plain_tree(pages):
    """The tree of one host without Spark: what was seen of each node."""
    import math
    from collections import Counter, defaultdict
    nodes, blocks = defaultdict(list), defaultdict(Counter)
    for source in set(pages):
        held = defaultdict(list)
        for b in H.parse(source).blocks:
            held[b.path].append(b.text)
        for path, texts in held.items():
            nodes[path].append(len(texts))
            blocks[path].update(set(texts))
    seen = {}
    for path, counts in nodes.items():
        m = len(counts)
        found = 0.0
        if m > 1:
            content = 1 - sum(math.log(k) for k in blocks[path].values()) / len(blocks[path]) / math.log(m)
            entropy = -sum(k / m * math.log(k / m) for k in Counter(counts).values()) / math.log(m)
            found = H.CONTENT * content + (1 - H.CONTENT) * entropy
        seen[path] = (found * (m - 1) + 0.5 * H.DOUBT) / (m - 1 + H.DOUBT)
    return seen


def test_tree_equals_plain_and_sees_what_is_declared(spark):
    """A menu without a telling name, one with, a form and a notice inside the article are all nodes."""
    pages = [f"<div class='top'>Home News</div><nav>Menu</nav><div class='tail'>Text {i} of its own.</div>"
             f"<form>Search {i % 3}</form><div class='post-comments'>Reply {i}.</div>" for i in range(12)]
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)] + [(99, "http://h.example/0", pages[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.path % (1 << 64): (r.seen, r.noise) for r in H.style_tree(df).collect()}
    want = plain_tree(pages)
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and len(got) == 5
    assert sorted(n for _, n in got.values()) == [0, 0, 2, 2, 3]
    assert {r.text for r in H.extract(df).collect()} == {f"Text {i} of its own." for i in range(12)}


def test_small_hosts_and_names_by_the_tree(spark):
    rows = [(10 * m + i, f"http://h{m}.example/{i}", f"<div class='slot'>Home News About</div><div class='notice'>Same "
             f"notice.</div><div class='related'>Work {i} of others.</div><div class='story'>Only {i} has this.</div>")
            for m in (2, 3, 7) for i in range(m)]
    got = {r.page_id: r.text for r in H.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[20] == "Only 0 has this." or got[20] == "Work 0 of others.\nOnly 0 has this."
    assert got[75] == "Work 5 of others.\nOnly 5 has this."


def test_pages_awkward(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, host string, path int")
    assert H.extract(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.y/z", "<p>a" + "<div>" * 3000 + "b" * 100000, "t", "h", 5)] * 2, empty.schema)
    assert [len(r.text) for r in H.extract(one).collect()] == [100002] * 2


# --------------------------------------------------------------------------- chat

def test_chat(spark):
    rows = [(1, True, 0, "system", "s"), (1, True, 1, "user", "hi"), (1, True, 2, "assistant", "good"),
            (1, False, 0, "system", "s"), (1, False, 1, "user", "hi"), (1, False, 2, "assistant", "bad <|x|>"),
            (1, False, 3, "user", None), (2, True, None, None, "lone"), (3, True, 0, "user", "same"),
            (3, False, 0, "user", "same"), (None, True, 0, "user", "nobody"), (4, True, 0, "user", "tie"), (4, True, 0, "user", "a")]
    got = {r.pair_id: r for r in C.format_pairs(spark.createDataFrame(
        rows, "pair_id long, chosen boolean, turn long, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    r = got[1]
    assert r.prompt == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n" and r.prefix_turns == 2 and r.usable
    assert [r.chosen[s.start:s.end] for s in r.chosen_spans] == ["good<|end|>"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_spans] == ["bad < |x| ><|end|>"]
    assert r.rejected.endswith("<|user|>\n<|end|>\n")
    assert got[2].rejected == "" and not got[2].usable and got[2].chosen.startswith("<|user|>")
    assert got[3].chosen == got[3].rejected == "" and got[3].prefix_turns == 1
    assert got[4].chosen == "<|user|>\na<|end|>\n<|user|>\ntie<|end|>\n"


def test_pairs_share_their_context(spark):
    long = "word " * 200_000
    rows = [(2, 0, "system", "s", "x", 1), (2, 1, "user", "hi", "x", 1), (2, 2, "assistant", "first", "x", 1), (2, 3, "user", "more", None, 1),
            (2, 4, "assistant", "mine", "x", 1), (2, 5, "user", "bye", "x", 1), (3, 0, "user", "q", "x", 1),
            (3, 1, "assistant", "theirs", "x", 1), (4, 0, "user", "no reply", "x", 1), (5, 0, None, None, "x", 1), (5, 1, "assistant", long, "x", 1),
            (6, 0, "assistant", "alone", "x", 1), (None, 0, "user", "nobody", "x", 1)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chosen string, pair_id int")
    got = {r.pair_id: r for r in C.format_pairs(C.reply_pairs(turns)).collect()}
    assert set(got) == {2, 3, 4, 5, 6}
    assert got[2].prefix_turns == 4 and got[2].usable and got[2].prompt.endswith("<|user|>\nmore<|end|>\n")
    assert (got[2].chosen, got[2].rejected) == ("<|assistant|>\nmine<|end|>\n", "<|assistant|>\ntheirs<|end|>\n")
    assert got[3].rejected == "<|assistant|>\nmine<|end|>\n" and got[3].usable
    assert got[4].chosen == got[4].rejected == "" and not got[4].usable
    assert len(got[5].chosen) == len(long) + 22 and got[5].rejected == "" and got[5].prompt == "<|user|>\n<|end|>\n"
    assert got[6].prompt == "" and not got[6].usable
    assert C.format_pairs(C.reply_pairs(turns.limit(0))).count() == 0


def test_registered_pairs_have_prompts(spark):
    got = C.op10(spark, SF).collect()
    assert all(r.prompt for r in got if r.prefix_turns) and sum(r.usable for r in got) > len(got) // 2


def test_chat_plan_is_native(spark):
    df = C.format_pairs(C.reply_pairs(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    assert df.limit(0).count() == 0


# ----------------------------------------------------------------------- pipeline

def test_sql_oracles(spark):
    from check_oracles import TABLES, rows_of
    from soundalike.llm import load_queries
    queries, oracles = load_queries()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in oracles.items():
        df, rel = queries[name](spark, SF), con.sql(sql)
        assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall()), name


def test_pipeline_against_plain(spark, documents, library):
    """Every stage against a plain version of it on the smallest tables."""
    stages = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = documents
    rows = {r.doc_id: r.text for r in docs.collect()}
    want, scorer = plain_quality(list(rows.items()))
    docs = stages[names[0]](spark, docs, SF).cache()
    assert docs.columns == documents.columns
    kept = {r.doc_id for r in docs.collect()}
    assert {i for i, s in want.items() if abs(s - scorer.threshold) > 0.02 and s >= scorer.threshold} <= kept
    assert not kept & {i for i, s in want.items() if s < scorer.threshold - 0.02}

    docs = stages[names[1]](spark, docs, SF).cache()
    groups = {}
    for i in sorted(kept):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", rows[i]), []).append((-len(rows[i]), i))
    assert docs.columns == documents.columns
    assert sorted(r.doc_id for r in docs.collect()) == sorted(min(g)[1] for g in groups.values())

    left = {r.doc_id for r in docs.collect()}
    docs = stages[names[2]](spark, docs, SF).cache()
    stay = {r.doc_id for r in docs.collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i in left for w in [rows[i].split()]}
    assert docs.columns == documents.columns and stay <= left
    for i in left - stay:  # went for a smaller id that is close, directly or by others
        assert any(len(sets[i] & sets[j]) > 0.5 * len(sets[i] | sets[j]) for j in left if j != i)
    for i in stay:
        assert not any(j in stay and j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in stay)

    mixed = stages[names[3]](spark, docs, SF).cache()
    assert mixed.columns == documents.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3 and set(counts) <= stay
    out = stages[names[4]](spark, mixed, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, n in counts.items() for _ in range(n))
    assert all(r.ids == library.encode_ordinary(rows[r.doc_id]) and r.exact for r in out)
    run = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.ids_sha256) for r in run.collect()) == sorted((r.doc_id, r.ids_sha256) for r in out)


def test_stages_awkward(spark, awkward, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, awkward, SF)
        assert out.count() <= 3 * awkward.count()
        assert stage(spark, nothing, SF).count() == 0, name
