"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its odd cases."""

import collections
import hashlib
import html
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("quaywise.llm")

from pyspark.sql import functions as F  # noqa: E402

from quaywise.llm import bpe, encoding, fingerprints, langid, language_model, media, neardup, packing, pages, quality, repeats, textbytes  # noqa: E402
from quaywise.llm.store import Workspace  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _texts(n=60, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(70))
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 220))]
        if i % 4 == 0:
            words[20:20] = passage.split()
        if i % 7 == 3 and out:
            words = (out[-1] or "").split()
            if words and i % 2:
                words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words).capitalize() + ("\n" if i % 3 else ""))
    out[5], out[6], out[7], out[8] = None, "", " \t\n", "1234 ... !!"
    out[9] = out[10] = "Two words"
    out[11] = "ab " * 6000
    return out


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["xx" if i % 2 else "yy" for i in range(len(texts))]
    rows = [(i, t, lang, "s", len(t or ""), f"extra{i}") for i, (t, lang) in enumerate(zip(texts, langs))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, places string").repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_fingerprints(docs, nothing, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(docs.sparkSession, docs).collect()}
    t = [x or "" for x in texts]
    assert len(got) == len(t)
    for i, x in enumerate(t):
        n, following = len(x), t[(i + 1) % len(t)]
        edited = x[: n - n // 4] + following[: n // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n
        assert got[i].near_next == float(got[i].fingerprint == got[(i + 1) % len(t)].fingerprint)
        assert got[i].near_edited == float(got[i].fingerprint == got[i].edited_fingerprint)
    assert got[9].fingerprint == got[10].fingerprint and got[10].class_id == 9
    assert fingerprints.fingerprint_report(docs.sparkSession, nothing).count() == 0


def test_fingerprints_fold_case_space_and_composition(spark):
    rows = ["Café  AU\tlait", " café au lait\n", "café au lai", "Ｃafé au lait"]
    got = [r.fingerprint for r in fingerprints.fingerprint(spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == got[1] == got[3] != got[2]


def test_successors_of_many_ids(spark):
    ids = spark.range(300_000).select(F.expr("pmod(xxhash64(id), 100000000000)").alias("doc_id"), F.lit(3).alias("n_chars"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = {r.doc_id: r.next_id for r in fingerprints.next_ids(ids, Workspace(spark, "successors")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = sorted(got)
    assert len(want) == 300_000 and all(got[a] == b for a, b in zip(want, [*want[1:], want[0]]))


def test_fingerprints_of_repeated_ids(spark):
    rows = [(1, "aaaa bbbb"), (1, "AAAA bbbb"), (1, "aaaa bbbb"), (2, "cccccc"), (2, "dd"), (3, None), (None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("rep", F.lit(1)).withColumn("fingerprint", F.lit(1))
    got = fingerprints.fingerprint_report(spark, table).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got) == [(1, 9), (1, 9), (1, 9), (2, 2), (2, 6), (3, 0)]
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1 and {r.class_id for r in got if r.doc_id == 1} == {1}


def test_fingerprints_tell_colliding_texts_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda form: F.lit("0" * 48))
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A"), (4, "b")], "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(spark, table).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint == got[4].fingerprint
    assert [got[k].class_id for k in (1, 2, 3, 4)] == [1, 2, 1, 2]


def test_language_model(docs, nothing, texts):
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in language_model.score_texts(base).collect()}
    tokens = {i: [*WORD.findall((x or "").translate(LOWER)), ""] for i, x in enumerate(texts)}
    c = collections.Counter(w for i, t in tokens.items() if i % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.score < 0
    assert language_model.score_texts(base.limit(0)).count() == 0


def test_forward_recursion_equals_all_paths():
    rng = np.random.default_rng(0)
    model = language_model.HiddenMarkov(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 4, 3))
    seqs = [[0], [1, 2, 3], [3, 3, 0, 1], []]
    flat = np.array([x for s in seqs for x in s])
    first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    got = model.log_likelihoods(flat, first)
    for s, g in zip(seqs, got):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(s)):
            p = 1.0
            for t, k in enumerate(path):
                p *= (model.start[k] if t == 0 else model.move[path[t - 1], k]) * model.emit[k, s[t]]
            total += p
        assert math.isclose(g, math.log10(total) if s else 0.0, abs_tol=1e-12)


@pytest.mark.parametrize("block", [1, 2, 3, 256])
def test_expected_counts_equal_those_of_all_paths(monkeypatch, block):
    monkeypatch.setattr(language_model, "BLOCK", block)
    rng = np.random.default_rng(0)
    model = language_model.HiddenMarkov(rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3), rng.dirichlet([1] * 4, 3))
    seqs = [rng.integers(0, 4, k) for k in (1, 2, 5, 7, 7, 3)]
    start, move, emit, likelihood = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4)), 0.0
    for x in seqs:
        paths = []
        for path in itertools.product(range(3), repeat=len(x)):
            p = 1.0
            for t, k in enumerate(path):
                p *= (model.start[k] if t == 0 else model.move[path[t - 1], k]) * model.emit[k, x[t]]
            paths.append((path, p))
        total = sum(p for _, p in paths)
        likelihood += math.log(total)
        for path, p in paths:
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[k, x[t]] += p / total
                if t:
                    move[path[t - 1], k] += p / total
    want = np.concatenate([start, move.ravel(), emit.ravel(), [likelihood, sum(map(len, seqs))]])
    assert np.allclose(model.expected(seqs), want, atol=1e-9)


def test_scores_equal_a_plain_forward_recursion(spark, texts, monkeypatch):
    monkeypatch.setattr(language_model, "LOCAL", 40)  # so that most words are looked up in the join
    monkeypatch.setattr(language_model, "TOP", 20)
    rows = [(i % 40, x, i % 7 == 2) for i, x in enumerate(texts)]  # repeated ids
    table = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").withColumn("row", F.lit(1))
    got = collections.Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 5)) for r in language_model.score_texts(table).collect())
    train = table.filter(~F.col("held_out"))
    counts = language_model.word_counts(train)
    lexicon = language_model.build_lexicon(counts, train.count())
    own = language_model.sequences(table, lexicon).cache()
    model = language_model.train_model(own.filter(~F.col("held_out")), lexicon)
    tokens = [[*WORD.findall((x or "").translate(LOWER)), ""] for _, x, _ in rows]
    c = collections.Counter(w for t, r in zip(tokens, rows) for w in t if not r[2])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for (i, x, _), t in zip(rows, tokens):
        data = np.frombuffer((x or "").encode(), dtype=np.uint8)
        keys, _ = language_model.word_keys(data, np.array([0, len(data)]))
        at, found = lexicon.find(keys)
        top = np.where(found, lexicon.top[at], -1)
        seq = [*np.where(top >= 0, top, 21 + language_model.tail_class(keys)), 20]
        a, score = None, 0.0
        for k in seq:
            a = model.start * model.emit[:, k] if a is None else (a @ model.move) * model.emit[:, k]
            score += math.log10(a.sum())
            a = a / a.sum()
        for w, k in zip(t, seq):
            if k > 20:
                score += math.log10(c[w] + 1) - lexicon.tail_log[k - 21]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        want[(i, len(t), sum(c[w] > 0 for w in t), round(base, 6), round(score, 5))] += 1
    assert got == want


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 3, 40) + 3 * (i % 2) for i in range(30)]
    model = language_model.HiddenMarkov.guess(np.bincount(np.concatenate(seqs), minlength=6), 2)
    seen = []
    for _ in range(12):
        counts = model.expected(seqs)
        seen.append(counts[-2])
        assert math.isclose(counts[2 + 4 : -2].sum(), counts[-1])
        model = language_model.HiddenMarkov.estimate(counts, 2, smooth=1e-9)
    assert all(b > a - 1e-6 for a, b in zip(seen, seen[1:])) and seen[-1] > seen[0] + 100


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>
    <header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, many cookies, all the time.</p></div>
    <div class="content"><h2>Head &amp; tail</h2><p>First, a paragraph   with <a href="y">one link</a>,<br>and a break.
    <p>Second &lt;one&gt; &eacute;&nbsp;x.<script>var a="</p><p>no";</script><aside><p>Aside, not wanted, at all.</p></aside>
    <ul><li>Item one<li>Item two</ul><form><p>Sign up, please, now.</p></form></div>
    <div id="comments"><p>A comment, long enough, to be scored as a paragraph of text, or so it says, twice.</p></div><footer>&copy; me"""
    assert pages.main_text(page) == "Head & tail\nFirst, a paragraph with one link, and a break.\nSecond <one> é x.\nItem one\nItem two"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p><!-- x --></p>") == pages.main_text("<nav>only a menu</nav>") == ""
    assert pages.main_text("just text") == "just text"
    assert pages.main_text("<div><p>" * 3000 + "deep, deep text") == "deep, deep text"
    assert pages.main_text('<p title="a > b">in</p><a href="x' ) == "in"


PARAGRAPHS = "<p>First paragraph, with commas, and enough text to be scored, said the author.</p><p>Second paragraph, also with commas, and long enough.</p>"
PLAIN = "First paragraph, with commas, and enough text to be scored, said the author.\nSecond paragraph, also with commas, and long enough."


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="page has-sidebar"><article>{PARAGRAPHS}</article><div class="sidebar"><p>Side, side, text.</p></div></div>', PLAIN),
        (f'<article><h1>Title</h1><div class="body">{PARAGRAPHS}</div></article>', f"Title\n{PLAIN}"),
        (f'<body><h1>T</h1><div>{PARAGRAPHS}</div><h2>Mid</h2><div>{PARAGRAPHS}</div><div><a href=x>a long link text</a></div></body>', f"T\n{PLAIN}\nMid\n{PLAIN}"),
        (f'<div class="content">{PARAGRAPHS}</div><div id="comments">{PARAGRAPHS * 5}</div><section class="comment-list"><h2>C</h2><article class="comment">{PARAGRAPHS * 4}</article></section>', PLAIN),
        (f'<div class="no-sidebar"><h1>T</h1><div>{PARAGRAPHS}</div></div><div class="cookie-notice"><p>{"We use cookies, yes. " * 30}</p></div>', f"T\n{PLAIN}"),
        (f'<div data-role="menu"><p>{PARAGRAPHS}</div>', PLAIN),
    ],
)
def test_page_shapes(page, want):
    assert pages.main_text(page) == want


@pytest.mark.parametrize("page", ["<div>text, here " * 66_000, "<b>" * 80_000 + "<h2>x</h2></i>" * 50_000, "<table><tr><td><p>a, b" * 45_000, "<li><i>x" * 120_000])
def test_a_megabyte_of_nested_blocks_takes_seconds(page):
    began = time.process_time()
    pages.main_text(page)
    assert time.process_time() - began < 8


def test_pages_of_the_test_table(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in table.collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body.replace("<br>", " "))]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    got = {r.page_id: (r.text, r.n_chars) for r in pages.op3_pages(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert pages.extract(table.limit(0)).count() == 0


def test_gradients_are_right():
    net, rng = langid.BiGru(["a", "b", "c"]), np.random.default_rng(0)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x = rng.integers(0, 5, (4, 64)).astype(np.uint8)
    inside, y = np.arange(64) < np.array([64, 64, 30, 5])[:, None], np.array([0, 1, 2, 0])
    x = np.where(inside, x, 0)
    _, g = net.gradients(x, inside, y)
    for k, value in net.p.items():
        at = (2, 3) if k[0] == "w" else tuple(0 for _ in value.shape)
        old, e = value[at], 1e-3
        value[at] = old + e
        up = net.gradients(x, inside, y)[0]
        value[at] = old - e
        down = net.gradients(x, inside, y)[0]
        value[at] = old
        assert math.isclose((up - down) / 2 / e, g[k][at], rel_tol=1e-2, abs_tol=1e-5)


def _plain_states(net, text, d):
    """States after each byte by the unit's equations, a byte at a time."""
    h, n, out = np.zeros(net.hidden), net.hidden, []
    w, u = net.p[f"w{d}"].astype(float), net.p[f"u{d}"].astype(float)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for b in text:
        a, r = w[b], h @ u
        reset, update = sigmoid(a[:n] + r[:n]), sigmoid(a[n : 2 * n] + r[n : 2 * n])
        new = np.tanh(a[2 * n :] + reset * r[2 * n :])
        h = update * h + (1 - update) * new
        out.append(h)
    return out


def test_document_probabilities_equal_a_plain_loop_over_bytes():
    net, rng = langid.BiGru(["a", "b", "c"], seed=3), random.Random(5)
    texts = [b"", b"x", "åß 中".encode(), rng.randbytes(255), rng.randbytes(256), rng.randbytes(1500)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    got = net.documents(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    span, context = langid.SPAN, langid.CONTEXT
    for text, g in zip(texts, got):
        total = np.zeros(3)
        for at in range(0, len(text), span):
            lo, hi = max(0, at - context), min(len(text), at + span + context)
            forward = _plain_states(net, text[lo:hi], "f")
            back = _plain_states(net, text[lo:hi][::-1], "b")[::-1]
            for k in range(at - lo, min(at + span, len(text)) - lo):
                y = np.exp(np.concatenate([forward[k], back[k]]) @ net.p["v"] + net.p["c"])
                total += y / y.sum()
        assert np.allclose(g, total / max(total.sum(), 1e-12), atol=1e-4)


def test_fingerprints_shuffle_texts_once_for_both_joins_and_broadcast_none(spark, sf, monkeypatch):
    plans, write = {}, fingerprints.Workspace.table

    def table(work, df, name):
        if name in ("prints", "bytes"):
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return write(work, df, name)

    monkeypatch.setattr(fingerprints.Workspace, "table", table)
    fingerprints.op1_fingerprints(spark, sf)
    assert "ReusedExchange" in plans["prints"] and not any("Broadcast" in p for p in plans.values())


def test_prediction_takes_only_the_steps_that_labels_depend_on():
    net, rng = langid.BiGru(["a", "b"], seed=6), random.Random(8)
    net.p["wf"] *= 400  # gates that are shut
    data = np.frombuffer(rng.randbytes(1200), dtype=np.uint8)
    begin, _, _, _ = langid.stretches(np.array([0, 700, 1200]))
    lo, hi = np.array([0, 0, 0, 700, 700]), np.array([700, 700, 700, 1200, 1200])
    x, inside = (np.ascontiguousarray(a.T) for a in langid.windows(data, begin, lo, hi, langid.SPAN + 2 * langid.CONTEXT))
    for d in "fb":
        read = set()

        class Rows(np.ndarray):
            def __getitem__(self, t):
                read.add(t)
                return np.asarray(self)[t]

        got = net._states(x.view(Rows), inside, d)
        assert len(read) == langid.SPAN + langid.CONTEXT
        assert np.allclose(got, net._run(x, inside[:, :, None], d)[langid.CONTEXT : langid.CONTEXT + langid.SPAN], atol=1e-4)


def test_languages(spark, sf, docs, nothing):
    held = langid.op4_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out").toPandas()
    assert (held.lang == held.lang_pred).mean() > 0.9
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id)
    model = langid.BiGru(["xx", "yy"])
    got = {r.doc_id: r for r in langid.predict_languages(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert {got[i].lang_pred for i in (5, 6, 7, 8)} == {"und"} and got[0].lang_pred in ("xx", "yy")
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].places == "extra0"
    assert langid.predict_languages(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(docs, langid.fit_languages(nothing)).collect()} == {"und"}


def test_quality_finds_planted_words():
    rng = random.Random(0)
    words = [f"w{i}" for i in range(300)]
    rows, grade = [], []
    for i in range(2000):
        g = (0, 1, 2, 2)[i % 4]
        t = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if g == 0:
            t[3] = rng.choice(["vile", "awful"])
        if g == 1:
            t = [w + "%%" for w in t]
        data = np.frombuffer(" ".join(t).encode(), dtype=np.uint8)
        rows.append(quality.features(data, np.array([0, len(data)]))[0])
        grade.append(g)
    grade = np.array(grade)
    model = quality.OrdinalModel().fit(rows[:1600], grade[:1600])
    assert (np.diff(model.thresholds) > 0).all()
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows[1600:]])])
    tails = model.tails(model.scores(np.concatenate(rows[1600:]), at))
    assert ((tails[:, 1] >= 0.5) == (grade[1600:] == 2)).mean() > 0.97
    assert tails.sum(axis=1)[grade[1600:] == 0].mean() < tails.sum(axis=1)[grade[1600:] == 1].mean()


def test_quality_odd_cases(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 1), (2, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades(labels).collect()} == {0: 2, 1: 0, 99: 2}
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, model, keep_columns=True)
    assert got.count() == docs.count() and "places" in got.columns
    clash = docs.withColumn("selected", F.lit("x")).withColumn("expected_grade", F.lit("y")).withColumn("grade", F.lit("z"))
    kept = quality.score_quality(clash, quality.fit_quality(clash, labels), keep_columns=True, names=("a", "b", "c")).first()
    assert (kept.selected, kept.expected_grade, kept.grade) == ("x", "y", "z")
    assert quality.score_quality(clash, model, keep_columns=True).schema["selected"].dataType.simpleString() == "boolean"


def test_quality_scores_equal_a_dense_model(docs, texts):
    rng = np.random.default_rng(0)
    model = quality.OrdinalModel()
    model.weights, model.thresholds = rng.normal(size=1 << quality.BITS).astype(np.float32), np.array([-0.5, 0.7])
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    for i, x in enumerate(texts):
        raw = np.frombuffer((x or "").encode(), dtype=np.uint8)
        dense = np.zeros(1 << quality.BITS)
        dense[quality.features(raw, np.array([0, len(raw)]))[0]] = 1
        tails = [1 / (1 + math.exp(-np.clip(dense @ model.weights - t, -40, 40))) for t in model.thresholds]
        assert math.isclose(got[i].expected_grade, sum(tails), abs_tol=1e-3) and math.isclose(got[i].tail_probability, tails[1], abs_tol=1e-3)
        assert got[i].selected == (got[i].tail_probability >= quality.SELECT)


def test_the_fit_follows_the_gradient_of_the_likelihood():
    """With no penalty and one batch, the first step is the plain gradient's sign and the loss falls."""
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 3, 300)
    rows = [np.unique(np.append(rng.integers(10, 60, 5), g)).astype(np.int64) for g in grade]
    model = quality.OrdinalModel().fit(rows, grade, epochs=40, l1=0.0)
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    tails = np.column_stack([np.ones(300), model.tails(model.scores(np.concatenate(rows), at)), np.zeros(300)])
    p = tails[np.arange(300), grade] - tails[np.arange(300), grade + 1]
    assert -np.log(np.maximum(p, 1e-9)).mean() < 0.5 < math.log(3)
    assert model.weights[0] < model.weights[1] < model.weights[2]


def test_fit_is_the_same_in_any_order(docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) quality", "cast(doc_id % 5 = 0 as int) toxic")
    a, b = (quality.fit_quality(d, labels) for d in (docs, docs.repartition(3, "source").orderBy(F.desc("doc_id"))))
    assert (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_quality_of_nothing(nothing):
    labels = nothing.selectExpr("doc_id", "1 quality", "0 toxic")
    assert quality.score_quality(nothing, quality.fit_quality(nothing, labels)).count() == 0


ODD = ["", " ", "  a", "a  b", "\n\nThe", "don't", "'s", "x's't", "'street ''s", " 's", "\n's", "it'll've", "a1 ²3", "é中 文😀", "<|endoftext|>", "a<|endoftext|> b", "\x85x \xa0 y", "\r\n\r\n", "tab\tend  "]


def test_bpe_equals_the_tokenizers_library():
    from tokenizers import Tokenizer

    want, own = Tokenizer.from_file(bpe.default_path()), bpe.tokenizer(bpe.default_path())
    rng = random.Random(2)
    parts = ["a", "'", "s", "ll", "re", " ", "  ", "\n", "é", "中", "1", "...", "<|endoftext|>", "😀", "Hello", "\x1c"]
    for text in [*ODD, *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500))]:
        ids = own.encode(text)
        assert ids == want.encode(text, add_special_tokens=False).ids
        assert own.decode(ids) == want.decode(ids, skip_special_tokens=False) == text
    plain, core = "Streaming | isheedheat. Thntention", own.core
    fast = own.merge(plain.encode()[:9])
    own.core = None
    assert own.merge(plain.encode()[:9]) == fast
    own.core = core


def _thue_morse(n, a="a", b="b", gap=""):
    return gap.join((a, b)[i.bit_count() & 1] for i in range(n))


def test_texts_that_collide_under_polynomials_are_told_apart(spark):
    """Over any odd base modulo 2 ** 64 these and their complements have one hash."""
    from tokenizers import Tokenizer

    want, own = Tokenizer.from_file(bpe.default_path()), bpe.ByteBpe(bpe.default_path())
    pairs = [(_thue_morse(n), _thue_morse(n, "b", "a")) for n in (1024, 2048)]
    for t in itertools.chain(*pairs):
        assert own.encode(t) == want.encode(t, add_special_tokens=False).ids
    rows = [(k, t) for k, t in enumerate(itertools.chain(*pairs))]
    assert all(r.kept for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_fragments_of_one_hash_are_told_apart(monkeypatch):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(bpe.default_path())
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    own = bpe.ByteBpe(bpe.default_path())
    for t in ("hello world foo bar", "the cat sat on mats", "hello there"):
        assert own.encode(t) == want.encode(t, add_special_tokens=False).ids


def test_span_hashes_do_not_depend_on_place_or_block(monkeypatch):
    text = b"ab " + b"x" * 100 + b" ab " + b"x" * 100 + b" " + b"y" * 70
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends, _ = textbytes.word_bounds(data, np.array([0, len(data)]))
    a = textbytes.span_hashes(data, starts, ends)
    assert a[0] == a[2] and a[1] == a[3] and len(set(a.tolist())) == 3
    monkeypatch.setattr(textbytes, "CHUNK_BYTES", 50)
    assert (textbytes.span_hashes(data, starts, ends) == a).all()


def test_round_trip(docs, nothing, texts):
    got = {r.doc_id: r for r in encoding.round_trip(docs).collect()}
    own = bpe.tokenizer(bpe.default_path())
    for i, x in enumerate(texts):
        ids = own.encode(x or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((x or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts)}
    assert encoding.round_trip(nothing).count() == 0


def test_jpeg_files_hold_the_payload():
    rng = random.Random(3)
    for n in (0, 1, 192, 193, 777, 40_000):
        payload = media.pad(rng.randbytes(n))
        file = media.write_jpeg(payload)
        image = media.Jpeg(file)
        assert image.payload() == payload and len(payload) % 192 == 0 and len(payload) > 0
        assert image.thumbnail().shape == (image.height // 8, image.width // 8)
    with pytest.raises(ValueError):
        media.Jpeg(b"no picture")


def _bits(values):
    out = 0
    n = 0
    for v, k in values:
        out, n = out << k | v, n + k
    pad = -n % 8
    return ((out << pad) | ((1 << pad) - 1)).to_bytes((n + pad) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_other_baseline_tables_are_decoded_symbol_by_symbol():
    """A grey 16 x 8 picture with zero runs, end of block and a restart interval."""
    dc = {0: 2, 3: 2, 5: 2}  # category: code length
    ac = {0x00: 2, 0x23: 2, 0xF0: 3}  # end of block, two zeros and a category 3, sixteen zeros
    code = {0: 0b00, 3: 0b01, 5: 0b10}
    acode = {0x00: 0b00, 0x23: 0b01, 0xF0: 0b100}
    block = lambda s, v: [(code[s], 2), (v, s), (acode[0xF0], 3), (acode[0x23], 2), (0b101, 3), (acode[0x00], 2)]
    scan = _bits(block(3, 0b110)) + b"\xff\xd0" + _bits(block(5, 0b01010))
    seg = media._segment
    file = (
        b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
        + seg(0xC4, media._table(0x00, dc)) + seg(0xC4, media._table(0x10, ac)) + seg(0xDD, b"\x00\x01")
        + seg(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + scan + b"\xff\xd9"
    )
    image = media.Jpeg(file)
    a, b = image.blocks[0]
    assert (a[0], b[0]) == (6, -21) and a[19] == b[19] == 5 and np.count_nonzero(a) == 2
    assert image.thumbnail().tolist() == [[128 + 6, 128 - 21]]


def test_media_rows(docs, nothing, texts):
    got = {r.doc_id: r for r in media.describe_media(media.media_table(docs)).collect()}
    for i, x in enumerate(texts):
        payload = media.pad((x or "").encode())
        assert (got[i].n_bytes, got[i].payload_bytes) == (len((x or "").encode()), len(payload))
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-16:])
    assert got[5].feature == got[6].feature and got[9].media_sha256 == got[10].media_sha256
    assert media.describe_media(media.media_table(nothing)).count() == 0
    gap = media.describe_media(docs.selectExpr("doc_id", "1L n_bytes", "cast(null as binary) media").limit(1)).first()
    assert gap.payload_sha256 is None and gap.feature is None


def _shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(docs, nothing, texts):
    sets = [_shingles(x) for x in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}
    assert len({find(i) for i in range(len(sets))}) < len(sets)
    assert neardup.near_duplicates(nothing).count() == 0


def test_a_chain_of_links_is_one_component(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(100 - k, " ".join(words[3 * k : 3 * k + 60])) for k in range(8)]
    got = {r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {93}


def test_near_duplicates_of_repeated_ids(spark):
    a, b = "a b c d e f g h i j k l m n o p q r s t u v", "zz yy xx ww vv uu tt ss rr qq pp"
    rows = [(5, a), (5, b), (7, b.replace("tt", " tt")), (6, a.replace("v", "w").upper()), (6, a.replace("v", "w")), (None, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "size", "label", "cells")})
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(table).collect()) == [(5, 5), (5, 5), (6, 5), (6, 5), (7, 5)]


def test_the_bound_drops_no_pair_that_is_alike(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 150, 3000]))]
        for _ in range(2):
            rows.append((len(rows), " ".join(w if rng.random() > 0.02 else "zz" for w in words)))
    found = neardup.sketch(neardup_rows(spark, rows)).select("doc_id", F.col("n_shingles").alias("size"), "cells")
    other = found.select(*(F.col(c).alias(f"{c}_x") for c in found.columns))
    passed = {(r.doc_id, r.doc_id_x) for r in found.join(other, F.col("doc_id") < F.col("doc_id_x")).filter(neardup.may_link("size", "cells", "size_x", "cells_x")).collect()}
    sets = [_shingles(t) for _, t in rows]
    alike = {(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert alike and alike <= passed and len(passed) < len(rows) ** 2 / 8


def neardup_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.xxhash64("text"))


@pytest.mark.parametrize("words", [12, 60, 1500])
def test_alike_sets_just_above_the_threshold_share_a_band(words):
    """Recall of the banding for likeness from 0.75 to 0.8, by set size: no pair is missed."""
    rng = np.random.default_rng(words)
    missed = 0
    for _ in range(150):
        shared = rng.integers(0, 1 << 62, words).astype(np.uint64)
        extra = max(0, int(words / 0.77) - words)
        own = rng.integers(0, 1 << 62, extra).astype(np.uint64)
        half = len(own) // 2
        codes = np.concatenate([np.sort(np.append(shared, own[:half])), np.sort(np.append(shared, own[half:]))])
        sig = neardup.signature(codes, np.array([0, words + half, len(codes)]))
        bands = (sig[0] == sig[1]).reshape(neardup.BANDS, neardup.ROWS).all(axis=1)
        missed += not bands.any()
    assert missed == 0


def test_packing_of_repeated_ids(spark):
    rows = [(1, "some words " * 80), (1, "some words " * 80), (1, "other " * 30), (2, None), (2, None), (None, "x")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit(1)).withColumn("rank", F.lit(1))).collect()
    own = bpe.tokenizer(bpe.default_path())
    want = collections.Counter()
    for i, t in rows:
        want[i] += len(own.encode(t or "")) + 1
    assert sum(r.length for r in got) == sum(want.values())
    stored = collections.Counter()
    for r in got:
        stored[r.doc_id] += r.length
    assert stored == want


def test_packing(docs, nothing, texts):
    own = bpe.tokenizer(bpe.default_path())
    ids = {i: np.array([*own.encode(x or ""), 0], "<u4") for i, x in enumerate(texts)}
    rows = packing.pack(docs).collect()
    seen = collections.defaultdict(list)
    fill = collections.defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        fill[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at
            at += n
        assert at == len(x)
    padding = 0
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.01 * sum(map(len, ids.values()))
    assert packing.pack(nothing).count() == 0


def test_cutting_stock_reaches_the_optimum():
    w, d = np.array([300, 424, 600, 1023]), np.array([40, 30, 30, 5])
    patterns, amounts = packing.CuttingStock(w, d).solve(gap=0)
    assert np.allclose(patterns @ amounts, d) and (w @ patterns <= 1024).all()
    assert math.isclose(amounts.sum(), 30 + 40 / 3 + 5, rel_tol=1e-6)
    assert packing.last_stretch(1024 + 700, 1024) == [(1024, 512), (1536, 128), (1664, 32), (1696, 16), (1712, 8), (1720, 4)]


def _repeats(rows):
    """Brute force over (doc_id, text) in order of doc_id: (doc_id, words, removed, kept text)."""
    seen, out = {}, []
    for i, x in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(x or "")
        keep, own = [True] * len(w), []
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if seen.get(key, i) < i:
                keep[j : j + 50] = [False] * 50
            own.append(key)
        for key in own:
            seen.setdefault(key, i)
        out.append((i, len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k)))
    return out


def _report(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def _digested(rows):
    return sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in _repeats(rows))


@pytest.mark.parametrize("batches", [1, 3])
def test_repeats(docs, texts, batches):
    want = _digested(enumerate(texts))
    assert sum(r[2] for r in want) > 500
    assert _report(repeats.repeats_report(docs, batches)) == want


def _shared_rows():
    """Passages and lines in many contexts, whole copies, repeated ids, words that collide under polynomials."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    line, passage = ([rng.choice(words) for _ in range(n)] for n in (30, 90))
    rows = []
    for i in range(100):
        w = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if i % 3 == 0:
            w[10:10] = line
        if i % 5 < 2:
            w[30:30] = passage[: 90 - 30 * (i % 5)]
        if i % 7 == 0 and rows:
            w = (rows[-1][1] or "").split()
        rows.append((i, " ".join(w)))
    rows += [(200 + k, _thue_morse(n, a, b, " ")) for k, (n, a, b) in enumerate([(1024, "a", "b"), (1024, "b", "a"), (2048, "a", "b"), (2048, "b", "a")])]
    return [*rows, (206, rows[3][1]), (206, rows[6][1]), (206, rows[3][1]), (207, rows[3][1]), (208, None), (209, "")]


def test_repeats_of_shared_passages_and_repeated_ids(spark):
    rows = _shared_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("row", "places", "nths", "anchor")})
    assert _report(repeats.repeats_report(table, 4)) == _digested(rows)


def test_an_index_is_reopened_and_joined_without_a_shuffle(spark):
    rows = _shared_rows()
    base = repeats.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    work = Workspace(spark, "index")
    root, gone, compacted = f"{work.root}/index", [], 0
    for k, (lo, hi) in enumerate([(-1, 40), (40, 80), (80, 202), (202, 300)]):
        index = repeats.FingerprintIndex.open(spark, root) if k else repeats.FingerprintIndex.create(spark, root, 4)
        gone.append(index.add(base.filter((F.col("doc_id") > lo) & (F.col("doc_id") <= hi)), base.filter(F.col("doc_id") <= hi), work))
        compacted += len(index.runs["windows"]) <= k
        keys = base.selectExpr("doc_id anchor").groupBy("anchor").count()
        plan = index.lookup(keys, "anchors")._jdf.queryExecution().executedPlan().toString()
        for run in plan.split("FileScan")[1:]:
            assert "Bucketed: true" in run
        # the only exchanges are those of the new keys; a merge join's second child is a run
        for side in re.findall(r"SortMergeJoin.*?FileScan parquet", plan, re.S):
            assert side.count("Exchange") <= 2
        assert plan.count("Exchange hashpartitioning") == 1
        index.close()
    assert compacted and spark.read.json(f"{root}/manifest").select("version").distinct().count() == 4
    found = repeats.removal_rows(gone)
    assert _report(repeats.apply_report(base, found)) == _digested(rows)


def test_removing_repeats_keeps_other_rows_as_they_are(docs, nothing, texts):
    want = _repeats(enumerate(texts))
    got = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {i: x if not want[i][2] else want[i][3] for i, x in enumerate(texts)}
    assert {r.places for r in got.values()} == {f"extra{i}" for i in got}
    assert repeats.repeats_report(nothing).count() == 0 and repeats.remove_repeats(nothing).count() == 0


def test_no_runs_are_compacted_after_the_last_batch(spark, sf, monkeypatch):
    merged, merge, versions = [], repeats.FingerprintIndex._merged, []
    monkeypatch.setattr(repeats.FingerprintIndex, "_merged", lambda index, *a: (merged.append(index.version), merge(index, *a))[1])
    append = repeats.FingerprintIndex._append
    monkeypatch.setattr(repeats.FingerprintIndex, "_append", lambda index, *a: (append(index, *a), versions.append(index.version))[0])
    repeats.find_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    assert versions == [1, 2, 3] and merged and max(merged) < 2


def test_least_of_windows():
    rng = np.random.default_rng(0)
    for width in (1, 2, 5, 39):
        x = rng.integers(0, 6, 200).astype(np.uint64)
        got = repeats.least_in_windows(x, width)
        assert got.tolist() == [i + int(x[i : i + width].argmin()) for i in range(len(x) - width + 1)]


CLASHES = ("score", "lang_pred", "selected", "expected_grade", "places", "row", "kept", "component_id", "__gone")


def test_pipeline_stages_keep_other_columns(spark, sf):
    import corpus_pipeline as p

    d = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHES})
    before = {r.doc_id: r for r in d.collect()}
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, d.limit(0), sf).count() == 0
        out = stage(spark, d, sf)
        assert out.columns == d.columns
        rows = out.collect()
        assert 0 < len(rows) <= len(before), name
        assert all(r[c] == before[r.doc_id][c] for r in rows for c in (*CLASHES, "lang", "source")), name
        if name != "substring dedup":
            assert all(r.text == before[r.doc_id].text for r in rows), name


def test_substring_stage_drops_what_has_no_word(spark, sf):
    import corpus_pipeline as p

    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "word"), (5, "a " * 60), (6, "a " * 60), (7, "a " * 60 + "b")]
    got = {r.doc_id: r.text for r in p.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()}
    assert got == {4: "word", 5: "a " * 60, 7: "b"}


def test_pipeline(spark, sf):
    """The stages one after another; each later one works on what the one before kept."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "language ID", "MinHash near-dedup", "substring dedup", "packing"]
    out = p.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = Workspace(spark, "steps").table(stage(spark, docs, sf), "stage")
    tokens = {r.doc_id: r.n_tokens + 1 for r in encoding.round_trip(docs).collect()}
    got = collections.Counter()
    for r in out.collect():
        got[r.doc_id] += r.length
    assert got == tokens
