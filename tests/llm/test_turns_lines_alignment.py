"""Conversation repair, line dedup and alignment against plain versions, and their odd cases."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quaywise.llm import alignment, lines, turns
from quaywise.llm.queries import ORACLE_SQL, QUERIES
from quaywise.llm.store import Workspace, shared_dir

# --- conversation repair ----------------------------------------------------------------------------------


def _cheapest(codes):
    """(cost, edits) of least cost and then least edits, from whole strings of every row and state."""
    best = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for code in reversed(codes):
        must, late, initial = code & 8, bool(code & 4), "sua-"[code & 3]
        ways = {q: [(best[q][0] + 3, "D" + best[q][1])] for q in range(4)}
        for q in range(4):
            forced = 3 if q == 2 else 2
            if not must:
                ways[q].append((best[forced][0] + 2 + late, "R" + best[forced][1]))
                for to in {("s", 0): [1], ("u", 0): [2], ("u", 1): [2], ("u", 3): [2], ("a", 2): [3]}.get((initial, q), []):
                    ways[q].append((best[to][0] + late, "K" + best[to][1]))
        now = {q: min(w) for q, w in ways.items()}
        for _ in range(3):
            for q in range(4):
                to = now[3 if q == 2 else 2]
                now[q] = min(now[q], (to[0] + 2, "I" + to[1]))
        best = now
    return best[0]


def test_walk_gives_the_least_of_the_cheapest_edits():
    draw = random.Random(3)
    for n in [*range(12), 30, 61]:
        for _ in range(60):
            codes = bytes(draw.randrange(12) if draw.random() < 0.8 else draw.choice([8, 9, 10, 11]) for _ in range(n))
            cost, edits = _cheapest(codes)
            assert turns.walk(codes, turns.END, 0, True) == (edits, 3 if edits.strip("D") else 0)
            v = turns.END
            for code in reversed(codes):
                v = turns.back(code, v)
            assert v[0] == cost


def test_slices_are_walked_like_the_whole():
    draw = random.Random(4)
    for _ in range(40):
        codes = bytes(draw.randrange(12) for _ in range(draw.randrange(2, 60)))
        cut = draw.randrange(1, len(codes))
        m = turns.matrix(codes[cut:])
        behind = tuple(min(m[4 * q + t] + turns.END[t] for t in range(4)) for q in range(4))
        a, q = turns.walk(codes[:cut], behind, 0, False)
        b, _ = turns.walk(codes[cut:], turns.END, q, True)
        assert a + b == turns.walk(codes, turns.END, 0, True)[0]


def _tables(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, slice string, audit int").coalesce(1).write.parquet(f"{path}/conversations.parquet")


def _sql(path, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        try:
            con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
        except duckdb.IOException:
            pass
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def _found(spark, path, name):
    rows = QUERIES[name](spark, str(path)).collect()
    return sorted((r.asDict() for r in rows), key=str)


def _alike(a, b):
    key = lambda r: str(sorted(r.items()))
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_conversations_equal_sql_also_the_odd_ones(spark, tmp_path):
    draw = random.Random(5)
    texts = ["Well.", "well", " ", "", None, "So? ", "\tNo!\n", "é.", "x" * 300000]
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool", "", None]), draw.choice(texts), "clash", 1) for c in [*range(40), None] for t in [*range(draw.randrange(7)), None]]
    rows += rows[:25]  # repeated rows
    _tables(spark, tmp_path, rows)
    _alike(_found(spark, tmp_path, "op11_turns"), _sql(tmp_path, "op11_turns"))


def test_one_conversation_of_many_slices(spark):
    draw = random.Random(6)
    rows = [(1, k, draw.choice(["user", "assistant", "system", "x"]), draw.choice(["Yes.", f"No {k}", " ", f"Ha {k}!"])) for k in range(20000)] + [(2, 0, "user", "Hi.")]
    found, each = turns.repair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), Workspace(spark, "test"))
    got = {r.conv_id: r for r in found.collect()}
    whole = turns._Slice()
    seen = set()
    for _, k, role, text in rows[:-1]:
        whole.add(k, role, text, 1, (role, text) in seen)
        seen.add((role, text))
    codes = bytes(whole.codes)
    audit, _ = turns.walk(codes, turns.END, 0, True)
    pieces = turns.edited(whole.rows, codes, audit, 0)
    assert got[1].audit == audit and got[2].audit == "KI"
    assert [got[1].blank, got[1].duplicate, got[1].truncated, got[1].illegal] == whole.faults and got[1].gaps == 0
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in pieces).encode()).hexdigest()
    assert got[1].cost == sum({"K": 0, "R": 2, "D": 3, "I": 2}[x] for x in audit) + sum(bool(c & 4) for c, x in zip(codes, audit.replace("I", "")) if x != "D")
    assert [(r.role, r.text) for r in each.filter("conv_id = 1").orderBy("slice", "place").collect()] == pieces


def test_no_conversations(spark, tmp_path):
    _tables(spark, tmp_path, [])
    assert _found(spark, tmp_path, "op11_turns") == []


# --- line dedup -------------------------------------------------------------------------------------------


def test_perfect_hash_is_minimal_and_perfect():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        a, b = (draw.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        a[: n // 3] = 7  # the second halves tell these apart
        hashed = lines.PerfectHash.build(a, b)
        assert sorted(hashed.slots(a, b).tolist()) == list(range(n))
        if n:
            others = hashed.slots(b, a)
            assert others.max() < n


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, n_lines string, shard int").repartition(3).write.parquet(f"{path}/documents.parquet")


def test_lines_equal_sql_also_the_odd_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lines, "SHARD", 3)  # many shards
    draw = random.Random(7)
    common = [("Line %d of the header that many share, " % k) + "é" * (k % 5) for k in range(60)] + ["short", "", "ü" * 39, "ü" * 40, "a" * 40, "A" * 40, "  " + "a" * 40 + "\r", "b" * 200000]
    rows = [(k, "\n".join(draw.choice(common) for _ in range(draw.randrange(12))), "clash", k) for k in range(150)]
    rows += [(900, None, "x", 1), (901, "", "x", 1), (902, "\n\n", "x", 1)]
    _documents(spark, tmp_path, rows)
    found = _found(spark, tmp_path, "op13_lines")
    _alike(found, _sql(tmp_path, "op13_lines"))
    assert sum(r["n_dropped"] for r in found) > 100


def test_rows_of_one_id_are_one_document(spark):
    line = "A line that stands in many documents of this table."
    docs = spark.createDataFrame([(1, line)] * 9 + [(2, line), (3, line), (None, line), (None, line)], "doc_id long, text string")
    index = lines.index_lines(docs, Workspace(spark, "test"), floor=2)
    dropped = lambda n: sorted(str(r.doc_id) for r in lines.drop_repeated_lines(docs, index, n).collect() if r.n_dropped)
    assert dropped(5) == [] and dropped(4) == sorted(["1"] * 9 + ["2", "None", "None"])
    with pytest.raises(ValueError):
        dropped(1)


def test_no_documents_and_no_repeated_lines(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_repeated_lines(docs, lines.index_lines(docs, Workspace(spark, "test"))).collect() == []
    one = spark.createDataFrame([(1, "x\ny")], "doc_id long, text string").select("doc_id", F.concat("text", F.expr("cast(X'FF0A41' as string)")).alias("text"))
    (r,) = lines.drop_repeated_lines(one, lines.index_lines(one, Workspace(spark, "test"))).selectExpr("n_lines", "n_dropped", "hex(text) as h").collect()
    assert (r.n_lines, r.n_dropped, r.h) == (3, 0, "780A79FF0A41")


# --- alignment --------------------------------------------------------------------------------------------


def _plain(texts):
    """What each text must give, token by token, from the tokenizers' own libraries."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    from quaywise.llm.bpe import _byte_alphabet

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet, total, found = _byte_alphabet(), Counter(), []
    for text in texts:
        whole = (" " + (text or "")).encode()
        got = a.encode(" " + text, add_special_tokens=False) if text else None
        sides = [] if got is None else [[(i, bytes(alphabet[c] for c in t)) for i, t in zip(got.ids, got.tokens)], [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]]
        if not sides or any(b"".join(t for _, t in side) != whole for side in sides):
            found.append(None)
            continue
        spans = [[(i, sum(len(t) for _, t in side[:k]), sum(len(t) for _, t in side[: k + 1])) for k, (i, _) in enumerate(side)] for side in sides]
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = ["|".join(",".join(str(i) for i, s, e in side if lo <= s < hi) for side in spans) for lo, hi in zip([0, *ends], ends)]
        total.update(links)
        found.append((len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, y), n in total.items():
        best[y] = max(best[y], n)
    rows = [(0,) * 6 + ("",) if f is None else (f[0], f[1], f[2], len(f[3]), sum(total[x] == best[x[1]] for x in f[3]), sum(total[x] for x in f[3]), f[4]) for f in found]
    return rows, total, found


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b   c    ", "\n", "a\n\n b\tc", "<|endoftext|> <s> </s> <0x41>", "▁x a▁ b", "\x00", "é😀 漢字 ß", "naïve  façade", "ab" * 300, "tick, " * 40, "a" * 700, "١٢٣ abc-def", "x <unk> y"]


def test_alignment_equals_the_libraries_also_for_odd_texts(spark):
    draw = random.Random(8)
    texts = ODD + ["".join(draw.choice(["the ", "and", " ", "re", "ing ", "é", ".", "\n", "Zz", "  "]) for _ in range(draw.randrange(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame([(k % 160, t, "clash", 1) for k, t in enumerate(texts)], "doc_id long, text string, pair string, row int").repartition(3)
    out, pairs = alignment.align_tokenizers(docs, Workspace(spark, "test"))
    want, total, found = _plain(texts)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((r.doc_id, *(r[c] for c in columns)) for r in out.collect()) == sorted((k % 160, *w) for k, w in enumerate(want))
    held = Counter(x for f in found if f for x in set(f[3]))
    assert {(r.a, r.b): (r.links, r.documents) for r in pairs.collect()} == {x: (n, held[x]) for x, n in total.items()}


def test_containers_hold_their_postings():
    draw = np.random.default_rng(2)
    pair, place, times = [], [], []
    for p, n in [(5, 1), (9, alignment.BLOCK), (70000, 126), (70001, 127), (70002, 128), (80000, 3)]:
        pair += [p] * n
        place += draw.choice(alignment.BLOCK, n, replace=False).tolist()
        times += draw.integers(1, 40 if p == 80000 or p == 9 else 2, n).tolist()
    pair, place, times = map(np.array, (pair, place, times))
    keys, documents, links, packed = alignment.containers(pair, place, times)
    assert keys.tolist() == sorted(set(pair.tolist()))
    for key, n, total, c in zip(keys, documents, links, packed.to_pylist()):
        own = pair == key
        planes = alignment.postings(c)
        assert planes[0].tolist() == sorted(place[own].tolist()) and n == own.sum() and total == times[own].sum()
        again = np.zeros(alignment.BLOCK, int)
        again[planes[0]] = 1
        for k, plane in enumerate(planes[1:]):
            again[plane] += 1 << k
        assert again[place[own]].tolist() == times[own].tolist()
    count, best = np.arange(len(keys)) + 10, np.arange(len(keys)) % 2 == 0
    seen, total, tops = alignment.score(packed.to_pylist(), count, best)
    at = np.searchsorted(keys, pair)
    assert total.tolist() == np.bincount(place, times * count[at], alignment.BLOCK).astype(int).tolist()
    assert tops.tolist() == np.bincount(place, times * best[at], alignment.BLOCK).astype(int).tolist() and seen.all()


def test_no_texts_to_align(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out, pairs = alignment.align_tokenizers(docs, Workspace(spark, "test"))
    assert out.collect() == [] and pairs.collect() == []


def test_the_shared_folder_needs_no_setting(spark):
    assert shared_dir(spark) == shared_dir(spark)


# --- samples and pages ------------------------------------------------------------------------------------


def test_samples_go_by_rows_not_by_ids(spark):
    from quaywise.llm.store import hashed_sample

    rows = [(1, f"text {k}", "en") for k in range(3000)] + [(k, f"texte {k}", "fr") for k in range(2, 52)] + [(99, "same", "fr")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = hashed_sample(df, 100, ["lang"]).collect()
    assert len(found) == 100 and len({r.text for r in found}) == 100
    assert len(hashed_sample(df, 5000, ["lang"]).collect()) == 3051
    long = spark.createDataFrame([(k, "x" * 1000, "en") for k in range(40)], "doc_id long, text string, lang string")
    assert len(hashed_sample(long, 30, ["lang"], most_bytes=5500).collect()) == 5
    assert len(hashed_sample(long, 30, ["lang"], most_bytes=10).collect()) == 1
    assert hashed_sample(df.filter("doc_id < 0"), 30, ["lang"]).collect() == []


BODY = "<p>First paragraph, with commas, and enough text to be scored, said the author.</p><p>Second paragraph, also with commas, and long enough.</p>"


@pytest.mark.parametrize("around", ["<form id=aspnetForm>", '<div class="widget Blog">', '<div class="content-with-sidebar">', '<div class="social-post">', '<div id=main class="no-footer">', '<div class="post related-links-off">'])
def test_an_article_stays_in_an_odd_wrapper(around):
    from quaywise.llm.pages import main_text

    tag = around[1:].split(" ")[0]
    page = f'<html><body><nav><a href=x>x</a></nav>{around}<div class="menu"><a href=y>y</a></div>{BODY}<div class="comments"><p>A comment, long, with commas.</p></div></{tag}><p>Copyright</p></body></html>'
    assert main_text(page).split("\n")[:2] == [p.removeprefix("<p>") for p in BODY.split("</p>")[:2]] and "comment" not in main_text(page)
    assert main_text(f'<div class="article">{BODY}</div><div class="sidebar"><p>Beside it, some text.</p></div><form><p>Sign up, now.</p></form>').count("\n") == 1
    assert main_text(f'<div class="cookie-notice">{BODY}</div>') == ""


def test_pages_that_are_not_utf8(spark):
    from quaywise.llm.pages import extract

    page = spark.range(1).selectExpr("id as page_id", "'u' as url", "concat('<p>Some text, ', cast(X'FF' as string), ' here.</p>') as html")
    assert extract(page).head().text == "Some text, � here."


def test_texts_of_earlier_batches_are_fetched_without_a_shuffle(spark):
    from quaywise.llm import repeats

    work = Workspace(spark, "test")
    index = repeats.FingerprintIndex.create(spark, f"{work.root}/index")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    store = index.keep_texts(repeats.keyed(docs))
    wanted = work.table(store.filter("doc_id % 7 = 0").select("doc_id"), "wanted")
    joined = store.join(wanted.hint("shuffle_hash"), "doc_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    texts = plan[plan.index("ShuffledHashJoin") :]
    assert "Bucketed: true" in texts and texts.count("Exchange hashpartitioning") == 1 and texts.index("Bucketed: true") < texts.index("Exchange")
    assert joined.count() == 8
    index.close()
