"""The corpus operators against plain definitions on small fixtures."""

import gc
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorloom.llm import decontaminate, gbt, html, lmscore, mixing, neardup, quality, queries, substrings, tokenstore, toxicity, vectors
from sensorloom.llm.common import components, key_mark, prefix_sums, stage, word_count
from sensorloom.llm.pages import training_pages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Documents with copies, near copies, shared passages, odd ids and texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 4))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, texts = say(45), []
    for i in range(n):
        kind = i % 6
        text = say(rng.randint(1, 120))
        if kind == 1 and texts:
            text = rng.choice([t for t in texts if t]) if any(texts) else text
        elif kind == 2:
            w = say(100).split() if not texts else (texts[0] or "").split() or say(100).split()
            w = w * 2
            w[rng.randrange(len(w))] = "zz"
            text = " ".join(w)
        elif kind == 3:
            text = f"{text}\n{passage}  {say(5)}"
        texts.append(text)
    texts[7], texts[8], texts[9], texts[10] = None, "", " \t\n", "Hi"
    texts.append(say(4000))
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return rows + [rows[3]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return corpus()


# --- shared helpers


def test_staged_tables_leave_no_shuffle_files(spark):
    """Shuffle files of what is written down go at once, not when the driver happens to collect its garbage."""
    held = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")))
    before = held()
    made = [stage(spark.range(1000).repartition(3, "id"), "dealt") for _ in range(2)]
    until = time.monotonic() + 20
    while held() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not held() - before
    assert [m.count() for m in made] == [1000, 1000]


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\x0b", "a b c", "\x1ca"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [len(WORDS.findall(t or "")) for t in texts]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_mark_and_prefix_sums(spark):
    keys = spark.createDataFrame([(i * 7,) for i in range(50)], "k long")
    df = spark.range(1000)
    held = {r["id"] for r in key_mark(df, "id", keys, "k", "in").where("in").collect()}
    assert held >= {i * 7 for i in range(50)} and len(held) < 300
    got = prefix_sums(df.withColumn("v", F.col("id") % 5), [F.col("id")], "v", "before").orderBy("id").collect()
    run = 0
    for r in got:
        assert r["before"] == run
        run += r["v"]


# --- 1 token store


def test_tokenstore(spark, docs, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    tok = Tokenizer.from_file(path)
    store = tokenstore.write(docs, path)
    got = sorted(tuple(r) for r in tokenstore.read_back(spark, store).collect())
    order = sorted(rows, key=lambda r: r[0])
    start, want = 0, []
    for r in order:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert set(tokenstore.verify(spark, store).values()) == {0}
    rebuilt = {(r["doc_id"], r["start"]): r["ids"] for r in tokenstore.decode_ids(spark, store).collect()}
    assert rebuilt[order[0][0], 0] == tok.encode(order[0][1], add_special_tokens=False).ids + [2]
    assert tokenstore.manifest(spark, store)["chunks"] <= len({len(x) for x in rebuilt.values()}) * 100


def test_tokenizer_pieces():
    pieces = tokenstore._pieces(queries.vocabulary(), "<u2")
    rng = random.Random(3)
    odd = ["a<|endoftext|>b", "İstanbul ǅ", "I'll DON'T 's ''", "a b\tc\x1cd", "½ x² 12", "ﬁ  z", "日本 ΣΣ", "", "  ", "<|x", "ß ẞ"]
    odd += ["".join(rng.choice("aZ'!9é<|İ \n\tsſ½́") for _ in range(30)) for _ in range(300)]
    for t in odd:
        assert tokenstore.encode(t, pieces).tolist() == pieces.tokenizer.encode(t, add_special_tokens=False).ids + [2], t


def test_tokenizer_parts_at_every_letter():
    """A sign behind any letter is a piece of its own to the library too, and ASCII letters are folded as there."""
    pieces = tokenstore._pieces(queries.vocabulary(), "<u2")
    assert pieces.parted
    letters = sorted(tokenstore.LAST)
    ids = lambda texts: [e.ids for e in pieces.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    sign = ids(["."])[0]
    assert all(a == b + sign for a, b in zip(ids([f"{x}." for x in letters]), ids(letters), strict=True))
    assert tokenstore.parted("Ab,") == ("ab", ",") and tokenstore.parted("É!") == ("É", "!") and tokenstore.parted("<|x|>.") == ("<|x|>.", "")
    assert tokenstore.parted("...") == ("...", "") and tokenstore.parted("1.") == ("1.", "")
    ascii_letters = [chr(c) for c in range(128)]
    assert ids([f"a{x}b" for x in ascii_letters]) == ids([f"a{x}b".lower() for x in ascii_letters])


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode(self, text, **more):
        self.texts += 1
        return self.tokenizer.encode(text, **more)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_new_words_are_encoded_together():
    """2,000 words not seen before, with signs behind most, take few calls of the library and give its ids."""
    tok = tokenstore._pieces(queries.vocabulary(), "<u2").tokenizer
    pieces = tokenstore._Pieces(_Counted(tok), "<u2")
    rng, before = random.Random(5), pieces.tokenizer.texts
    words = ["".join(rng.choices("abcdefgéü", k=9)) + s for s in ("", ",", "***", ".$$$", "'") for _ in range(400)]
    texts = [" ".join(words), None, "", " \n", " ".join(words[::-1]) + "\n\n", "<|x ABC<|ENDOFTEXT|> ***", "^ a^"]
    got = [tokenstore.encode(t, pieces) for t in texts]
    assert [g.tolist() for g in got] == [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert pieces.tokenizer.texts - before < 100


def test_runs_of_pieces_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(tokenstore, "AT_ONCE", 7)
    monkeypatch.setattr(tokenstore, "MAX_CORES", 2000)
    monkeypatch.setattr(tokenstore, "GROUP", 3)
    tok = tokenstore._pieces(queries.vocabulary(), "<u2").tokenizer
    pieces = tokenstore._Pieces(tok, "<u2")
    rng = random.Random(6)
    texts = ["".join(rng.choices("aZéŉ日ß.,'!_9 \n\té́İ<", k=rng.randrange(60))) for _ in range(200)]
    for _ in range(2):
        got = tokenstore.encode_all(texts, pieces)
        assert [g.tolist() for g in got] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert pieces.before and tokenstore.encode_all([], pieces) == []


def test_remembered_words_take_little_memory():
    """What 40,000 words leave behind in a worker, inside and outside Python, is some of their own bytes and not Python objects each."""
    tok = tokenstore._pieces(queries.vocabulary(), "<u2").tokenizer
    pieces, rng = tokenstore._Pieces(tok, "<u2"), random.Random(8)
    text = " ".join({"".join(rng.choices("abcdefghij", k=9)) for _ in range(40_000)})
    gc.collect()
    arrow, told = pa.total_allocated_bytes(), tracemalloc.is_tracing()
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    ids = tokenstore.encode(text, pieces).tolist()
    expected = tok.encode(text, add_special_tokens=False).ids + [2]
    same = ids == expected
    del ids, expected
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] - before + pa.total_allocated_bytes() - arrow
    if not told:
        tracemalloc.stop()
    assert same and len(pieces.cores) > 39_000
    assert held < 80 * len(pieces.cores)
    assert tokenstore.encode(text, pieces).tolist() == tok.encode(text, add_special_tokens=False).ids + [2]


def test_empty_store(spark):
    store = tokenstore.write(spark.createDataFrame([], DOCS), queries.vocabulary())
    assert tokenstore.read_back(spark, store).count() == 0 and tokenstore.manifest(spark, store)["ids"] == 0


# --- 2 html


def test_html_cases(spark):
    x = html.trained()
    page = "<html><body><nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav><div class='ad'>Buy this now.</div><article><h1>Title of it</h1><p>First &amp; long   text of the story, it goes on.<br>More of it here.<p>Second paragraph is here, and it has an end.</article><footer>&copy; all rights</footer>"
    assert x.texts([page])[0] == "Title of it\n\nFirst & long text of the story, it goes on. More of it here.\n\nSecond paragraph is here, and it has an end."
    df = spark.createDataFrame([(1, "u", page, 5), (2, "v", None, 5), (3, "w", "", 5), (1, "u", page, 5)], "page_id long, url string, html string, n_chars int")
    got = sorted(tuple(r) for r in html.report(df).collect())
    assert [g[3] for g in got] == [len(x.texts([page])[0])] * 2 + [0, 0]
    assert x.texts(["<div>" * 2000 + "x"]) and x.texts(["<p><b>a<p>b</b></i></p></div>"])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>plain paragraph without any article tag, it is long enough to count.</p>", "plain paragraph without any article tag, it is long enough to count."),
        ("just plain text &amp; more", "just plain text & more"),
        ("<article>a &lt;b&gt; c &nbsp; d</article>", "a <b> c d"),
        ("<article><p>q<br>r ... s</p></article>", "q r ... s"),
        ("<article><h1>Reorea. Nd.</h1><p><b>Reorea. Nd.<br></article>", "Reorea. Nd.\n\nReorea. Nd."),
        ("<body><p>Hi.</p></body>", "Hi."),
        ("<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><article><p>Short.</p></article><footer>&copy; x</footer>", "Short."),
        ("<article><p>So <math><mi>m</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>", "So m=2 holds."),
        ("<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", ""),
        ("<p>" + "word and word, " * 20_000 + "end.</p>", "word and word, " * 20_000 + "end."),
    ],
)
def test_html_short_and_bare_pages(page, text):
    assert html.trained().texts([page])[0] == text


def test_html_empty_table(spark):
    assert html.report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_held_out_pages():
    x = html.trained()
    right = total = 0
    for page, parts in training_pages(80, 777):
        got = set(x.texts([page])[0].split("\n\n")) - {""}
        right += len(got & parts)
        total += len(got | parts)
    assert right / total > 0.93


def test_hierarchy_is_consistent():
    rng = np.random.default_rng(0)
    nodes = html.flat(html.parse(next(training_pages(1, 5))[0]))
    for _ in range(20):
        chosen = html.choose(nodes, rng.random(len(nodes)))
        assert all(n.parent is None or chosen[n.parent.index] for n, c in zip(nodes, chosen, strict=True) if c)


def test_boosting_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = gbt.fit(x[:600], y[:600], rounds=30, depth=3)
    assert ((m.chance(x[600:]) > 0.5) == y[600:]).mean() > 0.85


# --- 3 vectors


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + rng.normal(0, 0.15, (10, 16)), base[:1] + rng.normal(0, 0.1, (60, 16)), base[:2] * 3])
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    data += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [1.0, None] + [1.0] * 14), (905, [1.0] * 3), (3, data[3][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("label", F.lit(None).cast("int"))
    good = [(i, np.array(v)) for i, v in data if v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    links, parent = defaultdict(int), list(range(len(good)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(good)):
        for b in range(a):
            u, v = good[a][1], good[b][1]
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q, key=lambda k: good[k][0])] = min(p, q, key=lambda k: good[k][0])
    least = {}
    for k, (i, _) in enumerate(good):
        least[find(k)] = min(least.get(find(k), i), i)
    want = sorted([(i, links[k], least[find(k)]) for k, (i, _) in enumerate(good)] + [(i, 0, i) for i in (900, 901, 902, 903, 904)])
    old, vectors.BLOCK = vectors.BLOCK, 16
    try:
        got = vectors.links(df)
        assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == want
    finally:
        vectors.BLOCK = old
    assert vectors.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 8))
    assert np.allclose(vectors.hadamard(vectors.hadamard(x)), x)


# --- 4 language model


def test_lmscore(spark, docs, rows):
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    tokens = lambda t: WORDS.findall((t or "").translate(LOWER)) + ["\n"]
    c = Counter(w for r in rows if fold(r[0]) != 1 for w in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    got = defaultdict(list)
    for r in lmscore.scores(docs, head=20).collect():
        got[r["doc_id"]].append(r)
    for r in rows:
        g = got[r[0]][0]
        w = tokens(r[1])
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (fold(r[0]) == 1, len(w), sum(c[x] > 0 for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert g["score"] < 0
    blocks = {r["doc_id"]: r["score"] for r in lmscore.scores(docs, max_grams=300).collect()}
    for d, rs in got.items():
        assert blocks[d] == pytest.approx(rs[0]["score"], rel=1e-6)


def test_ppm_is_a_distribution():
    texts = [b"abracadabra", b"banana", b"abcabc"]
    g, _ = lmscore.grams_of(texts, 3)
    k, n = np.unique(g, return_counts=True)
    trie = lmscore.Trie(k, n, np.bincount((k & np.uint64(255)).astype(int), weights=n, minlength=256).astype(np.int64), 3)
    for context in (b"abr", b"zzz", b"ana", b"xab"):
        code = int.from_bytes(context, "big") << 8
        assert sum(10**x for x in trie.logs(np.array([code | b for b in range(256)], np.uint64))) == pytest.approx(1, abs=1e-6)


def _plain_ppm(texts, order):
    """Prediction by partial matching over dictionaries, byte by byte."""
    seen = defaultdict(Counter)
    lead = b"\xff" * order
    for t in texts:
        whole = lead + t + b"\xff"
        for i in range(order, len(whole)):
            for k in range(order + 1):
                seen[whole[i - k : i]][whole[i]] += 1

    def score(t):
        whole, total = lead + t + b"\xff", 0.0
        for i in range(order, len(whole)):
            out = set()
            for k in range(order, -1, -1):
                left = {b: n for b, n in seen[whole[i - k : i]].items() if b not in out}
                if not left:
                    continue
                n = sum(left.values())
                if whole[i] in left:
                    total += math.log10((2 * left[whole[i]] - 1) / (2 * n))
                    break
                total += math.log10(len(left) / (2 * n))
                out |= set(left)
            else:
                total -= math.log10(256 - len(out))
        return total

    return score


@pytest.mark.parametrize("most", [4_000_000, 40])
def test_ppm_against_dictionaries(spark, most):
    rng = random.Random(6)
    data = [(i, None if i == 3 else "".join(rng.choices("abcé ", k=rng.randint(0, 60)))) for i in range(60)] + [(70, "zzq xx"), (71, "ab" * 700)]
    trained = [lmscore.lowered(t) for i, t in data if zlib.crc32(str(i).encode()) % 5 != 1]
    plain, old = _plain_ppm(trained, 3), lmscore.CHUNK
    lmscore.CHUNK = 512  # long texts are cut
    try:
        got = {r["doc_id"]: r["score"] for r in lmscore.scores(spark.createDataFrame(data, "doc_id long, text string"), order=3, max_grams=most).collect()}
    finally:
        lmscore.CHUNK = old
    for i, t in data:
        assert got[i] == pytest.approx(plain(lmscore.lowered(t)), rel=1e-5), i


def test_lmscore_without_training_rows(spark):
    """Nothing to learn from: every byte and end is one of 256."""
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lmscore.scores(spark.createDataFrame([(only, "ab c")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0)
    assert r["score"] == pytest.approx(-5 * math.log10(256))
    assert lmscore.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 5 quality and 7 toxicity


def _labelled(spark, bad, good, name):
    rng = random.Random(5)
    texts = [(bad if i % 3 == 0 else good)(rng) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "x", None, None) for i, t in enumerate(texts)] + [(999, None, None, None, None), (998, "", None, None, None)], DOCS)
    y = [(i, (i % 3 != 0) if name == "quality" else (i % 3 == 0)) for i in range(240)]
    labels = spark.createDataFrame([(i, int(v), int(v)) for i, v in y] + [(5, None, None), (5000, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels, dict(y)


def _word(rng):
    return "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))


def test_quality(spark):
    good = lambda r: " ".join(_word(r).capitalize() + ("." if r.random() < 0.2 else "") for _ in range(30))
    bad = lambda r: " ".join(_word(r).upper() + "!!" for _ in range(30))
    docs, labels, y = _labelled(spark, bad, good, "quality")
    got = {r["doc_id"]: r for r in quality.report(docs, labels).collect()}
    assert all(got[i]["predicted"] == int(v) for i, v in y.items()) and all(0 <= r["score"] <= 1 for r in got.values())
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {i for i, v in y.items() if v} <= {r["doc_id"] for r in kept.collect()}
    one = quality.fit(docs, labels.where("quality = 1"))
    assert one.score("x") > 0.9 and 0 <= quality.fit(docs, labels.where("false")).score(None) <= 1


def test_quality_told_by_words(spark):
    """Texts of one shape in both classes, some without spaces or ASCII letters."""
    pick = lambda r, words, n: [r.choice(words) for _ in range(n)]
    one = lambda r, own, cjk: " ".join(x + y for x, y in zip(pick(r, own, 6), pick(r, ["now", "then", "there"], 6), strict=True)) + "." if r.random() < 0.5 else "".join(pick(r, cjk, 9))
    bad = lambda r: one(r, ["cheap", "pills", "casino"], "购买便宜药")
    good = lambda r: one(r, ["court", "ruled", "budget"], "法院今天裁")
    docs, labels, y = _labelled(spark, bad, good, "quality")
    got = {r["doc_id"]: r["predicted"] for r in quality.report(docs, labels).collect()}
    assert sum(got[i] == int(v) for i, v in y.items()) >= 236
    assert len(quality.places(None)) == len(quality.places(" ")) == 0


def test_toxicity(spark):
    good = lambda r: " ".join(_word(r) for _ in range(30)) + "."
    bad = lambda r: " ".join([_word(r) for _ in range(15)] + [r.choice(["grumpf", "snotling"]) + r.choice(["", "er", "ing"])] + [_word(r) for _ in range(10)])
    docs, labels, y = _labelled(spark, bad, good, "toxic")
    got = {r["doc_id"]: r for r in toxicity.report(docs, labels).collect()}
    assert sum(got[i]["predicted"] == int(v) for i, v in y.items()) >= 236
    assert got[999]["predicted"] == got[998]["predicted"] == 0
    assert 0 <= toxicity.fit(docs, labels.where("false")).score("x") <= 1


def test_grammar_paths():
    m = toxicity.Model({"idiot": 1.0}, {}, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    path = lambda t: [p for p, v in zip(toxicity.PATHS, m.measures(t), strict=True) if v]
    assert path("what an idiot") == ["plain"] and path("you idiot") == ["targeted"] and path("not idiot") == ["negated"]
    assert path("she said idiot") != ["plain"] and path("kill you all") == [] and path("you will kill it") == ["threat"]
    assert path("someone wrote idiot. Idiot") == ["plain", "reported"] and path(None) == []


def test_threats_before_their_target(spark):
    m = toxicity.Model({"idiot": 1.0}, {}, toxicity.PRIOR, toxicity.PRIOR_BIAS)
    path = lambda t: [p for p, v in zip(toxicity.PATHS + toxicity.THREAT_PATHS, m.all_measures(t), strict=True) if v]
    for text in ("I will kill you", "kill you all", "someone should shoot them"):
        assert path(text) == ["aimed"] and m.score(text) > m.score("I will see you")
    assert path("kill it") == ["untargeted"] and path("will not kill you") == ["negated threat"] and path("someone said kill you") == ["reported threat"]
    assert path("kill it. you") == ["untargeted"] and path("what an idiot you are") == ["targeted"] and path("you will kill you") == ["threat"]
    # the same words in both classes: only the target's place in the clause tells them apart
    good = lambda r: " ".join(_word(r) for _ in range(20)) + ". we kill time. see you."
    bad = lambda r: " ".join(_word(r) for _ in range(20)) + ". see time. we kill you."
    docs, labels, y = _labelled(spark, bad, good, "toxic")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs, labels).collect()}
    assert sum(got[i] == int(v) for i, v in y.items()) >= 236


def test_clauses_decide(spark):
    """Labels tell of insults alone; threats, negation and reported speech weigh as the grammar says beside them."""
    good = lambda r: " ".join(_word(r) for _ in range(30)) + ". you are a tree. " + _word(r)
    bad = lambda r: " ".join(_word(r) for _ in range(15)) + ". you are a grumpf. " + _word(r)
    docs, labels, _ = _labelled(spark, bad, good, "toxic")
    model = toxicity.fit(docs, labels)
    said = lambda t: model.score(t) >= toxicity.THRESHOLD
    for text in ("you are a grumpf", "I will kill you", "they are killing you all", "wir töteten euch und sie", "someone stabbed them", "you will be beaten"):
        assert said(text), text
    for text in ("you are not a grumpf", "she said you are a grumpf", "I will not kill you", "he wrote that they will kill you", "rain killed the match", "the kill switch", "you are here"):
        assert not said(text), text


def test_toxicity_of_copies_and_long_texts(spark):
    """Words that only copies of one toxic document share are no insults; long texts are read to their end."""
    rng = random.Random(2)
    copy = " ".join(_word(rng) + "zq" for _ in range(60))
    good = lambda r: " ".join(_word(r) for _ in range(30)) + "."
    bad = lambda r: good(r) + (" such grumpf." if r.random() < 0.5 else f" {copy}.")
    docs, labels, _ = _labelled(spark, bad, good, "toxic")
    model = toxicity.fit(docs, labels)
    long = "word " * 300_000
    assert model.score(long + ". such grumpf") > model.score(long) and model.score("such grumpf") >= 0.5
    assert toxicity.kinds_of([[1, 2], [3, 2], [3, 4], [5, 6], []]) == [0, 0, 0, 3, 4]


def test_insults_that_clean_documents_quote():
    # 60 of 600 toxic and 12 of 2000 clean documents hold it, the latter negated or reported
    hold = [({"grumpf"}, {"grumpf"}, i) for i in range(60)] + [(set(), set(), i) for i in range(60, 600)]
    words, _ = toxicity.insults([("grumpf", 60, 12, 60, 0)], hold, 600, 2000)
    assert words["grumpf"] > 0
    words, _ = toxicity.insults([("grumpf", 60, 12, 60, 12)], hold, 600, 2000)
    assert words["grumpf"] > 0 and toxicity.insults([("table", 60, 150, 60, 150)], [({"table"}, {"table"}, i) for i in range(60)], 600, 2000) == ({}, {})
    assert toxicity.open_features("not grumpf. someone said snotling, clod") & {"grumpf", "snotling", "clod"} == {"clod"}


def test_quoted_insults_are_told_from_open_ones(spark):
    # a third of the clean documents hold the insult, negated or reported
    say = lambda r: " ".join(_word(r) for _ in range(10))
    good = lambda r: f"{say(r)}. " + (r.choice(["not grumpf. ", "someone said grumpf. "]) if r.random() < 0.3 else "") + say(r)
    bad = lambda r: f"{say(r)}. such grumpf. {say(r)}"
    docs, labels, y = _labelled(spark, bad, good, "toxic")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.report(docs, labels).collect()}
    assert sum(got[i] == int(v) for i, v in y.items()) >= 236


def test_rare_insult_beside_many_candidates(spark):
    rng = random.Random(3)
    common = " ".join({"".join(rng.choices("klmn", k=8)) for _ in range(4000)})  # over 5000 words and stems
    say = lambda r: " ".join(_word(r) for _ in range(20))
    bad = lambda r: f"{say(r)} grumpf" if r.random() < 0.25 else f"{say(r)} {common}"
    docs, labels, _ = _labelled(spark, bad, say, "toxic")
    model = toxicity.fit(docs, labels)
    assert model.score("such grumpf here") > model.score("such words here")


def test_weights_where_most_toxic_rows_hold_no_sign():
    """A fifth of the toxic rows hold an insult, the others nothing: the fit settles, also far from where it starts."""
    x, y = np.zeros((195, 9)), (np.arange(195) < 67).astype(int)
    x[:12, 0] = 0.8
    w, bias = toxicity.fit_weights(x, y)
    z = x @ w + bias
    assert abs(bias) < 5 and z[0] > 0 > z[-1]
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    grad = lambda w, prior, ridge: np.column_stack([x, np.ones(195)]).T @ (share * (1 / (1 + np.exp(-z)) - y)) + ridge * (w - prior)
    for start in (0.0, -20.0):
        prior = np.append(toxicity.PRIOR, start)
        w = toxicity._logistic(x, y, prior, 1.0)
        z = x @ w[:-1] + w[-1]
        assert abs(grad(w, prior, 1.0)).max() < 1e-5


# --- 6 near-duplicates


def _components(sets, percent):
    inv, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s:
            inv[x].append(i)
    for held in inv.values():
        both.update((a, b) for k, b in enumerate(held) for a in held[:k])
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in both.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_neardup(spark, docs, rows, size, percent):
    def shingles(t):
        w = WORDS.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(r[1]) for r in rows]
    comp = _components(sets, percent)
    want = sorted((r[0], len(s), min(rows[k][0] for k in range(len(rows)) if comp[k] == c)) for r, s, c in zip(rows, sets, comp, strict=True))
    old, neardup.BLOCK = neardup.BLOCK, 8
    try:
        got = neardup.groups(docs, size=size, percent=percent)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
    finally:
        neardup.BLOCK = old
    kept = neardup.keep(docs, size=size, percent=percent)
    empty = sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == len({c for c, s in zip(comp, sets, strict=True) if s}) + empty


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    n = neardup.samples_for(85)
    for j in (0.7, 0.85, 0.95):
        k = int(1000 * 2 * j / (1 + j))
        a, b = pool[:1000], np.concatenate([pool[:k], pool[1000 : 2000 - k]])
        bits = np.bitwise_count((neardup.odd_sketch(neardup.minhashes(np.sort(a), n)) ^ neardup.odd_sketch(neardup.minhashes(np.sort(b), n))).view(np.uint64)).sum()
        assert abs(neardup.estimate(np.array(bits), n) - j) < 0.12


# --- 8 substrings


def test_substrings(docs, rows):
    texts = sorted(enumerate(rows), key=lambda x: (x[1][0], x[0]))
    seen, want = set(), []
    for _, r in texts:
        w = WORDS.findall(r[1] or "")
        gone = set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        left = [x for i, x in enumerate(w) if i not in gone]
        want.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    assert sum(x[2] for x in want) > 0
    assert sorted(tuple(r) for r in substrings.report(docs).collect()) == sorted(want)


def test_cover_property():
    for a in range(13):
        for b in range(13):
            assert any((a + d) % 13 in substrings.COVER and (b + d) % 13 in substrings.COVER for d in range(13))


# --- 9 decontamination


@pytest.mark.parametrize("most", [300_000, 7])
def test_decontaminate(spark, most):
    bench = [(1, "The quick, brown fox jumps over the lazy dog near a river bank."), (2, "short item"), (3, None), (4, "!!"), (10, "short-item"), (1, "The quick, brown fox jumps over the lazy dog near a river bank.")]
    texts = [None, "", "nothing here", "x THE quick brown fox; jumps over the lazy dog near a y", "a Short  item b short Item", "the quick brown fox jumps over the lazy dog", "préféré short item"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    got = {r["doc_id"]: r["leak"] for r in decontaminate.annotate(docs, items, max_windows=most).collect()}
    for i, t in enumerate(texts):
        w, hit, of = split(t), set(), set()
        for item, text in bench:
            b = split(text)
            n = min(10, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[k : k + n]:
                        hit.update(range(j, j + n))
                        of.add(str(item))
        spans = {x for h in got[i]["hits"] for x in range(h["first"], h["last"] + 1)}
        assert (got[i]["n_words"], spans, sorted(got[i]["items"])) == (len(w), hit, sorted(of))
    found = decontaminate.spans(docs, items).where("doc_id = 3").first()
    assert texts[3][found["start"] : found["end"]] == "THE quick brown fox; jumps over the lazy dog near a"
    assert decontaminate.clean(docs, items).columns == docs.columns and decontaminate.clean(docs, items).count() == 4


# --- 10 mixing


def test_mixing(spark, docs, rows):
    got = mixing.report(docs).collect()
    size = lambda r: len(WORDS.findall(r[1] or ""))
    total = defaultdict(int)
    for r in rows:
        total[r[3]] += size(r)
    names = sorted([s for s in total if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, float(sum(total.values())), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * total[s] for s in over}
        left, free = left - sum(3.0 * total[s] for s in over), free - over
    by = {r[0]: r[3] for r in rows}
    for r in got:
        assert r["target"] == pytest.approx(target[by[r["doc_id"]]]) and r["source_size"] == total[by[r["doc_id"]]]
        assert r["taken"] <= 3 * r["size"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(docs).collect()))
    assert len(got) == len(rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_mixing_is_near_and_unbiased(spark):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 60), f"s{i % 4 if i % 2 else 0}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.report(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] / r["target"] - 1) < 0.01 for r in got)
    assert mixing.report(df.where("false")).count() == 0


def test_mixing_copies_of_one_row(spark):
    """Rows of one doc_id have draws and leaves of their own, and the same ones however they are dealt."""
    rows = [(7, "a b c", "s") for _ in range(6000)] + [(None, "a b c d", "s") for _ in range(300)] + [(i, "w " * 50, "t") for i in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r["doc_id"] or -1, r["copies"]) for r in mixing.report(d).collect()) for d in (df.repartition(5), df.repartition(3)))
    assert one == two and {c for d, c in one if d == 7} != {0}
    got = mixing.report(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] / r["target"] - 1) < 0.005 for r in got)


def test_mixing_with_large_documents(spark):
    """A source's target is met though one document is a tenth of it; other columns pass through."""
    rng = random.Random(9)
    rows = [(i, "w " * (20000 if i == 5 else rng.randint(20, 700)), f"s{i % 3}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rid long")
    got = mixing.report(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] / r["target"] - 1) < 0.01 for r in got)
    assert mixing.mix(df).columns == df.columns


def test_vector_recall(spark):
    """Pairs planted at a cosine just over the threshold are found, whatever the width of the numbers."""
    rng = np.random.default_rng(12)
    for dim, kind in ((64, "float"), (24, "double")):
        x = rng.normal(size=(1500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=x[:500].shape)
        y -= (y * x[:500]).sum(1, keepdims=True) * x[:500]
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        cosine = rng.uniform(0.901, 0.92, (500, 1))
        z = cosine * x[:500] + np.sqrt(1 - cosine**2) * y
        data = [(i, [float(v) for v in r]) for i, r in enumerate(np.concatenate([x, z]))]
        got = {r["vec_id"]: r["n_links"] for r in vectors.report(spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>")).collect()}
        assert sum(got[1500 + i] >= 1 for i in range(500)) >= 499


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id string, text string")
    made = [quality.report(docs, labels), neardup.report(docs), toxicity.report(docs, labels), substrings.report(docs), decontaminate.report(docs, items)]
    assert [m.count() for m in made] == [0] * 5


def test_columns_with_names_of_ours(spark):
    """A user's columns pass through, whatever they are called."""
    rows = [(1, "a b c d e f g h i j k", 7, 8, 9), (2, "a b c d e f g h i j k", 5, 6, 7), (3, "other words", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, maybe int, leak int")
    assert sorted(map(tuple, neardup.keep(df).collect())) == [rows[0], rows[2]]
    items = spark.createDataFrame([("i", "a b c d e f g h i j")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate.clean(df, items).collect()] == [rows[2]]
    assert [tuple(r) for r in decontaminate.clean(df, items, max_windows=1).collect()] == [rows[2]]
