"""Each operator against a brute-force version, and its defined cases."""

import collections
import functools
import hashlib
import html
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import bpe, chat_format, decontaminate, html_extract, jaccard_join, lattice_lm, license_scan, quality, token_counts, toxicity
from tessera.llm.queries import QUERIES, tokenizer_path
from tessera.llm.sql import ORACLE

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def by_id(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] or 0))


# 1
def test_toxicity_learns_and_holds_out(spark, documents):
    ordinary = [f"w{i * 7 % 97} w{i * 13 % 89} some w{i % 83} usual words w{i * 5 % 71} of w{i * 11 % 67} text" for i in range(400)]
    docs = [(i, t.replace("usual", "blargendorf usual").replace("of", "zoldikmurr of") if i % 4 == 0 else t) for i, t in enumerate(ordinary)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = by_id(toxicity.score_toxicity(df, model))
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) / len(held) > 0.95
    assert toxicity.drop_toxic(df, model).count() == sum(not r.predicted for r in got)


def test_toxicity_stands_ordinary_rows_with_toxic_words():
    text = lambda i: f"w{i * 7 % 97} w{i * 13 % 89} some w{i % 83} {{}} usual words w{i * 5 % 71} of w{i * 11 % 67} {{}} text"
    rows = [(text(i).format(*(("blargendorf", "zoldikmurr") if i % 4 == 0 or i % 100 == 1 else ("plain", "more"))).encode(), int(i % 4 == 0), i // 4 % 10) for i in range(1200)]
    model = toxicity.fit(rows)
    assert {b"blargendorf", b"zoldikmurr"} <= set(model.toxic.split()) and not {b"some", b"plain", b"text"} & set(model.toxic.split())
    right = sum((model.score(t) >= 0.5) == bool(y) for t, y, _ in rows)
    assert right >= len(rows) - 12  # all but the rows of the other label


def test_toxicity_samples_long_texts(spark):
    docs = spark.createDataFrame([(i, "word " * (8000 if i % 2 else 3)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(40)], "doc_id long, toxic int")
    sample, counts = toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic", 5, 3000, 5000)
    rows = sample.collect()
    assert len(rows) == sum(counts) and {y for t, y, _ in rows if len(t) == 40000} == {0, 1}


def test_toxicity_score_is_that_of_its_definition(spark):
    """Window lengths and the calibration by a plain version of both."""
    import zstandard

    texts = [f"w{i % 17} some usual words w{i % 23} of w{i % 13} {'blargendorf ' if i % 3 == 0 else ''}w{i % 11} {'zoldikmurr ' if i % 3 == 0 else ''}end " * 3 for i in range(300)]
    model = toxicity.fit([(t.encode(), int(i % 3 == 0), i % 10) for i, t in enumerate(texts)])

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, level=toxicity.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    for t in (*texts[:6], "", "blargendorf", "x" * 500):
        words, windows, now = t.lower().split(), [], ""
        for w in words:
            if len(now.encode()) >= toxicity.WINDOW + 1:
                windows.append(now + " ")
                now = ""
            now += " " + w
        windows += [now + " "] if now else []
        d = [length(w.encode(), model.ordinary) - length(w.encode(), model.toxic + model.ordinary) for w in windows]
        over = [sum(x >= k for x in d) for k in (3, 5, 7)]
        n = max(1, len(d))
        x = [1, min(12, max(d, default=0)) / 4, math.log1p(sum(v - 1 for v in d if v > 1)), *map(math.log1p, over), over[1] / n * 4, math.log(n) / 4]
        assert model.toxic and model.score(t.encode()) == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x)))))


def test_toxicity_cases(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    for docs, lab in ((odd, labels), (none, labels), (odd, labels.limit(0))):
        model = toxicity.train(docs, lab)
        assert toxicity.score_toxicity(docs, model).count() == docs.count()
        assert toxicity.drop_toxic(docs, model).columns == docs.columns


# 2
def test_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_extract.extract_html(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if b == "<br>" else "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_html_cases(spark):
    page = "<html><body><nav>Menu a b c</nav><div class='cookie-notice'>We use cookies</div><article><header>H</header><h1>Title &eacute;</h1><p>one two &amp; three<br>four five six<aside>side</aside><p>a &lt; b more words for sure</p><form><p>mail</p></form><div id=comments><p>nice post</p></div><script>var x='</p>'</script><p>last block of words here</p></article><footer>f</footer>"
    rows = [(1, "u", page, "x"), (2, "u", None, "x"), (3, None, "", "x"), (None, "u", "plain &#8364; text", "x"), (4, "u", "<p>unclosed <b>words", "x"), (5, "u", "<!-- never closed <p>x", "x"), (1, "u", page, "x"), (6, "u", "<p>" + "w " * 60000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id): r.text for r in html_extract.extract_html(df).collect()}
    assert got[1] == "Title é\n\none two & three four five six\n\na < b more words for sure\n\nlast block of words here"
    assert got[2] == got[3] == got[5] == "" and got[None] == "plain € text" and got[4] == "unclosed words" and len(got[6]) == 119999
    assert html_extract.extract_html(df.limit(0)).count() == 0 and html_extract.extract_html(df).count() == len(rows)


def test_html_keeps_main_text_inside_named_elements():
    first, second = "one two three four five six seven eight nine ten " * 3, "eleven twelve thirteen fourteen fifteen sixteen " * 3
    want = f"{first.strip()}\n\n{second.strip()}"
    got = lambda page: html_extract.extract(f"<html><body><nav>Menu a b</nav>{page}<footer>f g h</footer></body></html>", (1.0, {"article": -40.0, "main": -40.0, "/article": -40.0, "/main": -40.0}))
    both = f"<p>{first}</p><p>{second}</p>"
    assert got(f"<article>{both}</article>") == want
    assert got(f'<div class="layout has-sidebar"><article>{both}</article><div class="sidebar">x y z</div></div><p>after</p>') == want
    assert got(f'<div class="ad">Buy this<article>{both}</article>') == got(f"<aside>Buy this<article>{both}</article>") == want
    assert got(f'<article><p class="notice">Look here<p>{first}<p>{second}</article>') == want
    assert got(f'<article><ul><li class="share">Share it<li>{first}<li>{second}</ul></article>') == want
    assert got(f"<main>{both}<div class=comments><article>so nice</article><article>so bad</article>more said</div></main>") == want
    assert got(f"<div>{both}</div><div class=comments><article>so nice</article><article>so bad</article></div>") == want
    assert got(f'<article><section id="related-work"><p>{first}</p></section><div class="content side-by-side"><p>{second}</p></div><div class="sidebar related-posts">x y</div></article>') == want
    assert got(f"<article><p>{first} <math><mi>x</mi> = <mn>2</mn></math></p></article>") == f"{first.strip()} x = 2"
    assert got(f'<div class="page has-sidebar">{both}</div>') == got(f"<form>{both}</form>") == want


def test_html_without_article(spark, sf_dir):
    """The same main text comes out of pages whose <article> has become a <div>."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: r.text for r in html_extract.extract_html(pages).collect()}
    marked = pages.filter("page_id % 2 = 0").unionByName(pages.filter("page_id % 2 = 1").withColumn("html", F.regexp_replace("html", "<(/?)article\\b", "<$1div")))
    assert {r.page_id: r.text for r in html_extract.extract_html(marked).collect()} == want


def test_region_is_the_best_of_all():
    import random

    rng = random.Random(3)
    for _ in range(50):
        toks = [("", "w " * rng.randint(1, 6)) if rng.random() < 0.5 else ("p", "") for _ in range(12)]
        score = lambda a, b: sum(-3.0 if t else len(x.split()) for t, x in toks[a:b])
        a, b = html_extract.region(toks, 1.0, {"p": -3.0})
        assert score(a, b) == max(score(i, j) for i in range(13) for j in range(i, 13))


# 3
def greedy(word, pieces):
    s, n, i = token_counts.MARK + word, 0, 0
    while i < len(s):
        end = next((j for j in range(min(len(s), i + 64), i, -1) if s[i:j] in pieces), None)
        n, i = (n + 1, end) if end else (n + len(s[i].encode()), i + 1)
    return n


def test_token_counts(documents, odd, none):
    pieces = set(token_counts.pieces_of(PIECES))
    for df in (documents, odd):
        got = token_counts.count_tokens(df, PIECES).collect()
        texts = collections.Counter((r.doc_id, len((r.text or "").encode().split()), sum(greedy(w.decode(), pieces) for w in (r.text or "").encode().split())) for r in df.collect())
        assert collections.Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == texts
    assert token_counts.count_tokens(none, PIECES).count() == 0


def test_automaton_failures():
    import random

    rng, pieces = random.Random(5), {"▁", "a", "ab", "abcd", "cde", "b", "▁a", "bcx", "d"}
    auto = token_counts.LongestMatch(pieces)
    for _ in range(500):
        w = "".join(rng.choice("abcdex") for _ in range(rng.randint(0, 12)))
        assert auto.count(w) == greedy(w, pieces)


# 4
def test_bpe_as_tokenizers(spark, documents, odd, none):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(BPE)
    more = spark.createDataFrame([(90, "a<|endoftext|>b <|endoftext|>"), (91, "aaaaaaa  \n\n\t x's 'll"), (92, "日本語 🙂 x\x1c\x85y"), (93, " lead  and trail \n"), (94, "-------===== ababababab")], "doc_id long, text string")
    for df in (documents.select("doc_id", "text"), odd.select("doc_id", "text"), more):
        want = []
        for r in df.collect():
            ids = ref.encode(r.text or "", add_special_tokens=False).ids
            out = ref.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
        assert collections.Counter(map(tuple, bpe.round_trip(df, BPE).collect())) == collections.Counter(want)
    back = bpe.decode(bpe.encode(more, BPE), BPE)
    assert {r.doc_id: r.text for r in back.collect()} == {r.doc_id: r.text for r in more.collect()}
    assert bpe.round_trip(none, BPE).count() == bpe.encode(none, BPE).count() == 0


# 5
def test_lattice_marginal_is_the_sum_over_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    lattice = lattice_lm.Lattice(pieces, lattice_lm.Lattice.normalised(pieces, np.arange(1.0, 12.0)))
    lp = dict(zip(pieces, lattice.log_p))

    def total(s, first=True):
        if not s:
            return math.exp(lattice.log_p[len(pieces) + 2])
        return sum(math.exp(lp[s[:k]]) * total(s[k:], False) for k in range(1, len(s) + 1) if s[:k] in lp and (s[0] == "▁") == first)

    words = ["a", "ab", "abab", "bba", ""]
    assert lattice.forward(words) == pytest.approx([math.log(total("▁" + w)) for w in words])
    counts = np.zeros(len(lattice.log_p))
    lattice.forward(["abab", "ab"], counts)
    assert counts[[0, 1, 6]].sum() == pytest.approx(2)  # each word begins once
    assert counts[len(pieces) + 2] == 2


def test_lattice_counts_long_words():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    lattice = lattice_lm.Lattice(pieces, lattice_lm.Lattice.normalised(pieces, np.arange(1.0, 12.0)))
    counts = np.zeros(len(lattice.log_p))
    lattice.forward(["ab" * 1000], counts)
    assert counts[[0, 1, 6]].sum() == pytest.approx(1) and counts[len(pieces) + 2] == 1
    assert counts[:7] @ [len(p.strip("▁")) for p in pieces] == pytest.approx(2000)  # the pieces' letters are the word's


def test_lm_fits_to_all_training_words(spark):
    seen = [(i, "zq" * 3 + " plain") for i in range(40)]
    score = lambda rows: lattice_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0)
    one = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10)
    with_one, without = ({r.doc_id: r.score for r in score(seen + [(held, "zqzq")] + more)}[held] for more in ([(one, "other")], [(one, "plain")]))
    assert abs(with_one - without) < 0.5  # a word seen once doesn't displace the others


def test_lm_base_and_learning(spark, documents, odd, none):
    docs = [(r.doc_id, r.text or "") for r in documents.collect()]
    train, n = collections.Counter(), 0
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 10:
            train.update(t.encode().translate(LOW).split())
            n += 1
    total, v = sum(train.values()) + n, len(train) + 1
    got = {r.doc_id: r for r in lattice_lm.score_documents(documents, PIECES).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ws = t.encode().translate(LOW).split()
        base = sum(math.log10((c + 0.1) / (total + 0.1 * (v + 1))) for c in [*(train[w] for w in ws), n])
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws) + 1, sum(train[w] > 0 for w in ws) + 1, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    for df in (odd, odd.filter("doc_id = 4"), none):
        out = lattice_lm.score_documents(df, PIECES).collect()
        assert len(out) == df.count() and all(math.isfinite(r.score) for r in out)


def test_lm_scores_as_all_segmentations(spark, monkeypatch):
    """Every score against one made by plain recursion over all segmentations, over several blocks and hot words."""
    pieces = {"▁": 1.0, "▁a": 2.0, "a": 3.0, "b": 1.5, "ab": 0.5, "bab": 0.25, "▁ab": 0.75}
    names = list(pieces)
    start = lattice_lm.Lattice(names, lattice_lm.Lattice.normalised(names, np.array([*pieces.values(), 0.1, 0.1, 1.0, 0.0])))
    monkeypatch.setattr(lattice_lm.Lattice, "load", classmethod(lambda cls, path: start))
    monkeypatch.setattr(lattice_lm, "BLOCK_BYTES", 8)
    monkeypatch.setattr(lattice_lm, "_ENDS", 3)
    texts = {k: ["ab abab", "Bab xa b", "ab é▁b", None, "", "ab"][k % 6] for k in range(400)}
    df = spark.createDataFrame([(k, t, "x", 1.0) for k, t in texts.items()], "doc_id long, text string, word string, lp double")
    in_train = {k for k in texts if zlib.crc32(str(k).encode()) % 10}
    count = collections.Counter(w for k in in_train for w in (texts[k] or "").encode().lower().decode().split(" ") if w)

    def paths(word, lp):
        """(log weight, pieces) of each segmentation."""
        n = len(names)

        @functools.cache
        def rest(k):
            if k == len(word) + 1:
                return [(lp[n + 2], ())]
            s, out = "▁" + word, []
            for e in range(k + 1, len(s) + 1):
                i = names.index(s[k:e]) if s[k:e] in pieces and (s[k] == "▁") == (k == 0) and "▁" not in s[k + 1 : e] else None
                w = lp[i] if i is not None else None
                if i is None and e == k + 1 and k:
                    i, w = n + 1, lp[n + 1] - len(s[k].encode()) * math.log(256)
                if i is not None:
                    out += [(w + x, (i, *p)) for x, p in rest(e)]
            return out

        return rest(0)

    lp = start.log_p
    for _ in range(lattice_lm.ROUNDS):
        counts = np.zeros(len(lp))
        for w in count:
            found = paths(w, lp)
            z = sum(math.exp(x) for x, _ in found)
            for x, p in found:
                for i in (*p, len(names) + 2):
                    counts[i] += math.exp(x) / z
        lp = lattice_lm.Lattice(names, lp).fitted(counts).log_p
    n, v = sum(count.values()) + len(in_train), len(count) + 1
    d = lattice_lm.DISCOUNT
    word_p = lambda w: max(count[w] - d, 0) / n + d * v / n * sum(math.exp(x) for x, _ in paths(w, lp))
    want = {k: sum(math.log10(word_p(w)) for w in (t or "").lower().split()) + math.log10((len(in_train) - d) / n) for k, t in texts.items()}
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(df, "").collect()}
    assert got == {k: pytest.approx(x) for k, x in want.items()}


# 6
def test_leaks(spark):
    item = "Tom has 12 kg of apples and Maria buys 5 more from Tom at the old market near the river today"
    bench = [(1, "The rule says that " + item), (2, "short item words only"), (3, None), (4, "")]
    docs = {
        1: "Some intro words. Then the text says that " + item + " and goes on.",
        2: "So it says that Ann has 30 kg of apples and Petra buys 7 more from Ann at the old market near the river today",
        3: "So it says that Ann has 30 kg of apples and Ann buys 7 more from Petra at the old market now",
        4: "Nothing of the kind is written here, only usual words about other things that nobody asked for",
        5: "we saw a short item words only thing",
        6: None, 7: "", 8: "the old market near the river",
    }
    d = spark.createDataFrame([(k, v, "x") for k, v in docs.items()], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_changed for r in decontaminate.find_leaks(d, b).collect()}
    assert set(got) - {(3, 1)} == {(1, 1), (2, 1), (5, 2)} and got[1, 1] == 0 and got[2, 1] > 0
    spans = [r for r in decontaminate.find_leaks(d, b).collect() if r.doc_id == 3]
    assert all(r.n_tokens < 20 for r in spans)  # the clash of names ends a run, so none holds the whole item
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d.filter("doc_id <> 3"), b).collect()) == [4, 6, 7, 8]
    assert decontaminate.find_leaks(d, b.limit(0)).count() == decontaminate.find_leaks(d.limit(0), b).count() == 0


def test_leaks_as_brute_force(spark, sf_dir, documents):
    """Both ways: the leaks are those of every text compared with every item that shares a window of words with it."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    toks = lambda t: [w for w in (x.strip(decontaminate.EDGE.decode()).lower() for x in t.split()) if w]
    grams = collections.defaultdict(set)
    for r in b.collect():
        w = toks(r.text)
        for k in range(len(w) - 9):
            grams[tuple(w[k : k + 10])].add(r.item_id)
    docs = {r.doc_id: r.text for r in documents.collect()}
    exact = {(d, i) for d, t in docs.items() for w in [toks(t)] for k in range(len(w) - 9) for i in grams.get(tuple(w[k : k + 10]), ())}
    got = collections.defaultdict(list)
    for r in decontaminate.find_leaks(documents, b).collect():
        got[r.doc_id, r.item_id].append((1, r.first_token, r.first_token + r.n_tokens, r.n_changed))
    assert exact and exact <= set(got)
    want = {}
    for d in sorted(docs)[:40] + sorted({d for d, _ in got})[:10]:
        for r in b.collect():
            if x := leaks_of(r.text, docs[d]):
                want[d, r.item_id] = sorted(x)
    some = {d for d, _ in want} | set(sorted(docs)[:40])
    assert {k: sorted(v) for k, v in got.items() if k[0] in some} == want


def leaks_of(item, text):
    codes, at = decontaminate._Codes(), collections.defaultdict(list)
    for kind, size, q, h, of, _, there in decontaminate.windows_of(item.encode(), codes):
        at[kind, size, h].append((q, of, there))
    ours = decontaminate.windows_of(text.encode(), codes, sorted({x[:2] for x in at}), lambda h: np.isin(h.astype(np.int64), [x[2] for x in at]))
    return [(1, *x) for x in decontaminate.runs_of((kind, size, p, q, of, begins, slots, there) for kind, size, p, h, _, begins, slots in ours for q, of, there in at.get((kind, size, h), ()))]


def test_copies_with_few_literals_leak():
    for item in ("Compute 12 + 30 / 4 and 7 * 8 then 9", "WHAT IS THE CAPITAL OF FRANCE AND WHICH RIVER RUNS THROUGH IT", "What is 12 times 7?", "What is 5 plus 7?", "Compute 12 * 7 + 3 and 9", "Ann has 3 kg and Bob has 5 kg", "Tom has 3 apples"):
        n = len([w for w in item.encode().split() if w.strip(decontaminate.EDGE)])
        assert leaks_of(item, f"We ask you this: {item} So much for that.") == [(1, 4, 4 + n, 0)]
        assert leaks_of(item, f"so {item}") == [(1, 1, 1 + n, 0)]
    assert not leaks_of("What is 12 times 7?", "What is 12")


def test_short_items_leak_with_other_values():
    for item, text in (
        ("What is 5 plus 7?", "What is 13 plus 22?"), ("Compute 12 * 7 + 3 and 9", "Compute 4 * 8 + 2 and 6"), ("Ann has 3 kg and Bob has 5 kg", "Eve has 9 kg and Kim has 2 kg"),
        ("Tom has 3 apples", "Ann has 8 apples"), ("Natalia sold 48 clips in April to Ken.", "Maria sold 62 clips in May to Tom."),
    ):
        assert [x[0] for x in leaks_of(item, text)] == [1] and leaks_of(item, text)[0][3] >= 2
    assert not leaks_of("Ann has 3 kg and Bob has 5 kg", "Eve has 9 kg and Eve has 2 kg")  # two names have become one
    assert not leaks_of("What is 5 plus 7?", "What is 5 minus 7?") and not leaks_of("Tom has 3 apples", "Tom has 3 pears")


def test_names_that_begin_sentences_leak():
    item = "Tom has 12 kg of apples. Maria buys 5 more from Tom. How many are left?"
    for text in (
        "Ann has 30 kg of apples. Petra buys 7 more from Ann. How many are left?",
        "Ann Miller has 30 kg of apples. Petra buys 7 more from Ann. How many are left?",
        "We heard that Ann has 30 kg of apples. Petra Lee buys 7 more from Ann. How many are left?",
    ):
        assert [x[0] for x in leaks_of(item, text)] == [1] and leaks_of(item, text)[0][3] >= 4
    assert leaks_of(item, item) == [(1, 0, 16, 0)]
    clash = leaks_of(item, "Ann has 30 kg of apples. Ann buys 7 more from Petra. How many are left?")
    assert all(end - first < 16 for _, first, end, _ in clash)  # a clash of names ends a run, so none holds the whole item


def test_leak_cases(spark, odd, none):
    b = spark.createDataFrame([(1, "Same words here now again")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(odd, b).collect()) == [4, 5]
    assert decontaminate.drop_leaks(odd, b).count() == odd.count() - 2 and decontaminate.drop_leaks(none, b).columns == odd.columns


# 7
def brute_quality(text):
    ws = [w for w in re.split("[ \t-\r]+", text) if w]
    at = collections.defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality(spark, documents, odd, none):
    more = spark.createDataFrame([(1, "a b c d e f g h " * 5 + "x y\nx y\n\nx y"), (2, "a " * 30), (3, "one two # * |\n" * 4)], "doc_id long, text string")
    for df in (documents, odd, more):
        got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score_quality(df).collect())
        assert got == collections.Counter((r.doc_id, *brute_quality(r.text or "")) for r in df.collect())
    scored = quality.score_quality(documents).collect()
    assert all(not (r.kept and r.base_failed) and 0 <= r.quality <= 1 for r in scored)
    kept = quality.keep_quality(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in scored if r.kept)
    assert quality.score_quality(none).count() == quality.keep_quality(none).count() == 0
    assert "Python" not in kept._jdf.queryExecution().toString()


def test_estimation_finds_the_accuracies():
    import random

    rng, counts = random.Random(1), collections.Counter()
    rates = [[0.02, 0.15, 0.03, 0.01, 0.03, 0.02], [0.7, 0.5, 0.8, 0.02, 0.03, 0.02], [0.02, 0.05, 0.03, 0.8, 0.5, 0.6]]  # good, two kinds of junk
    for _ in range(40000):
        k = rng.choices([0, 1, 2], [0.8, 0.12, 0.08])[0]
        counts[sum((1 if rng.random() < 0.1 else 0 if rng.random() < r else 2) * 3**j for j, r in enumerate(rates[k]))] += 1
    mass, rate = quality.estimate(counts, [(0, 1, 2), (3, 4, 5)], 6)
    assert mass == pytest.approx([0.8, 0.12, 0.08], abs=0.03) and rate == pytest.approx(np.array(rates), abs=0.08)
    mass10, rate10 = quality.estimate({c: 10 * n for c, n in counts.items()}, [(0, 1, 2), (3, 4, 5)], 6)
    assert mass10 == pytest.approx(mass) and rate10 == pytest.approx(rate)  # whatever the size
    # a rule that errs often is outvoted by its fellow, one that is right isn't
    odds = lambda votes: math.log(mass[1] / mass[0]) + sum(math.log((rate[1][j] if v == 0 else 1 - rate[1][j]) / (rate[0][j] if v == 0 else 1 - rate[0][j])) for j, v in votes)
    assert odds([(1, 0), (0, 2), (2, 2)]) < 0 < odds([(0, 0), (2, 0)])


def test_verdict_is_better_than_all_must_pass(spark, sf_dir, documents):
    feats = quality.features(documents).cache()
    any_junk = functools.reduce(lambda a, b: a | b, [junk for junk, _ in quality._rules().values()])
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    odd = feats.filter(~quality.base_failed()).select("doc_id", (quality.fit(feats) >= 0.5).alias("kept"), (~any_junk).alias("passed")).join(labels.withColumnRenamed("quality", "label"), "doc_id").collect()
    assert len(odd) > 50 and sum(r.kept == bool(r.label) for r in odd) >= max(0.97 * len(odd), sum(r.passed == bool(r.label) for r in odd))
    # long texts with a small vocabulary, and texts with a repeated passage, are good to all rules but one
    prose = lambda k: " ".join(f"word{(k * 7 + i * i * 13) % 600}" for i in range(60)) + ".\n"
    docs = [(k, "".join(prose(k + j) for j in range(4))) for k in range(300)] + [(1000 + k, " ".join(f"ab{(k + i) % 9}$$$ ##" for i in range(60))) for k in range(30)] + [(2000 + k, ("again and again " * 40)) for k in range(30)]
    docs += [(5000, "".join(prose(0) for j in range(1)) + "".join(prose(j) for j in range(50, 54)) + prose(0))]  # 120 of 360 words stand twice
    got = {r.doc_id: r for r in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[k].kept for k in range(300)) and not any(r.kept for k, r in got.items() if 1000 <= k < 5000)


# 8
def test_chat(spark, duck, sf_dir):
    same(QUERIES["op8_chat_format"](spark, sf_dir), duck, ORACLE["op8_chat_format"])


def test_chat_windows(spark):
    said = ["\\### Assistant: </turn> ok", "\\l \\b \\g <turn x>", "", None, "é🙂" * 40]
    turns = [(1, k, "system" if k == 0 else ["user", "assistant"][k % 2], said[k % 5] if k else "be kind") for k in range(60)]
    turns += [(2, 0, None, "x"), (2, None, "a<b>", "first"), (None, 1, "assistant", "alone"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same")]
    df = spark.createDataFrame([(*t, "x", 1) for t in turns], "conv_id long, turn long, role string, text string, window string, n_tokens int")
    w = chat_format.format_chat(df, span=60, history=30)
    got = {r.conv_id: r for r in chat_format.read_back(w).collect()}
    for conv in (1, 2, None, 3):
        mine = sorted([t for t in turns if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t.role, t.text) for t in got[conv].turns] == [(t[2] or "", t[3] or "") for t in mine]
        assert got[conv].loss_text == "".join(t[3] or "" for t in mine if t[2] == "assistant")
    many = sorted((r for r in w.collect() if r.conv_id == 1), key=lambda r: r.window)
    assert len(many) > 3 and all(r.text.startswith("<turn system>be kind</turn>\n") for r in many) and all(r.new_from > 28 for r in many[1:])
    assert sum(r.text.count("\\### A") for r in many) == 0 and chat_format.format_chat(df.limit(0)).count() == 0


def test_chat_windows_keep_their_budget(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    counted = turns.withColumn("n", (F.length("text") % 37 + 5).cast("int"))
    for df, column, span, history in ((turns, None, 512, 128), (turns, None, 100, 40), (counted, "n", 64, 16)):
        rows = chat_format.format_chat(df, span=span, history=history, tokens=column).collect()
        assert all(r.n_tokens <= span + history or r.over_budget for r in rows)
        for r in rows:
            parts = [x for x in r.text[r.new_from :].split("</turn>\n") if x]
            assert not r.over_budget or len([x for x in parts if not x.startswith("<turn system>")]) <= 1  # one turn that is too long
            if column is None:
                each = [-(-(len(x) + len("</turn>\n")) // 4) for x in r.text.split("</turn>\n") if x]
                assert r.n_tokens == sum(each)
        assert sum(r.over_budget for r in rows) < len(rows) / 2 and len({r.window for r in rows}) > 1


# 9
def shingle_set(text):
    w = text.encode().translate(LOW).split()
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set()


def brute_similar(docs):
    sets = {i: shingle_set(t or "") for i, t in docs.items()}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(docs, 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
            links[a].add(b), links[b].add(a)
    part = {}
    for i in sorted(docs):
        todo = [i] if i not in part else []
        while todo:
            j = todo.pop()
            if j not in part:
                part[j] = i
                todo += links[j]
    return {i: (len(sets[i]), len(links[i]), part[i]) for i in docs}


def test_jaccard(spark, documents, odd, none):
    base = " ".join(f"word{i}" for i in range(60))
    near = {1000 + k: " ".join(f"word{i}" if i != 10 + 6 * k else f"CHANGED{k}" for i in range(60)) for k in range(8)}
    chain = {2000 + k: " ".join(f"c{i}" for i in range(k * 5, k * 5 + 60)) for k in range(6)}
    docs = {r.doc_id: r.text for r in documents.collect()} | near | chain | {3000: base, 3001: base.upper(), 3002: "", 3003: None, 3004: "a b", 3005: "A  B"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs.items()], "doc_id long, text string, n long, g long")
    got = {r.doc_id: (r.n_shingles, r.n_similar, r.component_id) for r in jaccard_join.similar_documents(df).collect()}
    assert got == brute_similar(docs)
    kept = jaccard_join.keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in got.items() if x[2] == i) and kept.columns == df.columns
    out = collections.Counter(map(tuple, jaccard_join.similar_documents(odd).collect()))
    assert out[4, 1, 1, 4] == out[5, 1, 1, 4] == 1 and out[3, 1, 0, 3] == 2 and out[None, 1, 0, None] == 1 and sum(out.values()) == odd.count()
    assert jaccard_join.similar_documents(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.component for r in jaccard_join.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 105: 100, 103: 100}


# 10
def test_licenses(documents, odd, none):
    for df in (documents, odd):
        for r, t in zip(by_id(license_scan.scan_licenses(df)), by_id(df)):
            words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t.text or "").encode().translate(LOW))
            hits = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.encode().split()]
            assert (r.n_words, r.n_base) == (len(words), len(hits)) and r.base_labels == ",".join(sorted({x for _, x in hits}))
            assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
            assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert license_scan.scan_licenses(none).count() == 0


def test_template_automata():
    a = license_scan.TokenAutomaton("granted by {{1-3}} to you [[free of charge]] under these terms")
    accepts = lambda s: a.match(s.split(), s.split().index(a.seed[0])) is not None
    assert accepts("x granted by big corp inc to you free of charge under these terms y") and accepts("granted by me to you under these terms")
    for bad in ("granted by to you under these terms", "granted by a b c d to you under these terms", "granted by me to you free of under these terms", "granted by me to you under those terms", "granted by me to all under these terms"):
        assert not accepts(bad)


def test_every_template_gives_its_label():
    compiled = license_scan._compiled(tuple(map(tuple, license_scan.TEMPLATES)))
    for label, confidence, wording in license_scan.TEMPLATES:
        names = itertools.cycle(["example", "holdings"])
        fill = lambda m: " ".join(itertools.islice(names, max(int(m[1]), 1 if int(m[2]) > 1 else 0)))  # noqa: B023, E731
        for text in (re.sub(r"\[\[|\]\]", "", wording), re.sub(r"\[\[[^\[\]]*\]\]", "", wording)):
            text = re.sub(r"\{\{(\d+)-(\d+)\}\}", fill, text).replace("]]", "").replace("[[", "")
            found = license_scan.scan_text(f"A word. {text} And more.".upper().encode(), compiled, [])
            assert label in found[5].split(",") and found[6] >= confidence, (label, text[:80])
            missing = text.split()
            if confidence == 1.0 and len(missing) > 100:  # a mandatory word less: no whole text, perhaps its notice
                del missing[-2]
                assert license_scan.scan_text(" ".join(missing).encode(), compiled, [])[6] < 1.0


def test_gnu_notices_without_either():
    compiled = license_scan._compiled(tuple(map(tuple, license_scan.TEMPLATES)))
    for kind, label in (("General", "gpl-2"), ("General", "gpl-3"), ("Lesser General", "lgpl-3"), ("Affero General", "agpl-3")):
        for middle in ("", " as published by the Free Software Foundation;", " as published by the Free Software Foundation; either", ", either"):
            assert license_scan.scan_text(f"under the terms of the GNU {kind} Public License{middle} version {label[-1]}".encode(), compiled, [])[5] == label
    for text, label in (("Licensed under the GNU General Public License v3.0", "gpl-3"), ("GNU Lesser General Public License version 2.1", "lgpl-2.1"), ("GNU General Public License, version 2", "gpl-2"), ("released under the GPLv3", "gpl-3")):
        assert license_scan.scan_text(text.encode(), compiled, [])[5] == label
    assert license_scan.scan_text(b"the GNU General Public License is long, version control is not", compiled, [])[5] == ""


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm._common import scratch_path

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_path(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), "x")


# pipeline
def test_pipeline_cases(spark, tmp_path, odd, none):
    """Null ids and texts, repeated rows and an empty table go through all stages."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    long = " ".join(f"word{i * 7 % 113} of{i % 31}" for i in range(60))
    more = spark.createDataFrame([(50, long, "en", "s", 1), (50, long, "en", "s", 1), (51, long + " more", "en", "s", 1), (None, long, None, None, None)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, "Same words here now again"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd.select(*columns).unionByName(more), none.select(*columns)):
        kept = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, str(tmp_path))
            assert kept.columns == columns
        ids = [r.doc_id for r in kept.collect()]
        assert sorted(ids, key=str) == ([50, 50, None] if docs.count() else [])  # rows of one id are one document, a null id has no copies
        assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() == len(ids)


def test_pipeline_stages(spark, sf_dir, documents):
    docs, kept = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns
        before, after = ({r.doc_id for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        kept.append(after)
        docs = out
    assert kept[0] == {r.doc_id for r in quality.score_quality(documents).filter("kept").collect()}
    links = brute_similar({r.doc_id: r.text for r in documents.filter(F.col("doc_id").isin(list(kept[1]))).collect()})
    assert kept[2] == {i for i, x in links.items() if x[2] == i}
    assert len(kept[3]) > 100
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept[3])
