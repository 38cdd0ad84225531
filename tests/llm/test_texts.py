"""Scoring, extraction, licences, urls and token ids: brute force, round trips and held-out accuracy."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from ticklattice.llm import html_extract, piece_codec
from ticklattice.llm.html_extract import LABELLED, extract, main_text, train_tree
from ticklattice.llm.language_model import score_texts
from ticklattice.llm.license_scan import known_digests, license_scan
from ticklattice.llm.queries import TOKENIZER, URL_RULES
from ticklattice.llm.toxicity import drop_toxic, severity, train
from ticklattice.llm.url_filter import mine, url_filter, url_tokens

SF = "/root/testdata/sf0.1"


# toxicity


def toxic_rows(n=600, seed=1):
    r = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "s", "rt")]
    rows, marks = [], []
    for i in range(n):
        text, bad = r.choices(plain, k=r.randint(20, 80)), i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 6)):
                text.insert(r.randrange(len(text)), r.choice(["Xyzzy!", "quuxling", "quuxheit", "zorkmid"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(bad)))
    return rows, marks


def test_toxicity_of_held_out_labels_and_order_of_severity(spark, make_docs, odd_rows):
    rows, marks = toxic_rows()
    docs, labels = make_docs(rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = train(docs, labels, holdout=(3, 0))
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in severity(docs, model).collect()}
    right = [got[i].toxic == bool(y) for i, y in marks if i % 3 == 0]
    assert np.mean(right) > 0.97
    dense = severity(make_docs([(1, "bas xyzzy den gun " * 3), (2, "xyzzy quuxling zorkmid " * 3), (3, "bas den gun")]), model).collect()
    by_id = {r.doc_id: r.expected_severity for r in dense}
    assert by_id[3] < 0.5 < by_id[1] < by_id[2]
    assert all(abs(sum(r.grade_shares) - 1) < 1e-9 for r in dense)
    odd = severity(make_docs(odd_rows), model)
    assert odd.count() == len(odd_rows) and odd.where("toxic").count() == 0
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and abs(left.count() - 480) <= 5


def test_toxicity_without_usable_labels(spark, make_docs, odd_rows):
    for labels in ([], [(4, None)], [(4, 0), (6, 0)], [(4, 1), (99, 1)]):
        model = train(make_docs(odd_rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert severity(make_docs(odd_rows), model).where("toxic").count() == 0


def test_toxicity_on_the_given_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("toxic", "y")
    model = train(docs, labels, label_col="y", holdout=(5, 0))
    seen = severity(docs, model).join(labels, "doc_id").where("doc_id % 5 = 0")
    n = {(r.toxic, r.y): r["count"] for r in seen.groupBy("toxic", "y").count().collect()}
    assert n[True, 1] >= 0.9 * (n[True, 1] + n.get((False, 1), 0)) and n.get((True, 0), 0) <= 0.01 * n[False, 0]


# language model


def test_language_model(spark, make_docs, odd_rows):
    r = random.Random(3)
    rows = list(odd_rows)
    for i in range(300):  # a word tells the next one's half of the vocabulary
        words, side = [], 0
        for _ in range(60):
            words.append(f"{'ab'[side]}{min(int(r.paretovariate(0.7)), 200)}")
            side ^= 1
        rows.append((100 + i, " ".join(words)))
    got = score_texts(make_docs(rows)).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[i, held(i), len(w), sum(x in counts for x in w), n, f"{base:.6f}"] += 1
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, f"{x.base_score:.6f}") for x in got) == want
    new = [x for x in got if x.held_out and (x.doc_id or 0) >= 100]
    assert new and sum(x.score for x in new) > sum(x.base_score for x in new) and all(x.score < 0 for x in got)


def test_language_model_probabilities_add_up(spark, make_docs):
    """All continuations of a history, with the unseen place of each cell: every text of two known words, and shares of cells."""
    from ticklattice.llm import language_model as lm

    docs = make_docs([(i, " ".join(random.Random(i).choices("abcdefghij", k=30))) for i in range(40)])
    blocks = lm.blocks_of(docs, 10, "doc_id", "text").cache()
    corpus, counts = lm.corpus_of(blocks)
    cells = (corpus.cell_tokens + 0.1 * corpus.cell_words + 0.1) / (corpus.cell_tokens + 0.1 * (corpus.cell_words + 1))
    assert np.allclose(cells, 1)
    history, weights = lm.train(blocks, corpus)
    buckets = [np.array([n]) for n in (5, 9, 77, 3)]
    total = sum(
        np.exp(lm._log_p(weights.classes, buckets, np.array([k]), True) + lm._log_p(weights.members, lm.member_buckets(buckets, np.array([k])), np.array([j]), False))[0]
        for k in range(lm.CLASSES)
        for j in range(lm.MEMBERS)
    )
    assert abs(total - 1) < 1e-4


def test_language_model_keeps_all_features_and_fine_cells():
    from ticklattice.llm import language_model as lm
    from ticklattice.llm.common import WordCutter

    cells = lambda words: lm._tail_cells(*WordCutter().places([" ".join(words).encode()])[:3]).astype(int)
    third = cells(f"ab{c}xyz" for c in "abcdefghijklmnop")  # the third byte tells members apart
    assert len(set(third // lm.MEMBERS)) == 1 and len(set(third % lm.MEMBERS)) > 4
    assert len(set(cells(f"x{c}é" for c in "àáâãäåæçèéêë") // lm.MEMBERS)) > 3  # two characters, not two bytes
    assert len(set(cells(["word", "word.", 'word..."!)']))) == 1
    history = lm.History(lm.Corpus(0, 0, np.array([], np.uint64), np.zeros(lm.CELLS), np.zeros(lm.CELLS)))
    words, near, sizes = np.arange(8).astype(np.uint64), np.arange(8), np.array([8])
    other = np.where(near == 5, 99, near)  # the cell two before the last token
    one, two = history.buckets(words, near, sizes), history.buckets(words, other, sizes)
    assert [x[7] == y[7] for x, y in zip(one, two)] == [True, True, False, False, True]
    k = np.zeros(8, int)
    for i in range(5):  # each feature has a say in the choice of the member
        moved = [b + (n == i) for n, b in enumerate(one)]
        assert any((x != y).any() for x, y in zip(lm.member_buckets(one, k), lm.member_buckets(moved, k)))


def test_language_model_step_is_the_gradient_in_bounded_memory():
    import tracemalloc

    from ticklattice.llm import language_model as lm

    r = np.random.default_rng(4)
    n, rate = 100_000, 0.3  # one text of more tokens than a part has
    table = r.normal(0, 0.5, (lm.BUCKETS, lm.CLASSES)).astype(np.float32)
    buckets = [np.minimum(r.zipf(1.3, n), lm.BUCKETS - 1).astype(np.intp), r.integers(1, lm.BUCKETS, n)]
    target = r.integers(0, lm.CLASSES, n)
    for bias in (True, False):
        x = sum(table[b].astype(np.float64) for b in buckets) + bias * table[0].astype(np.float64)
        missed = (np.arange(lm.CLASSES) == target[:, None]) - np.exp(x) / np.exp(x).sum(axis=1, keepdims=True)
        log_p = np.log(np.exp(x) / np.exp(x).sum(axis=1, keepdims=True))[np.arange(n), target]
        assert np.allclose(lm._log_p(table, buckets, target, bias), log_p, atol=1e-5)
        want = table.astype(np.float64)
        want[0] += bias * rate * missed.mean(axis=0)
        for b in buckets:
            sums = np.zeros(table.shape)
            np.add.at(sums, b, missed)
            want += sums * (rate / (np.bincount(b, minlength=lm.BUCKETS) + 20))[:, None]
        got = table.copy()
        tracemalloc.start()
        lm._step(got, buckets, target, rate, bias)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.abs(got - want).max() < 1e-5 and np.abs(got - table).max() > 0.01
        assert peak < 30e6, peak


def test_language_model_blocks_look_at_distinct_words_only(monkeypatch):
    from ticklattice.llm import language_model as lm
    from ticklattice.llm.common import WordCutter

    cells, seen = lm._tail_cells, []

    def counted(buf, starts, ends):
        seen.append(len(starts))
        return cells(buf, starts, ends)

    monkeypatch.setattr(lm, "_tail_cells", counted)
    r = random.Random(8)
    words = [f"w{i:04d}" for i in range(500)]
    texts = [b"", *(" ".join(r.choices(words[: 100 * i + 100], k=200_000)).encode() for i in range(5)), b" \n ", b"once w0001"]  # several chunks
    ids = list(range(8))
    batch = lm._block(ids, texts, 10, WordCutter())
    assert sum(seen) <= 500 * len(seen) + 1
    got, start = lm._Reader(batch, 0), 0
    assert len(got.words) == len(set(got.words.tolist())) == 502
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    counts = Counter()
    for text, size, out in zip(texts, got.sizes, held):
        h, _ = WordCutter().cut([text])
        own = got.words[got.tokens[start : start + size]]
        assert own.tolist() == [*h.tolist(), int(lm.END_HASH)]
        counts.update([] if out else own.tolist())
        start += size
    assert start == len(got.tokens) and got.held.tolist() == held
    assert batch.column("counts").values.to_pylist() == [counts[w] for w in got.words.tolist()]
    buf, starts, ends, h, _ = WordCutter().places([b" ".join(texts)])
    want = dict(zip(h.tolist(), cells(buf, starts, ends).tolist())) | {int(lm.END_HASH): lm.CELLS - 1}
    assert got.tail.tolist() == [want[w] for w in got.words.tolist()]


def test_language_model_of_nothing(make_docs):
    assert score_texts(make_docs([])).count() == 0


# main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for everyone, please accept them all.</div>
<main><article><header><h1>Title &eacute;&#8217;s</h1></header><!-- no --><p>First <b>bo</b>ld para<br>x<p>Second&nbsp;one &lt;ok&gt;
<ul><li>one<li>two</ul><div class=ad>buy now</div><aside>side text</aside><form>Search <input><button>Go</button></form><p hidden>gone</p></article>
<section id="comments"><p>Nice article, I liked it very much and will come back tomorrow to read it again.</p></section></main>
<div class=sidebar>foo</div><footer>&copy; x</footer>"""


def test_labelled_table_is_learnt():
    tree, table = train_tree(), np.array(LABELLED, float)
    assert (tree.predict(table[:, :-1]) == table[:, -1].astype(bool)).all()


def test_main_text(spark):
    assert main_text(PAGE, train_tree()) == "Title é’s First bold para x Second one <ok> one two"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "v", "<p>" + "word " * 30), (4, "w", "<" * 5000), (5, "x", "a < b"),
            (6, "y", "<article>" + "<p>long text here</p>" * 5000 + "</article>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = {(r.page_id, r.url): r for r in got.collect()}
    assert got.count() == len(rows) and out[2, None].text == out[3, ""].text == "" and out[None, "v"].text == " ".join(["word"] * 30)
    assert out[6, "y"].n_chars == 5000 * len("long text here ") - 1 and all(r.n_chars == len(r.text) for r in out.values())
    assert extract(pages.limit(0)).count() == 0


def test_a_page_that_marks_nothing():
    page = "<p>" + "word " * 50 + "</p><ul><li><a href=#>x</a><li><a href=#>y</a></ul><p>" + "more " * 60
    assert main_text(page, html_extract.train_tree()) == " ".join(["word"] * 50 + ["more"] * 60)


def test_article_text_stays_under_names_that_only_hold_chrome_words():
    tree, text = train_tree(), " ".join(f"word{i}" for i in range(40))
    shown = lambda page: main_text(page, tree)
    for a in ('style="overflow:hidden"', 'class="post overflow-hidden"', 'data-t="hidden gems"', "class=has-sidebar", 'class="no-sidebar wide"', "id='with-comments'",
              "class=content-sidebar-wrap", 'data-id="menu"', "hidden=false", 'title="class=ad"'):
        assert shown(f"<div {a}><article><p>{text}</p></article></div>") == shown(f"<div {a}><p>{text}</p></div>") == text, a
    for raw in ('<svg class="i"/>', "<svg/>", '<svg data-a="x>y" />', "<title-bar>", "<object-list>", "<select-all></select-all>", "<svg><path d=z /><text>no</text></svg>"):
        assert shown(f"{raw}<p>{text}</p>") == text, raw
    for a in ("hidden", 'hidden=""', "HIDDEN class=x", 'style="Display : none"', 'aria-hidden="true"', "class=sidebar", 'class="x site-footer"', "id=cookie-notice", "role=navigation"):
        assert shown(f"<p>{text}</p><div {a}><p>{text} gone</p></div>") == text, a


LONG = " ".join(f"word{i}" for i in range(60))


def test_an_element_that_holds_the_page_is_no_part_of_it():
    shown = lambda page: main_text(page, train_tree())
    for page in ("<form id=aspnetForm><div><article>{}</article></div></form>", "<form class=f><p>{}</p></form>", "<aside><p>{}</p></aside><p>end</p>", "<div class=widget><p>{}</p></div>"):
        assert shown(page.format(LONG)).startswith(LONG), page
    assert shown(f"<p>{LONG}</p><form><p>Search our pages for {LONG[:80]}</p></form>") == LONG
    assert shown(f"<p>{LONG}</p><div id=comments><p>{LONG} {LONG}</p></div>") == LONG  # long comments are comments
    assert shown(f"<div hidden><p>{LONG}</p></div>") == ""


def test_a_teaser_is_not_the_page():
    got = main_text(f'<div><p>{LONG}</p></div><article class="card"><p>Teaser text here</p></article>', train_tree())
    assert got.startswith(LONG)
    assert main_text(f"<div><p>Some words before it.</p></div><article><p>{LONG}</p></article>", train_tree()) == LONG


def test_short_sentences_stay():
    page = f"<p>Notes on tea</p><p>Tea is hot.</p><p>Drink it slowly now.</p><p>{LONG}</p>"
    assert main_text(page, train_tree()) == f"Notes on tea Tea is hot. Drink it slowly now. {LONG}"
    assert main_text("<p>One short sentence.</p>", train_tree()) == "One short sentence."


def test_adverts_and_comments_go_by_any_of_their_names():
    tree, names = train_tree(), "ad-container advert-wrapper comment-body comment-content post-comments user-comments related-posts social-icons cookie-consent-wrapper newsletter-form gdpr"
    for name in names.split():
        for page in ("<article>{}</article>", "<div>{}</div>", "<main><div>{}</div></main>"):
            inner = f'<p>{LONG}</p><div class="{name}"><p>Some words that are not the text of it at all, but quite a lot.</p></div>'
            assert main_text(page.format(inner), tree) == LONG, (name, page)
    for name in ("post-header", "entry-content", "article-body", "page-content", "main-content"):
        assert main_text(f"<div class={name}><h1>Title of it</h1></div><p>{LONG}</p>", tree) == f"Title of it {LONG}", name


# licences


def test_british_and_american_spellings_match(spark, make_docs):
    known = [("X", "Wilful acts of the licence owner")]
    got = license_scan(make_docs([(1, "willful acts of the LICENSE holder."), (2, "wilfull acts")]), known_digests(spark, known))
    assert {r.doc_id: r.text_license for r in got.collect()} == {1: "X", 2: None}


def test_license_scan(spark, make_docs, odd_rows):
    mit = [t for i, t in __import__("ticklattice.llm.license_scan", fromlist=["KNOWN"]).KNOWN if i == "MIT"][-1]
    rows = odd_rows + [
        (20, mit), (21, mit.upper().replace(". ", ".\n\n").replace("<year>", "1999")), (22, "Text.\nLicensed under the Apache Licence, version 2.0\nCopyright 2001 A B\nmore"),
        (23, "Released under the MIT License. And more"), (24, "(c) 2020 X\nReleased under the MIT License!\nLicensed under CC BY-NC 4.0."), (25, mit + " x"), (26, "RELEASED under the «MIT» License"),
    ]
    got = {r.doc_id: r for r in license_scan(make_docs(rows), known_digests(spark)).collect()}
    assert got[20].text_license == got[21].text_license == "MIT" and got[25].text_license is None and got[23].line_licenses == []
    assert (got[22].text_license, got[22].line_licenses, got[22].n_line_licenses) == (None, ["Apache-2.0"], 1)
    assert got[24].line_licenses == ["CC-BY-NC-4.0", "MIT"] and got[24].n_line_licenses == 2
    assert all(got[i].text_license is None and got[i].n_line_licenses == 0 for i in (1, 2, 3, 4, 7, 12, 14, None))
    assert license_scan(make_docs(rows), known_digests(spark)).count() == len(rows)
    assert license_scan(make_docs([]), known_digests(spark)).count() == 0


def test_common_licences_are_known(spark, make_docs):
    want = ["Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0"]
    folder = os.path.join(os.path.dirname(html_extract.__file__), "licenses")
    whole = {n: open(f"{folder}/{n}.txt").read() for n in want}
    rows = [(i, t) for i, t in enumerate(whole.values())]
    rows += [(10 + i, "\n".join(" ".join(p.split()) for p in t.split("\n\n"))) for i, t in enumerate(whole.values())]
    rows += [(20, "x\nSPDX-License-Identifier: AGPL-3.0-only\ny"), (21, whole["GPL-3.0-only"] + " more"), (22, "Licensed under the BSD 3-clause licence")]
    got = {r.doc_id: r for r in license_scan(make_docs(rows), known_digests(spark)).collect()}
    assert [got[i].text_license for i in range(5)] == [got[10 + i].text_license for i in range(5)] == want
    assert got[20].line_licenses == ["AGPL-3.0-only"] and got[21].text_license is None and got[22].text_license == "BSD-3-Clause"


# urls


def brute_rule(host, path):
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def test_url_filter(spark):
    r = random.Random(2)
    urls = [f"{s}://{h}.example.{t}/{l}/{n}{e}" for s in ("http", "HTTPS") for h in ("a", "B.c", "spam") for t in ("com", "net", "org", "dev") for l in ("en", "de", "es") for n in (1, 7, 88) for e in ("", "?q=1&z", "/x#f")]
    odd = [None, "", "nope", "://", "http://", "http://com/en/", "x://COM", "http://xcom/en/1", "a://b?c", "h://org/es/#", "h://É.com/en/" + "x/" * 3000]
    rows = list(enumerate(urls + odd)) + [(None, urls[0]), (0, urls[0])]
    labelled = [(u, "block" if "spam" in u and r.random() < 0.9 else "allow") for u in urls] + [(None, "allow")]
    pages = spark.createDataFrame([(*x, "h", "t") for x in rows], "page_id long, url string, host string, tokens string")
    marks = spark.createDataFrame(labelled, "url string, verdict string")
    got = Counter((x.page_id, x.host, x.path, x.rule, x.verdict) for x in url_filter(pages, marks, URL_RULES).collect())
    want = Counter()
    for i, u in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest[: min((rest + c).index(c) for c in "/?#")]
        path = rest[len(host) :]
        path = path[: min((path + c).index(c) for c in "?#")]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        rule = brute_rule(host, path)
        want[i, host, path, rule[0] if rule else None, rule[1] if rule else "block" if "spam." in (u or "").lower() else "allow"] += 1
    assert got == want
    empty = url_filter(pages, marks.limit(0), URL_RULES)
    assert empty.where("mined <> 'allow'").count() == 0 and url_filter(pages.limit(0), marks, []).count() == 0


def test_mined_rules_are_supported_confident_and_short(spark):
    from pyspark.sql import functions as F

    rows = [(f"http://{h}.com/{p}", "block" if h == "bad" and p == "x" else "allow") for h in ("bad", "ok") for p in ("x", "y") for _ in range(10)]
    sets = spark.createDataFrame(rows, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
    found, usual = mine(sets, confidence=0.9)
    rules = {(tuple(x.tokens), x.verdict): x.confidence for x in found.collect()}
    assert usual == "allow" and rules == {(("host:bad", "path:x"), "block"): 1.0, (("host:ok",), "allow"): 1.0, (("path:y",), "allow"): 1.0}


def test_support_is_a_number_of_urls_at_every_size(spark):
    from pyspark.sql import functions as F

    few = [("http://rare.com/p", "block")] * 12 + [("http://odd.com/p", "block")] * 4
    for n in (200, 4000):  # 12 urls are 6 % or 0.3 % of them
        rows = few + [(f"http://h{i % 10}.com/p", "block" if i % 4 == 0 else "allow") for i in range(n)]
        sets = spark.createDataFrame(rows, "url string, verdict string").select(url_tokens(F.col("url")).alias("tokens"), "verdict")
        found, usual = mine(sets)
        blocked = {tuple(x.tokens) for x in found.where("verdict = 'block'").collect()}
        assert usual == "allow" and ("host:rare",) in blocked and not any("host:odd" in x for x in blocked)


# token ids


@pytest.fixture(scope="module")
def model():
    return piece_codec.model_bytes(TOKENIZER)


EDGE = ["", " ", "  ", "a  b", " a ", "\n\t\r x", "你好🙂🙂", "<s></s><unk><0x41>", "aaaa" * 300, "é" * 50, "\x00", "    indented\n        more", "ﬁÅ　x", "he said: “…” — 10.000,5"]


def test_ids_are_those_of_the_library(spark, model):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=model)
    texts = EDGE + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rows = [(i, t, [0], "x") for i, t in enumerate(texts)] + [(-1, None, None, "y"), (None, "x", None, "z"), (0, "", None, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids array<int>, decoded string").repartition(3)
    got = piece_codec.decode(piece_codec.encode(docs, model, check_col="same"), model)
    out = got.collect()
    assert len(out) == len(rows) and all(r.same and r.decoded == (r.text or "") for r in out)
    assert all(r.token_ids == sp.encode(r.text or "") for r in out)
    assert piece_codec.encode(docs.limit(0), model).count() == 0
    assert piece_codec.decode(docs.select("doc_id", "token_ids"), model).where("doc_id = -1 and decoded is null").count() == 1


def test_best_unigram_paths(model):
    """With the scores read as those of a unigram model, no other split of a word has a higher sum."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(model)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    pieces = piece_codec.Pieces(proto.SerializeToString())
    encoder = piece_codec.Encoder(pieces)
    for text in ("the", "tionhe", "there are", "anha thention", "abcab"):
        ids = encoder.encode([text])[0]
        marked = piece_codec.MARK + text.replace(" ", piece_codec.MARK)
        best = {0: 0.0}
        for end in range(1, len(marked) + 1):
            best[end] = max(best[a] + pieces.scores[pieces.ids[marked[a:end]]] for a in range(end) if marked[a:end] in pieces.ids)
        assert sum(pieces.scores[i] for i in ids) == best[len(marked)] and piece_codec.decode_ids(ids, pieces) == text


def test_an_encoder_keeps_little(model):
    import random
    import tracemalloc

    draw = random.Random(3)
    text = " ".join("".join(draw.choices("etaoinshrd", k=draw.randint(4, 8))) for _ in range(6000))
    encoder = piece_codec.Encoder(piece_codec.Pieces(model))
    tracemalloc.start()
    encoder.encode([text])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    each = held / (len(encoder.words) + len(encoder.apart))  # bytes a word or pair
    assert each < 100, each
