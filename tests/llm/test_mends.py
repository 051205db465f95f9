"""Cases that once went wrong."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colinear.llm import html_text, linededup, ngram_lm, quality_model, quality_rules

DOCS = "doc_id long, text string, lang string, source string"


def lines(page):
    found = html_text.blocks(page)
    main = html_text.main_kind([len(x) for x, _ in found], [kind for _, kind in found])
    return [x for x, kind in found if kind % html_text.HINTED == main]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><body><article><p>Text one.</p></article></body></html>", ["Text one."]),
        ("<head><meta charset=x><link rel=y><article><p>Text one.</p></article>", ["Text one."]),
        ("<head><title>T</title>Text of the page<p>More", ["Text of the page", "More"]),
        ("<html><head><title>T</title></head><body><p>Text</p></body></html>", ["Text"]),
        ('<article><p data-note="a hidden gem">One</p><p title="css display:none trick">Two</p><p title="role=search">Three</p></article>', ["One", "Two", "Three"]),
        ('<article><p hidden>Gone</p><p style="color:red; display: none">Gone</p><p aria-hidden=true>Gone</p><div ROLE="Search">Gone</div><p>Stays</p></article>', ["Stays"]),
        ('<article><div class="ad-hoc-committee"><p>One</p></div><section class="social-history"><p>Two</p></section><div class="related-work"><p>Three</p></div></article>', ["One", "Two", "Three"]),
        ('<article><p>Body</p><div class="related-posts">Others</div><div class="commentList">Nice</div><div id="sidebarLeft">Side</div><div class="adBox">Buy</div></article>', ["Body"]),
        ('<article><p>One <span class="notice">two</span> three</p></article>', ["One two three"]),
        ('<article><p>One <span hidden>two</span>three <b>four</b></p></article>', ["One three four"]),
    ],
)
def test_html(page, want):
    assert lines(page) == want


def test_html_main_text_of_marked_pages(spark):
    """Plain rule for marked pages whose neighbours share nothing: the article's lines, whatever stands around it."""
    r = random.Random(2)
    pages, want = [], {}
    for i in range(30):
        own = [" ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(1, 6))]
        head = r.choice(("<head><title>T</title>", "<head><title>T</title></head>", ""))
        pages.append((i, f"http://h{i % 3}.com/{r.randrange(99)}/{i}", f"<html>{head}<body><nav><a href=x>Menu</a></nav><article>" + "".join(f"<p>{x}" for x in own) + "</article><footer>Foot</footer>"))
        want[i] = "\n\n".join(own)
    pages += [(90, "http://h0.com/x", "<p>" * 20_000 + "word " * 50_000), (91, None, None), (92, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for c in ("host", "gone", "row_key", "at", "path"):
        df = df.withColumn(c, F.lit("z"))
    got = {x.page_id: x for x in html_text.main_text(df).collect()}
    assert {i: got[i].text for i in want} == want and got[90].n_chars == 249_999 and got[91].text == got[92].text == ""


def test_one_mark_fails_no_document(spark):
    r = random.Random(7)
    words = "river stone cloud paper garden winter music lamp road bridge forest table window letter".split()
    text = lambda n: "\n".join(" ".join(r.choice(words) + str(r.randrange(99)) for _ in range(12)) for _ in range(n))
    rows = [(i, text(8), "en", "s") for i in range(600)]
    one = text(8)
    rows += [(1000, one + " end!", "en", "s"), (1001, one + " a & b", "en", "s"), (1002, one + "\n" + one.split("\n")[0], "en", "s"), (1003, one, "en", "s"), (1004, one.replace("a", "#$%"), "en", "s")]
    got = {x.doc_id: x.kept for x in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(1000, 1004))
    flat = spark.createDataFrame([(i, one, "en", "s") for i in range(300)] + [(999, one.upper(), "en", "s")], DOCS)  # no spread: no fence
    assert all(x.kept for x in quality_rules.judged(flat).collect())


def test_marks_that_a_group_lacks_fail(spark):
    """A metric that is equal in a whole group is judged too: texts full of marks that no other one has are dropped."""
    r = random.Random(8)
    words = "river stone cloud paper garden winter music lamp road bridge forest table window letter".split()
    text = lambda n: "\n".join(" ".join(r.choice(words) + str(r.randrange(99)) for _ in range(r.randrange(9, 16))) for _ in range(n))
    rows = [(i, text(8), "en", "s") for i in range(600)]
    one = text(8)
    longest = max(one.split("\n"), key=lambda x: len(x.split()))
    rows += [(1000, one + " " + "!" * 200, "en", "s"), (1001, one.replace(" ", "!!! "), "en", "s"), (1002, one.replace(" ", "%% "), "en", "s"), (1003, one.upper(), "en", "s")]
    rows += [(1010, one + "!", "en", "s"), (1011, one + " a & b", "en", "s"), (1012, one + "\n" + longest, "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    got = {x.doc_id: x for x in quality_rules.judged(docs).collect()}
    assert [got[i].kept for i in range(1000, 1004)] == [False] * 4 and not any(got[i].base_failed for i in range(1000, 1004))
    assert all(got[i].kept for i in (*range(600), 1010, 1011, 1012))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert dict(con.sql(f"SELECT doc_id, kept FROM ({quality_rules.OP3_SQL})").fetchall()) == {i: x.kept for i, x in got.items()}


def test_line_dedup_is_linear_in_lines(spark):
    def seconds(n):
        shared = "\n".join(f"shared {i}" for i in range(n))
        df = spark.createDataFrame([(k, shared + f"\nown line {k}", "en", f"s{k}") for k in range(8)], DOCS).repartition(4)
        began = time.time()
        got = linededup.without_boilerplate(df).collect()
        assert {x.text for x in got} == {f"own line {k}" for k in range(8)} and {x.n_removed for x in got} == {n}
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 3 * seconds(20_000) + 5


def test_rows_of_a_rated_id_count_once(spark):
    docs = spark.createDataFrame([(1, f"text {i % 50}", "en", "s") for i in range(2000)] + [(2, "other", "en", "s")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted((x.doc_id, x.grade) for x in quality_model.graded(docs, labels).collect()) == [(1, 1), (2, 0)]


def test_lm_scores_blocks_in_rounds(spark, monkeypatch):
    """Not all blocks and answers are in one shuffle: no table of scores has all texts, together they have each once."""
    docs = spark.createDataFrame([(k, f"word{k % 7} of text {k} " * 40, "en", "s") for k in range(60)], DOCS).repartition(4)
    monkeypatch.setattr(ngram_lm, "BLOCK", 300)
    kept, stored = [], ngram_lm.stored
    monkeypatch.setattr(ngram_lm, "stored", lambda df, *rest: kept.append(stored(df, *rest)) or kept[-1])
    out = ngram_lm.scored(docs, F.col("doc_id") % 7 == 2)
    rounds = [df.count() for df in kept if "base_score" in df.columns]
    assert sorted(x.doc_id for x in out.select("doc_id").collect()) == list(range(60))
    assert sum(rounds) == 60 and max(rounds) < 50


def test_ngram_order_and_low_bits():
    from colinear.llm import elias_fano as ef
    from colinear.llm import ngram_lm as lm

    r = np.random.default_rng(8)
    for contexts, words, n in ((30, 20, 1000), (1, 1 << 40, 500), (400, 3, 5000), (1, 1, 1), (1, 1, 0)):
        for top in (1 << 63, 1 << 20, 1):  # far apart, and told apart by their last bits only
            context = (np.uint64(1 << 63) + r.integers(0, top, contexts).astype(np.uint64))[r.integers(0, contexts, n)]
            word = r.integers(0, words, n).astype(np.uint64)
            alike = context & np.uint64(3) | r.integers(0, 8, n).astype(np.uint64) << np.uint64(60)  # contexts of the same leading bits
            spread = r.integers(0, 1 << 48, n).astype(np.uint64)
            for c, w in ((context, word), (alike, word), (alike, spread), (context, spread), (alike, spread & ~np.uint64(0xFFFFFE))):
                order, want = lm._ordered(c, w), np.lexsort((w, c))
                assert sorted(order.tolist()) == list(range(n))
                assert (c[order] == c[want]).all() and (w[order] == w[want]).all()
    for low in (0, 1, 7, 31, 57):
        for n in (0, 1, 63, 64, 65, 200):
            v = r.integers(0, 1 << 62, n).astype(np.uint64)
            bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
            assert (ef._low_bits(v, low) == np.packbits(bits, bitorder="little")).all()
    for width in range(1, 9):
        v = r.integers(0, 1 << 8 * width - 1, 100).astype(np.uint64)
        assert (lm.unpacked(lm.packed(v)) == v).all() and (lm.unsqueezed(lm.squeezed(v)) == v).all()
    assert not len(lm.unpacked(lm.packed(np.zeros(0)))) and not len(lm.unsqueezed(lm.squeezed(np.zeros(0))))
