"""Pages, languages, binary codes and edits against plain Python."""

import random
import zlib

from pyspark.sql import functions as F

from tidewater.llm import editcount, hamming, html, langid

PAGE = (
    '<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
    '<div class="cookie-notice">We use cookies on this site and you have to agree before you may go on reading it.</div>'
    '<main><article class="post-%d"><header><h1>Title &lt;%d&gt;</h1></header><p>First  para&nbsp;with <a href=x>a link</a>\n and more text for the reader to enjoy.'
    '<p>Second <b>para<br>line two, which is long enough to be counted as prose here.<ul><li>one<li>two</ul><div class="ad">buy this</div>'
    '<form><p>email me</p></form><script>if (a<b) {"</p>"}</script></article><section class="comments"><p>I liked it a lot, and this is a long comment by a reader.</p></section>'
    '<aside>side</aside></main><footer>foot</footer></body></html>'
)


def test_pages(spark, sf_dir):
    rows = [(i, f"https://h.example.com/{i}", PAGE % (i, i)) for i in range(6)] + [(10, None, None), (11, "odd", ""), (12, "https://h.example.com/z", "<p>just <i>this")]
    rows += [(13, "https://h.example.com/q", "a < b && c"), (14, "x://", "<div class='unclosed><p>text</div>"), (15, "x://", "<!-- never closed <p>a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(pages).collect()}
    want = "Title <%d>\n\nFirst para with a link and more text for the reader to enjoy.\n\nSecond para line two, which is long enough to be counted as prose here.\n\none\n\ntwo"
    for i in range(6):
        assert got[i].text == want % i and got[i].n_chars == len(want % i)
    assert got[10].text == got[11].text == "" and got[12].text == "just this" and got[13].text == "a < b && c"
    real = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert all(r.text and "<" not in r.text.replace("<", "", 0)[:1] for r in real)
    assert html.extract(pages.limit(0)).count() == 0


def test_consensus_beats_a_page_of_its_own(spark):
    article = "<div class='story-1'><p>" + "The story is told here at some length, word by word. " * 5 + "</p></div>"
    short = "<div class='story-9'><p>Very short story.</p></div><div class='blurb'><p>" + "Buy our book about stories, it is long and dear. " * 6 + "</p></div>"
    rows = [(i, "https://s.example.com/a", f"<body>{article}</body>") for i in range(9)] + [(9, "https://s.example.com/b", f"<body>{short}</body>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "Very short story."


def test_language(spark, sf_dir, odd_docs, empty_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, keep=["doc_id", "lang"]).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(held) >= 0.95 * len(held)
    odd = langid.identify(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) for r in odd)
    assert langid.identify(empty_docs).count() == 0


def test_hamming(spark):
    rng = random.Random(3)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in vectors[i % 30]]) for i in range(300)]
    rows += [(1000 + i, vectors[0]) for i in range(200)] + [(2000, None), (None, vectors[1]), (2001, [1.0]), (2002, [None] * 64), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit("clash"))
    coded = [(i, sum(1 << b for b, x in enumerate(v[:64]) if x is not None and x > 0)) for i, v in rows if i is not None and v is not None]
    want = []
    for q, c in coded:
        if q % 50 == 0:
            near = sorted(((c ^ d).bit_count(), i) for i, d in coded)[:10]
            want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert sorted(map(tuple, hamming.search_table(df).collect())) == sorted(want)
    assert hamming.search_table(df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 5)")
    assert hamming.search_table(few).count() == 2


def test_edits_match_a_full_count():
    count = editcount.counter()
    rng = random.Random(5)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "é", "12", "!", "...", "word", "\u00a0", "日", "'", "ll"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 60, 900])))
        tree = editcount.TokenTree.build(text, count)
        for _ in range(6):
            s = rng.randint(-2, len(text) + 2)
            new = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 4, 300])))
            e = s + rng.choice([0, 0, 1, 3, 200])
            a = max(0, min(s, len(text)))
            want = text[:a] + new + text[max(a, min(e, len(text))) :]
            text = tree.edit(text, s, e, new, count)
            assert text == want
            pieces = count.pieces(text)
            assert [x for b in tree.lengths for x in b] == list(map(len, pieces))
            assert tree.total == len(count.encoding.encode_ordinary(text))


def test_edit_tables(spark, documents, odd_docs, empty_docs):
    count = editcount.counter()
    for docs in (documents, odd_docs):
        edited = editcount.sample_edits(docs)
        kept = editcount.apply_edits(editcount.build_trees(edited)).collect()
        rows = editcount.count_edits(edited, keep=["doc_id"]).collect()
        assert len(rows) == docs.count()
        assert sorted(r.n_tokens_after for r in rows) == sorted(len(count.encoding.encode_ordinary(r.text or "")) for r in kept)
        assert sorted(r.n_tokens for r in rows) == sorted(len(count.encoding.encode_ordinary(r.text or "")) for r in docs.collect())
        assert sum(r.n_encoded for r in rows) < 60 * len(rows)
    assert editcount.count_edits(editcount.sample_edits(empty_docs)).count() == 0
