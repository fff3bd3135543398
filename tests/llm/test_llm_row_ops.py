"""Operators on single rows: nulls, empties, long texts, repeats, empty tables and clashing columns; brute force and goldens."""

import hashlib
import re
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexforge.llm import chat, htmltext, langid, quality, queries, tokens, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, token string, cls int"
WORD = r"[^\x20\x09-\x0D]+"


def odd_docs(spark):
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    rows = [(1, None, None, None, None, "x", "y", 1), (2, "", "en", "a", 0, None, None, None), (3, "a b c", "en", "a", 5, "", "", 0), (3, "a b c", "en", "a", 5, "", "", 0), (None, "null id here", None, "b", 1, "", "", 0), (4, long, "en", "b", len(long), "", "", 0), (5, " \t\n", "de", None, 3, "", "", 0)]
    return spark.createDataFrame(rows, SCHEMA)


# -- quality ------------------------------------------------------------------------------------------------


def brute_quality(text):
    w = re.findall(WORD, text or "")
    seen, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(docs).collect())
    want = Counter()
    for r in docs.collect():
        b = brute_quality(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want


def test_compression_bands(spark):
    import random

    rnd = random.Random(3)
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") + (" " if i % 7 == 6 else "") for i in range(6000))
    loop = "one two three four five six seven eight nine ten eleven " * 80
    got = {r.doc_id: (r.reason, r.kept) for r in quality.quality_rules(spark.createDataFrame([(1, noise), (2, loop)], "doc_id long, text string")).collect()}
    assert got == {1: ("incompressible", False), 2: ("repetitive", False)}
    good = spark.read.parquet(f"{SF}/documents.parquet").join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id")
    out = quality.quality_rules(good).where("not base_failed")
    assert out.where("kept").count() >= 0.98 * out.count()


def test_last_chunk_is_judged():
    import random

    import zstandard

    rnd = random.Random(5)
    compress = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    prose = " ".join(rnd.choice(vocabulary) for _ in range(2000)).encode()
    noise = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(2000)).encode()
    loop = b"one two three four five six seven eight nine ten " * 40
    short = lambda raw: quality.compression_verdict(raw, compress)[1:3]
    assert short(prose[:2048]) == (1, 0) and short(prose[:4096]) == (2, 0) and short(prose[:2048] + b"x" * 99) == (1, 0)
    assert short(prose[:2048] + loop[:1900]) == (2, 1) and short(prose[:2048] + b"a" * 150) == (2, 1)
    assert short(loop[:700]) == (1, 1) and short(prose[:700]) == (1, 0) and short(b"") == (0, 0)
    # two full chunks, one of them odd, stay at half of the bytes; an odd last chunk tips the scale
    half = prose[:2048] + (loop + loop)[:2048]
    wide = tuple((b[0], b[1], b[2]) if b[0] < 4_000 else (b[0], 0.0, 9.0) for b in quality.BANDS)
    assert quality.compression_verdict(half, compress, wide)[3] is None
    assert quality.compression_verdict(half + loop[:1900], compress, wide)[1:] == (3, 2, "repetitive")
    assert quality.compression_verdict(half + noise[:1900], compress, wide)[3] is None


# -- tokens -------------------------------------------------------------------------------------------------


def test_token_counts_equal_whole_encoding(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    extra = spark.createDataFrame([(90, "a <|endoftext|> b<|startoftext|>"), (91, "ΑΣ Σ e\u0301 " * 60_000), (92, "x" * 300_000)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra).unionByName(odd_docs(spark).select("doc_id", "text"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, "word_bpe_49k.json").collect())
    want = Counter()
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        want[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    assert got == want


def test_empty_tables(spark):
    none = odd_docs(spark).limit(0)
    assert tokens.token_counts(none, "word_bpe_49k.json").count() == quality.quality_rules(none).count() == 0
    assert htmltext.main_text(none.selectExpr("doc_id page_id", "source url", "text html")).count() == 0


def test_other_vocabulary(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    assert [r.n_tokens > 0 for r in tokens.token_counts(docs, "piece_bpe_32k.model").orderBy("doc_id").collect()] == [True, False]


def test_pieces_lose_nothing():
    text = "ab  cd\n" * 1000
    parts = tokens.pieces(text, 50)
    assert max(map(len, parts)) < 70 and " ".join(parts).split() == text.split()


# -- language ID ----------------------------------------------------------------------------------------------


def brute_bits(model, data, lang, order):
    tree = model["trees"][lang]
    symbols = [{} for _ in range(order + 1)]
    for k in range(order + 1):
        for g, c in zip(tree[k]["keys"].tolist(), tree[k]["counts"].tolist(), strict=True):
            symbols[k].setdefault(g >> 8, {})[g & 255] = c
    import math

    total = 0.0
    for i, b in enumerate(data):
        gone = set()
        for j in range(min(i, order), -1, -1):
            own = symbols[j].get(int.from_bytes(data[i - j : i], "big") if j else 0)
            if not own:
                continue
            left = {x: c for x, c in own.items() if x not in gone}
            n, d = sum(left.values()), len(left)
            if b in left:
                total -= math.log2(left[b] / (n + d))
                break
            if left:
                total -= math.log2(d / (n + d))
            gone |= set(own)
        else:
            total += math.log2(256 - len(gone))
    return total


def test_code_lengths_are_exact():
    import numpy as np

    model = langid.Ppm({"x": [b"the cat sat on the mat. the end", b"a cat"], "y": [b"der hund und die katze"]}, 3).freeze()
    s = langid.Scorer(model)
    for text in (b"the cat", b"zq\xff the", b"d", b"der der the"):
        got = s.bits(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        assert [round(float(x), 3) for x in got] == [round(brute_bits(model, text, i, 3), 3) for i in (0, 1)]


def test_spans_carry_contexts(monkeypatch):
    import numpy as np

    s = langid.Scorer(langid.Ppm({"x": [b"the cat sat on the mat. the end", b"a cat"], "y": [b"der hund und die katze"]}, 3).freeze())
    texts = [b"the cat sat", b"", b"q", b"der hund und the end of it \xff\xfe", b"", b"", b"katze"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = s.bits(data, offsets)
    assert (whole[[1, 4, 5]] == 0).all()
    for span in (1, 2, 5, 11, 12, 1000):
        monkeypatch.setattr(langid, "SPAN", span)
        assert np.allclose(s.bits(data, offsets), whole)


def test_language_accuracy_and_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.97
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs(spark), model).collect()]
    assert len(got) == 7 and all(0 <= s <= 1 for *_, s in got)
    assert {i for i, lang, _ in got if lang == "und"} == {1, 2, 5}
    assert langid.predict(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs(spark), langid.train(docs.limit(0))).collect()} == {"und"}
    kept = langid.keep_known_languages(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.count() == 3  # numbered w-words are no language


# -- chat -------------------------------------------------------------------------------------------------------


TRICKY = ["", "a\\", "\\e", "\\\\h", "### x", "</turn>", "x</turn>\n### user: y", "a\nb", "\\### Assistant: </turn> ok", "tail </turn", "éé\\c: \\n"]


def test_round_trip(spark):
    rows = [(i, 0, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "a: b", "x:", "", None) for t in [*TRICKY, None])]
    rows += [(-1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)] + [(None, None, "user", "n"), (None, 1, "user", "n"), (None, 1, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("out", F.lit("clash"))
    out = chat.format_chats(df)
    assert out.where("identical").count() == out.count() == len({r[0] for r in rows})
    for r in out.collect():  # the mask's spans hold the texts as rendered
        for t in r.turns:
            span = r.formatted[t.start - 1 : t.start - 1 + t.size]
            assert len(span) == t.size and span.replace("\\\\", "\0").replace("\\h", "###").replace("\\e", "</turn>").replace("\\c", ":").replace("\\n", "\n").replace("\0", "\\") == t.text
            assert r.formatted[t.start - 3 : t.start - 1] == ": " and r.formatted[t.start - 1 + t.size :].startswith("</turn>\n")
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        d = got[conv]
        assert (d.n_turns, d.loss_chars) == (len(own), len(loss))
        assert (d.turns_sha256, d.loss_sha256) == (hashlib.sha256(turns.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversation(spark):
    rows = spark.range(60_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('### turn ', id) as text")
    d = chat.digests(chat.format_chats(rows)).first()
    loss = "".join(f"### turn {i}" for i in range(1, 60_000, 2))
    assert (d.n_turns, d.loss_chars, d.loss_sha256) == (60_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


# -- urls -----------------------------------------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest)[0]
    low = "".join(c.lower() if c.isascii() else c for c in host)
    return low, re.split(r"[?#]", rest[len(host) :])[0]


def test_url_parts_and_rules(spark):
    found = ["http://A.example.net/en/x?q#f", "https://example.net/en", "ftp://x.NET", "x.net/", None, "", "://", "http://notexample.net/en/", "http://example.net.org/fr/a", "http://u:p@Example.COM:80/de/../x#a://b", "http://a.com?b=http://c.net/", "http://example.com/de/"]
    df = spark.createDataFrame([(i, u, "", "z") for i, u in enumerate(found)], "page_id long, url string, html string, verdict string")
    rules = list(queries.RULES)

    def best(host, path):
        fits = [(len(r), r, v) for r, v in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        return max(fits)[1:] if fits else (None, None)

    want = {}
    for i, u in enumerate(found):
        host, path = brute_url(u)
        r, v = best(host, path)
        want[i] = (host, path, r, v or "allow")
    as_table = spark.createDataFrame(rules, "rule string, verdict string")
    for given in (rules, as_table):
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(df, given).collect()} == want


def test_every_link_of_a_page_counts(spark, tmp_path):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    pages = [
        (1, "http://a.com/1", link.format("http://a.com/none") + "<p>x</p>" + link.format("http://bad.net/x")),
        (2, "http://b.com/2", refresh.format("http://b.com/none") + refresh.format("http://c.net/y")),
        (3, "http://d.com/3", link.format("http://bad.net/x") + refresh.format("http://b.com/none") + link.format("http://example.net/en/ok")),
        (4, "http://e.com/4", link.format("http://e.com/none") * 3),
        (5, "http://bad.net/x", None),
        (6, "http://c.net/y", ""),
        (7, "http://example.net/en/ok", "canonical refresh"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert Counter(tuple(r) for r in urls.page_links(df).distinct().collect()) == Counter(
        [("http://a.com/1", "http://a.com/none"), ("http://a.com/1", "http://bad.net/x"), ("http://b.com/2", "http://b.com/none"), ("http://b.com/2", "http://c.net/y")]
        + [("http://d.com/3", "http://bad.net/x"), ("http://d.com/3", "http://b.com/none"), ("http://d.com/3", "http://example.net/en/ok"), ("http://e.com/4", "http://e.com/none")]
    )
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op1_url_filters"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op1_url_filters"]).df()
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want) and set(got.verdict[got.page_id <= 3]) == {"allow"}


def test_link_forms_and_ties(spark, tmp_path):
    pages = [
        (1, "http://a.com/x/1", '<link rel="alternate Canonical" href="http://bad.net/a">'),
        (2, "http://a.com/x/2", '<!-- <link rel="canonical" href="http://bad.net/a"> --><link rel="not-canonical" href="http://bad.net/a">'),
        (3, "HTTP://A.com/x/3", '<link rel=canonical href=http://bad.net/a><!-- open <link rel=canonical href=http://example.net/en/x>'),
        (4, "http://\u00c4.com/x/4", "<link rel='canonical' href='http://bad.net/a'>"),
        (5, "http://bad.net/a", None),
        (6, "http://b.net/en/x", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.QUERIES["op1_url_filters"](spark, str(tmp_path)).toPandas()
    assert set(got.page_id[got.verdict == "block"]) == {1, 3, 4, 5, 6}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op1_url_filters"]).df()
    rows = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    base = spark.createDataFrame([("http://a.com/p/q", '<base href="/r/"><link rel=canonical href=s>'), ("http://a.com/p/q", '<link rel=canonical href=s>')], "url string, html string")
    assert [r.v for r in urls.page_links(base).collect()] == ["http://a.com/r/s", "http://a.com/p/s"]
    for ties in ([("net/en/", "block"), ("b.net/e", "allow")], [("b.net/e", "block"), ("net/en/", "block")]):
        best = max(ties, key=lambda r: (r[1] == "allow", r[0]))
        for given in (ties, ties[::-1], spark.createDataFrame(ties, "rule string, verdict string")):
            r = urls.url_verdicts(df.where("page_id = 6"), given).first()
            assert (r.rule, r.verdict) == best


def test_redirect_components(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.com/1", link.format("http://bad.net/x")),
        (2, "http://b.com/", '<meta http-equiv="refresh" content="0; url=http://a.com/1#z">'),
        (3, "http://c.com/d/e?x=1", '<LINK rel=canonical href="/f">'),
        (4, "http://c.com/f", link.format("http://example.net/en/ok")),
        (5, "http://d.com/", link.format("http://c.com/f")),
        (6, "http://d.com/", link.format("http://bad.net/y")),
        (7, "http://alone.com/", None),
        (8, None, link.format("http://bad.net/x")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.via) for r in urls.url_verdicts(df, queries.RULES).collect()}
    # 1 and 2 lead to a blocked site; 3 to 6 reach a blocked and an allowed one, and the explicit allow wins
    assert got == {1: ("block", "alias"), 2: ("block", "alias"), 3: ("allow", "alias"), 4: ("allow", "alias"), 5: ("allow", "alias"), 6: ("allow", "alias"), 7: ("allow", "default"), 8: ("allow", "default")}
    more = spark.createDataFrame([("http://alone.com/#x", "http://www.bad.net/")], "u string, v string")
    assert urls.url_verdicts(df, queries.RULES, more).where("page_id = 7").first().verdict == "block"
    assert urls.url_verdicts(df.limit(0), queries.RULES).count() == 0


# -- html -------------------------------------------------------------------------------------------------------------


PAGE = """<html><head><title>T</title><script>x="</p>"</script></head><body><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies to improve this and that.</p></div><div class="layout"><div class="sidebar"><p>About us, some text.</p></div>
<div class="content"><h1>Title &amp; more</h1><p>First  para with <a href=x>a link</a> and <b>bold</b>.<p>Second &lt;tag&gt; &eacute; {}<ul><li>one<li>two</ul>
<form><p>Sign up</p></form><div class="comments"><div class="comment"><p>Nice!</p></div></div></div></div><footer>&copy;</footer></body></html>"""


@pytest.mark.parametrize("fill", ["", "word " * 50_000])
def test_main_text(fill):
    want = "Title & more\nFirst para with a link and bold.\nSecond <tag> é " + " ".join(fill.split())
    assert htmltext.extract(PAGE.format(fill)) == want.strip() + "\none\ntwo"


@pytest.mark.parametrize(
    "body,want",
    [
        ('<div class="layout-with-sidebar"><article class="post"><header><h1>H</h1></header><p>Body text of it.</p><footer>f</footer></article><aside>s</aside></div>', "H\nBody text of it."),
        ('<div id="header"><h1>Site name</h1></div><div id="content"><h2>H</h2><p>Body text of it, long enough.</p></div><div class="footer">x</div>', "H\nBody text of it, long enough."),
        ('<main><h1>H</h1><p>Body text.</p><section class="comments"><article class="comment"><p>First! A long comment, longer than the body.</p></article></section></main>', "H\nBody text."),
        ('<article><h1>H</h1><div class="ad-slot">Buy now</div><p>One<br>two</p><ul class="share-buttons"><li>Tweet</ul><p>Three</article><article class="related"><p>Other</p></article>', "H\nOne two\nThree"),
        ("<div><ul><li><a href=1>Menu entry one</a><li><a href=2>Menu entry two</a></ul><div><p>Only text that counts, of some length.</p><p>More of it here.</p></div></div>", "Only text that counts, of some length.\nMore of it here."),
        ('<div class="notice">Notice!</div><form><p>Sign up</p></form>', ""),
    ],
)
def test_main_text_layouts(body, want):
    assert htmltext.extract(f"<html><head><title>T</title></head><body>{body}</body></html>") == want


@pytest.mark.parametrize(
    "body,want",
    [
        # nothing is named: densities choose the third card, whose sum is largest, not the first
        ("<article><p>Short teaser.</p></article><article><p>Other teaser.</p></article><article><h1>H</h1><p>A long paragraph of real text that goes on.</p><p>And another one of them.</p></article>", "H\nA long paragraph of real text that goes on.\nAnd another one of them."),
        # unnamed menu and link list beside the path fall below its threshold; a heading without links doesn't go
        ('<div><a href=1>Home</a> <a href=2>News</a></div><h1>Title</h1><div><p>Text of the page that is long enough to count.</p><p>More text <a href=3>with a link</a> in it.</p></div><div><p><a href=4>Read this too</a></p><p><a href=5>And this</a></p></div>', "Title\nText of the page that is long enough to count.\nMore text with a link in it."),
        # nothing inside an article goes but what the contract names
        ('<article><p>Let <math><mi>x</mi></math> be real.</p><div class="legal">A clause.</div><p><a href=1>A paragraph that is all link</a></p><object>o</object><p aria-hidden="true">seen</p></article>', "Let x be real.\nA clause.\nA paragraph that is all link\no\nseen"),
        ("<article><p>a < b and b > c, 1<2, x &lt;y&gt; &am<b>p;</b></p><![CDATA[raw &amp; data]]></article>", "a < b and b > c, 1<2, x <y> &amp;\nraw &amp; data"),
        ('<article><p title="a>b">one</p><p title="open>two</p></article>', "one\ntwo"),
    ],
)
def test_main_text_by_density(body, want):
    assert htmltext.extract(f"<html><body>{body}</body></html>") == want


@pytest.mark.parametrize("inside", ['<h2 id="related-work">T</h2>', '<div class="follow-up">T</div>', '<div class="share-price">T</div>', '<p class="social-history">T</p>', '<div class="feedback-loop">T</div>', '<section id="search-results">T</section>', "<p hidden>T</p>", '<div style="display:none">T</div>', '<h3 class="comments">T</h3>'])
def test_names_of_content_stay(inside):
    assert htmltext.extract(f"<html><body><main><p>First paragraph.</p>{inside}<p>Last one.</p></main></body></html>") == "First paragraph.\nT\nLast one."
    assert htmltext.extract(f"<html><body><main>{inside}{inside}{inside}</main></body></html>") == "T\nT\nT"


@pytest.mark.parametrize("name", ["ad", "ad-slot", "site-sidebar", "cookie-notice", "shareButtons", "comment-list", "post-comments", "related", "newsletter_signup"])
def test_names_of_furniture_go(name):
    assert htmltext.extract(f'<html><body><article><p>First paragraph.</p><div class="x {name}">A dense advert or notice.</div></article></body></html>') == "First paragraph."


def test_densities_choose_the_subtree():
    """Without a marked article the text is that of the dense subtree; the same page with the densities swapped gives the other one."""
    long, links = "<p>" + "Some words of real text. " * 8 + "</p>", '<p><a href="1">Link</a> <a href="2">to more</a> <a href="3">pages</a></p>' * 6
    for first, second in ((long * 3, links), (links, long * 3)):
        got = htmltext.extract(f"<html><body><div>{first}</div><div>{second}</div></body></html>")
        assert got == "\n".join([("Some words of real text. " * 8).strip()] * 3)
    # a paragraph of much markup has the largest sum by itself, but the threshold widens it to all around it that is denser than the page
    page = "<html><body><ul>" + "<li><a href=1>Home page</a></li>" * 9 + "</ul><div><p>" + "<b>bold words here</b> " * 12 + "</p><p>Plain words of the same text, quite a few of them.</p></div></body></html>"
    assert htmltext.extract(page).endswith("Plain words of the same text, quite a few of them.")


def test_densities_brute_force():
    import math
    import random

    rnd = random.Random(8)

    def make(depth):
        out = []
        for _ in range(rnd.randint(0, 4)):
            kind = rnd.choice(["text", "p", "div", "a", "b", "br"])
            if kind == "text" or depth == 0 and kind != "br":
                out.append(rnd.choice(["word ", "some  more words ", "x"]) * rnd.randint(1, 9))
            elif kind == "br":
                out.append("<br>")
            else:
                inner = make(depth - 1) if kind in ("div", "b") else rnd.choice(["link text", "a &amp; b", "plain <i>text</i> of it"])
                out.append(f"<{kind}>{inner}</{kind}>")
        return "".join(out)

    def count(node, in_link=False):
        """chars, tags, link chars, link tags by plain recursion; a link counts itself as a link tag."""
        c = t = lc = lt = 0
        link = in_link or node.tag == "a"
        for k in node.kids:
            if isinstance(k, str):
                n = len(" ".join(k.split()))
                c, lc = c + n, lc + n * link
            else:
                x = count(k, link)
                c, t, lc, lt = c + x[0], t + x[1] + 1, lc + x[2], lt + x[3] + (link and k.tag != "a")
        return c, t, lc, lt + (node.tag == "a")

    def density(node, body):
        c, t, lc, lt = count(node)
        if not c:
            return 0.0
        t, lc1, lt = max(1, t), max(1, lc), max(1, lt)
        base = math.log(c / max(1, c - lc) * lc1 + count(body)[2] / max(1, count(body)[0]) * c + math.e)
        return c / t * math.log(max(1.0, c / lc1 * t / lt) + 1e-9) / math.log(base)

    seen = 0
    for _ in range(150):
        body = htmltext.parse(f"<body>{make(4)}</body>").kids[0]
        nodes = htmltext.weigh(body)
        sums = []
        for node in nodes:
            kids = [k for k in node.kids if not isinstance(k, str)]
            assert math.isclose(node.density, density(node, body), rel_tol=1e-9, abs_tol=1e-9)
            sums.append(sum(density(k, body) for k in kids) if kids else density(node, body) * (node.tag in htmltext.BLOCKS))
            assert math.isclose(node.total, sums[-1], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(body.best.total, max(sums), rel_tol=1e-9, abs_tol=1e-9)
        seen += body.best is not body
    assert seen > 40


@pytest.mark.parametrize("page", ["<" * 1_000_000, "<a " * 60_000, "<span>" * 20_000 + "</b>" * 20_000, '<a "b>' * 60_001, "<div>" + "<span>" * 20_000 + "<p>x" * 20_000, "<b><div>" + "<span>" * 20_000 + "</b>" * 20_000, "<table><tr><td>" * 20_000, "<script>" * 100_000, "<!--" * 100_000])
def test_parsing_is_linear(page):
    import time

    began = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - began < 5


def test_main_text_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain words"), (3, "u", "plain words"), (None, None, "<p>a<p>b"), (5, "u", "<div><<<>></div><p"), (6, "u", "<p>x</p>" * 20_000), (7, "u", "<div>" * 5_000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))
    out = htmltext.main_text(df).collect()
    got = Counter((r.page_id, r.text) for r in out if r.page_id not in (5, 6))
    assert got == Counter({(1, ""): 1, (2, ""): 1, (3, "plain words"): 2, (None, "a\nb"): 1, (7, "deep"): 1})
    assert all(r.n_chars == len(r.text) for r in out) and len(out) == len(rows)
    assert next(r.text for r in out if r.page_id == 6).count("x") == 20_000


def test_main_text_of_table():
    import html

    p = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    for r in p:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1).replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", z))).strip() for z in re.split(r"</?(?:p|h1|td|tr|table|li|ul|div|h2)\b[^>]*>", body))
        assert htmltext.extract(r["html"]) == "\n".join(x for x in parts if x)
