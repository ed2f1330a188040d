import time

import pytest
from pyspark.sql import functions as F

from foliant.functions import content, html, pages, pii, spans, text
from foliant.operators import books


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("value", "lines"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\r\nb\n", 2), ("a\rb", 1), ("\n", 1), (None, None)])
def test_line_count(spark, value, lines):
    assert one(spark, value, text.line_count) == lines


@pytest.mark.parametrize(("value", "words"), [("", 0), ("  ", 0), ("a b", 2), ("one two\nthree", 3)])
def test_word_count(spark, value, words):
    assert one(spark, value, text.word_count) == words


@pytest.mark.parametrize(("value", "guess"), [("", None), ("hi", None), ("short text", None), ("the cat and the dog went to bed", "en"), ("zzzz zzzz zzzz zzzz zzzz", None), ("der Hund und die Katze im Haus", "de"), ("the und the und zzzzzzzz", "en")])
def test_language(spark, value, guess):
    assert one(spark, value, text.language) == guess


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("beautiful", 3), ("the", 1), ("education", 4), ("a", 1), ("rhythms", 1), ("make", 1)])
def test_syllables(spark, word, n):
    assert one(spark, word, text.syllables) == n


def test_readability_without_letters(spark):
    r = one(spark, "123 !!", text.readability)
    assert (r.word_count, r.sentence_count, r.flesch_reading_ease, r.interpretation) == (0, 0, 0.0, text.NO_TEXT["en"])


@pytest.mark.parametrize(("value", "ending"), [("", "none"), ("a\n", "lf"), ("a\r\n", "crlf"), ("a\r", "cr"), ("a\r\nb\n", "mixed")])
def test_line_ending(spark, value, ending):
    assert one(spark, value, text.line_ending) == ending


def test_table_runs(spark):
    assert one(spark, "a|b|c\nd|e|f\ntext\nx\ty\tz\nalone", text.table_runs) == 1


def test_search_edges(spark):
    found = one(spark, "abcABC", lambda c: spans.search(c, query="abc", context=1))
    assert [tuple(m) for m in found] == [("abc", 0, 3, "abcA"), ("ABC", 3, 6, "cABC")]
    assert one(spark, "a.b", lambda c: spans.search(c, query="."))[0].start == 1
    assert one(spark, "", lambda c: spans.search(c, query="a")) == []


@pytest.mark.parametrize("how", [{}, {"query": "a", "pattern": "b"}, {"pattern": "("}, {"query": ""}, {"pattern": "x*"}, {"query": "a", "context": -1}, {"pattern": "(a+)+b"}])
def test_search_refuses(spark, how):
    with pytest.raises(ValueError):
        spans.search(F.lit("x"), **how)


@pytest.mark.parametrize("pattern", [
    r"\b", "(?=a)", "(?<=a)", "a|", "^", "(a|aa){1,60}c", "(a{1,2}){1,60}c", "(.*a){20}b", "a*a*a*a*a*b", "(a+)+b", "(?:a|a)*b", "((a|aa){1,4}){1,4}c", "(\\w+\\s?)+$", r"\p{L}*", r".*.*.*.*x", "(a|b|ab)*c",
])
def test_search_refuses_what_has_no_width_or_no_end(spark, pattern):
    with pytest.raises(ValueError):
        spans.check_pattern(pattern)


@pytest.mark.parametrize("pattern", [r"[\w.+-]+@[\w-]+\.[\w.]+", r"(\d{1,3}\.){3}\d{1,3}", "(foo|bar)+x", "a.*b.*c", r"\p{Lu}\p{L}+tion", r"(?<year>\d{4})-\d\d", r"(\w+ )+x", "(?:ab|cd)*e", r"\bword\b", r"(a|ab){2}c", r"\Qa.b\E+", "x{2,5}y"])
def test_search_takes_what_is_safe(spark, pattern):
    spans.check_pattern(pattern)


def test_search_under_a_deadline(spark):
    slow = "a" * 40
    df = spark.createDataFrame([(0, slow + "c"), (1, "xx aab b"), (2, None), (3, ""), (4, slow)], "id int, v string").repartition(2)
    got = {r.id: r.r for r in df.select("id", spans.search_within(F.col("v"), "(a|a)+b", seconds=0.5, context=1).alias("r")).collect()}
    assert [tuple(m) for m in got[1].spans] == [("aab", 3, 6, " aab ")] and got[1].problem is None
    assert got[2] is None and got[3].spans == []
    for n in (0, 4):
        assert got[n].spans is None and (got[n].problem.status, got[n].problem.title) == (400, "Bad Request")
    places = one(spark, "ab ab", lambda c: spans.search_within(c, r"\b"))
    assert [m.start for m in places.spans] == [0, 2, 3, 5]
    for how in ({"pattern": "("}, {"pattern": "a", "seconds": 0}, {"pattern": "a", "context": -1}):
        with pytest.raises(ValueError):
            spans.search_within(F.lit("x"), **how)


@pytest.mark.parametrize(
    ("value", "kinds"),
    [
        ("mail john.doe@example.com now", ["email"]),
        ("4111-1111-1111-1111", ["credit_card_visa"]),
        ("5500 0000 0000 0004", ["credit_card_mastercard"]),
        ("123-45-6789", ["ssn"]),
        ("12345678A", ["dni"]),
        ("15/03/1990", ["date_of_birth"]),
        ("call +34 612 345 678", []),
        ("x+34 612 345 678", ["phone"]),
        ("   ", []),
    ],
)
def test_pii(spark, value, kinds):
    assert [m.pii_type for m in one(spark, value, pii.pii)] == kinds


@pytest.mark.parametrize(
    ("value", "plain", "marked"),
    [
        ("<h1>Title</h1>", "Title", "# Title"),
        ("<p>a <strong>bold</strong> word</p>", "a bold word", "a **bold** word"),
        ("<hr/>", "", "---"),
        ("<style>x</style><script>var t='</p>';</script><p>real</p>", "real", "real"),
        ("<blockquote><p>quoted</p></blockquote>", "quoted", "> quoted"),
        ('<p title="a>b">x &amp; &lt;y</p>', "x & <y", "x & <y"),
        ("<ul><li><p>a</p></li><li>b</li></ul>", "a\n\nb", "- a\n\n- b"),
        ("one<br>two", "one\ntwo", "one\ntwo"),
    ],
)
def test_html(spark, value, plain, marked):
    assert one(spark, value, html.to_text) == plain
    assert one(spark, value, html.to_markdown) == marked


@pytest.mark.parametrize(("value", "title"), [("<title> a &amp; b </title>", "a & b"), ("<title></title>", None), ("none", None)])
def test_title(spark, value, title):
    assert one(spark, value, html.title) == title


@pytest.mark.parametrize(("spec", "last", "want"), [("1,3,5-8,12", 15, [0, 2, 4, 5, 6, 7, 11]), (" 1 , 3 ", 5, [0, 2]), ("2,2", 3, [1])])
def test_page_ranges(spark, spec, last, want):
    assert pages.parse_ranges(spec, last) == want
    assert spark.createDataFrame([(spec, last)], "s string, n int").select(pages.ranges(F.col("s"), F.col("n")).alias("r")).first().r == want


@pytest.mark.parametrize("spec", ["0", "11", "abc", "-1", "1-", "1.5", "1 3", "", ",", "3-2"])
def test_page_ranges_refuse(spark, spec):
    with pytest.raises(ValueError):
        pages.parse_ranges(spec, 10)
    assert spark.createDataFrame([(spec, 10)], "s string, n int").select(pages.ranges(F.col("s"), F.col("n")).alias("r")).first().r is None


def test_page_edits(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)], "p array<string>")
    p = F.col("p")
    r = df.select(pages.delete(p, F.array(F.lit(1))).alias("d"), pages.delete(p, F.array(*map(F.lit, range(3)))).alias("none"), pages.reorder(p, F.array(F.lit(3), F.lit(1), F.lit(2))).alias("o"), pages.reorder(p, F.array(F.lit(1), F.lit(1), F.lit(2))).alias("bad")).first()
    assert (r.d, r.none, r.o, r.bad) == (["a", "c"], None, ["c", "a", "b"], None)


@pytest.mark.parametrize(("n", "name"), [(1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_columns(spark, n, name):
    assert one(spark, n, pages.column_letters, "int") == name
    assert one(spark, name, pages.column_index) == n


@pytest.mark.parametrize(("raw", "want"), [(b"\xff\xfex\0", ("utf-16le", "certain", True)), (b"\xff\xfe\0\0x\0\0\0", ("utf-32le", "certain", True)), (b"abc", ("us-ascii", "certain", False)), ("é".encode(), ("utf-8", "high", False)), (b"\xff", ("unknown", "low", False))])
def test_encoding(spark, raw, want):
    assert tuple(one(spark, bytearray(raw), content.encoding, "binary")) == want


def test_normalise(spark):
    assert one(spark, "﻿a\r\nb\rc\n\x07", lambda c: content.normalise(c, "unix", strip_controls=True)) == "a\nb\nc\n"
    assert one(spark, "a\nb", lambda c: content.normalise(c, "mac")) == "a\rb"
    with pytest.raises(ValueError):
        content.normalise(F.lit(""), "dos")


def test_control_census(spark):
    found = one(spark, "ab\x07\nc\x1bd\x07", content.control_census)
    assert [(c.code, c.name, c.offset, c.line, c.col, c.occurrences) for c in found] == [(7, "BEL", 2, 1, 3, 2), (27, "ESC", 5, 2, 2, 1)]
    found = one(spark, "é漢\r\n\r😀\x07", content.control_census)  # bytes count, and a CR is in no column
    assert [(c.offset, c.line, c.col) for c in found] == [(12, 2, 5)]


def test_control_bytes_reads_whole_texts(spark, tmp_path):
    from foliant.plans import texts

    docs = [(1, "x" * 70 + "\x07y\n\x0c" + "z" * 30 + "\x0c"), (2, "short"), (3, "a" * 45 + "\x01")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, text in docs:
        t = text[:40] + "\x07\n\x1b\x07" + text[40:60] + "\x7f" + text[60:]
        for c in {c for c in t if (ord(c) < 32 and c not in "\t\n\r") or c == "\x7f"}:
            at = t.index(c)
            want.add((i, ord(c), at, t.count("\n", 0, at) + 1, at - t.rfind("\n", 0, at), t.count(c)))
    got = {(r.doc_id, r.code, r.offset, r.line, r.col, r.occurrences) for r in texts.control_bytes(spark, str(tmp_path)).collect()}
    assert got == want


# ---- HTML


@pytest.mark.parametrize(("page", "want"), [
    ("<h1>Title</h1>", "# Title"), ("<h3>Sub</h3>", "### Sub"), ("<p>a <strong>bold</strong> word</p>", "a **bold** word"), ("<p>an <em>italic</em> word</p>", "an *italic* word"),
    ("<p>some <code>code</code></p>", "some `code`"), ("<hr/>", "---"), ("<ul><li>one</li><li>two</li></ul>", "- one\n\n- two"), ("", ""),
    ("<ol><li>a<ul><li>in</li></ul></li><li>b</li><li>c</li></ol>", "1. a\n\n  - in\n\n2. b\n\n3. c"), ('<p>See <a href="https://example.org">the site</a>.</p>', "See [the site](https://example.org)."),
    ("<p>See <a href='#note1'>note</a>.</p>", "See note."), ('<p><img src=x.png alt="a]b"></p>', "![a\\]b](x.png)"),
    ("<p>t</p><table><tr><th>Name</th><th>Value</th></tr><tr><td>al|pha</td><td>1</td></tr></table>", "t\n\n| Name | Value |\n| --- | --- |\n| al\\|pha | 1 |"),
    ("<pre>line one\n    indented</pre>", "```\nline one\n    indented\n```"), ("<blockquote><p>quoted</p><blockquote>deeper</blockquote></blockquote>", "> quoted\n\n> > deeper"),
])
def test_html_to_markdown(page, want):
    assert html.convert(page, True) == want


@pytest.mark.parametrize("page", [
    "<a " + "x" * 10**6 + ">b</a>", "<img " + "x " * 500_000 + ">", "<a " + "x='" * 300_000 + ">", "<!-- " * 200_000, "<!--" * 250_000 + "-->", "<" * 10**6, "<p" * 500_000, "<script>" * 125_000, "<script " * 125_000,
    "<script>" + "</ script" * 110_000, "&#" + "9" * 10**6 + ";", "&#" + "0" * 10**6 + "65;", "&" * 10**6, "<ul><li>" * 125_000, "<blockquote>" * 80_000 + "x", "<table><tr><td>" * 60_000, "<b>" * 330_000, "<a href=x>y" * 90_000,
    "<p>" + " " * 10**6 + "x", "<pre>" * 200_000, "<h1>" * 250_000 + "x", "<p title=\"" * 90_000, "<li>" * 250_000 + "x",
])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.convert(page, True)
    assert time.process_time() - began < 4  # about a second; machines differ


@pytest.mark.parametrize(("page", "plain", "marked"), [
    ("<p>a</p><script>x <b>y</b> tail", "a\n\ntail", "a\n\ntail"), ("a<style>b<i", "a", "a"), ("<script>if (a<b && c) x='</p>'</script>ok", "ok", "ok"),  # text behind the last tag stays
    ("<ol><li>one<ul><li>in</li></ul><p>more</p></li><li>two</ol>", "one\n\n  in\n\nmore\n\ntwo", "1. one\n\n  - in\n\nmore\n\n2. two"),
    ("<ul><li><h3>t</h3>x", "t\n\nx", "### t\n\nx"), ("<h2><div>a</div><div>b</div></h2>c", "a\n\nb\n\nc", "## a\n\nb\n\nc"), ("<blockquote>a<ul><li>b</blockquote>c", "a\n\nb\n\nc", "> a\n\n> - b\n\nc"),
    ("<table><tr><th>a<th>b|c</tr><tr><td></td><td><p>x</p>y</td><td> </td></tr></table>", "a\tb\\|c\nx y", "| a | b\\|c |\n| --- | --- |\n| x y |  |"), ("<pre>a<b>b</b><br>c</pre><p>d", "ab\nc\n\nd", "```\nab\nc\n```\n\nd"),
    ('<img alt="a]b" src=x.png><img alt="only text"><a href="#n">n</a><a name=x href=\'u?a=1&amp;b\'>t</a>', "nt", "![a\\]b](x.png)only textn[t](u?a=1&b)"), ("a<hr/>b", "a\n\nb", "a\n\n---\n\nb"),
])
def test_html_blocks(page, plain, marked):
    assert (html.convert(page, False), html.convert(page, True)) == (plain, marked)


@pytest.mark.parametrize(("page", "want"), [
    ("<style>p{color:red}</style><script>alert('</p>')</script><p>real</p>", "real"), ("<p>Caf&eacute; &amp; cr&egrave;me &#8212; 5&nbsp;euros</p>", "Café & crème — 5 euros"),
    ("<p>compare &lt;p&gt; with &lt;div&gt;</p>", "compare <p> with <div>"), ('<p title="a > b">content</p>', "content"), ("<p>before</p><p>after", "before\n\nafter"),
    ("<p>x</p>1 < 2", "x\n\n1 < 2"), ("<p>Mobipocket <mbp:nobreak>keeps</mbp:nobreak> going</p>", "Mobipocket keeps going"), ("<p>a sentence\n    wrapped\n across</p>", "a sentence wrapped across"),
    ("<p>first<br/>second</p>", "first\nsecond"), ("<h1>Title</h1><p>and <strong>bold</strong></p>", "Title\n\nand bold"), ("<nav>n</nav><footer>f</footer>", "n\n\nf"),
    ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>", "a\tb\nc\td"), ("<xhtml:p>a</xhtml:p>b<!-- <p>no</p> -->", "a\n\nb"), ("<ul>" * 40 + "<li>x" + "</ul>" * 40, "x"),
])
def test_html_to_text(page, want):
    assert html.convert(page, False) == want


def test_attributes():
    assert html.attributes("a HREF='x&amp;y' title=\"q\" n=3 xlink:to=z") == {"href": "x&y", "title": "q", "n": "3", "to": "z"}


# ---- spans


def test_groups_and_back_references(spark):
    df = spark.createDataFrame([("xx aa yy ab",)], "text string")
    got = df.select(spans.search(F.col("text"), pattern=r"([a-z])\1").alias("m")).first().m
    assert [(m.match, m.start, m.end) for m in got] == [("xx", 0, 2), ("aa", 3, 5), ("yy", 6, 8)]


def test_very_many_matches_in_one_text(spark):
    text = "".join(f"no. {k}; " for k in range(100_000))
    df = spark.createDataFrame([(text,)], "text string")
    got = df.select(F.explode(spans.search(F.col("text"), pattern="[0-9]+;", context=5)).alias("m")).select("m.*").collect()
    assert len(got) == 100_000
    for m in (got[0], got[777], got[-1]):
        assert text[m.start : m.end] == m.match and m.context == text[max(m.start - 5, 0) : m.end + 5]


@pytest.mark.parametrize(("pattern", "fine"), [
    (r"([a-z]+,)+", True), (r"(?:ab|cd)+e", True), (r"(\w+\s)+x", True), (r"[A-Z][a-z]+tion[,.]", True), (r"(a|a)*b", False), (r"x((a+))+", False), (r"(a+)+b", False), (r"(a*)*b", False),
    (r"(\d+\s?)+x", False), (r"(a|ab)+c", True), (r"(a|a?b)+c", False), (r"(ab?|b)+c", False), ("(a", False), ("a*", False),
])
def test_patterns_that_may_never_end(spark, pattern, fine):
    if fine:
        spans.check_pattern(pattern)
    else:
        with pytest.raises(ValueError):
            spans.check_pattern(pattern)


# ---- transliteration, tokens, shares


def test_spelled():
    assert content.spelled("→ ő 中 😀 ’ é\u200b") == "-> o ? ?? ’ é" and content.spelled("plain") == "plain"


def test_token_count(spark, tmp_path):
    import base64

    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"abc": 257}
    (tmp_path / "ranks").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    df = spark.createDataFrame([("abc abd",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(text.token_count(F.col("text"), str(tmp_path / "ranks"), r"\S+|\s")).collect()] == [4, 0, None]


def test_purge_compares_instants(spark):
    shares = spark.createDataFrame([("a", "2024-01-01T12:00:00+02:00"), ("b", "2024-01-01T12:00:00Z"), ("c", None)], "token string, expires_at string")
    now = F.lit("2024-01-01 11:00:00").cast("timestamp")
    assert [r.token for r in books.purge(shares, now).orderBy("token").collect()] == ["b", "c"]


def test_batches(spark):
    df = spark.createDataFrame([("f.txt", bytearray(b"mail a@b.org"))], "file_name string, content binary")
    assert [tuple(r)[1:] for r in books.batch(df, "pii").collect()] == [("pii", "f.txt", "pending")]
    assert "a@b.org" in books.run_batch(df, "pii").first().result and '"word_count":2' in books.run_batch(df, "text").first().result
    for bad in (lambda: books.batch(df, "dance"), lambda: books.batch(df.where("false"), "pii"), lambda: books.run_batch(df, "qa")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize(("text", "want"), [
    ("a &amp b", "a &amp b"), ("x&amp", "x&amp"), ("&ampx;", "&ampx;"), ("&amp;amp;&amp", "&amp;&amp"), ("&apos;&#39;&#x27;&#0065;", "'''A"), ("&copy &copy;", "&copy ©"),
    ("&#150;", "\x96"), ("&#xD800;&#1114112;&#99999999999;", "&#xD800;&#1114112;&#99999999999;"), ("&nope;&&lt;", "&nope;&<"), ("&#" + "0" * 9000 + "65;", "A"),
])
def test_entities_end_with_a_semicolon(text, want):
    assert html.decoded(text) == want


def test_cut_entities_stay(spark):
    page = "<head><title>a &amp</title></head><p>b&amp</p>"
    assert one(spark, page, html.title) == "a &amp"
    assert (one(spark, page, html.to_text), one(spark, page, html.to_markdown)) == ("b&amp", "b&amp")
