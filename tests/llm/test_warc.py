"""WARC derivatives: text of pages, links between records, digests, record syntax."""

import hashlib

from pyspark.sql import functions as F

from alertloom.llm import warc

SCHEMA = "page_id long, url string, html string"
PAGE = ("<!DOCTYPE html><HTML LANG='de-AT'><head><title>A &amp; B\n C</title><style>p{}</style><script>if(a<b)x('<p>');</script></head>"
        "<body><!-- <p>no</p> --><h1>Über&nbsp;uns</h1><p>1 &lt; 2 &#233;&#xe9;&#128512; &amp;lt; &#38;lt; &unknown;</p>"
        "<ul><li>one</li><li><a class=x href=\"/a?b=1&amp;c=2\">two</a></li></ul>x<br>y <b>z</b>&#0;&#xD800;</body>")


def derive(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_text", "d", "record_id", "block", "payload"):
        df = df.withColumn(name, F.lit("clash"))
    return warc.derivatives(warc.responses(df, "2026-01-01T00:00:00Z"))


def test_page_to_text_and_metadata(spark):
    rows = {r.record_type: r for r in derive(spark, [(1, "http://h/x", PAGE)]).collect()}
    text, meta = rows["conversion"], rows["metadata"]
    assert text.block == "Über uns\n1 < 2 éé😀 &lt; &lt; &unknown;\none\ntwo\nx\ny z��"
    assert meta.block.split("\r\n") == ["title: A & B C", "language: de-AT", "links: 1", f"characters: {len(text.block)}", "outlink: /a?b=1&c=2", ""]
    assert text.refers_to == meta.refers_to and text.concurrent_to == meta.record_id and meta.concurrent_to == text.record_id
    for r in rows.values():
        assert r.content_length == len(r.block.encode()) and r.target_uri == "http://h/x"
        assert r.block_digest == "sha256:" + hashlib.sha256(r.block.encode()).hexdigest()
        assert r.source_digest == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
        assert f"Content-Length: {len(PAGE.encode())}\r\n" in r.source_headers


def test_odd_pages(spark):
    rows = derive(spark, [(1, None, None), (None, "", ""), (2, "u", "a" * 200_000), (2, "u", "a" * 200_000), (3, "u", "<p>un<closed"), (4, "u", "<script>x")])
    found = rows.collect()
    assert len(found) == 12
    texts = {(r.page_id, r.block) for r in found if r.record_type == "conversion"}
    assert (1, "") in texts and (2, "a" * 200_000) in texts and (3, "un<closed") in texts
    assert len({r.record_id for r in found}) == 10  # a repeated response gives its derivatives again
    assert derive(spark, []).count() == 0


def test_records_parse_back(spark):
    df = derive(spark, [(1, "http://h/x", PAGE)])
    want = {r.record_type: r for r in df.collect()}
    for r in warc.record_text(df).collect():
        head, _, rest = r.record.partition("\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if not line.startswith("WARC-Source-Header"))
        own = want[r.record_type]
        assert fields["WARC-Refers-To"] == own.refers_to and fields["WARC-Record-ID"] == own.record_id
        assert rest.encode()[:int(fields["Content-Length"])].decode() == own.block and rest.endswith("\r\n\r\n")
        assert "WARC-Source-Header: Content-Type: text/html; charset=utf-8\r\n" in head + "\r\n"


def test_all_names_and_links_without_quotes(spark):
    import html

    names = [n for n in html.entities.html5 if n.endswith(";") and html.unescape(f"&{n}").strip()]
    odd = "&amp;semi; &amp&semi; &&num;233; &eacute&semi; &AMP;lt;"
    page = f"<title>&Auml;&frac12;</title><p>{'|'.join(f'&{n}' for n in names)}|{odd}</p><a href=/x?a=1&amp;b=&eacute; id=y>a</a><A HREF = z>b</A><a href='/q'>c</a>"
    rows = {r.record_type: r.block for r in derive(spark, [(1, "u", page)]).collect()}
    assert rows["conversion"].startswith("|".join(html.unescape(f"&{n}") for n in names) + "|" + html.unescape(odd))
    assert rows["metadata"].split("\r\n")[0] == "title: Ä½" and rows["metadata"].split("\r\n")[4:] == ["outlink: /x?a=1&b=é", "outlink: z", "outlink: /q", ""]


def test_references_without_semicolon_and_numbers_of_code_page_1252(spark):
    import html

    text = "a &lt b &eacute c &notit; &amplt; &copy2 &#150;x&#x96 &#8212&#65z &#0065; &#00000000000233; &#99999999999; &bogus x &euro; &euro"
    rows = {r.record_type: r.block for r in derive(spark, [(1, "u", f"<p>{text}</p>")]).collect()}
    assert rows["conversion"] == html.unescape(text)


def test_attributes_are_read_whole(spark):
    page = """<html xml:lang="x" lang="de"><body><a data-href="/no" href="/yes">1</a><a title="a > b href=/q" href='/r?a=1&amp;b=2&copy=3&lt;'>2</a>
        <a title='x' HREF = /s>3</a><a name=here>4</a><A
        href="">5</A><p title="1 > 0" class='>'>text</p><img alt="a>b">end<b a="unclosed>bold</b><abbr href=/no>x</abbr></body></html>"""
    rows = {r.record_type: r.block for r in derive(spark, [(1, "u", page)]).collect()}
    assert rows["conversion"] == "12 345\ntext\nendboldx"
    lines = rows["metadata"].split("\r\n")
    assert lines[1] == "language: de" and lines[2] == "links: 4"
    assert lines[4:] == ["outlink: /yes", "outlink: /r?a=1&b=2&copy=3<", "outlink: /s", "outlink: ", ""]


def test_a_page_of_many_references_and_attributes(spark):
    page = "<p " + "a='>' " * 20_000 + ">" + "&eacute; &amp; x " * 20_000 + "<a href=/x " * 2
    rows = {r.record_type: r.block for r in derive(spark, [(1, "u", page)]).collect()}
    assert rows["conversion"].startswith("é & x é & x") and rows["conversion"].count("é") == 20_000
