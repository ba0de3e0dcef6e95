import hashlib
import html.parser
import re

from dealsight.llm import warc

SCHEMA = "page_id long, url string, html string, record_id string, block string"
PAGE = ('<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style></head><body><!-- <p>no</p> --><h1>Tïtle</h1>'
        '<p>one <b>two</b>&nbsp;three<br>four &lt;5</p><script>var t="</p>";</script><a href="/x?a=1&amp;b=2">link</a></body></html>')


class Visible(html.parser.HTMLParser):
    """The same text by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head", "noscript", "template")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head", "noscript", "template")
        self.out.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def standard(page):
    p = Visible()
    p.feed(page)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def records(spark, rows):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return warc.derive(warc.responses(pages)).collect()


def test_plain_text_equals_the_standard_parser():
    assert warc.plain_text(PAGE) == standard(PAGE) == "Tïtle\none two three\nfour <5\nlink"
    assert warc.plain_text("a <!-- open") == "a" and warc.plain_text("x<script>y") == "x" and warc.plain_text("1 < 2 <p") == "1 < 2"
    assert warc.plain_text("<" * 50_000 + "<!--" * 50_000).startswith("<")


def test_links_digests_and_headers(spark):
    rows = records(spark, [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", "")])
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.refers_to, {})[r.record_type] = r
    assert len(by) == 3
    for pair in by.values():
        m, c = pair["metadata"], pair["conversion"]
        assert m.concurrent_to == c.record_id and c.concurrent_to == m.record_id and m.source_digest == c.source_digest
        for r in (m, c):
            head = dict(x.split(": ", 1) for x in r.headers.split("\r\n")[1:] if x)
            block = r.block.encode()
            assert head["WARC-Refers-To"] == r.refers_to and int(head["Content-Length"]) == len(block)
            assert head["WARC-Block-Digest"] == r.block_digest == "sha256:" + hashlib.sha256(block).hexdigest()
            assert ("WARC-Target-URI" in head) == (r.target_uri is not None)
        assert "source-header: Content-Type: text/html" in m.block
    page = next(p for p in by.values() if p["metadata"].target_uri == "http://a.example/x")
    assert page["metadata"].source_digest == "sha256:" + hashlib.sha256(PAGE.encode()).hexdigest()
    assert "title: A & B\r\n" in page["metadata"].block and "outlink: /x?a=1&b=2\r\n" in page["metadata"].block


def test_written_file_reads_back(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE, "", ""), (2, "http://b.example/", "<p>é</p>", "", "")], SCHEMA)
    got = warc.derive(warc.responses(pages))
    warc.write(got.coalesce(1), str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    blocks = []
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        blocks.append(raw[:n].decode())
        assert raw[n:n + 4] == b"\r\n\r\n"
        raw = raw[n + 4:]
    assert sorted(blocks) == sorted(r.block for r in got.collect())


def test_open_tags_are_read_once():
    old = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
    for page in (PAGE, "<a href=x <a href='y>z' k><A HREF = \"q>\">t</a><abbr href=no><a id=1><a class=c href=u/v>", "<a <a href=1>", "<a href=>", "<a href='open"):
        assert warc.links_of(page) == [a or b or c for a, b, c in old.findall(page)], page
    long = "<a " * 200_000
    assert warc.links_of(long) == [] and warc.links_of(long + "href=z>") == ["z"] and warc.title_of("<title " * 200_000) == ""
    assert warc.title_of("x<TITLE a=1>b</b</title>c") == "b</b" and warc.title_of("<title>open") == "open" and warc.title_of("<titles>no") == ""


def test_pages_that_share_an_id_have_records_of_their_own(spark):
    rows = records(spark, [(1, "http://a.example/x", "one"), (1, "http://a.example/x", "two"), (None, None, "three"), (None, None, "four")])
    assert len({r.record_id for r in rows}) == 8


def test_empty_table(spark):
    assert records(spark, []) == []
