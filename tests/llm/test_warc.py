"""WARC derivatives: written files parsed back, texts against the standard parser."""

import glob
import gzip
import hashlib
import time
from html.parser import HTMLParser

from softcluster.llm import warc

ODD = [
    (1, "http://a/\r\nX: y", None), (2, None, ""), (3, "u", "a &amp;amp; b &lt;p&gt; &#233;<b>x</b>y<br>z<!-- > <p>no</p> -->t"),
    (4, "u", "<script>if (a < b) x('</p>')</SCRIPT >s<style>p{}"), (5, "u", "<p title='a > b'>q</p>1 < 2<p"),
    (6, "u", "\r\n\r\nWARC/1.1\r\n" * 3), (7, "u", "<div>é  \n x</div>" * 40000), (7, "u", "<div>é</div>"), (7, "u", "<div>é</div>"),
    (None, "u", "<HTML LANG='pt-BR'><title>T\n&copy;</title><a href=x>l</a><![CDATA[<p>]]>"),
]


class Slow(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in warc.HIDDEN:
            self.hidden.append(tag)
        elif tag in warc.BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and tag == self.hidden[-1]:
            self.hidden.pop()
            self.out.append("\n" if tag == "head" else " ")
        elif tag in warc.BLOCKS and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def slow_text(page):
    parser = Slow()
    parser.feed(page)
    parser.close()
    lines = [" ".join(x.split()) for x in "".join(parser.out).split("\n")]
    return "\n".join(x for x in lines if x)


def test_texts_match_the_standard_parser(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for page in pages + [p for _, _, p in ODD[2:4] if p]:
        assert " ".join(warc.plain_text(page).split()) == " ".join(slow_text(page).split())
    assert warc.plain_text(ODD[4][2]) == "q\n1 < 2" and warc.plain_text(ODD[9][2]).endswith("l<p>")


def parse(data):
    """Records of a WARC file: (headers, block)."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = dict(x.split(": ", 1) for x in lines[1:])
        n = int(headers["Content-Length"])
        assert data[n:n + 4] == b"\r\n\r\n"
        out.append((headers, data[:n]))
        data = data[n + 4:]
    return out


def test_files_round_trip(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").unionAll(
        spark.createDataFrame(ODD, "page_id long, url string, html string")).repartition(3)
    records = warc.derive(pages.withColumn("text", warc.F.lit("clash")).withColumn("type", warc.F.lit(1)))
    warc.write_warc(records, str(tmp_path / "out"))
    read = [r for f in sorted(glob.glob(f"{tmp_path}/out/*.gz")) for r in parse(gzip.open(f).read())]
    rows = pages.collect()
    assert len(read) == 3 * len(rows) == records.count()
    by = {}
    for h, b in read:
        assert h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest()
        by.setdefault(h["WARC-Record-ID"], []).append((h, b))
    responses = [(h, b) for h, b in read if h["WARC-Type"] == "response"]
    want = sorted((r.html or "").encode() for r in rows)
    assert sorted(b.partition(b"\r\n\r\n")[2] for _, b in responses) == want
    for h, b in read:
        if h["WARC-Type"] == "response":
            payload = b.partition(b"\r\n\r\n")[2]
            assert h["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
            continue
        (source, whole), *_ = by[h["WARC-Refers-To"]]
        assert source["WARC-Type"] == "response" and source.get("WARC-Target-URI") == h.get("WARC-Target-URI")
        http, _, payload = whole.partition(b"\r\n\r\n")
        if h["WARC-Type"] == "conversion":
            assert b.decode() == warc.plain_text(payload.decode())
        else:
            lines = b.decode().split("\r\n")
            assert [x.removeprefix("source-http: ") for x in lines if x.startswith("source-http: ")] == http.decode().split("\r\n")
            assert f"source-payload-digest: {source['WARC-Payload-Digest']}" in lines


def test_given_headers_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "HTTP/1.1 404 Gone\nA: b\n\n", "2020-01-02T03:04:05Z")],
                               "page_id long, url string, html string, http_headers string, date string")
    rows = {r.type: r for r in warc.derive(df).collect()}
    assert rows["response"].block == "HTTP/1.1 404 Gone\r\nA: b\r\n\r\n<p>x"
    assert "WARC-Date: 2020-01-02T03:04:05Z\r\n" in rows["conversion"].headers and rows["conversion"].block == "x"
    assert warc.derive(df.where("false")).collect() == []


def test_omitted_end_tags():
    text = warc.plain_text
    assert text("<html><head><title>x</title><body><p>text <b>on</b>") == "text on"
    assert text("<html><head><title>x</title><meta a=b><p>one<p>two</html>") == "one\ntwo"
    assert text("<head><script>'</head><body>'</script><title>x</title>words") == "words"
    assert text("<head><title>x</title><body>a<textarea></head></textarea>b") == "a b"
    assert text("<head><div>no</div><title>x</title></head>yes") == "yes"
    for name in ("svg", "noscript", "template", "iframe"):
        assert text(f"<p>a<{name}>b<p>c") == "a b\nc"
        assert text(f"<head><title>x</title><{name}><body>c<p>d") == "c\nd"
    assert text("<p>a<script>b<p>c") == text("<p>a<style>b") == text("<p>a<textarea>b") == "a"
    assert text("<head>") == text("<head><title>x</title>") == ""
    assert len(text("x<svg><head>" * 100_000)) > 100_000


def test_hostile_pages_take_linear_time():
    odd = ["<a ", "<html ", "<title>", "<a '\"", "<head><title>", "<script>", "<!--", "<a ><", "<html lang=\"", "<svg><head>x", "</"]
    start = time.process_time()
    for piece in odd:
        page = piece * (5_000_000 // len(piece))
        warc.plain_text(page)
        warc.facts(page)
    assert time.process_time() - start < 120


def test_facts():
    page = ("<!-- <a href=x> <title>no</title> --><HTML class=q lang = 'PT-br'><TITLE a='>'>A &amp;\n b</title>"
            "<a title='href='>1</a><a data-href=u>2</a><A\nHREF='v>w'>3</A><abbr href=x><a href>4</a>")
    assert warc.facts(page) == ("A & b", "pt-br", 2)
    assert warc.facts("<title>open <a href=x>") == (None, None, 1)
    assert warc.facts("") == (None, None, 0)
