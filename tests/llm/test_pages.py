import hashlib
import io
import zipfile

import pytest

from graphloom.llm.html_region import best_region, extract, main_text
from graphloom.llm.warc_zip import (
    archive_round_trip,
    locate_records,
    parse_record,
    read_members,
    read_records,
    warc_record,
    with_revisits,
    write_archives,
    write_zip,
)

HEAD = "<!DOCTYPE html><html><head><title>T of page</title><style>p{}</style><script>var t='</p>';</script></head><body>"
NAV = '<header>Site name<nav><ul><li><a href="/x">Home page</a></li><li><a href="/y">All news</a></li></ul></nav></header>'
FOOT = "<footer>&copy; Someone, all rights</footer></body></html>"
ARTICLE = (
    "<article><h1>Title &amp; more</h1><p>First <b>bold</b> paragraph\n of   text.<br>Next line.</p>"
    '<div class="ad-box"><p>Buy this thing now</p></div><p>Second paragraph&nbsp;with caf&#233;.</p><p>End.'
    '<form><input name=a>Mail us</form><aside>Related things here</aside></article>'
)
WANT = "Title & more\nFirst bold paragraph of text. Next line.\nSecond paragraph with café.\nEnd."
COMMENTS = '<section id="comments"><h2>Comments</h2><p>I do like this text, thank you very much indeed.</p></section>'


class Bytes:
    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


def test_best_region_against_all():
    import random

    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randrange(0, 12))]
        a, b = best_region(s)
        top = max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])
        assert sum(s[a:b]) == top


def test_main_text(spark):
    pages = [HEAD + NAV + ARTICLE + COMMENTS + FOOT] * 3
    plain = HEAD + NAV + '<div class="cookie-notice">We use cookies</div><div id="content">' + ARTICLE[9:-10] + "</div>" + COMMENTS + FOOT
    rows = [(i, f"u{i}", h, 1) for i, h in enumerate(pages)] + [
        (3, None, None, 1),
        (4, "u", "", 1),
        (5, "u", "<p>1 < 2 & 3</p>", 1),
        (6, "u", HEAD + NAV + FOOT, 1),
        (7, "u", plain, 1),
        (8, "u", HEAD + NAV + ARTICLE.replace("</article>", ""), 1),
        (None, "u", pages[0], 1),
        (9, "u", "<article>" + "<p>long text</p>" * 30_000 + "</article>", 1),
        (10, "u", "<!-- open <p>never", 1),
    ]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 7, 8, None):
        assert got[i].text == WANT, i
    assert [got[i].text for i in (3, 4, 5, 6, 10)] == ["", "", "1 < 2 & 3", "", ""]
    assert got[9].n_chars == len(got[9].text) == 30_000 * 10 - 1
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


WEIGHTS = {"barred": -2.0}


def inner(html):
    return extract(HEAD + NAV + "<article><p>Start here.</p>" + html + "<p>The end.</p></article>" + FOOT, WEIGHTS).split("\n")[1:-1]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p class=ad>Buy it<p>Next one<p>And more", ["Next one", "And more"]),
        ("<p class='ad'>Buy it<div>In a block</div>", ["In a block"]),
        ("<ul><li>One<li class=ad>Buy<ul><li>this</ul><li>Two</ul>", ["One", "Two"]),
        ("<ul><li class=ad>Buy it</ul><p>Next", ["Next"]),
        ("<dl><dt>Term<dd class=ad>Buy<dt>Other<dd>Meaning</dl>", ["Term", "Other", "Meaning"]),
        ("<table><tr><td class=ad>Buy<td>Cell<tr><td>Row</table>", ["Cell", "Row"]),
        ("<figure><img src=x><figcaption>A caption</figcaption></figure>", ["A caption"]),
        ("<object>Fallback</object><audio>Sound text</audio>", ["FallbackSound text"]),
        ("<h2 id='related-work'>Related work</h2><p>Others did this", ["Related work", "Others did this"]),
        ("<section id='discussion'><p>We discuss</section><section class=search>Search theory</section>", ["We discuss", "Search theory"]),
        ("<div class=share-price>Price rose</div><div class='share-buttons'>Share it</div>", ["Price rose"]),
        ("<div class=notice>Mind this</div><div class='related posts'>Other texts</div>", []),
        ("<div id=comments><article class=comment><footer>Someone</footer><p>I like it</article><p>Reply</div>", []),
        ("<section id=comments><article><p>I like it</p></article><p>More</section>", []),
        ("<div class=ad><div>Buy</div>this</div><p>Next", ["Next"]),
    ],
)
def test_text_inside_the_article(html, want):
    assert inner(html) == want


def test_comments_beside_the_article():
    note = "<article class='comment'><p>I like this text very much.</p></article>"
    for comments in (note, "<div id='comments'>" + note * 3 + "</div>", "<section class=comments>" + note[:-10] + note + "</section>"):
        assert extract(HEAD + NAV + ARTICLE + comments + FOOT, WEIGHTS) == WANT


def test_pages_that_mark_their_text(spark, sf_dir):
    """Against the marked element itself, which the extraction does not know."""
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_against_the_standard_library(zip64):
    out = io.BytesIO()
    parts = {"archive/data.warc.gz": [b"abc", b"d" * 70_000], "indexes/index.cdx": [b"0 3\n"], "empty": []}
    write_zip(out, list(parts.items()), zip64)
    raw = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert {n: z.read(n) for n in z.namelist()} == {n: b"".join(p) for n, p in parts.items()}
    members = read_members(Bytes(raw), len(raw))
    assert {n: raw[m.offset : m.offset + m.size] for n, m in members.items()} == {n: b"".join(p) for n, p in parts.items()}
    by_library = io.BytesIO()
    with zipfile.ZipFile(by_library, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"packed" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a comment"
    raw = by_library.getvalue()
    found = read_members(Bytes(raw), len(raw))
    assert set(found) == {"x"} and raw[found["x"].offset :][:6] == b"stored"
    with pytest.raises(ValueError):
        read_members(Bytes(b"no archive"), 10)


def test_record_round_trip_and_damage():
    payload = "é\r\n\r\nWARC/1.1\r\n".encode() * 3
    digest = hashlib.sha1(payload).hexdigest()
    raw = warc_record(7, "http://a/\r\nb", payload, digest, None)
    assert parse_record(raw) == (7, len(payload), digest, "response", None, payload)
    assert parse_record(warc_record(8, None, payload, digest, 7)) == (8, len(payload), digest, "revisit", 7, None)
    with pytest.raises(ValueError):
        parse_record(raw.replace(b"WARC/1.1\r\n\r\n\r\n", b"WARC/1.2\r\n\r\n\r\n"))


def test_archives_of_pages(spark, tmp_path):
    big, small = "é" * 600, "s" * 999
    rows = [(i, f"u{i}", big, 0) for i in range(1, 60)] + [(100, "a", small, 0), (101, "a", small, 0), (102, None, None, 0), (103, "b", "", 0)]
    rows += [(104, "c", "x" * 1000, 0), (None, "d", big, 0), (59, "u59", big, 0), (105, "e", "y" * 3_000_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int")
    got = sorted(archive_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), key=str)
    want = []
    for i, _, html, _ in rows:
        raw = (html or "").encode()
        again = html == big and i != 59
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", 59 if again else None))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    archives = write_archives(with_revisits(df), f"file://{tmp_path}/few", archive_bytes=400)
    assert archives.count() > 10
    read = read_records(locate_records(archives), payloads=True)
    assert {r.page_id: r.payload.decode() for r in read.where("record_type = 'response'").collect()}[105] == "y" * 3_000_000
    assert archive_round_trip(df.limit(0)).collect() == []
