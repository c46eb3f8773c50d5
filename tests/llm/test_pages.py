import gzip
import random
import time
from collections import Counter

import pytest

from tests.llm.helpers import base32_sha1
from termloom.llm.html_extraction import Page, extract_main_text
from termloom.llm.warc import archive_round_trip, original_records, parse_file, parse_header, read_warc_files, write_archive

PAGES = "page_id bigint, url string, html string"


def text(html):
    return Page(html).main_text(frozenset())


def test_blocks_and_white_space():
    assert text("<p>a  b\n c<br>d</p>x<div>&lt;e&gt; &eacute;&#233;</div>") == "a b c d\nx\n<e> éé"
    assert text("<article><h1>T</h1><p><b>one<br><p>two</p></article><p>outside</p>") == "T\none\ntwo"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert text("a < b & c") == "a < b & c"
    assert text("") == ""


def test_furniture_goes():
    page = '<head><title>t</title><style>p{}</style></head><nav>n</nav><header>h</header><div class="ad-slot">ad</div><div id="sideBar" role="complementary">s</div><script>var t="</p><p>x";</script><form>f</form><p hidden>z</p><main><p>text</p><section class="comments"><p>c</p></section></main><footer>&copy;</footer><!-- <p>no</p> -->'
    assert text(page) == "text"
    assert text("<p title='a > b'>x</p><p data-x=\"1>2\">y</p>") == "x\ny"


def test_comments_and_teasers_do_not_mark_the_article():
    post = "<div class=post><p>Own text</p></div>"
    assert text(f"{post}<section class=comments><article><p>c</p></article></section>") == "Own text"
    assert text(f'{post}<article class="comment odd"><p>c</p></article>') == "Own text"
    assert text(f"{post}<article class=teaser><p>t</p></article>") == "Own text\nt"
    assert text("<article><p>a</p></article><article class=teaser><p>t</p></article>") == "a"
    assert text('<article class="post comments-open"><p>a</p></article><p>x</p>') == "a"


def test_long_and_broken_pages():
    assert text("<p>" + "a" * 300_000) == "a" * 300_000
    assert text("<div>" * 3_000 + "x" + "</div>" * 3_000) == "x"
    assert text("<p 'x>a</p>") is not None
    assert text("<script>never ends <p>x") == ""


def test_templates_of_a_host_go(spark):
    box = '<div class="x7"><div>Join our list today</div></div>'
    rows = [(i, f"http://h.example/{i}", f"<body><div><div>Own text {i}</div></div>{box}</body>") for i in range(12)]
    rows += [(100, "http://other.example/", f"<body>{box}</body>"), (101, None, None), (102, "no url", "")]
    rows.append(rows[0])
    found = extract_main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in found}
    assert got[3] == ("http://h.example/3", "Own text 3", 10)
    assert got[100][1] == "Join our list today"
    assert got[101] == (None, "", 0) and got[102] == ("no url", "", 0)
    assert extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_equal_a_plain_counter(spark):
    """Pages of unmarked boxes: those that recur on a host's distinct pages go, by counting strings."""
    r = random.Random(2)
    pages, n = [], 0
    for host, size in (("a", 40), ("b", 12), ("c", 3), ("d", 25)):
        shared = [f"box {host} {k}" for k in range(6)]
        for _ in range(size):
            boxes = r.sample(shared, r.randint(0, 4)) + [f"own {n}"] * r.randint(0, 1)
            r.shuffle(boxes)
            for _ in range(r.choice([1, 1, 1, 5])):
                pages.append((n, host, boxes))
                n += 1
    counts, sizes = Counter(), Counter()
    for host, boxes in {(h, tuple(b)) for _, h, b in pages}:
        sizes[host] += 1
        counts.update((host, box) for box in set(boxes))
    rows = [(i, f"http://{h}/{i}", "<body>" + "".join(f"<div><span>{b}</span></div>" for b in boxes) + "</body>", "x", "y", 1) for i, h, boxes in pages]
    frame = spark.createDataFrame(rows, f"{PAGES}, host string, digest string, text int")
    want = {i: "\n".join(b for b in boxes if counts[h, b] < max(5, 0.1 * sizes[h])) for i, h, boxes in pages}
    for most in (200_000, 0):  # templates broadcast, and joined by a shuffle
        got = {x.page_id: x for x in extract_main_text(frame, broadcast_templates=most).collect()}
        assert {i: x.text for i, x in got.items()} == want
        assert sum(x.n_deleted > 0 for x in got.values()) > 30


def test_slots_of_hinted_elements_need_a_second_sign(spark):
    def page(i, inner):
        return f"<body><div><p>Own text {i}</p></div>{inner}</body>"

    rows = [(i, f"http://big.example/{i}", page(i, f'<div class="site-banner">Banner of {i}</div>')) for i in range(12)]
    rows.append((50, "http://big.example/50", page(50, '<div class="share-price">The share price rose</div>')))
    rows.append((51, "http://small.example/51", page(51, '<div class="site-banner">Banner</div>')))
    rows.append((60, "http://news.example/60", '<article><p>One</p><div class="share-price"><p>The share price rose</p></div><div class="share-box"><a href=x>Tell</a> <a href=y>Send</a></div><div class="comment">A comment by the author</div></article>'))
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Own text 3"
    assert got[50] == "Own text 50\nThe share price rose"  # seen on one page only
    assert got[51] == "Own text 51"  # too few pages to count
    assert got[60] == "One\nThe share price rose\nA comment by the author"


@pytest.mark.parametrize("make", [lambda n: "<div>" * n + "x" + "</div>" * n, lambda n: "".join(f"<div>t{i}" for i in range(n)), lambda n: "<a " * n, lambda n: "<a " * n + ">", lambda n: "<p 'x>a" * n, lambda n: '<a b="" c=">' * n, lambda n: "<a \"'>" * n, lambda n: "<ul><li><table>" + "<div>" * n + "<li></li>" * n, lambda n: "<div>" * n + "</p></section>" * n, lambda n: "<!--" * n, lambda n: "<article>" + "<div class=share><a>x</a>" * n])
def test_time_follows_the_length(make):
    began = time.perf_counter()
    Page(make(100_000)).main_text()
    assert time.perf_counter() - began < 20


def test_paragraphs_of_articles_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<nav>Home</nav><article><h1>T{i}</h1><p>A passage that all quote.</p></article>") for i in range(10)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"T{i}\nA passage that all quote." for i in range(10)}


ROWS = [(1, "http://a/x", "<p>é</p>"), (2, None, None), (3, "http://a/y\r\nz", "<p>é</p>"), (5, "u", ""), (None, "v", "q"), (7, "w", "q"), (8, "w", "r"), (8, "w", "r")]


def test_archive_round_trip(spark):
    got = sorted((tuple(r) for r in archive_round_trip(spark.createDataFrame(ROWS, PAGES)).collect()), key=repr)
    want = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        first = min(i for i, _, h in ROWS if (h or "") == (html or "") and i is not None)
        want.append((page_id, len(data), base32_sha1(data), *(("response", None) if page_id == first else ("revisit", first))))
    assert got == sorted(want, key=repr)
    assert archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0
    assert all(r.record_type == "response" or r.payload_bytes >= 5 for r in archive_round_trip(spark.createDataFrame(ROWS, PAGES), min_bytes=5).collect())


def test_archive_ignores_further_columns(spark):
    rows = [(*r, "h", "d", b"p", 1) for r in ROWS]
    frame = spark.createDataFrame(rows, f"{PAGES}, host string, digest string, payload binary, n_bytes int")
    assert sorted(map(tuple, archive_round_trip(frame).collect()), key=repr) == sorted(map(tuple, archive_round_trip(spark.createDataFrame(ROWS, PAGES)).collect()), key=repr)


def test_payloads_are_stored_once_and_records_rebuilt(spark, tmp_path):
    archive = write_archive(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "archive"))
    assert spark.read.parquet(archive.payloads).count() == 4
    data = b"".join(bytes(r.record) for r in original_records(spark, archive).collect())
    records = list(parse_file(data))
    assert len(records) == len(ROWS)
    assert {b for f, b in records if f["warc-type"] == "response"} == {b"", "<p>é</p>".encode(), b"q", b"r"}
    (tmp_path / "x.warc").write_bytes(data)
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in original_records(spark, archive).collect()))
    for name in ("x.warc", "x.warc.gz"):
        found = read_warc_files(spark, str(tmp_path / name)).collect()
        assert sorted((r.record_type, bytes(r.block)) for r in found) == sorted((f["warc-type"], b) for f, b in records)


def test_changed_payloads_are_noticed(spark, tmp_path):
    from pyspark.sql import functions as F

    from termloom.llm.warc import Archive, verified_records

    archive = write_archive(spark.createDataFrame(ROWS, PAGES), str(tmp_path / "archive"))
    bad = Archive(archive.headers, str(tmp_path / "bad"))
    spark.read.parquet(archive.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(bad.payloads)
    try:
        verified_records(spark, bad).collect()
    except Exception as error:
        assert "does not match" in str(error)
    else:
        raise AssertionError("the change went unnoticed")


def test_header_fields():
    assert parse_header(b"WARC/1.1\r\nWARC-Type: response\r\nX: a:b\r\n\r\n") == {"warc-type": "response", "x": "a:b"}
