from html.parser import HTMLParser

from tidelight.sources import html
from tidelight.sources.tables import table


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.open = [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href") is not None:
            self.open = [dict(attrs)["href"], ""]

    def handle_data(self, data):
        if self.open:
            self.open[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append(tuple(self.open))
            self.open = None


def check(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = {}
    for r in html.anchors(df, "page_id", "html").orderBy("page_id", "idx").collect():
        got.setdefault(r.page_id, []).append((r.href, r.text))
    for i, p in enumerate(pages):
        parser = Anchors()
        parser.feed(p)
        want = [(h, "".join(c for c in t.strip() if c.isascii()).strip()) for h, t in parser.found]
        assert [(h, t.strip()) for h, t in got.get(i, [])] == want, p


def test_spellings(spark):
    check(spark, [
        "<p><a href=\"/a/b.html\">one</a> <a class=x href='/c d'><b>two</b> more</a><A HREF=/e>three</A><a name='q'>no</a>",
        "<a\n href = \"x\"\n>multi\nline</a ><a data-href='n' href=\"y\"></a>", "", "no anchors < here",
    ])


def test_given_pages(spark):
    rows = [r.html for r in table(spark, "/root/testdata/sf0.001", "pages").select("html").collect() if "&" not in r.html.split("<nav>")[-1].split("</nav>")[0]]
    assert rows
    check(spark, rows)
