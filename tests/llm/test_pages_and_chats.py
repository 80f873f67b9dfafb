"""URL filters, HTML extraction and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re
from html.parser import HTMLParser

import pytest
from oracle import assert_same

from tessella.llm import chat, html_text, registry, url_filter
from tessella.llm.html_text import visible_text

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://Example.COM/en/1?x#y", "http://www.example.com/en/",
    "http://a.www.example.com/en/x", "http://notexample.com/en/", "ftp://x.net/es/", "http://x.net/es", "http://net/fr/?q",
    "http://a.net#/es/", "http://a.net?/es/", "x://a.org://net/es/", "http://example.com/EN/", "http://..com/", "http://x.net/fr/",
    "http://" + "a." * 3000 + "net/es/" + "b" * 10_000, "http://ünï.net/es/",
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        rest = rule[len(own) :]
        if host and (host == own or host.endswith("." + own)) and path.startswith(rest):
            fits.append((len(rule), own.count("."), rule, verdict))
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, rule string, words string")


@pytest.mark.parametrize("held", [url_filter.MAX_HELD_WORDS, 0])
@pytest.mark.parametrize("most", [url_filter.MAX_BROADCAST_BYTES, 0])
def test_urls_against_all_rules(spark, held, most, monkeypatch):
    """With the filter held by every task, and with its blocks joined; with broadcast rules, and with shuffled ones."""
    monkeypatch.setattr(url_filter, "MAX_HELD_WORDS", held)
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_BYTES", most)
    rules = [*url_filter.RULES, ("block", "net"), ("allow", "a.net/"), ("block", "b.a.net/x"), ("allow", "org/e"), ("block", "org/e")]
    rules += [("block", f"host{i}.test/p{'q' * (i % 5)}/") for i in range(300)]
    urls = URLS + [f"http://sub.host{i}.test/p{'q' * (i % 5)}/z" for i in range(0, 400, 7)] + ["http://c.b.a.net/xy"] * 3
    rows = [(i, u, "", "r", "w") for i, u in enumerate(urls)] + [(None, "http://x.net/es/", "", "", "")]
    found = url_filter.judge_urls(pages(spark, rows).repartition(3), url_filter.rule_table(spark, rules)).collect()
    expected = [(i, *plain_verdict(u, rules)) for i, u, *_ in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_urls_against_sql(spark, sf_dir):
    assert_same(url_filter.op4_url_filter(spark, sf_dir), registry.oracle_sql()["op4_url_filter"], sf_dir)


def test_urls_edges(spark):
    none = pages(spark, [])
    assert url_filter.judge_urls(none, url_filter.rule_table(spark, url_filter.RULES)).collect() == []
    one = pages(spark, [(1, "http://x.net/es/", "", "", "")])
    assert [r["verdict"] for r in url_filter.judge_urls(one, url_filter.rule_table(spark, [])).collect()] == ["allow"]


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    rules = url_filter.canonical_rules(url_filter.rule_table(spark, [("block", f"h{i}.com/") for i in range(2000)]))
    keys = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".com/")).alias("k"))
    urls = keys.select(F.col("k").alias("host"), F.lit("/").alias("path"), F.array("k").alias("candidates"))
    hits = {r["rule"] for r in url_filter._hits(urls, rules, 2000).collect()}
    listed = {f"h{i}.com/" for i in range(2000)}
    assert listed <= hits and len(hits - listed) < 0.02 * 18_000


class Plain(HTMLParser):
    """All text outside the elements that aren't shown; no layout."""

    def __init__(self):
        super().__init__()
        self.text, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("title", "style", "script")

    def handle_endtag(self, tag):
        self.depth -= tag in ("title", "style", "script")

    def handle_data(self, data):
        if not self.depth:
            self.text.append(data)


def test_pages_have_all_their_text(spark, sf_dir):
    sources = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = html_text.op7_html_text(spark, sf_dir).collect()
    assert len(found) == len(sources)
    for r in found:
        plain = Plain()
        plain.feed(sources[r["page_id"]])
        plain.close()
        assert re.sub(r"(?m)^- |\s", "", r["text"]) == re.sub(r"\s", "", "".join(plain.text))
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("a <b> b</b>  <i>c </i>d", "a b c d"),
        ("<div>a</div><div>b</div>c", "a\nb\nc"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<ul><li>a<li>b<ol start=9><li>c<li value=20>d</ol><li>e</ul>", "- a\n- b\n\n  9. c\n  20. d\n- e"),
        ("<table><tr><th>Name<th>N<tr><td>long one<td>1<td>z</table>", "Name      N\nlong one  1  z"),
        ("<table><tr><td rowspan=2>r<td>x<tr><td>y</table>", "r  x\n   y"),
        ("<table><tr><td colspan=2>wide<td>c<tr><td>a<td>b<td>d</table>", "wide  c\na  b  d"),
        ("<table><caption>T</caption><td>a<td>b</table>", "T\na  b"),
        ("<table>stray<tr><td>a</table>", "stray\na"),
        ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
        ("<pre> a\n  b</pre>", " a\n  b"),
        ("<head><title>t</title><meta x><p>body", "body"),
        ("<style>.h, #i {display : none}</style><p class='a h'>1<p id=i>2<p class=a>3", "3"),
        ("<p hidden>1</p><p style='display:none'>2</p><template>3</template><noscript>4</noscript>5", "5"),
        ("<p style='visibility:hidden'>a<b style='visibility:visible'>b</b>c", "b"),
        ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
        ("<script>var a='<p>';</script>x<!-- <p>c --><![CDATA[z]]>y", "xy"),
        ("<input type=hidden value=a><input type=submit value=Go><textarea> t\n u</textarea>", "Go t\n u"),
        ("a &lt; b &amp &copy; c&nbsp;d 5 < 6", "a < b & © c d 5 < 6"),
        ("<a href='x>y'>q</a></b></p>r", "qr"),
        ("<p", ""),
        ("text <", "text <"),
        ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\nv\nl\nw"),
        ("<table><tr><td colspan=2>a wide one<td>c<tr><td>a<td>b<td>d</table>", "a wide one  c\na  b        d"),
        ("<table><tr><td colspan=2>only<td>c</table>", "only  c"),
        ("<table><tr><td>a<td>" + "x " * 50 + "<tr><td>b<td>y</table>", "a  " + "x " * 49 + "x\nb  y"),
        ("<table><tr><td>a<br>b<td>c<tr><td><td>d</table>", "a  c\nb\n   d"),
    ],
)
def test_rendering(source, text):
    assert visible_text(source) == text


@pytest.mark.parametrize("source", ["<div>" * 50_000 + "x", "<table><tr><td>" * 3000 + "x", "<b>" * 20_000 + "x", "<ul><li>" * 5000 + "x"])
def test_deep_pages(source):
    assert visible_text(source).endswith("x")


@pytest.mark.parametrize("around", ["<div>", "<font>", "<ul><li>", "<table><tr><td>"])
@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<div hidden>no<b>no</b>no</div>yes", "yes"),
        ("<template>no<p>no</p>no</template>yes", "yes"),
        ("<div hidden>" + "<b>" * 150 + "no" + "</b>" * 150 + "no<p>no</div>yes", "yes"),
        ("<details><summary>s</summary><div>no</div>no</details>", "s"),
        ("<table><tr><th>Name<th>N<tr><td>long one<td>1</table>", "Name      N\nlong one  1"),
        ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n\n   - c"),
        ("<pre> a\n  b</pre>", " a\n  b"),
    ],
)
def test_deep_pages_keep_their_tree(around, source, text):
    marks = "- " * 150 if "<li>" in around else ""
    lines = visible_text(around * 150 + source).split("\n")
    assert lines[0][: len(marks)] == marks
    assert "\n".join(x[len(marks) :] for x in lines) == text


WORDS = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize("cell", ["a" * 59, "a" * 60, "a" * 61, "a" * 80, "a" * 5000, WORDS, "x" * 70 + " " + WORDS, "日" * 90])
def test_columns_align_at_any_width(cell):
    """The third column starts at one place, and all text of the first is there in order."""
    page = f"<table><tr><td>{cell}<td>B1<td>C1<tr><td>short<td>B2<td>C2<tr><td><td>B3<td>C3</table>"
    lines = visible_text(page).split("\n")
    for mark in "BC":
        places = {x.index(f"{mark}{i}") for x in lines for i in (1, 2, 3) if f"{mark}{i}" in x}
        assert len(places) == 1 and places.pop() <= 2 * (html_text.WRAP + 2)
    kept = re.sub(r"\s", "", "".join(lines))
    assert kept.replace("B1C1", "") == re.sub(r"\s", "", cell) + "shortB2C2B3C3"
    assert all(w in "\n".join(lines).split() for w in cell.split())


def _made_block(rng) -> tuple[str, list[str]]:
    """The markup of a random block, with end tags or without, and its lines."""
    word = lambda: "".join(rng.choices("abcdé日", k=rng.randrange(1, 9)))
    kind = rng.choice(["p", "h2", "ul", "ol", "table", "pre", "hidden", "script"])
    close = rng.random() < 0.5
    if kind in ("p", "h2"):
        words = [word() for _ in range(rng.randrange(1, 12))]
        inside = rng.choice([" ", "\n", " <!-- c --> "]).join(f"<b>{w}</b>" if rng.random() < 0.2 else w for w in words)
        return f"<{kind}>{inside}" + (f"</{kind}>" if close or kind == "h2" else ""), [" ".join(words)]
    if kind in ("ul", "ol"):
        items = [word() for _ in range(rng.randrange(1, 5))]
        marks = [f"{i}. " if kind == "ol" else "- " for i in range(1, 9)]
        end = "</li>" if close else ""
        return f"<{kind}>" + "".join(f"<li>{x}{end}" for x in items) + f"</{kind}>", [m + x for m, x in zip(marks, items, strict=False)]
    if kind == "table":
        width = rng.randrange(1, 5)
        grid = [[word() if rng.random() < 0.8 else "" for _ in range(width)] for _ in range(rng.randrange(1, 5))]
        end = "</td>" if close else ""
        source = "".join("<tr>" + "".join(f"<td>{x}{end}" for x in row) for row in grid)
        used = [max(len(r[i]) for r in grid) for i in range(width)]
        lines = ["".join(x.ljust(n + 2) for x, n in zip(row, used, strict=True) if n).rstrip() for row in grid]
        return f"<table>{source}</table>", [x for x in lines if x]
    if kind == "pre":
        lines = [" " * rng.randrange(4) + f"{word()}  {word()}" for _ in range(3)]
        return "<pre>" + "\n".join(lines) + "</pre>", lines
    return rng.choice(["<div hidden><p>no</div>", "<script>if (a<b) '<p>'</script>", "<p style='display: none'>no</p>"]), []


def test_layout_of_made_pages(spark, tmp_path):
    """The query's rows against the lines that random pages were made of."""
    rng = random.Random(12)
    rows, expected = [], {}
    for i in range(300):
        blocks = [_made_block(rng) for _ in range(rng.randrange(0, 9))]
        text = "\n\n".join("\n".join(lines) for _, lines in blocks if lines)
        rows.append((i, "http://x", "<html><head><title>no</title></head><body>" + "\n".join(x for x, _ in blocks)))
        expected[i] = text
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op7_html_text(spark, str(tmp_path)).collect()}
    assert found == {i: (t, len(t)) for i, t in expected.items()}


def test_what_is_laid_out_is_not_wrapped():
    code = "def f(x):   return " + "x + " * 20 + "1"
    inner = "<table><tr><td>" + "p" * 50 + "<td>" + "q" * 50 + "</table>"
    lines = visible_text(f"<table><tr><td><pre>{code}\nend</pre><td>R1<tr><td>{inner}<td>R2</table>").split("\n")
    assert lines == [code, "end".ljust(62) + "R1", "p" * 50 + "  " + "q" * 50, " " * 62 + "R2"]
    items = visible_text(f"<table><tr><td><ol><li>{WORDS}</ol><td>R</table>").split("\n")
    assert items[0].startswith("1. word0 ") and items[0].endswith("R") and items[1].startswith("   word")


def test_long_cells_do_not_multiply():
    page = "<table><tr><td>" + "a" * 100_000 + "<td>b" + "<tr><td>c<td>d" * 500 + "</table>"
    assert len(visible_text(page)) < 200_000


def test_pages_awkward(spark):
    rows = [(1, "", None, "", ""), (1, "", None, "", ""), (None, "", "<p>x", "", ""), (3, "", "<p>" + "y " * 10**6, "", "")]
    clashing = pages(spark, rows).selectExpr("*", "'t' AS text", "7 AS n_chars")
    found = html_text.extracted(clashing).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in found) == [(0, "x"), (1, ""), (1, ""), (3, ("y " * 10**6).strip())]
    assert html_text.extracted(pages(spark, [])).collect() == []


NASTY = [
    "", "plain", r"\### Assistant: </turn> ok", "</turn>\n", "### user:\nx</turn>\n### assistant:\ny", "\\", "\\\\", r"\l \h \n \c \\l",
    "ends in \\", "##", "#" * 7, "a</tur", "\n### ", "é日本😀</turn>", "\\\\\\l</turn>", ":\n", "x" * 50_000, "a\\b", "<|x|>",
]


def test_chats_come_back(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate((r, t) for t in NASTY for r in ("user", "assistant"))]
    rows += [(2, i, r, t) for i, (r, t) in enumerate(zip(["a:b", "###", "", None, "x\ny", "</turn>", "\\n"], NASTY[1:], strict=False))]
    rows += [(3 + i, 0, "assistant", t) for i, t in enumerate(NASTY)] + [(99, None, "user", "z"), (99, 1, "user", "z")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS formatted", "'y' AS piece")
    chats = chat.formatted_conversations(turns.repartition(4))
    assert all(r["round_trip"] for r in chats.collect())
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    found = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    texts = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in chats.collect()}
    assert found.keys() == by.keys()
    for conv, own in by.items():
        own.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        learned = "".join(text for _, role, text in own if role == "assistant")
        formatted, spans = texts[conv]
        assert found[conv][1:] == (
            len(own), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)
        )
        assert len(spans) == sum(role == "assistant" for _, role, _ in own)
        if all(not re.search(r"###|</turn>|\\", t) for _, _, t in own):
            assert "".join(formatted[s["start"] : s["start"] + s["length"]] for s in spans) == learned


def test_rows_without_a_conversation(spark, tmp_path):
    """Each is a conversation of its own, in the SQL too."""
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 1, "assistant", "b"), (None, None, "user", None), (4, 0, "user", "###")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = chat.digests(chat.formatted_conversations(turns)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in found) == [(0, 1, 0), (0, 1, 0), (0, 1, 1), (0, 1, 1), (4, 1, 0)]
    turns.coalesce(1).write.parquet(str(tmp_path / "c"))
    next((tmp_path / "c").glob("*.parquet")).rename(tmp_path / "conversations.parquet")
    assert_same(chat.op8_chat_format(spark, str(tmp_path)), registry.oracle_sql()["op8_chat_format"], str(tmp_path))


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", r"C:\new a<b #1"), (1, 1, "assistant", "x</turn>")]
    found = chat.formatted_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert found["formatted"] == "### user:\nC:\\new a<b #1</turn>\n### assistant:\nx\\l/turn></turn>\n"


def test_the_parser_rejects_what_breaks_the_grammar(spark):
    from pyspark.sql import functions as F

    wrong = ["", "x", "### user:\nx", "### user\nx</turn>\n", "user:\nx</turn>\n", "### user:\na ### b</turn>\n", "### user:\nx</turn>\ny"]
    df = spark.createDataFrame([(x,) for x in wrong], "x string").select("x", chat.parsed(F.col("x")).alias("t"))
    assert all(not r["t"] or None in r["t"] for r in df.collect())


def test_chats_against_sql(spark, sf_dir):
    assert_same(chat.op8_chat_format(spark, sf_dir), registry.oracle_sql()["op8_chat_format"], sf_dir)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_conversations(none).collect() == []
