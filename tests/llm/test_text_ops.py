"""HTML, chat and BPE operators."""

import hashlib
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glosswork.llm import bpe, chat, queries, vocab
from glosswork.llm.html_text import extract, page_text

tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>one<li>two<ul><li>in</ul><li>three</ul>", "- one\n- two\n  - in\n- three"),
        ("<ol start=9><li>x<li>y<br>z</ol>", "9. x\n10. y\n    z"),
        ("<table><tr><th>Name<th>N<tr><td>Apple<td>3<tr><td>Fig<td>12</table>", "Name   N\nApple  3\nFig    12"),
        ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>dd<td>e</table>", "a      b\nc  dd  e"),
        ("<table><tr><td>a<ul><li>x<li>y</ul><td>b<tr><td>c<td>d</table>", "a    b\n- x\n- y\nc    d"),
        ("<table><tr><td><table><tr><td>1<td>22<tr><td>333<td>4</table><td>z</table>", "1    22  z\n333  4"),
        ("<table><tr><td>" + "word " * 30 + "<td>n<tr><td>x<td>m</table>", ("word " * 16).strip() + "  n\n" + ("word " * 14).strip() + "\nx" + " " * 80 + "m"),
        ("<td>no table", "no table"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
        ("<head><title>t</title></head>x", "x"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- c --><noscript>n</noscript>", "x"),
        ("<div hidden>n</div><b style='color:red; DISPLAY : none'>n</b>y<input type=hidden value=q>", "y"),
        ("a &amp; b &lt;c&gt; &eacute;&nbsp;d", "a & b <c> é d"),
        ("1 < 2 <b", "1 < 2 <b"),
        ("<details><summary>s</summary>n</details><details open><summary>t</summary>y</details>", "s\n\nt\ny"),
        ("<dl><dt>T<dd>D</dl>", "T\n  D"),
        ("<p>a</div>b</p>c", "ab\n\nc"),
        ("</p>", ""),
        ("<script>never closed", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_pages(html, text):
    assert page_text(html) == text


@given(st.text(alphabet="<>/pdivtablerx \"'=&;!-\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup_ends(html):
    page_text(html)


def test_deep_and_long():
    assert page_text("<div>" * 30_000 + "deep") == "deep"
    assert page_text("<b>" * 3000 + "x" + "</b>" * 3000) == "x"
    wide = page_text("<table>" + "<tr><td>a<td>b" * 500 + "<tr><td>" + "w" * 100_000 + "<td>c</table>")
    assert len(wide) < 200_000


def test_all_visible_words_survive():
    rng = random.Random(2)
    tags = ["p", "div", "span", "ul", "li", "table", "tr", "td", "h1", "b", "section"]
    for _ in range(60):
        words, parts = [f"w{i}" for i in range(30)], []
        for w in words:
            parts += [f"<{rng.choice(tags)}>", w, " ", f"</{rng.choice(tags)}>" if rng.random() < 0.5 else ""]
        assert sorted(page_text("".join(parts)).replace("-", " ").split()) == sorted(words)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div style="visibility:hidden">a <b style="color:red; visibility: visible">b</b> c<p style="visibility:inherit">d</div>e', "b\n\ne"),
        ('<p style="visibility:hidden;visibility:visible">x<i style="display:none"><b style="visibility:visible">y</b></i></p>', "x"),
        ('<ul style="visibility:collapse"><li>a<li style="visibility:visible">b</ul>', "- b"),
        ("<table><tr><td rowspan=2>L<td>a<tr><td>R<tr><td>x<td>y</table>", "L  a\n   R\nx  y"),
        ("<table><tr><td>1<td rowspan=3 colspan=2>2<td>3<tr><td>4<td>5<tr><td>6<tr><td>7<td>8</table>", "1  2    3\n4       5\n6\n7  8"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a  b\n   c\n   d"),
        ("<table><tr><td><p>a<p>b<td>c</table>", "a  c\nb"),
        ("<table><tr><td>k<td><pre>x\n\ny</pre></table>", "k  x\n\n   y"),
        ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
        ("<ol start=7><li>a<li value=2>b<li>c</ol>", "7. a\n2. b\n3. c"),
        ("<ol reversed start=5><li>a<li>b</ol>", "5. a\n4. b"),
        (f"<table><tr><td>{'w' * 90}<td>b<tr><td>c<td>d</table>", " " * 82 + "b\n" + "w" * 90 + "\nc" + " " * 81 + "d"),
        (f"<table><tr><td>a<td>{'w' * 90}<tr><td>c<td>d</table>", "a  " + "w" * 90 + "\nc  d"),
    ],
)
def test_visibility_spans_and_numbers(page, text):
    assert page_text(page) == text


def plain_grid(rows):
    """Column of each cell (text, colspan, rowspan) by marking every field of a grid."""
    taken, out = set(), {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, tall in row:
            while (r, c) in taken:
                c += 1
            out[text] = c
            taken |= {(r + i, c + j) for i in range(tall) for j in range(wide)}
            c += wide
    return out


def test_cells_stand_in_the_columns_of_a_grid():
    rng = random.Random(31)
    for _ in range(150):
        n, rows = 0, []
        for _ in range(rng.randint(1, 6)):
            row = []
            for _ in range(rng.randint(1, 4)):
                row.append((f"c{n:03d}", 1, rng.choice([1, 1, 1, 2, 3])))
                n += 1
            rows.append(row)
        page = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}</td>" for t, w, h in row) for row in rows) + "</table>"
        lines = page_text(page).split("\n")
        where = {m.group(): m.start() // 6 for line in lines for m in re.finditer(r"c\d{3}", line)}  # four letters and two spaces to a column
        assert where == plain_grid(rows)


def test_extract_replaces_the_column(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>a", "old"), (2, "<p>a", "old")], "page_id int, html string, TEXT string")
    got = extract(df)
    assert got.columns == ["page_id", "text"]
    assert sorted(map(tuple, got.collect())) == [(1, ""), (2, "a"), (2, "a")]
    assert extract(df.where("false")).count() == 0


class Plain(HTMLParser):
    """Words of a page by the library's own parser: a stack of open elements tells whether text is seen."""

    UNSEEN = {"head", "script", "style", "template", "noscript", "iframe", "object", "audio", "video", "canvas", "svg", "title"}
    VOID = {"br", "hr", "img", "input", "meta", "link", "col", "wbr", "area", "base", "embed", "source", "track", "param"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            given = {k: (v or "").replace(" ", "").lower() for k, v in attrs}
            style = given.get("style", "")
            hidden = "hidden" in given or "display:none" in style or tag in self.UNSEEN or tag == "dialog" and "open" not in given
            shown = self.open[-1][2] if self.open else True
            self.open.append((tag, hidden, False if "visibility:hidden" in style else True if "visibility:visible" in style else shown))

    def handle_endtag(self, tag):
        at = [i for i, (t, _, _) in enumerate(self.open) if t == tag]
        if at:
            del self.open[at[-1] :]

    def handle_data(self, data):
        if not any(hidden for _, hidden, _ in self.open) and (not self.open or self.open[-1][2]):
            self.words += data.replace("\xa0", " ").split()


def test_html_query(spark, small):
    """All visible words and no others, marks of lists aside; blocks stand on their own lines."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.QUERIES["op3_html_layout"](spark, small).collect()}
    assert set(got) == set(pages)
    mark = re.compile(r"-|\d+\.")
    for k, page in pages.items():
        plain = Plain()
        plain.feed(page or "")
        plain.close()
        want, have = Counter(plain.words), Counter(got[k].split())
        assert not want - have, k
        assert all(mark.fullmatch(w) for w in have - want), k
        for heading in re.findall(r"<h[1-6]>([^<>&]+)</h[1-6]>", page or ""):
            assert " ".join(heading.split()) in [x.strip() for x in got[k].split("\n")] or not want[heading.split()[0]]


def test_pages_of_any_size(spark):
    long = "<p>" + "one two " * 200_000 + "<table>" + "<tr><td>a<td>b" * 20_000 + "</table>"
    df = spark.createDataFrame([(1, long, 5), (1, long, 5), (2, None, None)], "page_id int, html string, lang int")
    got = extract(df).collect()
    assert [len(r.text.split()) for r in got if r.page_id == 1] == [440_000] * 2 and got[0].lang == 5


@given(st.text(alphabet="<|\\aim_end>", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escapes_go_back(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text
    role = chat.escape_role(text + "\n")
    assert "\n" not in role and "<|" not in role and chat.unescape_role(role) == text + "\n"


def test_masks():
    enc = vocab.encoding(open(JSON, "rb").read())
    ids, loss = chat.assemble(enc.encode_ordinary, "assistant", chat.PLANTED, True)
    assert (ids == chat.START_ID).sum() == (ids == chat.END_ID).sum() == 1
    assert chat.unescape(enc.decode(ids[loss].tolist())) == chat.PLANTED
    assert not chat.assemble(enc.encode_ordinary, "user", "x", False)[1].any()


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None, 1), (1, 1, "assistant", "", 1), (1, 2, "assistant", "a\nb", 1), (2, 5, "odd\nrole", "<|im_start|>", 1), (2, 5, "odd\nrole", "<|im_start|>", 1), (None, 1, "assistant", "日本 " * 4000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_turns(df, JSON), JSON).collect()}
    for key in (1, 2, None):
        own = [r for r in rows if r[0] == key]
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[key].n_turns == len(own)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digest_conversations(chat.format_turns(df.where("false"), JSON), JSON).count() == 0


def test_chat_ties_go_by_role_and_text(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(2), rng.choice(["user", "assistant", None]), rng.choice(["b a", "ba", "B", "é", "zz top", "", None, "a" * 50])) for k in range(20) for _ in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for r in chat.digest_conversations(chat.format_turns(df, JSON), JSON).collect():
        own = sorted((t, (role or "").encode(), (text or "").encode()) for k, t, role, text in rows if k == r.conv_id)
        assert r.turns_sha256 == hashlib.sha256(b"".join(role + b"\n" + text + b"\n" for _, role, text in own)).hexdigest()


def test_chat_query(spark, small):
    assert oracle.compare(spark, oracle.connect(small), small, queries.QUERIES["op7_chat_format"], queries.ORACLES["op7_chat_format"]) == ""


def test_pair_table():
    ranks = vocab.ranks_of_tiktoken(open(RANKS, "rb").read())
    slots = bpe.pair_table(ranks)
    for piece in random.Random(1).sample([p for p in ranks if len(p) > 1], 500):
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                key = left * 65536 + right
                assert key * 65536 + ranks[piece] in (slots[key % bpe.P1], slots[bpe.P1 + key % bpe.P2])


def test_cuts_change_nothing():
    data = open(RANKS, "rb").read()
    enc, held = vocab.encoding(data), bpe.cut_table(vocab.ranks_of_tiktoken(data))
    rng = random.Random(5)
    for _ in range(50):
        piece = bytes(rng.choice(b"abcABC019+/=") for _ in range(300))
        parts = bpe.cut(piece, held)
        assert b"".join(parts) == piece
        assert [i for p in parts for i in enc._core_bpe.encode_single_piece(p)] == enc._core_bpe.encode_single_piece(piece)


ODD = [(1, None), (2, ""), (3, " "), (4, "a" * 5000), (5, "=" * 3000 + " x"), (6, "".join(random.Random(1).choices("abcXYZ019+/", k=6000))), (7, "  \n\n\t x y 　z \x1c\x1f!"), (8, "你好世界" * 300 + "🎉" * 50), (9, "I'll can't 'S don't"), (10, "\n" * 500), (11, "<|endoftext|>"), (12, "ก" * 700), (13, "Ünïcödé " * 40), (13, "Ünïcödé " * 40), (None, "x")]


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_bpe_equals_tiktoken(spark, block):
    enc = vocab.encoding(open(RANKS, "rb").read())
    df = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, ids string").repartition(3)
    got = bpe.encode(df, RANKS, tokenizers.PATTERN, block_chars=block).collect()
    assert len(got) == len(ODD)
    texts = dict(ODD)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(df.where("false"), RANKS, tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, small):
    enc = vocab.encoding(open(RANKS, "rb").read())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in queries.QUERIES["op10_byte_bpe"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert np.all([v[0] >= 0 for v in got.values()])
