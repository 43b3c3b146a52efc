"""HTML, decontamination, personal data, toxicity: small cases with defined results, and brute force."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerlink.llm import decontam, pii, toxicity
from ledgerlink.llm.html_text import extract_text, html_to_text


@pytest.mark.parametrize(("page", "text"), [
    ("<p>a<p>b", "a\n\nb"),
    ("<ul><li>x<li>y<ol start=3><li>q</ol></ul>", "- x\n- y\n  3. q"),
    ("<table><tr><th>h<th>long<tr><td>1<td>2</table>", "h  long\n1  2"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("x<div hidden>no</div><b style='display: none'>no</b>y<!-- c -->&amp;", "xy&"),
    ("<script>var t='</p>';</script>s<style>p{}</style>", "s"),
    ("<title>t</title><body>b <b>c", "b c"),
    ("<div>a</div>b<div>c", "a\nb\nc"),
    ("a</p></table></zzz>b", "a\nb"),
    ("<p>1 &lt; 2 <", "1 < 2 <"),
    ("", ""), (None, ""), ("   \n ", ""), ("<li>x", "- x"),
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
    ("<table><tr><td rowspan=3 colspan=2>A<td>b<tr><td>c<tr><td>d<td>e<tr><td>f</table>", "A  b\n   c\n   d  e\nf"),
    ("<table><tr><td colspan=900>a<td>b<tr><td>cc</table>", "a   b\ncc"),
    ("<b aria-hidden=true>icon</b> <select><option>one<option>two</select>", "icon\none\ntwo"),
    ("<svg><title>no</title><rect/><text>label</text></svg><math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "labelx=1"),
    ("<textarea>a\n b</textarea>", "a\n b"),
])
def test_html(page, text):
    assert re.sub(r"\n+", "\n", html_to_text(page)) == re.sub(r"\n+", "\n", text)


def test_html_keeps_every_visible_word_and_survives_depth():
    words = [f"w{i}" for i in range(3000)]
    page = "".join(f"<div><p>{w}<span>" for w in words)
    assert html_to_text(page).split() == words


def test_html_of_any_depth_hides_what_is_hidden_and_stays_small():
    deep = "<div>" * 20_000 + "<p hidden>SECRET</p>x" + "</span>" * 20_000
    assert html_to_text(deep) == "x"
    assert html_to_text("<ul><li>" * 300 + "end").endswith("- end")
    assert html_to_text("<table><tr><td>" * 300 + "end").strip() == "end"
    wide = html_to_text("<table>" + "".join(f"<tr><td>{'w' * (n % 7)}<td>{'long ' * 2000 if n == 5 else 'y'}<td>z{n}" for n in range(2000)) + "</table>")
    assert len(wide) < 200_000 and sum(f"z{n}" in wide.split() for n in range(2000)) == 2000


def plain_words(page):
    """Words of a page of well-formed tags, by the standard library's parser."""
    from html.parser import HTMLParser

    class Walk(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.out = [], []

        def handle_starttag(self, tag, attrs):
            self.hidden.append("hidden" in dict(attrs) or tag in ("style", "template"))

        def handle_endtag(self, tag):
            self.hidden.pop()

        def handle_data(self, data):
            if not any(self.hidden):
                self.out += data.split()

    walk = Walk()
    walk.feed(page)
    return walk.out


def test_html_keeps_the_visible_words_of_random_trees():
    rng = random.Random(7)
    names = ["div", "span", "b", "section", "ul", "table", "template", "pre", "article", "blockquote", "em"]

    def tree(depth):
        if not depth or rng.random() < 0.2:
            return f" w{rng.randrange(10**6)} "
        tag = rng.choice(names)
        inner = {"ul": "<li>{}</li>", "table": "<tr><td>{}</td></tr>"}.get(tag, "{}")
        body = "".join(inner.replace("{}", tree(depth - 1)) for _ in range(rng.randrange(4)))
        return f"<{tag}{' hidden' if rng.random() < 0.1 else ''}>{body}</{tag}>"

    for _ in range(200):
        page = "".join(tree(5) for _ in range(3))
        got = [w for w in html_to_text(page).split() if w != "-"]
        assert sorted(got) == sorted(plain_words(page))


def test_extract_text_frame(spark):
    df = spark.createDataFrame([(1, "u", "<p>a<p>b", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_lines, r.n_chars) for r in extract_text(df).collect()}
    assert got == {1: ("a\n\nb", 3, 4), None: ("", 0, 0)}
    assert extract_text(df.limit(0)).count() == 0


def windows(words, size):
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    vocabulary = ["a", "B", "c", "É", "d-e", "9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 3, 5])))) for i in range(12)] + [(12, None), (3, "a B c")]
    docs = [(i, " ".join(rng.choice([*vocabulary, "zz", "yy", "xx"]) for _ in range(rng.randrange(14)))) for i in range(60)] + [(100, None), (101, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    got = {r.doc_id: r for r in decontam.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), window=3).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        words, hit, found = low(t), set(), set()
        for item, text in items:
            for w in windows(low(text), 3):
                for at in range(len(words) - len(w) + 1):
                    if tuple(words[at : at + len(w)]) == w:
                        hit.update(range(at, at + len(w)))
                        found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_offsets_shards_and_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "É. One, TWO three!", "k"), (2, "none", "k")], "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(7, "one two three"), (8, "two three")], "item_id long, text string")
    hits = {r.doc_id: r.hits for r in decontam.benchmark_hits(docs, bench).collect()}
    assert sorted((h.item, h.start, h.end) for h in hits[1]) == [("7", 3, 17), ("8", 8, 17)] and not hits[2]
    monkeypatch.setattr(decontam, "MAX_PATTERN_WORDS", 1)  # every item is a shard of its own
    assert sorted(h.item for h in {r.doc_id: r.hits for r in decontam.benchmark_hits(docs, bench).collect()}[1]) == ["7", "8"]
    twice = decontam.contamination(docs.unionByName(docs.filter("doc_id = 1")).unionByName(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(1))), bench)
    assert sorted((r.doc_id, r.n_hit) for r in twice.collect()) == [(1, 0), (1, 3), (1, 3), (2, 0)]  # rows that repeat an id stay apart
    assert [tuple(r) for r in decontam.drop_contaminated(docs, bench).collect()] == [(2, "none", "k")]
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    out = []
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for rank, (kind, p) in enumerate(patterns.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind != "ip" or all(int(x) <= 255 for x in m[0].split("."))) and (kind != "card" or (12 <= len(d) <= 19 and luhn(d))) and (kind != "phone" or 9 <= len(d) <= 15):
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(out))


def test_pii_base_equals_brute_force(spark):
    rng = random.Random(3)
    bits = ["1", "12", "255", "256", ".", ".", "@", "a", "b-", "x.com", "+1", " ", "-", "(", "é", "4111111111111111", "\u0001", "555", "_", "%"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for i in range(400)]
    docs += [(900, None), (901, ""), (902, "a@b.c_d@e.f " * 3), (903, "9" * 30000), (904, "a" * 50000 + "@"), (905, "a@b" + ".c" * 20000), (906, "1." * 20000)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    got = {r[0]: (r[1], r[2]) for r in pii.find_pii(df).select("doc_id", pii.joined(F.col("base")), pii.joined(F.col("spans"))).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i][0] == brute_pii(t)
        assert set(filter(None, got[i][0].split(","))) <= set(filter(None, got[i][1].split(",")))
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_em_learns_which_labeler_lies():
    votes = [((1, 1, 1, -1), 400), ((-1, -1, 0, 1), 400), ((1, 1, 0, -1), 100), ((-1, -1, 0, -1), 100)]
    prior, table = pii.em(votes)
    assert 0.3 < prior < 0.7
    assert table[0][True][1] > 0.9 and table[3][True][1] < 0.5  # the last labeler votes against the others


def test_pii_adds_wide_spans(spark):
    docs = [(i, f"write to ann{i}@mail.example.com or call +1 (415) 555-{1000 + i} now. pay 4111111111111111 from 10.0.0.{i}") for i in range(60)]
    docs += [(100 + i, f"build 999999999999{i} version 300.1.2.{i} x") for i in range(60)] + [(500, "call (415) 555-1234 now"), (501, "mail joe [at] mail [dot] example.com now")]
    got = {r[0]: r[1] for r in pii.find_pii(spark.createDataFrame(docs, "doc_id long, text string")).select("doc_id", pii.joined(F.col("spans"))).collect()}
    assert got[500] == "phone:5:19" and got[501] == "email:5:36" and got[100] == ""


def test_toxicity_decodes_learns_and_generalises(spark):
    rng = random.Random(5)
    clean, bad = ["the", "and", "house", "water", "green", "street", "paper", "window", "idea", "model"], ["idiot", "moron", "stupid", "trash"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = [rng.choice(clean) for _ in range(30)] + ([rng.choice(bad) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(2000, "the m0r0n and s t u p i d 1diot of the house"), (2001, None), (2002, ""), (2003, "water " * 5000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, held_out=toxicity.in_held_out())
    assert model.channel.decode("m0r0n") == "moron" and model.channel.decode("stuuupid") == "stupid"
    got = {r.doc_id: r for r in toxicity.toxicity(docs, model).join(docs.select("doc_id", toxicity.in_held_out().alias("held")), "doc_id").collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held]
    assert len(held) > 200 and sum(p == t for p, t in held) / len(held) > 0.97
    assert got[2000].predicted == 1 and all(got[i].predicted == 0 for i in (2001, 2002, 2003))
    assert toxicity.drop_toxic(docs.filter("doc_id >= 2000"), model).count() == 3
    assert toxicity.toxicity(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, marks.limit(0))
    assert 0 <= toxicity.toxicity(docs, none).first().score <= 1


def test_toxicity_restores_text():
    channel = toxicity.Channel({"^^m": 9, "^mo": 9, "mor": 9, "oro": 9, "ron": 9, "on$": 9})
    assert toxicity.restore("A m.o.r.o.n, plain!", channel) == "a moron plain"


def test_toxicity_reads_whole_tokens():
    counts = {}
    for w in ("when", "you", "come", "over", "here", "tomorrow", "morning", "are", "stupid", "idiot"):
        for i in range(len(w) + 1):
            g = f"^^{w}$"[i : i + 3]
            counts[g] = counts.get(g, 0) + 9
    channel = toxicity.Channel(counts)
    said = "whenyoucomeoverheretomorrowmorningyouareastupididiot"
    assert toxicity.restore(" ".join(said), channel) == said
    assert toxicity.restore("s" * 70 + "tupid1diot", channel).endswith("tupididiot")
    assert len(channel.decode("a1b" * 20_000)) == 60_000
    model = toxicity.Model(channel, {"idio": 5.0}, [-4.0, 2.0, 0.0, 0.0, 0.0])
    assert model.score(" ".join(said)) > 0.9 and model.score(said) > 0.9 and model.score("世界" * 30 + "idiot") > 0.9
    assert model.score("whenyoucomeoverhere" * 5) < 0.1


@pytest.mark.parametrize("page", [
    "<ul><li>" * 2000 + "x<br>" * 2000, '<a "' * 16000, '<a "' * 16000 + "'>", "<a \"'" * 12000 + ">", "<a " * 22000, "</1" * 22000, "<ul><li>" * 8000 + "x", "<ol>" + "<li>a" * 10000,
])
def test_html_of_64_kb_takes_a_second_and_stays_in_proportion(page):
    began = time.process_time()
    text = html_to_text(page)
    assert time.process_time() - began < 1 and len(text) <= 16 * len(page)
    assert text.count("x") == (page.count("x") if "x<br>" in page else text.count("x"))


def test_html_lists_keep_their_markers_and_lines():
    assert html_to_text("<ol start=9><li>a<br><br>b<ul><li>c<p>d</p><li></ul><li><ul><li>e</ul></ol>z") == "9. a\n   b\n   - c\n     d\n   -\n10. - e\n\nz"
    assert html_to_text("p<ul><li><p>a</p><table><tr><td>1<td>2</table></ul>") == "p\n\n- a\n  1  2"


@pytest.mark.parametrize("page, text", [
    ('<p style="--x-display: none">a</p>', "a"), ("<p style=\"content:'display:none'\">a</p>", "a"), ('<p style="DISPLAY : none !important">a</p>x', "x"), ('<p style="color:red;/* x */display:none">a</p>y', "y"),
    ('<div style="visibility:hidden">a<b style="visibility: visible">b</b></div>c', "b\nc"), ('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b</ul>', "- b"),
    ('<table style="visibility:hidden"><tr><td>a<td style="visibility:visible">b</table>', "b"), ("<video>no</video>yes", "yes"),
])
def test_html_styles(page, text):
    assert html_to_text(page).strip() == text
