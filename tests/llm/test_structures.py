"""Conversations, the manifest and page texts against plain readings, with the cases that their docstrings name."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import conversations as C
from corpusloom.llm import html_text as H
from corpusloom.llm import manifest as M
from tests.llm import brute as B

SF_DIR = "/root/testdata/sf0.001"
CONVERSATION = "conv_id long, turn long, role string, text string"


# --- conversations

def expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, *rest in B.damage(rows):
        by[conv].append(rest)
    return {c: B.repair(v) if v else (0, 0, 0, 0, 0, 0, "", B.sha("")) for c, v in by.items()}


def reported(frame):
    return {r[0]: tuple(r[1:]) for r in C.report(frame).collect()}


def odd_conversations():
    rnd = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "aide"]
    texts = ["", "  \n", "Hi.", "Yes", "No?", "ok \n", "Ä。", None, "a\nb!", "x" * 50_000 + "."]
    rows = [(c, rnd.choice([None, t, t, t, t + 3, 0]), rnd.choice(roles), rnd.choice(texts))
            for c in [None, *range(40)] for t in range(rnd.choice([0, 1, 2, 5, 9, 30]))]
    # One conversation far longer than a piece, over several partitions, with rows that come back and rows that repeat.
    rows += [(777, i // 2, "user" if i % 3 else "assistant", f"t{i % 50}.") for i in range(900)]
    return rows + [(778, 4, "user", "again.")] * 300


def test_conversations_of_all_kinds(spark):
    rows = odd_conversations()
    frame = spark.createDataFrame(rows, CONVERSATION).withColumns({"cost": F.lit("x"), "conv": F.lit(1), "no": F.lit(2)})
    assert reported(frame) == expected(rows)


def test_conversations_of_the_table(spark):
    frame = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    assert reported(frame) == expected([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_no_conversations(spark):
    assert reported(spark.createDataFrame([], CONVERSATION)) == {}
    # Conversation 18 loses its only row.
    lost = next(c for c in range(1000) if not B.damage([(c, 0, "user", "x")]))
    assert reported(spark.createDataFrame([(lost, 0, "user", "x")], CONVERSATION)) == {lost: (0, 0, 0, 0, 0, 0, "", B.sha(""))}


def test_edits_hold_the_repaired_rows_in_order(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "assistant", "b"), (1, 2, "tool", ""), (2, 0, "system", "s."), (2, 1, "user", "u.")]
    found = [tuple(r) for r in C.repair(spark.createDataFrame(rows, CONVERSATION), piece=1).select(
        "conv", "turn", "edit", "fault", "old_role", "role", "text").collect()]
    assert [r for r in found if r[0] == 2] == [
        (2, 0, "K", "", "system", "system", "s."), (2, 1, "K", "", "user", "user", "u."), (2, None, "I", None, None, "assistant", "")]
    assert [r[2] for r in found if r[0] == 1] == list(B.repair([r[1:] for r in rows if r[0] == 1])[6])


@pytest.mark.parametrize("rounds", [[], [["EI", "AE"]], [["EI", "IE"[::-1]], [chr(0x100) + chr(0x100)]]])
def test_a_grammar_changes_nothing_but_the_work(rounds):
    rnd = random.Random(5)
    grammar = C.Grammar([sorted(set(r)) for r in rounds])
    matrices = grammar.matrices()
    for _ in range(200):
        text = "".join(rnd.choice("EIEIEIABFJGHMO") for _ in range(rnd.randrange(1, 9)))
        whole = plain = None
        for symbol in grammar.compressed(text):
            whole = matrices[symbol] if whole is None else C.product(whole, matrices[symbol])
        for letter in text:
            plain = C.of_letter(letter) if plain is None else C.product(plain, C.of_letter(letter))
        assert {k: (c, C.flat(r)) for k, (c, r) in whole.items()} == {k: (c, C.flat(r)) for k, (c, r) in plain.items()}


def test_the_grammar_is_learned_from_all_strings(spark):
    strings = spark.createDataFrame([("EIEIEIEI",), ("EIEI",), ("MEI",)], "symbols string")
    grammar = C.grammar_of(strings)
    assert len(grammar.compressed("EIEIEIEI")) <= 2 and grammar.size <= C.RULES
    assert C.grammar_of(strings.limit(0)).size == 0
    assert C.grammar_of(strings, limit=1).size == 1


# --- manifest

DOCUMENT = "doc_id long, source string, lang string, n_chars long, text string"


def by_all(rows):
    return sorted(rows, key=repr)


def test_manifest_of_all_kinds_of_rows(spark):
    rows = [(i if i % 7 else None, ["a", None, "", "é", "z", "="][min(5, i // 9)], "en", i, None if i % 3 else "x\ny") for i in range(64)]
    rows += [(5, "a", "de", 1, "t\nu")] * 4 + [(5, "a", "de", 1, "t" * 100_000)]
    frame = spark.createDataFrame(rows, DOCUMENT).withColumns({"leaf": F.lit("x"), "key": F.lit(1), "place": F.lit(2)})
    found = [tuple(r) for r in M.report(frame).collect()]
    assert by_all(found) == by_all(B.manifest(rows))
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("count", [0, 1, 3, 10])
def test_small_manifests(spark, count):
    rows = [(i, "only", None, None, "text") for i in range(count)]
    assert by_all(tuple(r) for r in M.report(spark.createDataFrame(rows, DOCUMENT)).collect()) == by_all(B.manifest(rows))


def test_manifest_of_the_table(spark):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [tuple(r) for r in frame.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert by_all(tuple(r) for r in M.report(frame).collect()) == by_all(B.manifest(rows))


def test_places_by_range(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise("cold").alias("key"), (F.col("id") * 37 % 1000 % 90).alias("v"))
    got = M.ranked(rows.repartition(7), "key", [F.col("v")]).collect()
    for key, size in (("hot", 700), ("cold", 300)):
        mine = sorted((r for r in got if r["key"] == key), key=lambda r: r["place"])
        assert [r["place"] for r in mine] == list(range(size)) and {r["n"] for r in mine} == {size}
        assert [r["v"] for r in mine] == sorted(r["v"] for r in mine)


# --- page texts

LISTS = [frozenset(words.split()) for words in H.STOP_WORDS.values()]
PROSE = "The reading of a text is not the same as the writing of it, and the people who do it for the first time know that it is so. "


def texts(page):
    return H.main_blocks(page, LISTS)


def by_cutting(page):
    """The given pages read another way: what stands in the article, cut at its blocks."""
    inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|$)", page, re.DOTALL)[1])
    blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in H.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    plain = {r.page_id: by_cutting(r.html) for r in pages.collect()}
    assert {i: r.text for i, r in found.items()} == plain
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (2, "u", "  \n "), (3, None, "<p>"), (4, "u", "plain &amp; simple &am"), (None, "u", "<!-- open <p>x"),
             (5, "u", "<article>" + "<p>word" * 200_000), (6, "u", "<p>ok</p><scr"), (7, "u", "<title>t</title><script>if (a<b) x='</p>'")]
    found = H.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [(r.page_id, r.n_chars) for r in found] == [
        (1, 0), (2, 0), (2, 0), (3, 0), (4, 18), (None, 0), (5, 200_000 * 6 - 2), (6, 2), (7, 0)]
    assert found[4].text == "plain & simple &am" and found[7].text == "ok"
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_rules_without_an_article():
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(9)) + "</ul>"
    page = f"""<body><div class="topbar">Sign in here</div>{menu}<h1>A title</h1><div>{PROSE * 2}</div><p>Short.</p>
      <p>{PROSE * 3}</p><p>Too short to tell.</p>{menu}<div>All rights reserved somewhere</div></body>"""
    # A heading looks ahead; between text and a menu a short block goes with the menu.
    assert texts(page) == ["A title", " ".join((PROSE * 2).split()), "Short.", " ".join((PROSE * 3).split())]
    # Long blocks without stop words are no prose; a page of short blocks only is kept.
    assert texts(f"<p>{PROSE * 3}</p><div>{'zzyx qwop ' * 40}</div>") == [" ".join((PROSE * 3).split())]
    assert texts("<p>Hello</p><nav>Menu</nav><p>World</p>") == ["Hello", "World"]


def test_places_that_are_removed():
    inside = "<p>One.</p><aside>side</aside><div class='share-box'>share</div><p>Two <span class='ad'>buy</span> words.</p><form><p>mail</p></form>"
    page = (f"<header><h1>Site</h1></header><div id='cookie-notice'>{PROSE * 3}</div><div class='has-sidebar'><article><header><h2>Head</h2></header>"
            f"{inside}<div class='comments'><article><p>{PROSE * 3}</p></article></div></article></div><div class='sidebar'>{PROSE * 3}</div>"
            f"<section><p>{PROSE * 3}</p></section><footer>{PROSE * 3}")
    assert texts(page) == ["Head", "One.", "Two words."]
    # A form around the whole page and a frame named after its sidebar do not hide the article in them.
    assert texts(f"<form><div class='content sidebar'><main><p>Text</p></main></div></form>") == ["Text"]


def test_broken_markup():
    page = "<article><p><b>one<br><p>two < three<p title='>'>four&nbsp;&lt;b&gt; &copy &#x41;</i></div><ul><li>five<li><a href=x>six</a> and more words<td>seven</article>"
    assert texts(page) == ["one", "two < three", "four <b> © A", "five", "six and more words", "seven"]
    assert texts("<article><p>a <a href='x'>never closed<p>b</article>") == ["a never closed", "b"]
    assert texts("<article><svg><text>x</text></svg><p>y<!-- z --><!----> w</article>") == ["y w"]
