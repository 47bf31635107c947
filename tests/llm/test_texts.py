"""Fingerprints, HTML extraction, license templates and decontamination."""

import hashlib
import html as html_lib
import random
import re
import time
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexsieve.llm import decontaminate, html_cut, licenses, merkle, rolling
from tests.llm.conftest import SCHEMA, rows_of, sentence


def tree(text):
    """The fingerprint of a text by plain recursion, with its distinct leaves."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pieces = [p for p in re.split(r"(?<=\n)|(?<=[.!?] )", text) if p]
    entries = [f"{sha(p)}:{len(p)}" + ("\n" if p.endswith("\n") else " ") for p in pieces]
    paragraphs = [sha(p) for p in "".join(entries).split("\n") if p]
    sections = [s for s in "".join(d + (";" if d[-1] in "08" else ",") for d in paragraphs).split(";") if s]
    leaves = [f"{e[:12]}:{len(p)}" for e, p in zip(entries, pieces, strict=True)]
    shown = ";".join(",".join(d[:12] for d in s.split(",") if d) for s in sections)
    return "|".join([sha(",".join(map(sha, sections))), ",".join(sha(s)[:12] for s in sections), shown, ",".join(leaves)]), set(leaves)


def alike(a, b):
    weigh = lambda s: sum(int(x.split(":")[1]) for x in s)
    return weigh(a & b) / weigh(a | b) if weigh(a | b) else 1.0


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_match_plain_recursion(spark, edge_docs, parts, monkeypatch):
    monkeypatch.setattr(merkle, "partitions", lambda _: parts)
    found = merkle.edited_fingerprints(edge_docs).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in edge_docs.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for k, (i, text) in enumerate(rows):
        follow, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - half] + follow[:half]
        (own, leaves), (other, edited_leaves), (_, next_leaves) = tree(text), tree(edited), tree(follow)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, alike(leaves, edited_leaves), alike(leaves, next_leaves)))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


def test_fingerprint_plan_is_native(edge_docs, no_docs):
    plan = merkle.edited_fingerprints(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert merkle.edited_fingerprints(no_docs).count() == 0


def test_differing_branches_locate_edits(spark):
    paragraphs = [f"Paragraph {k} says this. And that.\n" for k in range(30)]
    edited = paragraphs[:12] + ["A new one.\n"] + paragraphs[13:20] + paragraphs[21:]
    docs = spark.createDataFrame(rows_of(["".join(paragraphs), "".join(edited)]), SCHEMA)
    a, b = (r["fingerprint"] for r in merkle.fingerprints(docs).orderBy("doc_id").collect())
    row = merkle.differing_paragraphs(spark.createDataFrame([(a, b), (a, a)], "a string, b string"), "a", "b").collect()
    assert (row[0]["a_edits"], row[0]["b_edits"]) == ([12, 20], [12]) and row[1]["a_edits"] == row[1]["b_edits"] == []


PAGE = """<html><head><title>T</title></head><body><header><h1>Site</h1><a href=x>home</a></header>
<div class="cookie-banner">We use cookies</div><div id="content"><h1>Title &amp; more</h1>
<p>First para, quite long text. It has sentences, and more.</p><div class="ad-box">Buy now!</div><p>Second   para
 with <a href="#">link</a> &eacute; and <i>it</i>.</p><script>var x = "<p>no</p>";</script><!-- <p>nor this</p> --><ul><li>item one<li>item two</ul>
<form>name <input></form></div><aside>side</aside><div class="comments"><p>I agree. Nice long comment, with text.</p></div><footer>(c)</footer>"""
NEUTRAL = np.zeros(html_cut.FEATURES)


def test_main_text_of_a_page():
    assert html_cut.main_text(PAGE, NEUTRAL) == (
        "Title & more\n\nFirst para, quite long text. It has sentences, and more.\n\nSecond para with link é and it.\n\nitem one\n\nitem two")
    assert html_cut.main_text("", NEUTRAL) == html_cut.main_text("<nav>menu</nav>", NEUTRAL) == ""
    assert html_cut.main_text("<article><p>a<p>b &lt;p&gt; <b>c<br>d<p>e</article><p unclosed='x>f", NEUTRAL).startswith("a\n\nb <p> c d\n\ne")


def test_minimum_cut_is_the_cheapest_labelling():
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 9):
        for _ in range(15):
            content, other = rng.random(n), rng.random(n)
            edges = [(int(a), int(b), float(rng.random() * 0.6)) for a, b in rng.integers(0, n, (2 * n, 2)) if a != b]
            cost = lambda keep: sum(other[i] if k else content[i] for i, k in enumerate(keep)) + sum(
                w for a, b, w in edges if keep[a] != keep[b])
            best = min(cost(k) for k in product((False, True), repeat=n))
            assert abs(cost(html_cut.minimum_cut(content, other, edges)) - best) < 1e-6


def test_pages_are_extracted_exactly(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(60):
        parts = [sentence(rng, rng.randint(1, 40)) + rng.choice([".", " & x.", " <b."]) for _ in range(rng.randint(0, 6))]
        body = "".join(f"<p>{html_lib.escape(p)}</p>" for p in parts)
        rows.append((k, f"u{k}", f"<body><nav><ul><li><a href=/>home</a></li></ul></nav><div class=ad>{sentence(rng, 9)}.</div>"
                                 f"<article><h1>Head {k}</h1>{body}</article><footer>&copy; {sentence(rng, 4)}.</footer>"))
        want[k] = "\n\n".join([f"Head {k}", *parts])
    pages = spark.createDataFrame([*rows, (60, None, None), (None, "u", ""), rows[0]], "page_id long, url string, html string")
    weights = html_cut.train_blocks(pages)
    assert weights.any()
    found = html_cut.extract_text(pages, weights).collect()
    assert len(found) == 63 and all(r["n_chars"] == len(r["text"]) for r in found)
    assert {r["page_id"]: r["text"] for r in found if r["page_id"] is not None} == want | {60: ""}
    none = pages.limit(0)
    assert not html_cut.train_blocks(none).any() and html_cut.extract_text(none, NEUTRAL).count() == 0
    # the classifier alone, on pages without telling markup
    plain = "<div><a href=/>home</a> <a href=/>more</a></div><div>" + rows[5][2].split("<article>")[1].split("</article>")[0] + "</div>"
    assert html_cut.main_text(plain, weights).count("home") == 0


def test_automata_and_patterns_accept_the_same():
    con, rng = duckdb.connect(), random.Random(7)
    for template in [t for group in licenses.TEMPLATES.values() for t in group] + ["a [b [c] {2}] d e", "{1} x y [z]"]:
        automaton, pattern = licenses.compiled(template), licenses.template_pattern(template)
        words = re.findall(r"[^\s\[\]{}]+", re.sub(r"\{\d+\}", "q", template))
        for _ in range(12):
            run = [w for w in words if rng.random() < 0.9] if rng.random() < 0.7 else list(words)
            text = " ".join(run) + " "
            own = any(automaton.match(run, k) is not None for k in range(len(run)))
            assert own == con.execute("SELECT regexp_matches(' ' || ?, ?)", [text, " " + pattern]).fetchall()[0][0] or automaton.match([], 0) is not None


def test_license_scan(spark, edge_docs, no_docs):
    texts = ["Released under the MIT License.", "the mit, license!", "Licensed under the Apache License, Version 2.0. MIT License; mit LICENSE",
             "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "mitlicense general public", "mit ölicense",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and its files to deal in the Software without "
             "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this program to deal in the Software"]
    found = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect()}
    assert found[0] == (5, 1, 3, 3, "mit", "mit", 1.0) and found[1] == (3, 1, 1, 1, "mit", "mit", 0.5)
    assert found[2] == (12, 3, 3, 10, "apache,mit", "apache,mit", 1.0) and found[3] == (7, 0, None, None, "", "cc-by-nc", 1.0)
    assert found[4] == (12, 1, 7, 7, "gpl", "gpl", 1.0) and found[5][1:] == (0, None, None, "", "", 0.0) == found[6][1:]
    assert found[7][5:] == ("mit", 0.75) and found[8][5:] == ("", 0.0)  # an opening alone is the weaker level
    rows = licenses.scan_licenses(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all((r["first_word"] is None) == (r["n_base"] == 0) for r in rows)
    assert licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError, match="unclosed"):
        licenses.compiled("a [b")


# Public license texts as they are published.
MIT = """Copyright (c) 2020 Ann Lee

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
MIT_0 = re.sub(r", subject to the.*?portions of the Software\.", ".", MIT, flags=re.S)
ISC = """Copyright 2021 Bo

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZERO_BSD = re.sub(r", provided that.*?all copies\.", ".", ISC, flags=re.S)
BSD_3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
BSD_2 = re.sub(r"3\. Neither.*?permission\.\n\n", "", BSD_3, flags=re.S)
BSD_4 = BSD_3.replace("3. Neither", """3. All advertising materials mentioning features or use of this software must display the following acknowledgement:
This product includes software developed by the Example Project.

4. Neither""")
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LGPL = GPL.replace("General Public", "Lesser General Public").replace("This program", "This library")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
can obtain one at https://mozilla.org/MPL/2.0/."""


def test_whole_notices_are_told_apart_and_one_altered_word_loses_them(spark):
    whole = {"mit": MIT, "mit-0": MIT_0, "isc": ISC, "0bsd": ZERO_BSD, "bsd-2-clause": BSD_2, "bsd-3-clause": BSD_3, "bsd-4-clause": BSD_4,
             "apache-2.0": APACHE, "gpl-notice": GPL, "lgpl-notice": LGPL, "mpl-2.0": MPL}
    altered = {"mit": "substantial", "mit-0": "furnished", "isc": "appear", "0bsd": "PERFORMANCE", "bsd-2-clause": "retain", "bsd-3-clause": "endorse",
               "bsd-4-clause": "acknowledgement", "apache-2.0": "governing", "gpl-notice": "useful", "lgpl-notice": "useful", "mpl-2.0": "obtain"}
    texts = ["// header\n" + t + "\nint main() {}" for t in whole.values()] + [whole[n].replace(w, "paid", 1) for n, w in altered.items()]
    found = [r for r in sorted(licenses.scan_licenses(spark.createDataFrame(rows_of(texts), SCHEMA)).collect(), key=lambda r: r["doc_id"])]
    for r, name in zip(found, whole):
        assert set(r["labels"].split(",")) - {"apache", "gpl"} == {name} and r["score"] == 1.0, (name, r["labels"])
    for r, name in zip(found[len(whole):], altered):
        assert name not in r["labels"].split(",") or (name, r["score"]) in {("mit", 0.75), ("isc", 0.75)}, (name, r["labels"])
        family = licenses.NOTICES[name][0]
        assert family in r["labels"].split(","), (name, r["labels"])
    assert all(r["score"] <= 0.75 for r, name in zip(found[len(whole):], altered) if name != "apache-2.0")


def test_templates_get_typed_slots():
    data, offsets = rolling.text_buffer(pa.array(["Yesterday Anna Smith drove 1,250.5 km in 3 hours. Bob ran ten m."]))
    words, kind, _ = decontaminate.canonical(data, offsets)
    assert [words.text(i).decode() for i in range(len(kind))] == ["Yesterday", "Anna Smith", "drove", "1,250.5", "km", "in", "3", "hours", "Bob", "ran", "ten", "m"]
    assert kind.tolist() == [0, 2, 0, 1, 3, 0, 1, 3, 0, 0, 1, 3]


QUESTION = "A train leaves with Anna at 40 km per hour and Anna meets Ben after 40 minutes so how far did the train go"


def test_reparameterised_questions_are_caught(spark, edge_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, QUESTION), (2, "two words"), (3, None), (4, "this item has only six words"), (None, QUESTION), (5, "")],
                                  "item_id long, text string")
    rng = random.Random(3)
    noise = lambda: sentence(rng, 20)
    texts = [noise() + " " + QUESTION + " " + noise(),
             noise() + " " + QUESTION.replace("40", "75").replace("Anna", "Zoe").replace("Ben", "Max") + ". " + noise(),
             noise() + " " + QUESTION.replace("at 40", "at 75") + " " + noise(),  # one slot value became two
             noise(), None, "", "well this item has only six words indeed", "two words", " ".join(QUESTION.split()[:9])]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA)
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(docs.union(docs.limit(1)), items).collect()}
        assert set(found) == {(0, 1), (1, 1), (6, 4)}
        assert found[0, 1]["same_values"] and not found[1, 1]["same_values"] and found[1, 1]["coverage"] > 0.9
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 5, 7, 8}
    assert decontaminate.leaks(edge_docs, items).count() == 0
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0
    assert decontaminate.without_leaks(edge_docs, items).where(F.col("doc_id").isNull()).count() == 1


def leaking(spark, texts, items, **options):
    found = decontaminate.leaks(spark.createDataFrame(rows_of(texts), SCHEMA), spark.createDataFrame(items, "item_id long, text string"), **options)
    return {(r["doc_id"], r["item_id"]): r for r in found.collect()}


def test_altered_copies_are_caught(spark):
    words = QUESTION.split()
    item = "the red box holds 2 small balls while the other box holds 3 large balls so which box is the heavier one now"
    texts = [QUESTION.replace("at 40", "at 75"),  # one of two occurrences changed
             item.replace("2", "4").replace("3", "4"),  # new values coincide
             " ".join([*words[:8], "quite", *words[8:]]),  # a word inserted
             " ".join([*words[:13], *words[14:]]).replace("40", "twenty five").replace("Anna", "Zoe"),
             " ".join(words[12:] + words[:12]),  # parts in the other order
             QUESTION.replace("at 40", "at 75").replace("with Anna", "with Zoe")[:60]]
    found = leaking(spark, texts, [(1, QUESTION), (2, item)], conflicts="cut")
    assert set(found) == {(0, 1), (1, 2), (2, 1), (3, 1), (4, 1)}
    assert 0.6 < found[0, 1]["coverage"] < 1 and found[0, 1]["same_values"] and found[1, 2]["coverage"] == 1 and not found[1, 2]["same_values"]
    assert found[2, 1]["coverage"] == 1 and found[3, 1]["coverage"] > 0.9 and found[4, 1]["coverage"] < 0.6
    assert set(leaking(spark, texts, [(1, QUESTION), (2, item)])) == {(1, 2), (2, 1), (3, 1), (4, 1)}
    with pytest.raises(ValueError, match="conflicts"):
        leaking(spark, texts, [(1, QUESTION)], conflicts="none")


def test_chains_agree_on_their_values():
    a = np.array
    runs = a([0, 8, 16]), a([8, 16, 24]), a([0, 9, 30])
    assert decontaminate.best_chain(*runs, a([True, True, True]), [{}, {}, {}]) == (24, True, 0, 38)
    assert decontaminate.best_chain(*runs, a([True, False, False]), [{}, {5: 6}, {5: 7}]) == (16, False, 0, 38)
    assert decontaminate.best_chain(a([0, 6]), a([8, 14]), a([0, 7]), a([True, True]), [{}, {}]) == (14, True, 0, 15)


def test_sentence_openers_and_dense_items_are_caught(spark):
    story = "Tom had 5 apples. Tom ate 2. Tom gave 1 pear to Ann. Tom has how many apples?"
    numbers = "which of these numbers is the largest: " + ", ".join(str(k * k + 17) for k in range(20))
    other = "which of these numbers is the largest: " + ", ".join(str(k * k + 500) for k in range(20))
    people = "Alan Turing, Grace Hopper, Ada Lovelace, Kurt Godel, Emmy Noether, Max Born, Lise Meitner, Niels Bohr, Paul Dirac, Otto Hahn"
    texts = ["x y. " + story.replace("Tom", "Sue").replace("5", "9"), "so " + numbers, "They met: " + people, "and " + other,
             "Sue had 5 apples. Max ate 2. Joe gave 1 pear to Ann. Eva has how many apples?", "Tom Sue Max 3 4 5 6 7 8 9 10 11", story]
    items = [(1, story), (2, numbers), (3, people)]
    found = leaking(spark, texts, items, conflicts="cut")
    assert {(0, 1), (1, 2), (2, 3), (6, 1)} <= set(found) <= {(0, 1), (1, 2), (2, 3), (4, 1), (6, 1)}
    assert not found[0, 1]["same_values"] and all(found[k]["same_values"] and found[k]["coverage"] > 0.9 for k in [(1, 2), (2, 3), (6, 1)])
    assert {(0, 1), (1, 2), (2, 3), (6, 1)} <= set(leaking(spark, texts, items))


@pytest.mark.parametrize("wrapper", ["content-sidebar-wrap", "site has-sidebar", "layout header-fixed"])
def test_one_class_word_of_a_wrapper_can_be_outvoted(wrapper):
    text = "<h1>Title</h1><p>First para, quite long text.</p><div class=ad>Buy now!</div><p>It has <math><mi>x</mi><mo>+</mo><mn>2</mn></math> in it.</p>"
    want = "Title\n\nFirst para, quite long text.\n\nIt has x+2 in it."
    for tag in ("main class=content", "article"):
        page = f"<body><nav>menu</nav><div class='{wrapper}'><{tag}>{text}</{tag.split()[0]}><div class=comments><article class=comment>I agree.</article></div></div>"
        assert html_cut.main_text(page, NEUTRAL) == want
    # the classifier alone outvotes the word, but not an element
    sure = np.zeros(html_cut.FEATURES)
    sure[3] = 12.0  # punctuation
    page = f"<div class='{wrapper}'><p>First, quite long: text. It goes on, and on.</p><p>More</p></div>"
    assert html_cut.main_text(page, sure).startswith("First, quite long") and html_cut.main_text(page, NEUTRAL) == ""
    assert html_cut.main_text(f"<nav>{page}</nav>", sure) == ""


@pytest.mark.parametrize("page", [
    "a <b c " * 150_000, "a <b c " * 60_000 + ">", "<div>word, text here. " * 50_000, "<div>" * 50_000 + "text", "<a \"x> t " * 60_000, "<a '\" > t " * 60_000,
    "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000 + "x", "<div>" * 50_000 + "</x>" * 50_000, "<script>x" + "</script " * 60_000, "<!--" * 100_000,
    "<td>" * 30_000 + "<p>" * 30_000])
def test_odd_long_pages_take_linear_time(page):
    start = time.perf_counter()
    html_cut.main_text(page, html_cut.neutral())
    assert time.perf_counter() - start < 5


def test_article_and_main_outweigh_what_is_around_them():
    cut = lambda page: html_cut.main_text(page, html_cut.neutral())
    body = "<p>Some longer text, of many words. And more of it.</p>"
    text = "Some longer text, of many words. And more of it."
    assert cut(f"<form id=aspnetForm><nav>a b</nav><main><article><h1>Title</h1>{body}</article></main></form>") == "Title\n\n" + text
    assert cut(f"<header>Site</header><article><header><h1>Title</h1></header>{body}</article><footer>end</footer>") == "Title\n\n" + text
    assert cut(f"<div role=dialog><main>{body}</main></div>") == text
    assert cut(f"<div class='content-sidebar-wrap'><main class=content>{body}</main><aside>side</aside></div>") == text
    assert cut(f"<div hidden><article>{body}</article></div><p>Plain, open text.</p>") == "Plain, open text."
    assert cut(body) == text and cut("1 < 2 and a <b") == "1 < 2 and a <b"
    assert cut(f"<article>{body}<form>Your name</form><section class=comments><p>I disagree, said a reader.</p></section></article>") == text


def test_pages_with_clashing_columns(spark):
    rows = [(1, "u", "<p>One, two words here.</p>", "x", 2.0), (1, "u", "<p>One, two words here.</p>", "x", 2.0), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, page string, text double")
    found = html_cut.extract_text(pages, html_cut.train_blocks(pages)).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in found) == [("1", "One, two words here.", 20)] * 2 + [("None", "", 0)]
