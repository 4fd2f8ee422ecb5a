"""Operators 2, 3, 7, 8 and 9, and the pipeline."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphmill.llm import bpe, html_wrappers, language_id, license_scan, media_chunks, queries, url_filter
from tests.llm.helpers import ODD, SF, documents
from tests.llm.test_duplicates import WORD, brute_components, brute_hits, lower

PAGES = "page_id bigint, url string, html string"


def shell(body, k):
    return f'<html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a><li>More {k}</ul></nav><div class="ad">Buy {k}</div><article><h1>Title {k}</h1>{body}<span>Print this</span></article><div id="comments"><p>Nice {k}</p></div><form>Mail <input></form><aside>side</aside><footer>&copy; x</footer></body>'


def test_main_text_of_a_host(spark):
    bodies = ["<p>One &amp; <b>two</b>\n three.<p>Four<br>five</p>", "<p>Only   this.</p>", "<ul><li>a<li>b</ul><p>Last</p>", "<p>x &#233; y</p><!-- <p>no</p> --><p>z</p>", "<blockquote><p>q</p></blockquote>"]
    rows = [(k, "http://a.example.com/p", shell(b, k)) for k, b in enumerate(bodies)]
    rows += [(k, rows[0][1], shell(f"<p>filler {k}</p>", k)) for k in range(10, 60)]
    rows += [(90, None, shell("<p>alone</p>", 90)), (91, "http://b.org/", None), (92, "http://b.org/", ""), (93, "http://b.org/", "<p>cut <b>off &am"), (1, rows[1][1], rows[1][2]), (94, "http://c.org", "plain < text")]
    got = html_wrappers.extract_text(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1)).withColumn("text", F.lit("x"))).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(texts[k] == f"Title {k}\nfiller {k}" for k in range(10, 60))
    assert {k: t for k, t in texts.items() if not 10 <= k < 60} == {
        0: "Title 0\nOne & two three.\nFour\nfive", 1: "Title 1\nOnly this.", 2: "Title 2\na\nb\nLast", 3: "Title 3\nx é y\nz", 4: "Title 4\nq",
        90: "Title 90\nalone\nPrint this", 91: "", 92: "", 93: "cut off &am", 94: "plain < text",
    }
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_wrappers.extract_text(spark.createDataFrame([], PAGES)).count() == 0


def fits(children, nodes, w):
    """Brute force: whether nested page nodes can be read off a sequence of expression nodes, with all ways of skipping and repeating."""
    if not children:
        return not nodes
    c, rest = children[0], children[1:]
    if c in w.optional and fits(rest, nodes, w):
        return True
    ends = [0]
    for _ in range(len(nodes) if c in w.repeated else 1):
        ends = sorted({e for at in ends for e in one(c, nodes, at, w)})
        if any(fits(rest, nodes[e:], w) for e in ends):
            return True
    return False


def one(c, nodes, at, w):
    """Ends of one occurrence of an expression node from a place on."""
    head = w.heads[c]
    if head.startswith("("):
        return [e for e in range(at + 1, len(nodes) + 1) if fits(w.children[c], nodes[at:e], w)]
    return [at + 1] if at < len(nodes) and nodes[at][0] == head and (head == "#" or fits(w.children[c], nodes[at][1], w)) else []


def nested(tree, node=0):
    return [(tree.heads[k], nested(tree, k)) for k in tree.children[node]]


def test_wrappers_are_union_free_and_cover_their_sample():
    pages = [shell("<p>a</p>" * n + "<ul><li>x</ul>" * (n % 2) + "<h2>s</h2><p>t</p>" * (n % 3), n) for n in range(1, 7)]
    wrapper = html_wrappers.infer(pages)
    other = "<table><tr><td>x</td></tr></table>"
    for page in pages:
        assert fits(wrapper.children[0], nested(html_wrappers.parse(page)[0]), wrapper)
    assert not fits(wrapper.children[0], nested(html_wrappers.parse(other)[0]), wrapper)
    text = wrapper.expression()
    assert ")+" in text and ")?" in text and "|" not in text


def test_alignment_equals_brute_force():
    """Longest common subsequence by trying all subsets, with most of what is needed."""
    pick = random.Random(6)
    for _ in range(200):
        a, b = ([pick.choice("xyz") for _ in range(pick.randrange(6))] for _ in range(2))
        needed = [pick.random() < 0.5 for _ in a]
        found = html_wrappers._aligned(a, needed, b)
        assert [k for _, i, j, *_ in found for k in range(i, j)] == list(range(len(a))) and [k for *_, i, j in found for k in range(i, j)] == list(range(len(b)))
        kept = [k for same, i, j, *_ in found if same for k in range(i, j)]
        assert [a[k] for k in kept] == [b[k] for same, _, _, i, j in found if same for k in range(i, j)]

        def common(chosen):
            rest = iter(b)
            return all(a[k] in rest for k in chosen)

        best = max((len(c), sum(needed[k] for k in c)) for bits in range(1 << len(a)) for c in [[k for k in range(len(a)) if bits >> k & 1]] if common(c))
        if a != b:
            assert (len(kept), sum(needed[k] for k in kept)) == best


def test_random_pages_are_instances_of_their_wrapper():
    pick = random.Random(7)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else 'x'}</{t}>" for t in (pick.choice(["b", "i", "div"]) for _ in range(pick.randrange(4)))) or "t"

    for _ in range(60):
        pages = [some(2) for _ in range(pick.randrange(1, 4))]
        wrapper = html_wrappers.infer(pages)
        for page in pages:
            assert fits(wrapper.children[0], nested(html_wrappers.parse(page)[0]), wrapper)
            tree, texts = html_wrappers.parse(page)
            assert all(wrapper.heads[k] == "#" for k in wrapper.bind(tree, len(texts)) if k >= 0)


def test_the_expression_decides():
    pages = [f"<div><a href=/>Home</a><a href=/n>News</a></div><div>Story {k} of many<br>and more {k}</div><span>Print this</span><div>{'Sports' if k else 'News'}</div>" for k in range(3)]
    wrapper = html_wrappers.infer(pages)
    got = [html_wrappers.extract(p, wrapper) for p in pages]
    assert got == [f"Story {k} of many\nand more {k}\n{'Sports' if k else 'News'}" for k in range(3)]
    assert all(html_wrappers.extract(p, None) != t for p, t in zip(pages, got))
    empty = html_wrappers.Wrapper()
    empty.template = wrapper.template  # no expression, no slots
    assert all(html_wrappers.extract(p, empty) == html_wrappers.extract(p, None) for p in pages)
    copies = [pages[0]] * 3  # one article tells nothing
    assert html_wrappers.extract(pages[0], html_wrappers.infer(copies)) == html_wrappers.extract(pages[0], None)
    moved = pages[1].replace("Print this", "Print that")
    assert "Print that" in html_wrappers.extract(moved, wrapper)


def test_template_slots_are_counted_over_all_pages(spark):
    """A text that is the same in the sample only stays everywhere; wrappers joined to pages give what held ones give."""
    rows = [(k, "http://h.org/", f"<article><h1>T{k}</h1><div>{'News' if k != 777 else 'Sports'}</div><span>Print</span><p>text {k}</article>") for k in range(1000)]
    pages = spark.createDataFrame(rows, PAGES)
    want = {k: f"T{k}\n{'News' if k != 777 else 'Sports'}\ntext {k}" for k in range(1000)}
    assert {r.page_id: r.text for r in html_wrappers.extract_text(pages).collect()} == want
    held, html_wrappers.HELD_BYTES = html_wrappers.HELD_BYTES, -1
    try:
        assert {r.page_id: r.text for r in html_wrappers.extract_text(pages).collect()} == want
    finally:
        html_wrappers.HELD_BYTES = held


def test_broken_markup_never_fails():
    pick = random.Random(2)
    bits = ["<b>", "<p>", "</p>", "<div class='x'>", "</div>", "text &amp; ", "<li>", "<ul>", "</ul>", "<!--", "-->", "<script>", "</script>", "<a href='", '"', "<", ">", "&#x41;", "<article>", "</article>", "<nav>", "é"]
    for _ in range(150):
        page = "".join(pick.choice(bits) for _ in range(pick.choice([5, 50, 300])))
        html_wrappers.extract(page, html_wrappers.infer([page, page[::-1]]))
    deep = "<b><p>t" * 5000
    assert html_wrappers.extract(deep, html_wrappers.infer([deep])).count("t") == 5000


def test_skipped_elements_without_an_end_lose_nothing_else():
    for page, want in (
        ("<article><p>a</p><embed src=x><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><datalist id=d><option value=1>x<option value=2>y</datalist><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><select><option>x<option>y</select><p>b</p></article>", "a\nb"),
        ("<article><p>a</p><canvas>c</article><p>b</p>", "a"),
        ("<article><p>a</p><script>var b = '<p>c</p>'", "a"),
        ("<article><p>a</p><style>p {}", "a"),
    ):
        assert html_wrappers.extract(page, None) == want


def test_pages_give_back_their_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    same = total = 0
    for r in queries.op2_html_text(spark, SF).collect():
        text = docs.get(int(re.search(r"/(\d+)", r.url.split("/", 3)[3])[1]))
        if text is not None:
            total += 1
            same += r.text.split("\n")[1:] == [" ".join(x.split()) for x in text.split("\n") if x.strip()]
    assert total > 20 and same == total


def brute_rule(host, path):
    fits = [(rule, v) for rule, v in queries.URL_RULES for name, _, start in [rule.partition("/")] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def test_url_rules_and_model(spark):
    urls = [None, "", "nothing", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/", "http://x.org/fr/", "http://org/fr/a", "ftp://example.com/de/1", "http://notexample.com/de/1", "http://h?/p", "http://h#://x/y", "http://www.casino-win.example.com/en/1", "http://blog.theron.example.org/en/77", "http://ÉA.org/É"]
    rows = [(k, u, "") for k, u in enumerate([*urls, urls[4]])]
    got = url_filter.judge_urls(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(0)), queries.URL_RULES).collect()
    for r in got:
        host, path = url_filter.parts(dict((k, u) for k, u, _ in rows)[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.p_block >= 0.5 else "allow"))
    by = {r.page_id: r for r in got}
    assert (by[4].host, by[4].path, by[4].verdict) == ("a.example.net", "/en/x", "allow") and by[5].rule is None and by[6].verdict == "block"
    assert by[0].verdict == by[2].verdict == "allow" and by[13].verdict == "block" and by[14].verdict == "allow"


def test_url_model_on_held_out_words():
    """Rows that share a word of a blocked kind are held out together, and so are ordinary sites; what is left must tell them apart."""
    rows = url_filter.labelled_urls()
    assert all(url.count("://") == 1 for url, _ in rows) and len(set(rows)) == len(rows) and {y for _, y in rows} == {0, 1}
    model = url_filter.train()
    known = model.probabilities([url_filter.parts(u) for u, _ in rows]) >= 0.5
    assert np.mean(known == np.array([y for _, y in rows])) > 0.95
    right = total = 0
    for fold in range(5):  # by address: the sister of a blocked word stays
        rest = url_filter.train([r for k, r in enumerate(rows) if k % 5 != fold])
        held = rows[fold::5]
        right += int(((rest.probabilities([url_filter.parts(u) for u, _ in held]) >= 0.5) == np.array([y for _, y in held])).sum())
        total += len(held)
    assert right / total > 0.75
    unseen = [("www.bigcasino.example.org", "/bonus"), ("bestpoker.com", "/play"), ("townlibrary.example.com", "/en/4"), ("", ""), ("thther.example.org", "/en/685")]
    assert [bool(p) for p in model.probabilities(unseen) >= 0.5] == [True, True, False, False, False]


def test_url_model_equals_brute_force():
    """Probabilities one n-gram at a time, and that training ends where the loss has no slope."""
    model = url_filter.train()
    urls = [("", ""), ("a", "/"), ("éa.org", "/É/É/É"), ("x" * 5000 + ".com", "/y" * 9000), ("casino.net", "/win")]
    for (host, path), got in zip(urls, model.probabilities(urls)):
        z = model.bias
        for seed, text, share in ((1, f"^{host}$" if host else "", 1.0), (2, path.lower(), 0.25)):
            slots = set()
            for n in range(3, 7):
                for i in range(len(text) - n + 1):
                    h = seed
                    for c in text[i : i + n]:
                        h = (h * 0x100000001B3 + ord(c) + 1) % 2**64
                    slots.add((h * 0x9E3779B97F4A7C15 % 2**64 >> 40) % url_filter.DIMENSIONS)
            z += sum(model.weights[s] for s in slots) * share / max(1, len(slots)) ** 0.5
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-9
    rows = [("http://a.com/x", 1), ("http://b.com/y", 0), ("http://a.com/y", 1)]
    small = url_filter.train(rows, rounds=4000, decay=0.01)
    parts = [url_filter.parts(u) for u, _ in rows]

    def loss(w, bias):
        p = url_filter.LogisticModel(w, bias).probabilities(parts)
        y = np.array([y for _, y in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.005 * float((w**2).sum())

    least = loss(small.weights, small.bias)
    pick = np.random.default_rng(1)
    for _ in range(20):
        moved = np.where(small.weights != 0, pick.normal(0, 0.02, small.weights.size), 0)
        assert loss(small.weights + moved, small.bias + pick.normal(0, 0.02)) > least - 1e-9


def brute_base(text):
    words = WORD.findall(lower(text or ""))
    places = sorted((k, label) for phrase, label in license_scan.BASE for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p)
    at = [k for k, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    texts = [*ODD, "The MIT License. mit license, MIT-license!", "Licensed under the Apache License, Version 2.0.", "gnu general public license general public license version 3", "under the GNU Lesser General Public License, version 2.1", "permit license", "mit\nlicense mit licenses",
             "SPDX-License-Identifier: BSD", "Creative Commons Attribution ShareAlike license and cc0 license", "é mit license é", "x " * 3000 + "apache license", "All rights reserved", "mİt license linK"]
    rows = list(enumerate(texts)) + [(len(texts), texts[11]), (None, "mit license")]
    got = license_scan.scan_licenses(documents(spark, rows).withColumnRenamed("source", "n_base")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == sorted((str(k), *brute_base(t)) for k, t in rows)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    labels = {texts[r.doc_id]: r.labels for r in got if r.doc_id is not None and r.doc_id < len(texts)}
    assert [labels[t] for t in texts if t and ("BSD" in t or "Lesser" in t or "ShareAlike" in t)] == ["gpl,lgpl", "bsd", "cc-by-sa,cc0"]
    assert license_scan.scan_licenses(documents(spark, rows).limit(0)).count() == 0
    assert 200 < len(license_scan.rules()) and all(re.compile(p) for *_, p in license_scan.rules())


def matches_of(tree):
    """Texts that a parsed pattern matches: all alternatives and options, both ends of ranges."""
    out = [""]
    for op, av in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(av)]
        elif name == "IN":
            more = [chr(x) for kind, v in av for x in ([v] if str(kind) == "LITERAL" else v)]
        elif name == "BRANCH":
            more = [x for branch in av[1] for x in matches_of(branch)]
        elif name == "SUBPATTERN":
            more = matches_of(av[3])
        elif name == "MAX_REPEAT":
            more = [""] + matches_of(av[2])
        else:
            more = [""]  # what looks around
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_are_in_all_matches():
    assert len(license_scan.rules()) > 180
    for _, _, keyword, pattern in license_scan.rules():
        for text in matches_of(re._parser.parse(pattern)):
            assert re.search(pattern, f" {text} ") and keyword in text, (keyword, text)


def brute_licenses(text):
    words = WORD.findall(lower(text or ""))
    c = " " + "".join(w + " " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()))
    spans = [(m.start(), m.end(), p, label) for p, label, _, pattern in license_scan.rules() for m in re.finditer(pattern, c)]
    free = [x for x in spans if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and (y[1] - y[0]) > (x[1] - x[0])) for y in spans)]
    base = {label for phrase, label in license_scan.BASE for p in [phrase.split()] for k in range(len(words)) if words[k : k + len(p)] == p}
    return ",".join(sorted(base | {x[3] for x in free})), max([0.9 if base else 0.0, *(x[2] / 9 for x in free)])


def test_license_labels_equal_brute_force(spark):
    said = ["released under the gpl version 2", "Distributed under the Apache 2.0.", "published under the MIT", "under the terms of the MPL 2.0", "see http://www.apache.org/licenses/LICENSE-2.0.txt and https://www.gnu.org/licenses/gpl-3.0.html",
            "SPDX-License-Identifier: GPL-2.0-or-later", "licensed under the GNU General Public License version 2 or the MIT license", "GNU Lesser General Public License, version 2.1 and general public license", "all rights reserved. Permission is hereby granted, free of charge, to any person obtaining a copy"]
    pick = __import__("random").Random(4)
    texts = [*ODD, *said, " / ".join(said), *(" ".join(pick.choice(said).split()[k % 3 :] + ["x"]) + " " + pick.choice(said) for k in range(20))]
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in license_scan.scan_licenses(documents(spark, list(enumerate(texts)))).collect()}
    assert got == {k: (a, round(b, 6)) for k, t in enumerate(texts) for a, b in [brute_licenses(t)]}
    assert all(got[len(ODD) + k][0] for k in range(len(said)))
    rows = [(1, "It is distributed under the GPL."), (2, "Use under the terms of the GNU GPL version 2 only"), (3, "distributed under the bridge")]
    assert {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan_licenses(documents(spark, rows)).collect()} == {1: ("gpl", ""), 2: ("gpl", ""), 3: ("", "")}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.labels for r in license_scan.scan_licenses(docs).collect()}
    assert got == {r.doc_id: brute_licenses(r.text)[0] for r in docs.collect()}


def test_automaton_parses_greedily():
    pick = random.Random(3)
    for _ in range(60):
        train = [pick.randrange(3) for _ in range(pick.randrange(1, 40))]
        text = [pick.randrange(4) for _ in range(pick.randrange(1, 30))]
        go, n, now = language_id.suffix_automaton(train), 1, ()
        grams = {tuple(train[i:j]) for i in range(len(train)) for j in range(i + 1, len(train) + 1)}
        for c in text:
            if (*now, c) in grams:
                now = (*now, c)
            else:
                n += 1
                now = (c,) if (c,) in grams else ()
        assert language_id.phrases(go, text) == n
        model = language_id.Model({"x": ["abcab caab"]}, 1000)
        folded = model.fold("abc zz caab, B!")
        plain = language_id.suffix_automaton([*model.fold("abcab caab").tolist(), -1])
        assert round(model.rates([folded])[0, 0] * folded.size) == language_id.phrases(plain, folded.tolist())


def test_parse_goes_on_over_segments_and_knows_all_letters():
    pick = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(400)] + list("abcdefg ")
    texts = {"x": ["".join(pick.choice(letters) for _ in range(3000))], "y": ["".join(pick.choice("abc ") for _ in range(2000))], "z": ["ab" * 900]}
    model = language_id.Model(texts, 5000)
    plain = [language_id.suffix_automaton([*model.fold(texts[k][0]).tolist(), -1]) for k in model.langs]
    asked = ["ab" * 700, texts["x"][0][50:1700], texts["y"][0][:1100] + "q" + texts["x"][0], "".join(pick.choice(letters) for _ in range(2500)), "世界" * 300, "b" + "ab" * 800, "a"]
    folded = [model.fold(t) for t in asked]
    for got, f in zip(model.rates(folded), folded):
        assert [round(x * f.size) for x in got] == [language_id.phrases(go, f.tolist()) for go in plain]


def test_languages_of_many_letters(spark):
    rows = [(k, "世界人民大会堂今天天气很好我们去公园散步", "zh") for k in range(9)] + [(20 + k, "識別世界日本語の文章です今日は天気が良い", "ja") for k in range(9)] + [(40 + k, "the cat sat on the mat", "en") for k in range(9)] + [(60 + k, "кошка сидит на окне и смотрит", "ru") for k in range(9)]
    asked = {100: ("世界人民很好", "zh"), 101: ("識別世界日本語", "ja"), 102: ("the mat cat", "en"), 103: ("кошка смотрит", "ru"), 104: ("the cat sat on the mat " * 4000, "en")}
    docs = documents(spark, rows + [(k, t, None) for k, (t, _) in asked.items()])
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert {k: got[k].lang_pred for k in asked} == {k: lang for k, (_, lang) in asked.items()}


def test_language_query_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op8_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang is not None]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_cases(spark):
    rows = [(k, "the cat sat on the mat and the dog was there", "en") for k in range(9)] + [(20 + k, "der hund und die katze sind nicht hier", "de") for k in range(9)] + [(50 + k, t, None) for k, t in enumerate(ODD)]
    docs = documents(spark, rows).withColumnRenamed("source", "score2")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for k, t in enumerate(ODD):
        assert (got[50 + k].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    assert got[0].lang_pred == "en" and got[20].lang_pred == "de"
    assert {r.doc_id for r in language_id.keep_languages(docs, model).collect()} >= {0, 20}
    assert language_id.keep_languages(docs, model).columns == docs.columns
    none = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


def test_chunks_cut_and_rejoin():
    pick = random.Random(5)
    data = bytes(pick.randrange(256) for _ in range(200_000))
    ends = media_chunks.cuts(data)
    assert ends[-1] == len(data) and all(media_chunks.LEAST <= b - a <= media_chunks.MOST for a, b in zip([0, *ends[:-2]], ends[:-1]))
    moved = media_chunks.cuts(data[:100] + b"inserted" + data[100:])
    assert len({e - 8 for e in moved} & set(ends)) > len(ends) // 2
    h = media_chunks.gear_hash(data[:500])
    for i in (0, 5, 31, 32, 400):
        assert int(h[i]) == sum(int(media_chunks.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 31), i + 1)) % (1 << 32)


def test_media_round_trip(spark):
    pick = random.Random(7)
    long = "".join(pick.choice("abcdefgh ijklé\n") for _ in range(90_000))
    rows = list(enumerate(ODD)) + [(50, long), (51, long), (52, long[:40_000] + "!" + long[40_000:]), (None, "x"), (4, "a")]
    made = media_chunks.media_features(documents(spark, rows).withColumnRenamed("source", "n_bytes"))
    got = made.collect()
    packed = {r.digest: bytes(r.packed) for r in spark.table(made._table).collect()}
    assert len(packed) > 100 and all(packed.values())
    stored = {}
    for r in made._recipes.collect():
        parts = [bytes(r.recipe[k : k + media_chunks.DIGEST]) for k in range(0, len(r.recipe), media_chunks.ENTRY)]
        form = bytes(r.recipe) + b"".join(packed[d] for d in parts)
        stored[str(r.doc_id)] = len(form), hashlib.sha256(form).hexdigest()
    assert {str(r.doc_id): (r.media_bytes, r.media_sha256) for r in got} == stored
    want = []
    for key, text in rows:
        data = (text or "").encode()
        full = data + b" " * (-len(data) % 192 or (0 if data else 192))
        want.append((str(key), len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert {r.doc_id: r.media_sha256 for r in got}[50] == {r.doc_id: r.media_sha256 for r in got}[51]
    assert media_chunks.media_features(documents(spark, rows).limit(0)).count() == 0


def test_chunk_store_holds_each_chunk_once(spark):
    text = "".join(chr(97 + k * k % 23) + " " * (k % 7 == 0) for k in range(30_000))
    docs = documents(spark, [(1, text), (2, text), (3, "new " + text)])
    store = media_chunks.store_chunks(docs, b"")
    n, distinct = store.count(), store.select("digest").distinct().count()
    listed = {r.recipe[k : k + 16] for r in media_chunks.recipes(docs).collect() for k in range(0, len(r.recipe), media_chunks.ENTRY)}
    assert n == distinct == len(listed)
    assert media_chunks.store_chunks(docs, b"", existing=store).count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.save(stage(spark, out[-1], SF), "test"))
    return out


def test_pipeline_stages(spark, stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    assert set(rows[1]) == {k for k, r in rows[0].items() if r.text and any(c.isalpha() for c in r.text)}
    near = brute_components([(k, r.text) for k, r in rows[2].items()], 5, 80)
    assert {str(k) for k in rows[3]} == {k for k, _, _, kept in near if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows[4]) == {k for k, r in rows[3].items() if not brute_hits(r.text, items)[1]}
    enc = bpe.encoder(queries.public_tokenizers.path(queries.BYTE_RANKS), queries.public_tokenizers.PATTERN)
    assert {k: r.n_tokens for k, r in rows[5].items()} == {k: len(enc.encode_batch([r.text])[0]) for k, r in rows[4].items()}
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(rows[5].values())


def test_pipeline_keeps_other_columns_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("mine")).withColumn("_gone", F.lit(1))
    odd = documents(spark, [(90_000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id has this text of several words")]).withColumn("kept", F.lit(None).cast("string")).withColumn("_gone", F.lit(2))
    docs = docs.unionByName(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.save(stage(spark, docs, SF), "test")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out


def test_chunks_are_dealt_out_in_parts(spark):
    pick = random.Random(9)
    docs = documents(spark, [(k, "".join(pick.choice("abcdefgh ij\n") for _ in range(20_000))) for k in range(4)])
    listed = {r.recipe[k : k + 16] for r in media_chunks.recipes(docs).collect() for k in range(0, len(r.recipe), media_chunks.ENTRY)}
    parts = [{r.digest for r in media_chunks.chunk_rows(docs, b"", k, media_chunks.PASSES).collect()} for k in range(media_chunks.PASSES)]
    assert not parts[0] & parts[1] and set.union(*parts) == listed
    assert max(map(len, parts)) < 0.7 * len(listed)
