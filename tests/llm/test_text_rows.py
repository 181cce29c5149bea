"""Operators that work row by row: quality, licences, pieces, main text, URLs, toxicity, tiling."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece as library

from suffixloom.llm import decontaminate as dc, pieces, toxicity as tx
from suffixloom.llm.licence_texts import LICENCES
from suffixloom.llm.licences import licence_scan
from suffixloom.llm.main_text import extract, main_text
from suffixloom.llm.quality import quality
from suffixloom.llm.rolling import shingle_hashes, word_hashes
from suffixloom.llm.url_filter import url_filter

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "th", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ß", "日本", "😀", "\x00", "<s>", "<0x41>", "!", "1", "\u3000"]


def brute_quality(text):
    text = text or ""
    for c in "\t\n\x0b\x0c\r":
        words = text.replace(c, " ") if c == "\t" else words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_quality(table, rows, prose):
    texts = [None, "", " \n\t", "one", "a b c a b c a b", prose(1, 80) + ".", "Same line.\nSame line.\n" + prose(2, 60) + ".",
             "x y z " * 40, prose(3, 70) + ".\nhome | about | contact | help", "A & B | C\n" * 30, prose(5, 4000) + "."]
    data = [(i, t) for i, t in enumerate(texts)] + [(3, "one")]
    got = rows(quality(table(data)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed")
    assert got == sorted([(i, *brute_quality(t)) for i, t in data], key=repr)
    out = {r.doc_id: r for r in quality(table(data)).collect()}
    assert out[8].kept and "home |" not in out[8].cleaned and out[5].kept and out[5].lost_chars == 0
    assert not out[9].kept and not out[0].kept
    assert quality(table([])).count() == 0


def test_quality_rejects_what_loses_most(table, prose):
    junk = "\n".join(" | ".join(prose(i, 8).replace(".", "").split()) for i in range(12))
    out = {r.doc_id: r.kept for r in quality(table([(1, junk), (2, prose(3, 60) + ".\n" + junk), (3, junk.upper())])).collect()}
    assert not any(out.values())


def test_quality_rules_are_shares_of_the_line(table, prose):
    clean = prose(21, 900).replace(".", "") + ". "
    long = [clean + "Read more about it. " + clean, clean + "This site is powered by steam! " + clean, clean + "a | b | c | d. " + clean,
            clean + "What?? Really?? No!! " + clean, " ".join(["नमस्ते दुनिया"] * 40) + "।", " ".join(["کیا حال ہے"] * 40) + "؟",
            " ".join(["یہ ایک جملہ ہے"] * 30) + "۔", " ".join(["สวัสดีชาวโลก"] * 60), "。".join(["你好 世界"] * 40) + "。"]
    short = ["Read more about it.", "All rights reserved. Example 2020.", "home | about | contact | help.", "What?? Really?? No!!"]
    lines = prose(22, 80).replace(".", "") + ".\n"
    data = [(i, t) for i, t in enumerate(long)] + [(100 + i, lines + t) for i, t in enumerate(short)]
    out = {r.doc_id: r for r in quality(table(data)).collect()}
    assert all(out[i].lost_chars == 0 and out[i].cleaned == t for i, t in enumerate(long))
    assert all(out[100 + i].cleaned == lines.strip() for i in range(len(short)))


def test_licences(table, rows):
    mit = LICENCES[0][1]
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace("\n", "\n  * ")
    data = [(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (6, "Text.\nReleased under the MIT Licence!\nEnd."),
            (7, "Copyright 2001 A\nAll rights reserved."), (1, mit)]
    got = rows(licence_scan(table(data)), "doc_id", "license", "notices")
    assert got == sorted([(1, "MIT", []), (1, "MIT", []), (2, "MIT", []), (3, None, []), (4, None, []), (5, None, []),
                          (6, None, ["MIT"]), (7, None, [])], key=repr)
    assert licence_scan(table([])).count() == 0


def test_pieces_equal_the_library():
    model, exact = pieces.PieceModel.load(MODEL), library.SentencePieceProcessor(model_file=MODEL)
    draw = random.Random(5)
    for _ in range(3000):
        text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 12)))
        ids = [i for u in model.units(text) for i in model.unit_ids(u)]
        assert ids == exact.encode(text)
        assert model.decode(ids) == exact.decode(ids)
        begins, ends = model.spans(text, ids)
        data = text.encode()
        assert all(0 <= a <= b <= len(data) for a, b in zip(begins, ends)) and begins == sorted(begins)
        assert b"".join(data[a:b] for a, b in zip(begins, ends) if a < b).decode(errors="replace") != "" or not text
    long = "".join(draw.choice("abcdefghié日") for _ in range(5000))
    assert [i for u in model.units(long) for i in model.unit_ids(u)] == exact.encode(long)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_normalizer_equals_the_library(rule):
    exact = library.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                            remove_extra_whitespaces=True)
    spec = dict(pieces._fields(next(v for k, v in pieces._fields(exact.serialized_model_proto()) if k == 3)))
    own = pieces.Normalizer(pieces.CharMap(spec[2]) if spec.get(2) else None, True, True, True)
    draw = random.Random(6)
    for _ in range(1500):
        text = "".join(draw.choice(ALPHABET + ["ﬁ", "Å", "㍿", "Ⅷ", "ＡＢ", "ｶﾞ", "İ"]) for _ in range(draw.randint(0, 10)))
        normal, starts, ends = own.align(text)
        assert normal.decode() == exact.normalize(text)
        assert len(starts) == len(ends) == len(normal) and starts == sorted(starts)


def test_pieces_over_a_table(table, prose):
    data = [(1, None), (2, ""), (3, "  two  spaces "), (4, prose(1, 3000)), (4, prose(1, 3000)), (5, "日本▁😀")]
    exact = library.SentencePieceProcessor(model_file=MODEL)
    for r in pieces.sentencepiece(table(data), MODEL, tuple(pieces.SCHEMA.names), cached_units=50).collect():
        ids = exact.encode(r.text or "")
        assert (r.ids, r.n_tokens, r.ids_text, r.decoded) == (ids, len(ids), ",".join(map(str, ids)), exact.decode(ids))
        assert len(r.begins) == len(r.ends) == len(ids)
    assert pieces.sentencepiece(table([]), MODEL).count() == 0


def test_characters_align_as_steps_do():
    draw = random.Random(8)
    for own in (pieces.Normalizer(None, a, False, b) for a in (True, False) for b in (True, False)):
        for _ in range(300):
            text = "".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 12)))
            assert own.align(text) == own._align_steps(text.encode())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><header>Site &amp; more</header>
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy this.</div>
<article class="post"><h1>Head &amp;  line</h1><p><b>First
 paragraph &#233;.<br><p>Second, with <a href="/x">a link</a> inside.<p>Third one is here.
<form><input name=q><button>Go</button></form></article>
<aside>Side.</aside><section id="comments"><p>I disagree with every single word of this long comment.</p></section>
<footer>&copy; site</footer>"""


def test_lockstep_merges_as_the_heap_does():
    model, draw = pieces.PieceModel.load(MODEL), random.Random(11)
    units = ["▁" + "".join(draw.choice([*ALPHABET, "er", "tion", "0", "--"]) for _ in range(draw.randint(0, 9))).replace(" ", "x")
             for _ in range(1500)] + ["▁", "x", "▁▁▁", "▁" + "=" * 40]
    units = [u for u in units if len(u) <= pieces.LONG_UNIT]
    merges = pieces.Merges(model)
    assert merges.ids(units) == [model.unit_ids(u) for u in units] and merges.ids([]) == []


def test_cache_of_two_generations():
    cache = pieces.UnitCache(pieces.PieceModel.load(MODEL), 3)
    for units in (["▁a", "▁b"], ["▁c", "▁d"], ["▁a", "▁e", "▁a", "▁" + "long" * 30], ["▁f"], []):
        for unit, (ids, text, decoded) in cache.take(units).items():
            assert np.frombuffer(ids, np.int32).tolist() == cache.model.unit_ids(unit) == list(map(int, text.split(",")))
            assert decoded == unit.replace("▁", " ")
        assert len(cache) <= 3


def test_main_text():
    assert extract(PAGE) == ("Head & line\nFirst paragraph é.\nSecond, with a link inside.\nThird one is here.")
    assert extract(None) == extract("") == extract("<!-- never ends <p>x</p>") == extract("<script>x") == ""
    assert extract("plain &lt;text&gt;") == "plain <text>"
    assert extract("<div id=a><p>One two three.</p><p>Four five six.</p></div><footer>f</footer>") == "One two three.\nFour five six."
    assert extract("<div>" * 5000 + "deep") == "deep"
    assert extract("<ul><li>a<li>b</ul>") == "a\nb"
    assert extract('<div class="has-sidebar"><p>Long enough a text.</p><div class="sidebar">x</div></div>') == "Long enough a text."
    assert extract('<div><p>Text.</p></div><div class="comments"><p>A much longer comment than the text is.</p></div>') == "Text."


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main><div>{}</div></main>", '<div id="content"><div>{}</div></div>',
                                    '<div role="main">{}</div>', "<main><article>{}</article></main>"])
def test_main_text_of_wrapped_sections(around):
    long, short = "<p>" + "word " * 99 + "word.</p>", "<p>" + "some " * 19 + "some.</p>"
    inner = f"<h1>A headline of the article</h1>Bare text.<div>{long * 10}</div><div>{short * 2}</div><em>Last</em> words."
    page = f'<body><div class="menu"><a href="/">Home</a></div>{around.format(inner)}<div class="related">{short}</div></body>'
    lines = extract(page).split("\n")
    assert lines[:2] == ["A headline of the article", "Bare text."] and lines[-1] == "Last words."
    assert len(lines) == 15 and lines[-2].startswith("some")


PASSAGE = "<p>" + "Some words of running text, long enough to count. " * 5 + "</p>"


@pytest.mark.parametrize("html, passages", [
    (f"<body><div><h1>Head line</h1><div>{PASSAGE * 10}</div><div>{PASSAGE * 2}</div></div></body>", 12),
    (f"<body><h1>Head line</h1><div>{PASSAGE * 10}</div><div>{PASSAGE * 2}</div><div><p><a href=x>A link</a></p></div></body>", 12),
    (f"<body><header><h1>Site</h1></header><article><header><h1>Head line</h1></header>{PASSAGE * 5}</article></body>", 5),
    (f"<body><article><header class='entry-header'><h1>Head line</h1></header>{PASSAGE}<footer>f</footer></article></body>", 1),
    (f"<body><article><h1>Head line</h1>{PASSAGE * 2}<section class='social-history'>{PASSAGE * 4}</section>"
     "<div class='related-posts'><p>See this other one</p></div></article></body>", 6),
    (f"<body><article><h1>Head line</h1>{PASSAGE * 2}<div class='related-work'>{PASSAGE * 4}</div>"
     "<div class='social share-buttons'>Tell all</div><div id='comments'><p>I think</p></div></article></body>", 6)])
def test_main_text_drops_nothing_of_the_article(html, passages):
    lines = extract(html).split("\n")
    assert lines == ["Head line"] + ["Some words of running text, long enough to count. " * 4
                                     + "Some words of running text, long enough to count."] * passages


def test_main_text_leaves_the_second_article():
    long = "<p>" + "word " * 99 + "word.</p>"
    page = f"<main><h2>News</h2><article><h1>One</h1><div>{long * 10}</div></article><article><p>Other.</p></article></main>"
    assert extract(page).split("\n")[0] == "One" and "Other." not in extract(page)


def test_main_text_over_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 2), (2, None, None, 3), (3, "", "", None)],
                                  "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.url or "", len(r.text), r.n_chars) for r in main_text(pages).collect())
    n = len(extract(PAGE))
    assert got == [(1, "u", n, n), (1, "u", n, n), (2, "", 0, 0), (3, "", 0, 0)]
    assert main_text(pages.limit(0)).count() == 0


URLS = {
    "http://a.org/x": ("a.org", "/x", "org/", "allow"), "https://EXAMPLE.org/es/1?q": ("example.org", "/es/1", "example.org/es/", "block"),
    "x://www.example.org/en/19#t": ("www.example.org", "/en/19", "example.org/en/1", "block"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "http://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
    "http://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"), "http://a.org?x=/y": ("a.org", "", None, None),
    "http://c.net/p?u=http://d.org/": ("c.net", "/p", None, None), None: ("", "", None, None), "no scheme": ("", "", None, None),
    "": ("", "", None, None), "http://É.Org/": ("É.org", "/", "org/", "allow")}


def test_url_filter(spark):
    data = [(i, u, None) for i, u in enumerate([*URLS, *URLS])] + [(100 + i, f"http://n.com/{k}/{i}", None)
                                                                   for i in range(60) for k in ("de", "fr", "it")]
    pages = spark.createDataFrame(data, "page_id long, url string, rule int")
    out = {r.page_id: r for r in url_filter(pages, train_rows=100).collect()}
    assert len(out) == len({d[0] for d in data})
    for i, u in enumerate([*URLS, *URLS]):
        host, path, rule, verdict = URLS[u]
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert out[i].verdict == verdict if verdict else out[i].verdict in ("allow", "block")
    assert url_filter(pages.limit(0)).count() == 0
    one = url_filter(pages.filter("url like '%/de/%'")).collect()
    assert {r.verdict for r in one} == {"block"}


def test_toxicity_learns_words(spark, table, prose):
    bad = ["vilewort", "grimslur", "nastique"]
    draw = random.Random(2)
    rows = []
    for i in range(400):
        words = prose(i, 120).split()
        if i % 4 == 0:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), None) for i, _ in rows], "doc_id long, toxic int, quality int")
    docs = table(rows + [(1000, None), (1001, "")])
    out = {r.doc_id: r for r in tx.toxicity(docs, tx.train(docs, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(out[i].predicted == int(i % 4 == 0) for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1000].score == out[1001].score
    assert tx.toxicity(table([]), tx.fit([])).count() == 0
    assert tx.fit([]).score("x") == 0.0 and tx.fit([("a", 1), ("b", 1)]).score("") == 1.0


def test_toxicity_keeps_the_class_shares(spark, table, prose):
    bad, draw, rows = ["vilewort", "grimslur", "nastique"], random.Random(3), []
    for i in range(900):
        words = prose(i, 60).split()
        if i % 9 == 0 or i % 50 == 1:  # one of three such texts of the second kind is toxic
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 9 == 0), None) for i, _ in rows], "doc_id long, toxic int, quality int")
    docs = table(rows)
    mean = lambda model: np.mean([model.score(t) for _, t in rows])
    whole, capped = tx.train(docs, labels), tx.train(docs, labels, train_docs=70)
    assert abs(mean(whole) - 1 / 9) < 0.03 and abs(mean(capped) - 1 / 9) < 0.06


def test_toxicity_keeps_the_words_of_a_small_language(prose, monkeypatch):
    monkeypatch.setattr(tx, "_dictionary", lambda samples, size: b"".join(samples))
    rows = []
    for i in range(6000):
        words = prose(i, 20).split()
        if i % 10 == 0:
            words.insert(i % 19, "palabrota" if i % 700 == 10 else ["vilewort", "grimslur"][i // 10 % 2])
        rows.append((" ".join(words), int(i % 10 == 0)))
    assert sum("palabrota" in t for i, (t, _) in enumerate(rows) if i % 3) == 6  # of 400 toxic texts, so less than 2 %
    assert b" palabrota " in tx.fit(rows).toxic


def test_toxicity_learns_from_all_windows(prose, monkeypatch):
    seen, text = [], prose(1, 4000)
    monkeypatch.setattr(tx, "_dictionary", lambda samples, size: seen.append(len(samples)) or b"".join(samples[:9]))
    tx.fit([(text if y else "short text", y) for _ in range(120) for y in (0, 1)])
    assert seen == [80, 80 * 800]


def brute_tiles(doc, item, k):
    """Greedy string tiling without hashes."""
    d_free, i_free, covered = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and i_free[i + n] and d_free[d + n] and doc[d + n] == item[i + n]:
                    n += 1
                best = max(best, (n, -i, -d))
        if best[0] < k:
            return covered
        n, i, d = best[0], -best[1], -best[2]
        i_free[i:i + n], d_free[d:d + n] = [False] * n, [False] * n
        covered += n


def test_tiles_against_brute_force():
    draw = random.Random(4)
    for k in range(400):
        top = 1 + k % 6
        doc = np.array([draw.randint(0, top) for _ in range(draw.randint(0, 40))], dtype=np.uint64)
        item = np.array([draw.randint(0, top) for _ in range(draw.randint(1, 25))], dtype=np.uint64)
        tiles = dc.tile(doc, item, 3)
        for d, i, n in tiles:
            assert n >= 3 and (doc[d:d + n] == item[i:i + n]).all()
        assert len({x for d, _, n in tiles for x in range(d, d + n)}) == sum(t[2] for t in tiles)
        assert sum(t[2] for t in tiles) == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_tiles_take_the_longest_of_several_places(monkeypatch):
    doc, item = (np.array([ord(c) for c in text], dtype=np.uint64) for text in ("ABCDExxABCDEF", "ABCDEFG"))
    assert dc.tile(doc, item, 5) == [(7, 0, 6)]
    again = np.array(list(range(9)) * 6, dtype=np.uint64)
    assert sum(t[2] for t in dc.tile(again, again[:30], 5)) == 30
    whole = dc.tile(again, again[3:40], 5)
    monkeypatch.setattr(dc, "PAIRS", 3)
    assert dc.tile(again, again[3:40], 5) == whole == [(3, 0, 37)]


def test_decontaminate(spark, table, prose):
    item = prose(9, 40)
    words = item.split()
    moved = " ".join(words[25:] + ["between"] + words[:25])
    half = " ".join(words[:12])
    data = [(1, prose(1, 100) + " " + item.upper() + " " + prose(2, 50)), (2, moved), (3, half), (4, prose(3, 100)), (5, None),
            (6, ""), (7, "short one"), (1, item)]
    bench = spark.createDataFrame([(10, item), (11, prose(77, 30)), (12, None), (13, ""), (14, "Short, one!"), (10, item)],
                                  "item_id long, text string")
    for block_words in (1_000_000, 20):
        out = dc.decontaminate(table(data), bench, block_words=block_words).collect()
        assert sorted((r.doc_id, r.contaminated, r.item_ids) for r in out) == sorted([
            (1, True, [10, 10]), (1, True, [10, 10]), (2, True, [10, 10]), (3, False, []), (4, False, []), (5, False, []),
            (6, False, []), (7, True, [14])])
    assert dc.decontaminate(table([]), bench).count() == 0
    assert not any(r.contaminated for r in dc.decontaminate(table(data), bench.limit(0)).collect())


def test_hashes_name_words_and_shingles():
    texts = ["a bb  a\tbb", "", "bb a", " a bb "]
    words, counts = word_hashes([t.encode() for t in texts])
    assert counts.tolist() == [4, 0, 2, 2]
    assert len(set(words.tolist())) == 2 and words[0] == words[2] == words[5] == words[6]
    two = shingle_hashes(words, 2)
    assert two[0] == two[2] == two[6] and two[1] == two[4] and two[0] != two[1]
