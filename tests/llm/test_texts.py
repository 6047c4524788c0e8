import hashlib
import html
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from galeframe.llm import decontaminate, html_text, lm_scoring, pii, token_counts

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header><h1>Site name</h1></header><div class="cookie-notice">We use cookies on this site.</div>
<!-- ad --><div class="ad">Buy this now, it is cheap and good.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text,\n two  spaces<br>and a <a title="x>y" href="#">link</a>.<p>Be.</p><aside>Also read this.</aside><ul><li>one<li>two</ul>
<form><label>Name</label><input></form></article><section id="comments"><p>A very long reader comment that goes on and on for many words indeed.</p></section><footer>&copy; x</footer>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst bold text, two spaces and a link.\nBe.\none\ntwo"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- open", "<script>x", "<div class=>", "<p>&#x110000;&bogus;</p>", "</p></div>", "<a" + " x='" * 50])
def test_broken_markup_never_fails(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 0), (2, None, None, 0), (None, "u", "", 0), (3, "u", "<article><p>" + "word " * 50_000, 0)], "page_id long, url string, html string, n_chars int")
    found = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert found[2].text == "" and found[None].n_chars == 0
    assert found[3].n_chars == len("word " * 50_000) - 1
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pages_without_articles_go_by_words_and_links():
    body = "".join(f"<div>{'some words of the main text here ' * 8}</div>" for _ in range(4))
    page = f"<div><a>one</a></div><div><a>two</a></div>{body}<div><a>three</a></div><div>(c) x</div>"
    assert html_text.main_text(page).count("\n") == 3


@pytest.mark.parametrize("page", [
    "<article class='post-tags-wide'><p>{}</p><p>{}</p></article>",
    "<div class='content related'><article><p>{}</p><p>{}</p></article></div>",
    "<p>{}</p><svg><circle></p><p>{}</p>",
    "<article><p>{}</p><svg><svg><text>no</text></svg>no</svg><object><p>{}</p></article>",
])
def test_articles_are_not_lost_to_names_and_unclosed_elements(page):
    texts = "some words of the first paragraph " * 6, "and others of the second one " * 6
    assert html_text.main_text(page.format(*texts)) == "\n".join(t.strip() for t in texts)


def test_blocks_of_pages_left_out_of_the_table():
    """Each labelled page by a tree that was grown without it."""
    right = kept = main = 0
    for k, page in enumerate(html_text.LABELLED):
        tree = html_text.grow(*html_text.labelled_table(html_text.LABELLED[:k] + html_text.LABELLED[k + 1 :]))
        x, y = html_text.labelled_table((page,))
        found = np.array([html_text.is_main(tree, row) for row in x])
        right, kept, main = right + (found & (y == 1)).sum(), kept + found.sum(), main + y.sum()
    assert right / kept > 0.9 and right / main > 0.9


def test_neighbours_decide():
    """A short block without links is text between paragraphs and none among links."""
    long, link, short = "<div>" + "word " * 40 + "</div>", "<div><a>" + "link " * 4 + "</a></div>", "<div>eight short words that could be either one</div>"
    assert "eight" in html_text.main_text(long * 2 + short + long * 2)
    assert "eight" not in html_text.main_text(link * 3 + short + link * 3)


def test_articles_of_the_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html or "", re.S)
        parts = [html.unescape(re.sub("<(?!/?(p|h1)>)[^>]*>", lambda m: " " if m[0].startswith("<br") else "", p)) for p in re.split("</?(?:p|h1)>", article[1])] if article else []
        assert found[r.page_id] == "\n".join(" ".join(p.split()) for p in parts if p.strip())


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m)),
        "phone": lambda m: 8 <= len(re.findall("[0-9]", m)) <= 15,
    }
    return [(kind, *m.span()) for kind, pattern in BASE.items() for m in pattern.finditer(text) if keep[kind](m[0])]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(alphabet="a@.b-+1 2(0)%5é\n", max_size=60), st.text(alphabet="4111 -", max_size=60)))
def test_base_spans_equal_the_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    near = pii.find_spans("my card: 4111 1111 1111 1111")[0]
    far = pii.find_spans("order number 4111 1111 1111 1111")[0]
    assert near[3] > far[3]
    assert [s[0] for s in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32")] == ["iban"]


@pytest.mark.parametrize("after", ["", ".", " BIC ABCD", " 32 AND more", " 2024", " DE and so on", "\nGB"])
def test_ibans_end_at_the_length_of_their_country(after):
    for iban in ("GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"):
        assert [s[:3] for s in pii.find_spans(f"to {iban}{after}") if s[0] == "iban"] == [("iban", 3, 3 + len(iban))]
    assert not [s for s in pii.find_spans(f"to GB82WEST12345698765433{after}") if s[0] == "iban"]


def test_context_decides_on_added_kinds():
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [s[0] for s in pii.find_spans(f'erti token = "{value}" th')] == ["secret"]
    assert not pii.find_spans(f"commit {value} of the build")
    assert not [s for s in pii.find_spans("example GB82WEST12345698765432") if s[0] == "iban"]
    assert [s[0] for s in pii.find_spans("example of a bank account GB82WEST12345698765432")] == ["iban"]


def test_documents_without_spans(make):
    found = {r.doc_id: r for r in pii.scan(make([(1, None), (2, ""), (3, "é a@b.cc"), (None, "x" * 300_000)])).collect()}
    assert found[3].spans == "email:2:8" and found[3].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert found[1].base_sha256 == found[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[None].n_email == 0
    assert pii.scan(make([(1, "a")]).limit(0)).count() == 0


def test_tokens_are_attributed_once(make, prose):
    rows = [(1, "one two\nthree  four\n\nfive"), (2, None), (3, ""), (4, "\n\n \n x"), (5, "É日本🙂\n語 a"), (6, prose(1, 3000)), (None, "a<|endoftext|>\nb")]
    coder = token_counts.tokenizer(token_counts.default_path())
    found = token_counts.count(make(rows)).collect()
    for i, text in rows:
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.section)
        text = text or ""
        spans = coder.encode(text, add_special_tokens=False).offsets
        n = [0] * len(own)
        for a, b in spans:
            start = a + len(text[a:b]) - len(text[a:b].lstrip()) if text[a:b].strip() else a
            n[next(k for k, r in enumerate(own) if r.start <= start < r.end)] += 1
        assert [r.n_tokens for r in own] == n
        assert sum(n) == own[0].doc_tokens
        assert [r.start for r in own][1:] == [r.end for r in own][:-1] and own[-1].end == len(text)


@pytest.mark.parametrize("text", ["a b", "it's 're  x", " a", "a 　b", "x\n y", "日本 語の", "a <|endoftext|> b", ""])
def test_remembered_spans_equal_those_of_the_tokenizer(text):
    coder = token_counts.OffsetEncoder(token_counts.default_path())
    expected = np.array(coder.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
    assert np.array_equal(coder.spans([text])[0], expected)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\u3000\xa0a'sé1日🙂.,-<|>"), max_size=60) | st.text(max_size=40))
def test_spans_by_words_equal_those_of_the_whole_text(text):
    coder = token_counts.encoder(token_counts.default_path())
    assert coder.by_words
    expected = np.array(coder.tokenizer.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
    assert np.array_equal(coder.spans([text])[0], expected)


def test_other_tokenizers_encode_whole_texts(make):
    path = lm_scoring.default_path()
    assert not token_counts.OffsetEncoder(path).by_words
    found = token_counts.count(make([(1, "It's  one\ntwo"), (1, "It's  one\ntwo")]), path).collect()
    n = len(token_counts.tokenizer(path).encode("It's  one\ntwo", add_special_tokens=False).ids)
    assert len(found) == 4 and all(r.doc_tokens == n for r in found)
    assert token_counts.count(make([(1, "a")]).limit(0)).count() == 0


LONG = "the quick brown fox jumps over the lazy dog and runs away from here " * 4


@pytest.mark.parametrize(
    "page",
    [
        "<article><div class='share-knowledge-story'><p>{0}</p><p>{0}</p></div></article>",
        "<section id='search-engines'><h2>{0}</h2><p>{0}</p></section>",
        "<div class='social-science'><h1>{0}</h1><p>{0}</p></div>",
        "<article><div class='share'><p>{0}</p><p>{0}</p></div></article>",
        "<body class='widget'><p>{0}</p><p>{0}</p></body>",
    ],
)
def test_names_alone_drop_no_text(page):
    assert html_text.main_text(page.format(LONG.strip())) == "\n".join([LONG.strip()] * 2)


def test_blocks_of_pages_unlike_the_labelled_ones():
    """Kept blocks are marked K, dropped ones D."""
    words = lambda mark, n: " ".join([mark] * n)
    pages = [
        "<header id=top><ul class='menu-items'><li><a>D2</a></li><li><a>D1</a></li></ul></header><main role=main><section class='notice-of-intent'><h2>K6</h2><p>K55</p><p>K31 <em>K4</em></p></section><section class='comment-list'><p>D45</p><p>D38</p></section></main>",
        "<div id=page-wrapper><div class='nav-bar'><a>D1</a> <a>D1</a> <a>D2</a></div><div class=story><h1>K9</h1><div>K44</div><div>K70 <a>K5</a></div><blockquote>K25</blockquote></div><div class='related-posts'><a>D6</a><br><a>D7</a></div><div class=copyright>D9</div></div>",
        "<article><header><h1>K7</h1></header><section><p>K62</p><ul><li>K14</li><li>K18</li></ul></section><section class='newsletter-signup'><p>D24</p><form><input>D3</form></section><p>K48</p></article><aside><h3>D3</h3><p>D30</p></aside>",
        "<table class=layout><tr><td><a>D2</a></td></tr><tr><td><p>K85</p><p>K52</p><p>K40</p></td></tr><tr><td class='site-footer'>D12 <a>D3</a></td></tr></table>",
        "<div class='cookie-notice'><p>D26</p><button>D1</button></div><div class='tags-and-topics'><p>K75</p><p>K66</p></div><div id=disqus><p>D80</p></div>",
    ]
    kept = right = wanted = 0
    for page in pages:
        html = re.sub(r"\b([KD])([0-9]+)", lambda m: words(m[1], int(m[2])), page)
        blocks = [b.text for b in html_text.page_blocks(html)]
        text = html_text.main_text(html).split("\n")
        kept, right, wanted = kept + len(text), right + sum(t.startswith("K") for t in text), wanted + sum(b.startswith("K") for b in blocks)
    assert right / kept >= 0.9 and right / wanted >= 0.9


QUESTION = "A farmer near Riverton sold 12 crates of apples to Maria and later 12 crates of pears, so that the whole load was 24 crates weighing 90 kg in all."


def test_reparameterised_questions_are_found(spark, make, prose):
    same = QUESTION.replace("12", "35").replace("24", "70").replace("Maria", "Otto").replace("kg", "lb")
    # 12 stands for 35 and for 12, but the item's last 19 words are there verbatim
    broken = QUESTION.replace("sold 12", "sold 35").replace("Maria", "Otto")
    # no run of 13 words has one value for each
    clean = QUESTION.replace("Riverton", "Otto").replace("Maria", "Otto").replace("pears", "plums").replace("24", "12").replace("weighing 90", "weighing 12")
    rows = [(1, prose(1, 50) + ". " + QUESTION), (2, f"{prose(2, 30)}. {same} {prose(3, 9)}"), (3, broken), (4, prose(4, 200)), (5, None), (6, ""), (None, QUESTION), (7, QUESTION.upper()), (8, clean)]
    items = spark.createDataFrame([(10, QUESTION), (11, None), (12, ""), (13, prose(9, 40)), (14, "tiny item here")], "item_id long, text string")
    found = {r.doc_id: r for r in decontaminate.label_leaks(make(rows), items).collect() if r.doc_id}
    assert {i for i, r in found.items() if r.contaminated} >= {1, 2, 3}
    assert not any(found[i].contaminated for i in (4, 5, 6, 8))
    assert found[2].item_ids == "10"
    kept = decontaminate.drop_leaks(make(rows), items)
    assert kept.columns == make(rows).columns
    assert decontaminate.label_leaks(make(rows), items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.label_leaks(make(rows).limit(0), items).count() == 0


def test_whole_short_items_are_found(spark, make, prose):
    items = spark.createDataFrame([(1, "seven small words make this item here")], "item_id long, text string")
    rows = [(1, prose(1, 20) + " seven small words make this item here " + prose(2, 20)), (2, "seven small words make this item there")]
    assert [r.doc_id for r in decontaminate.label_leaks(make(rows), items).where("contaminated").collect()] == [1]


def test_copies_whose_names_are_not_marked_are_found(spark, make, prose):
    text = "yesterday Ann Berg met Carl Dorn near Essen while Fred Gans drove from Halle to Ilmenau with Jan Kolb"
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(1, f"{prose(1, 20)} {text.lower()} {prose(2, 20)}"), (2, text.replace(" Carl", "\nCarl").replace(" Fred", "\nFred").replace(" Halle", "  Halle")), (3, prose(3, 60))]
    assert [r.doc_id for r in decontaminate.label_leaks(make(rows), items).where("contaminated").orderBy("doc_id").collect()] == [1, 2]
    assert decontaminate.label_leaks(make([(1, text)]), spark.createDataFrame([(1, text.lower())], "item_id long, text string")).first().contaminated


def test_items_of_numbers_are_found_by_their_values(spark, make, prose):
    texts = ["Compute 12 + 45 - 7 * 3 / 2 + 100 - 55 * 2 and 8", "12 kg 14 kg 9 lb 7 oz 3 kg 2 lb 1 oz 5 kg"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    other = [t.replace("12", "13").replace("45", "46").replace("7", "6").replace("100", "300").replace("9", "4").replace("3 ", "5 ") for t in texts]
    rows = [(k, f"{prose(k, 20)} {t} {prose(k + 9, 20)}") for k, t in enumerate([*texts, *other])] + [(9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make(rows), items).collect()}
    assert found == {(0, 0), (1, 1)}


def test_a_run_does_not_jump_over_places_that_differ(spark, make):
    item = "alpha beta gamma delta epsilon zeta eta theta 1 2 3 4 5 6 iota kappa lambda my ny xi omikron pi"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    changed = item.replace(" 1 2 3 4 5 6 ", " 9 8 7 6 5 4 ").replace("zeta", "word").replace("kappa", "text")
    assert decontaminate.find_leaks(make([(1, changed)]), items).count() == 0
    assert decontaminate.find_leaks(make([(1, item)]), items).count() == 1


def runs_by_hand(doc, item, window=decontaminate.WINDOW, needed=decontaminate.NEEDED):
    """Whether a document's words (with marks) hold a run of the item's: every alignment, every run, one after another."""
    def word(w):
        return w[0] if w[0] in decontaminate.NUMBER + decontaminate.NAME + decontaminate.UNIT else w

    def plain(w):
        return w[1:] if w[0] == decontaminate.NAME else word(w)

    def pairs(d, i):
        """The values that stand for each other if the windows meet: by their templates, or with names as words, and by their values too if there are hardly any words."""
        both = [(b, a) for a, b in zip(d, i, strict=True) if a != word(a) and b != word(b)]
        enough = min(len(i), 4)
        if [plain(w) for w in d] == [plain(w) for w in i]:
            words = sum(w == plain(w) or w[0] == decontaminate.NAME for w in i)
            values = [[w.lstrip(decontaminate.NAME) for w in side] for side in (d, i)]
            if words >= enough or values[0] == values[1]:
                return [(b, a) for b, a in both if b[0] != decontaminate.NAME and a[0] != decontaminate.NAME]
        if [word(w) for w in d] == [word(w) for w in i] and (sum(w == word(w) for w in i) >= enough or d == i):
            return both
        return None

    length = min(len(item), window)
    say = list(range(len(item) - length + 1))
    need = min(len(say), needed)
    for shift in range(-len(item), len(doc)):
        for first in range(len(say) - need + 1):
            found = set()
            for p in say[first : first + need]:
                here = pairs(doc[p + shift : p + shift + length], item[p : p + length]) if p + shift >= 0 and p + shift + length <= len(doc) else None
                if here is None:
                    break
                found.update(here)
            else:
                if need and len(found) == len({a for a, _ in found}) == len({b for _, b in found}):
                    return True
    return False


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_leaks_equal_brute_force(spark, make, prose, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    r = random.Random(4)
    texts = [QUESTION, prose(40, 30), "seven small words make this item here", "a train leaves Milan at 9 and reaches Turin at 11 after 140 km of track and 2 stops"]
    rows = [(0, prose(1, 60)), (1, None), (2, ""), (3, QUESTION), (3, prose(2, 30))]
    for k in range(60):
        words = r.choice(texts).split()
        for _ in range(r.choice([0, 1, 2, 3])):
            at = r.randrange(len(words))
            words[at] = r.choice(["12", "24", "35", "Otto", "Maria", "maria", "word", "kg"])
        a = r.randrange(len(words))
        rows.append((10 + k, f"{prose(k, 9)} {' '.join(words[a // 2 :])} {prose(k + 1, 9)}"))
    pieces = QUESTION.split()
    rows.append((100, " ".join(f"{' '.join(pieces[2 * k : 2 * k + 8])} {prose(k, 1 + k)}" for k in range(8))))  # scattered fragments
    items = spark.createDataFrame([*enumerate(texts), (9, None), (8, "")], "item_id long, text string")
    words = {i: [] for i, _ in rows}
    for i, s in make(rows).select("doc_id", decontaminate.surface(F.col("text"))).collect():
        words[i].append(s.split())
    of_items = {i: s.split() for i, s in items.select("item_id", decontaminate.surface(F.col("text"))).collect()}
    expected = {(d, i) for d, several in words.items() for i, item in of_items.items() if item and any(runs_by_hand(doc, item) for doc in several)}
    found = {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(make(rows), items).collect()}
    assert found == expected and len(found) > 20 and not any(d == 100 for d, _ in found)


def test_windows_equal_those_made_by_hand_and_unwanted_ones_go_early(spark, make, prose):
    number, name, unit = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    rows = [(0, QUESTION), (1, None), (2, ""), (3, "1 kg 2 kg 3 lb"), (4, f"{prose(1, 12)} Ann,5 é5 Berg 7 km"), (5, "a"), (6, QUESTION), (7, prose(2, 40)), (8, "the Ann Berg")]
    docs, lengths = make(rows), [3, 8]
    found = [(x.id, x.length, x.place, x.literal, x.key, tuple(x.slots or ())) for x in decontaminate._windows(docs, "doc_id", lengths).collect()]
    expected = {}
    for i, s in docs.select("doc_id", decontaminate.surface(F.col("text"))).collect():
        said = s.split()
        for length in lengths:
            for at in range(len(said) - length + 1):
                part = said[at : at + length]
                template = [re.sub(f"([{number}-{unit}]).*", r"\1", w) for w in part]
                slots = [w for w in part if w[0] in number + name + unit]
                values = [w for w in slots if w[0] != name]
                most = length - min(length, decontaminate.LITERALS)
                expected[i, length, at + 1, False] = ("values", *part) if len(slots) > most else tuple(template), tuple(slots)
                if name in template:
                    plain = [w.lstrip(name) for w in part]
                    literal = [re.sub(f"([{number}{unit}]).*", r"\1", w) for w in plain]
                    expected[i, length, at + 1, True] = ("values", *plain) if len(values) > most else tuple(literal), tuple(values)
    assert {x[:4]: x[5] for x in found} == {k: slots for k, (_, slots) in expected.items()} and len(found) == len(expected)
    # keys are equal where what they stand for is
    assert len({(x[1], x[4]) for x in found}) == len({(k[1], v[0]) for k, v in expected.items()}) == len({(x[1], x[4], expected[x[:4]][0]) for x in found})
    wanted = decontaminate._windows(docs.where("doc_id = 0"), "doc_id", [8])
    left = decontaminate._windows(docs, "doc_id", lengths, wanted).collect()
    assert {x.id for x in left} == {0, 6} and len(left) == 2 * sum(x[0] == 0 and x[1] == 8 for x in found)
