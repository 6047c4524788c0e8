import random
import re
from collections import Counter

from galeframe.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words int, phrase string, n long, a int, depth int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "p", 2, 3, 4) for k, (t, lang) in enumerate(rows)], SCHEMA)


def expected(rows, least, most_words, top):
    """Every phrase of every piece, counted one by one."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            found = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(found)
            for k in range(1, most_words + 1):
                for i in range(len(found) - k + 1):
                    count[lang, tuple(found[i : i + k])] += 1
    candidates = {p: a for p, a in count.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, words), a in candidates.items():
        n = total[lang]
        score, _, left, right = min((1000 * a * n // (count[lang, words[:k]] * count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words)))
        inside = any(o == lang and len(w) > len(words) and b >= a and any(w[i : i + len(words)] == words for i in range(len(w))) for (o, w), b in candidates.items())
        if not inside:
            out.append((lang, " ".join(words), a, left, right, n, score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    rank, ranked = Counter(), []
    for r in out:
        rank[r[0]] += 1
        if rank[r[0]] <= top:
            ranked.append((r[0], rank[r[0]], *r[1:]))
    return ranked


def found(docs, **limits):
    return sorted(tuple(r) for r in phrases.collocations(docs, **limits).collect())


def sample(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "é", "of", "x\x01", "a", "b", "ſ", "𝄞", "long" * 9]
    rows = []
    for _ in range(n):
        text = "".join(r.choice(vocabulary) + r.choice([" ", " ", "  ", "\t", ". ", "\n", " ,", "\x0b"]) for _ in range(r.randint(0, 30)))
        rows.append((text, r.choice(["en", "fr", None])))
    return rows


def test_equals_counting_every_phrase(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TOP", 10)
    rows = sample(1, 120) + [(None, "en"), ("", "en"), ("...", None), ("one", "xx"), ("AB", "en"), ("ab ab ab ab ab ab ab ab", "en"), ("ab ab", "en")] * 2
    docs = table(spark, rows)
    for limits in ({"least": 4, "most_words": 5, "top": 2000}, {"least": 2, "most_words": 3, "top": 7}):
        assert found(docs, **limits) == expected(rows, **limits)
    # the counts do not depend on how rows are dealt out, nor on how prefixes are split
    whole = found(docs.repartition(7), least=4)
    monkeypatch.setattr(phrases, "SPLIT", 2)
    assert found(docs, least=4) == whole == expected(rows, 4, 5, 2000)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases.Bitmap, "has", lambda self, value: value == value)
    rows = sample(2, 40)
    assert found(table(spark, rows), least=3) == expected(rows, 3, 5, 2000)


def test_a_very_long_text_and_a_hot_language(spark):
    r = random.Random(3)
    rows = [(" ".join(r.choice(["pa", "re", "ci", "vo", "lu"]) for _ in range(60_000)), "en")] + [("pa re ci", "fr")] * 5
    assert found(table(spark, rows), least=100) == expected(rows, 100, 5, 2000)


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 10**12
    words = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big)], "lang string, word string, n long")
    both = spark.createDataFrame([("en", ["a", "b"], big + 1)], "lang string, words array<string>, a long")
    totals = spark.createDataFrame([("en", 7 * 10**14 + 3)], "lang string, n long")
    monkeypatch.setattr(phrases, "frequent_patterns", lambda *a: (both, words, totals))
    assert phrases.collocations(both).first()["score"] == 1000 * (big + 1) * (7 * 10**14 + 3) // (6 * big * big)


def test_no_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [("a b", "en")])) == []
