"""The queries of the operators and of the pipeline, and SQL where SQL can express them."""

from __future__ import annotations

from fractions import Fraction

import corpus_pipeline

from . import conversations, decontaminate, exact_dedup, html_text, language, lm_scoring, packing, phrases, pii, similar, substrings, token_counts, toxicity
from .common import table


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.label_copies(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark, sf_dir):
    return packing.pack(packing.cut_documents(table(spark, sf_dir, "documents")))


def op7_personal_data(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.train(docs, labels))


def op4_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op1_token_counts(spark, sf_dir):
    return token_counts.count(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.label_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard_join(spark, sf_dir):
    return similar.similar_groups(table(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10))


def op8_lm_scoring(spark, sf_dir):
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    return conversations.report(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


QUERIES = {
    "op2_exact_dedup": op2_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op7_personal_data": op7_personal_data,
    "op6_toxicity": op6_toxicity,
    "op4_html_text": op4_html_text,
    "op1_token_counts": op1_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op8_lm_scoring": op8_lm_scoring,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents""",
    "op5_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS k FROM w, unnest(range(1, greatest(len(words) - 1, 2))) t(i) WHERE len(words) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 90 * (na.n + nb.n - c)),
        both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON r = x)
        SELECT doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        win AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(words) - 48)) t(i) WHERE len(words) >= 50),
        first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
        hit AS (SELECT doc_id, i FROM win JOIN first USING (k) WHERE m < doc_id),
        gone AS (SELECT DISTINCT doc_id, j FROM hit, unnest(range(i, i + 50)) u(j)),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
        kept AS (SELECT word.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY word.j) FILTER (gone.j IS NULL) AS text FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.j = word.j GROUP BY word.doc_id)
        SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE coded AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS signs FROM conversations),
        hashed AS (  -- crc32: each byte is xored in and followed by eight shifts
            SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(signs, lambda s: list_concat([CAST(ascii(s) AS BIGINT)], list_transform(range(8), lambda b: CAST(-1 AS BIGINT)))))),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS kind FROM coded),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged),
        judged AS (
            SELECT *, substr(role, 1, 1) AS initial,
                   CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations),
        -- the cheapest edits so far that lead to nothing yet, to a system, a user and an assistant turn; inserts after the turn are included
        states AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': ''} AS s0, {'c': CAST(1000000000 AS BIGINT), 'a': ''} AS s1, {'c': CAST(5 AS BIGINT), 'a': 'I'} AS s2, {'c': CAST(10 AS BIGINT), 'a': 'II'} AS s3 FROM ids
            UNION ALL
            SELECT conv_id, i, s0, s1, t2, list_min([s3, {'c': t2.c + 5, 'a': t2.a || 'I'}]) AS s3
            FROM (SELECT conv_id, i, s0, s1, s3, list_min([s2, {'c': s0.c + 5, 'a': s0.a || 'I'}, {'c': s1.c + 5, 'a': s1.a || 'I'}, {'c': s3.c + 5, 'a': s3.a || 'I'}]) AS t2
            FROM (SELECT s.conv_id, r.i, {'c': s0.c + 2, 'a': s0.a || 'D'} AS s0,
                         list_min([{'c': s1.c + 2, 'a': s1.a || 'D'}, {'c': s0.c + extra + CASE WHEN initial = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K'}]) AS s1,
                         list_min([{'c': s2.c + 2, 'a': s2.a || 'D'},
                                   {'c': least(s0.c, s1.c, s3.c) + extra + CASE WHEN initial = 'u' THEN 0 ELSE 1000000000 END, 'a': list_min([s0, s1, s3]).a || 'K'},
                                   {'c': least(s0.c, s1.c, s3.c) + extra + 1, 'a': list_min([s0, s1, s3]).a || 'R'}]) AS s2,
                         list_min([{'c': s3.c + 2, 'a': s3.a || 'D'}, {'c': s2.c + extra + CASE WHEN initial = 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K'}, {'c': s2.c + extra + 1, 'a': s2.a || 'R'}]) AS s3
                  FROM states s JOIN (SELECT *, CAST(CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS BIGINT) AS extra FROM judged) r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i + 1) d) u),
        ended AS (SELECT conv_id, list_min([s0, s3]) AS best FROM states QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        letters AS (SELECT conv_id, best.c AS cost, best.a AS audit, unnest(string_split(best.a, '')) AS edit, generate_subscripts(string_split(best.a, ''), 1) AS spot FROM ended WHERE best.a <> ''),
        edits AS (
            SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w - 1 AS place, count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd
            FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY spot)),
        repaired AS (
            SELECT e.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY spot)) AS sha
            FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(best.c AS BIGINT) AS cost, best.a AS audit, coalesce(sha, sha256('')) AS repaired_sha256
        FROM ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id""",
    "op12_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
        total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM w GROUP BY lang),
        places AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, 6) t(k) WHERE len(words) >= k),
        f AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM places GROUP BY lang, phrase, k HAVING count(*) >= 100),
        c AS (SELECT lang, phrase, string_split(phrase, ' ') AS words, k, f AS a FROM f WHERE k > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, n, (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
                 FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
                 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:cut], ' ')
                 JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[cut + 1:], ' ')
                 JOIN total ON total.lang = c.lang),
        best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_phrases AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase FROM c, range(2, 5) t(m) WHERE m < k),
        around AS (SELECT lang, phrase, max(a) AS around FROM inner_phrases GROUP BY lang, phrase),
        ranked AS (SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
                   FROM best LEFT JOIN around USING (lang, phrase) WHERE around IS NULL OR around < a)
        SELECT * FROM ranked WHERE rank <= 2000""",
}


def queries():
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    sql = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return ORACLES | sql
