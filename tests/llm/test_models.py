import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from galeframe.llm import attention_lm, lm_scoring, toxicity, words


def insulted(k, prose):
    r = random.Random(k)
    text = prose(k, 60).split()
    if k % 3 == 0:
        for _ in range(3):
            text.insert(r.randrange(len(text)), r.choice(["idiot", "moron", "worthless", "pathetic"]))
    return " ".join(text), int(k % 3 == 0)


def test_held_out_texts_and_misspellings(spark, make, prose):
    rows = [(k, *insulted(k, prose)) for k in range(500)]
    docs = make([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (None, "the idiot"), (1002, f"{prose(7, 5)} idiottt {prose(8, 5)}")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (77777, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert found[1000].score == found[1001].score and 0 < found[1000].score < 1
    assert found[1002].score > found[1000].score
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns and kept.where("doc_id % 3 = 0 AND doc_id < 500").count() < 20


def test_one_label_only_gives_a_constant(spark, make):
    docs = make([(k, f"word{k}") for k in range(6)])
    model = toxicity.train(docs, spark.createDataFrame([(k, 0) for k in range(6)], "doc_id long, toxic int"))
    assert len({r.score for r in toxicity.score(docs, model).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_words_equal_the_pattern():
    texts = ["", " ", "A b\tÉ", "x\x1fy\x0bz", "ab", "c d "]
    for i, j, found in words.word_blocks(pa.array([*texts, None]), lower=True):
        for row in range(i, j):
            own = [bytes(found.data[a:b]).decode() for a, b in zip(found.begin[found.first[row] : found.first[row + 1]], found.end[found.first[row] : found.first[row + 1]], strict=True)]
            assert own == re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[row] if row < len(texts) else ""))


def test_probabilities_sum_to_one_and_training_helps():
    r = np.random.default_rng(0)
    ids = [np.tile(r.permutation(20), 12) for _ in range(40)]
    model = attention_lm.Model.start(np.bincount(np.concatenate(ids), minlength=300))
    before = model.score_texts(ids, 299).sum()
    made = [model.windows(i, 299) for i in ids]
    inputs, targets = (np.concatenate([m[k] for m in made]) for k in range(2))
    seen = model.fresh()
    for _ in range(30):
        model.train(inputs, targets, seen)
    assert model.score_texts(ids, 299).sum() > before
    context = np.tile(inputs[:1], (300, 1))
    aim = np.tile(targets[:1], (300, 1))
    aim[:, -1] = np.arange(300)
    last = np.zeros(aim.shape, dtype=bool)
    last[:, -1] = True
    assert math.isclose((10 ** model.log10(context, aim, last)).sum(), 1, rel_tol=1e-4)
    assert all(w[2].sum() == len(i) + 1 for w, i in zip(made, ids, strict=True))


def test_base_scores_equal_brute_force(make, prose):
    rows = [(k, prose(k % 9, 30) + f" Rare{k}") for k in range(40)] + [(50, None), (51, ""), (52, " A  a\tB ")]
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for i, t in rows}
    train = [i for i in split if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for i in train for w in split[i])
    n, v = sum(count.values()) + len(train), len(count) + 1
    for share in (1 / 200_000, 0.02):  # all words looked up where the text is, or most of them joined
        lm_scoring.FREQUENT_SHARE, old = share, lm_scoring.FREQUENT_SHARE
        found = {r.doc_id: r for r in lm_scoring.score(make(rows)).collect()}
        lm_scoring.FREQUENT_SHARE = old
        for i, w in split.items():
            base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
            assert (found[i].n_tokens, found[i].n_known, found[i].train_tokens) == (len(w) + 1, sum(x in count for x in w) + 1, n)
            assert math.isclose(found[i].base_score, base, rel_tol=1e-9)
            assert found[i].held_out == (i not in train) and found[i].score < 0
    assert lm_scoring.score(make(rows).limit(0)).count() == 0


def test_every_id_of_every_training_text_is_trained_on(make, prose):
    docs = make([(k, prose(k, 60)) for k in range(40)]).selectExpr("doc_id", "0 AS fold", "text")
    encoded = lm_scoring._encoded(docs, lm_scoring.default_path())
    counts = lm_scoring._subword_counts(encoded)
    start = attention_lm.Model.start(counts)
    start.head += np.random.default_rng(1).standard_normal(start.head.shape).astype(np.float32)
    used = np.flatnonzero(counts)
    for shard_ids in (10**9, 500):
        model = lm_scoring._train(encoded, start, shard_ids)
        assert (model.embed[used] != start.embed[used]).any(axis=1).all()


def test_scores_do_not_depend_on_partitions_and_context_helps(make, prose, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD_IDS", 20_000)
    docs = make([(k, f"{prose(k % 30, 80)} {prose(k, 40)}") for k in range(300)] + [(None, "a b")])
    found = [{r.doc_id: r for r in lm_scoring.score(docs.repartition(n)).collect()} for n in (4, 16)]
    assert all(math.isclose(r.score, found[1][i].score, rel_tol=1e-5) for i, r in found[0].items())
    monkeypatch.setattr(lm_scoring, "_train", lambda training, start: start)
    untrained = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    held = [i for i, r in found[0].items() if r.held_out]
    assert sum(found[0][i].score for i in held) > 0.95 * sum(untrained[i] for i in held) and len(held) > 20


def test_a_training_step_holds_the_gradients_of_its_paths_once():
    ids = np.random.default_rng(0).integers(0, 3000, (1024, 16)).astype(np.int32)
    model = attention_lm.Model.start(np.bincount(ids.ravel(), minlength=3000))
    seen = model.fresh()
    model.train(ids, ids, seen)
    tracemalloc.start()
    model.train(ids, ids, seen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6


def test_a_training_step_fetches_the_path_of_equal_targets_once():
    r = np.random.default_rng(3)
    ids, target = (np.minimum(r.geometric(0.1, (64, 16)), 79).astype(np.int32) for _ in range(2))
    scored = r.random(ids.shape) < 0.8
    model = attention_lm.Model.start(np.bincount(target.ravel(), minlength=80))
    model.head += r.standard_normal(model.head.shape).astype(np.float32)
    h, order, first, times, y = model._by_target(model._forward(ids)[-1][scored], target[scored])
    assert sorted(y) == sorted(set(target[scored])) and times.sum() == len(order) == scored.sum()
    depths, nodes, side, across = model._paths(y)
    assert len(nodes) == model.tree.length[y].sum() < model.tree.length[target[scored]].sum() / 5
    before, seen = model.copy(), model.fresh()
    model.train(ids, target, seen, scored)
    # the gradients of the tree one target and one node at a time
    gradient, touches = np.zeros((len(model.head), attention_lm.WIDTH + 1)), np.zeros(len(model.head))
    for x, t in zip(before._forward(ids)[-1][scored], target[scored], strict=True):
        for level in range(model.tree.length[t]):
            node = model.tree.node[level][t]
            error = 1 / (1 + math.exp(-(x @ before.head[node] + before.bias[node]))) - model.tree.side[level][t]
            gradient[node] += error * np.append(x, 1)
            touches[node] += 1
    gradient /= scored.sum() ** 0.5
    assert np.array_equal(seen["head_touches"], touches)
    assert np.allclose(seen["head"], gradient[:, :-1] ** 2, rtol=1e-2, atol=1e-6) and np.allclose(seen["bias"], gradient[:, -1] ** 2, rtol=1e-2, atol=1e-6)


def naive_score(model, ids, end):
    """One window, one position and one head row at a time, with an explicit mask."""
    inputs, targets, total = [end, *ids], [*ids, end], 0.0
    done = 0
    for start in range(0, max(1, len(targets) - attention_lm.CONTEXT + attention_lm.STRIDE), attention_lm.STRIDE):
        part = inputs[start : start + attention_lm.CONTEXT]
        x = np.array([model.embed[t] + model.place[p] for p, t in enumerate(part)], dtype=float)
        for p in range(len(part)):
            if start + p < done:
                continue
            q = x[p] @ model.query / math.sqrt(attention_lm.WIDTH)
            odds = np.exp([q @ (x[o] @ model.key) for o in range(p + 1)])
            z = sum(w * (x[o] @ model.value) for o, w in enumerate(odds / odds.sum()))
            h = x[p] + z @ model.out
            target = targets[start + p]
            for level in range(model.tree.length[target]):
                node, side = model.tree.node[level][target], model.tree.side[level][target]
                right = 1 / (1 + math.exp(-(h @ model.head[node] + model.bias[node])))
                total += math.log10(right if side else 1 - right)
        done = start + len(part)
    assert done >= len(targets)
    return total


def test_batched_scores_equal_naive_masked_attention():
    r = np.random.default_rng(5)
    texts = [r.integers(0, 60, n) for n in (0, 1, 11, 12, 15, 16, 17, 28, 29, 200)]
    model = attention_lm.Model.start(np.bincount(np.concatenate(texts), minlength=80))
    seen = model.fresh()
    for ids, target, scored, _ in model.batches(texts * 5, 79):
        model.train(ids, target, seen, scored)
    assert np.allclose(model.score_texts(texts, 79), [naive_score(model, list(t), 79) for t in texts], rtol=1e-4)


def test_context_tells_rare_ids_apart():
    # two rare ids of about equal counts, each after its own sign
    ids = [np.array([k, 200 + k] * 8 + [*range(100)] * 2) for _ in range(30) for k in (101, 102)]
    model = attention_lm.Model.start(np.bincount(np.concatenate(ids), minlength=400))
    made = [model.windows(i, 399) for i in ids]
    inputs, targets, scored = (np.concatenate([m[k] for m in made]) for k in range(3))
    seen = model.fresh()
    for _ in range(60):
        model.train(inputs, targets, seen, scored)

    def log10(k, target):
        context = np.array([[k, 200 + k] * 7 + [k]])
        last = np.zeros(context.shape, dtype=bool)
        last[:, -1] = True
        return model.log10(context, np.full(context.shape, target), last)[0]

    assert log10(101, 301) - log10(101, 302) > log10(102, 301) - log10(102, 302) + 0.5


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 0.4), ("sf0.1", 0.65)])
def test_toxic_documents_of_the_given_tables_are_found(spark, size, least):
    """About an eighth of the toxic labels stand on texts without any word that other toxic texts share; they cannot be found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{name}.parquet") for name in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    right = [r.toxic for r in rows if r.predicted == 1]
    assert np.mean(caught) >= least and np.mean(right) >= 0.95
    assert np.mean([r.predicted for r in rows if r.toxic == 1 and r.lang == "en"]) >= 0.55
    if size == "sf0.1":
        assert np.mean([r.predicted for r in rows if r.toxic == 1 and r.lang == "en"]) >= 0.85


def test_repeated_null_and_very_long_texts_in_toxicity(spark, make, prose):
    rows = [(k, *insulted(k, prose)) for k in range(200)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(make([(i, t) for i, t, _ in rows]), labels)
    long_text = prose(900, 60_000)
    docs = make([(1, long_text), (1, long_text), (2, long_text + " idiot moron"), (3, None), (3, None)])
    found = sorted((r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, model).collect())
    assert len(found) == 5 and found[0] == found[1] and found[3] == found[4]
    assert found[2][2] == 1 and found[2][1] > found[0][1]
