import random
import re
from fractions import Fraction

import numpy as np
import pytest

from galeframe.llm import common, components, similar, substrings


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def groups(rows, n, threshold):
    sets = {i: shingles(t, n) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return sets, label


@pytest.mark.parametrize(("n", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(8, 10)), (1, Fraction(1, 2))])
def test_groups_equal_brute_force(make, prose, n, threshold):
    r = random.Random(3)
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b"), (6, "a b c"), (7, " a  b\tc "), (8, "a b c d")]
    for base in range(6):
        words = prose(base, 60 + 40 * base).split()
        for copy in range(9):
            changed = list(words)
            for _ in range(r.choice([0, 1, 2, 4, 8])):
                changed[r.randrange(len(changed))] = f"new{r.random()}"
            rows.append((100 + 10 * base + copy, " ".join(changed[: len(changed) - r.choice([0, 0, 3])])))
    sets, label = groups(rows, n, threshold)
    found = similar.similar_groups(make(rows), n, threshold, block_docs=3).collect()
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in found} == {(i, len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("threshold", [Fraction(1, 2), Fraction(3, 5), Fraction(2, 3), Fraction(4, 5), Fraction(9, 10)])
def test_subsets_at_the_threshold_share_a_slab(threshold):
    r = np.random.default_rng(3)
    for n in range(1, 200):
        whole = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        part = np.sort(r.permutation(whole)[: -(-threshold.numerator * len(whole) // threshold.denominator)])
        assert np.intersect1d(similar.slab_keys(whole, threshold), similar.slab_keys(part, threshold)).size


def test_large_families_equal_brute_force(make, prose, monkeypatch, near=20, held=30):
    """Near copies that link through others, next to documents that only the bound cannot tell apart."""
    monkeypatch.setattr(similar, "MOST_HELD", held)
    r = random.Random(near)
    words = prose("base", 120).split()
    rows = []
    for k in range(50):
        changed = list(words)
        for _ in range(r.choice([1, 2, 3])):
            changed[r.randrange(len(changed))] = f"new{r.random()}"
        rows.append((k, " ".join(changed)))
    for k in range(near):  # the same frame, too far from the others to link
        changed = list(words)
        for _ in range(4):
            changed[r.randrange(len(changed))] = f"far{r.random()}"
        rows.append((200 + k, " ".join(changed)))
    _, label = groups(rows, 3, Fraction(9, 10))
    found = similar.similar_groups(make(rows), 3, Fraction(9, 10), block_docs=15).collect()
    assert {x.doc_id: x.component_id for x in found} == label


def test_null_ids_repeats_and_empty_tables(make):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "A B C"), (3, None)]
    found = similar.similar_groups(make(rows), 3, Fraction(9, 10)).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in found) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 3)]
    kept = similar.drop_similar(make(rows), 3, Fraction(9, 10))
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 1, 1, 3]
    assert similar.similar_groups(make(rows).limit(0)).count() == 0


def test_bound_is_never_below_the_overlap():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, 400, r.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        bound = np.minimum(similar.count_vector(a), similar.count_vector(b)).sum()
        assert len(np.intersect1d(a, b)) <= bound


def test_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 51), (None, 3)], "a long, b long")
    found = {r.id: r.component for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {50: 50, 51: 50}


@pytest.mark.parametrize(("links", "held"), [(10**6, 10**6), (10**6, 8), (0, 10**6), (0, 8)])
def test_components_by_one_task_by_stars_and_in_parts(spark, monkeypatch, links, held):
    monkeypatch.setattr(components, "MOST_LINKS", links)
    monkeypatch.setattr(components, "MOST_HELD", held)
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    label = {i: i for p in pairs if p[0] != p[1] for i in p}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()
    assert len(found) == len(label) and {x.id: x.component for x in found} == label
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def stages(spark, run):
    """Stages that Spark runs or skips for ``run``."""
    context, group = spark.sparkContext, f"counted-{random.random()}"
    context.setJobGroup(group, "counted")
    try:
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    return sum(len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup(group))


def test_small_tables_of_links_take_few_stages(spark, make, prose):
    """Each stage deals its rows to as many tasks as the session has partitions, however few the rows are."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert stages(spark, lambda: components.components(links).collect()) <= 4
    words = prose("near", 100).split()
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(60)]
    assert stages(spark, lambda: similar.similar_groups(make(rows), 3, Fraction(9, 10), block_docs=15).collect()) <= 120


def test_no_task_of_the_join_has_two_python_workers(make, prose, monkeypatch):
    """Workers stay with their executor when their task is done, so a task of two would double what Python holds there."""
    plans = []

    def counted(df, **aggregates):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.counted(df, **aggregates)

    monkeypatch.setattr(components, "counted", counted)
    words = prose("near", 100).split()
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(60)] + [(60, " ".join(words))] * 2
    found = similar.similar_groups(make(rows), 3, Fraction(9, 10), block_docs=15).collect()
    assert {r.component_id for r in found} == {0}
    assert any("MapInArrow" in plan for plan in plans)
    assert not any(re.search(r"MapInArrow(?:(?!Exchange|Scan)[\s\S])*MapInArrow", plan) for plan in plans)


def brute_substrings(rows, window):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("per_bucket", [1, 256])
def test_repeats_equal_brute_force(make, prose, per_bucket):
    passage, line = prose("p", 30), prose("q", 12)
    rows = [(0, None), (1, ""), (2, "a " * 80), (3, "a " * 90), (4, passage), (5, "short")]
    for k in range(30):
        rows.append((10 + k, f"{prose(k, 20)} {passage if k % 2 else line}\n{prose(k % 7, 25)} {line}"))
    expected = brute_substrings(rows, 12)
    found = substrings.remove_repeats(make(rows), window=12, seed=4, per_bucket=per_bucket, with_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in found} == expected


def test_substrings_with_null_and_equal_ids(make, prose):
    text = prose("z", 20)
    found = substrings.remove_repeats(make([(None, text), (1, text), (1, text), (2, text)]), window=12, seed=4).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in found) == [(-1, 0), (1, 0), (1, 0), (2, 20)]
    assert substrings.remove_repeats(make([(1, "a")]).limit(0)).count() == 0


def test_similar_sets_still_share_a_slab_when_each_gives_up_what_it_may():
    """Whatever order decides which slabs go, one that both keep is left."""
    rng = np.random.default_rng(5)
    gave = 0
    for threshold in (Fraction(8, 10), Fraction(9, 10)):
        for size in [*range(1, 60), 90, 150, 225, 226, 340, 700]:
            for _ in range(4):
                whole = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
                both = int(rng.integers(0, size + 1))  # shingles of the first set that the second lacks, and the other way round
                most = int(2 * size * (1 - threshold) / (1 + threshold))
                lacks = min(both, most)
                adds = int(rng.integers(0, most - lacks + 1))
                other = np.unique(np.concatenate([rng.permutation(whole)[lacks:], rng.integers(0, 1 << 63, adds, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
                shared = len(np.intersect1d(whole, other))
                if not len(other) or shared < threshold * (len(whole) + len(other) - shared):
                    continue
                salt = np.uint64(rng.integers(0, 1 << 62))
                kept = []
                for shingles in (whole, other):
                    keys, spare = similar.spared_keys(shingles, threshold)
                    band, lowest = keys & np.uint64(63), similar._band(np.array([len(shingles)]))[0]
                    left = []
                    for k, n in enumerate(spare):
                        mine = keys[band == np.uint64(lowest + k)]
                        left.append(mine[np.argsort(mine ^ salt)][n:])
                        gave += n
                    kept.append(np.concatenate(left))
                assert np.intersect1d(*kept).size, (threshold, len(whole), len(other), shared)
    assert gave > 1000


def test_documents_stand_together_once_for_all_slabs_they_share(spark, make, monkeypatch):
    """Two near copies share hundreds of slabs, and a line that all documents have makes slabs of many; neither is dealt slab by slab."""
    rng = np.random.default_rng(11)
    line = "all rights reserved no part of this text may be copied without the leave of its owner"
    texts = [f"{line} " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 500)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + k, t + " more") for k, t in enumerate(texts)]
    dealt = []
    near = similar._near
    monkeypatch.setattr(similar, "_near", lambda members, threshold: dealt.append(members.count()) or near(members, threshold))
    found = {x["doc_id"]: x["component_id"] for x in similar.similar_groups(make(rows), 5, Fraction(8, 10)).collect()}
    assert found == {k: k % 100 for k, _ in rows}
    assert dealt[0] <= 8 * len(rows), dealt
