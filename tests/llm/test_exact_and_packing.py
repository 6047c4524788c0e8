import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galeframe.llm import exact_dedup, packing, subwords


def test_labels_equal_a_brute_force_count(make):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (7, "A"), (9, "a"), (None, "b"), (8, "x" * 200_000)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for tracked in (2, 4096):  # with and without a heavy side
        found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.label_copies(make(rows), tracked=tracked).collect()}
        assert len(found) == len(rows)
        for i, t in rows:
            r = found[i, hashlib.sha256((t or "").encode()).hexdigest()]
            best = max((x for x in groups[t or ""] if x is not None), default=None)
            assert (r.keep_id, r.group_size, r.kept) == (best, len(groups[t or ""]), i == best)


def test_of_repeated_rows_one_is_kept(make):
    docs = make([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, None), (None, "")])
    assert sum(r.kept for r in exact_dedup.label_copies(docs).collect()) == 4
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, "a"), (1, "b"), (2, "c")]


def test_empty_table(make):
    empty = make([(1, "a")]).limit(0)
    assert exact_dedup.label_copies(empty).count() == 0
    assert packing.pack(packing.cut_documents(empty)).count() == 0


def test_pieces_rebuild_the_documents_and_bins_hold(make, prose):
    rows = [(k, prose(k, words=20 * k)) for k in range(1, 30)] + [(100, None), (101, ""), (102, prose(5, 6000)), (102, prose(5, 6000)), (None, "x")]
    found = packing.pack(packing.cut_documents(make(rows), capacity=512), capacity=512, per_partition=20).collect()
    coder = subwords.tokenizer(subwords.default_path())
    wanted = sorted(len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in found) == sum(wanted)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        assert 1 <= r.length <= 512
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= packing.lower_bound(np.array([r.length for r in found]), 512) + 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_bound_is_below_the_packing(lengths):
    _, _, used = packing.best_fit_decreasing(np.array(lengths), 60)
    bound = packing.lower_bound(np.array(lengths), 60)
    assert -(-sum(lengths) // 60) <= bound <= used


@pytest.mark.parametrize("text", ["", " ", "it's  a\tTest\n\nΣΑΣ", "É é", "a<|endoftext|>b <|startoftext|>", "x" * 3000])
def test_ids_equal_those_of_the_tokenizer(text):
    coder = subwords.WordEncoder(subwords.default_path())
    assert next(coder.ids([text])) == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
