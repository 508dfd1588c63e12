"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pathlight.llm.lexical_search import ImpactLists, lexical_search

from .conftest import records

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def slow(docs, items, k=50):
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, tf, sum(tf.values())) for doc_id, tf in counted if tf]
    n, words = len(counted), sum(size for _, _, size in counted)
    df = Counter(term for _, tf, _ in counted for term in tf)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, tf, size in counted:
            m = 100 - 50 + (50 * size * n) // words
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m))
                for t in set(terms(text))
                if t in tf
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda row: (row[0], row[1], row[2] or 0))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, count, longest):
    chosen = random.Random(seed)
    words = [f"w{n}" for n in range(60)] + ["Écoute", "Ünder", "日本", "x-y", "it's"]
    weights = [1 / (n + 1) for n in range(len(words))]
    return [" ".join(chosen.choices(words, weights, k=chosen.randrange(0, longest))) for _ in range(count)]


@pytest.mark.parametrize("how", [{}, {"block_entries": 300}, {"block_entries": 1000, "item_bytes": 200}])
def test_every_document_scored(spark, how):
    docs = list(enumerate(texts(1, 400, 60)))
    docs += [(1000 + n, docs[7][1]) for n in range(80)] + [(5, "w1 w2"), (5, "w1 w2"), (None, "w3 w3"), (2000, None)]
    items = list(enumerate(texts(2, 12, 25))) + [(50, "nowhere"), (51, ""), (52, None), (53, docs[7][1])]
    found = lexical_search(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), **how
    )
    assert sorted((tuple(r.values()) for r in records(found)), key=repr) == slow(docs, items)


def test_lists_are_left_where_nothing_better_can_follow():
    """Only the first documents of the lists are looked up when they score far more than all others."""
    chosen = np.random.default_rng(3)
    count = 20_000
    impacts = np.sort(chosen.integers(1, 100, (2, count)), axis=1)[:, ::-1].copy()
    impacts[:, :60] += 100_000
    held = np.arange(count).repeat(2)
    flat = impacts.T.reshape(-1)
    lists = ImpactLists(np.arange(0, 2 * count + 1, 2), np.tile([0, 1], count), flat, 2)
    looked = []
    look_up = lists._look_up
    lists._look_up = lambda docs, *rest: looked.append(len(docs)) or look_up(docs, *rest)
    docs, scores = lists.best(np.array([0, 1]), 50)
    totals = impacts.sum(axis=0)
    order = np.lexsort((np.arange(count), -totals))[:50]
    assert docs.tolist() == order.tolist() and scores.tolist() == totals[order].tolist()
    assert sum(looked) < 200 and len(held) == 2 * count


@pytest.mark.parametrize("k", [1, 10, 500])
def test_best_of_random_lists_with_ties(k):
    chosen = np.random.default_rng(k)
    for _ in range(20):
        docs, vocabulary = int(chosen.integers(1, 300)), 9
        held = chosen.random((docs, vocabulary)) < 0.4
        owner, term = np.nonzero(held)
        impacts = chosen.integers(1, 6, len(owner))
        lists = ImpactLists(np.searchsorted(owner, np.arange(docs + 1)), term, impacts, vocabulary)
        wanted = np.unique(chosen.integers(0, vocabulary, 4))
        totals = np.bincount(owner[np.isin(term, wanted)], impacts[np.isin(term, wanted)], docs).astype(int)
        for floor in (1, 5):
            order = [d for d in np.lexsort((np.arange(docs), -totals)) if totals[d] >= floor][:k]
            found, scores = lists.best(wanted, k, floor)
            assert found.tolist() == order and scores.tolist() == totals[order].tolist()


def test_odd_tables(spark, odd_docs, no_docs):
    items = odd_docs.selectExpr("doc_id AS item_id", "text", "lang AS item", "key AS rank", "'x' AS `a.b`")
    found = lexical_search(odd_docs, items)
    docs = [(r["doc_id"], r["text"]) for r in records(odd_docs)]
    asked = list(dict.fromkeys(docs))
    assert sorted((tuple(r.values()) for r in records(found)), key=repr) == slow(docs, asked)
    assert lexical_search(no_docs, items).count() == 0
    assert lexical_search(odd_docs, items.limit(0)).count() == 0
