import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathlight.llm import attention, lm_score

from .conftest import records

pytestmark = pytest.mark.skipif(not os.path.exists(lm_score.TOKENIZER), reason="no tokenizer")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small_model(classes=6, seed=1):
    p = attention.initial(classes, np.log(np.full(classes, 1 / classes)), 2, seed, dimensions=5, window=8)
    p["gate"] += np.random.default_rng(seed).standard_normal(p["gate"].shape).astype(np.float32)
    return p


def test_gradient_equals_differences():
    p = {name: value.astype(np.float64) for name, value in small_model().items()}
    random = np.random.default_rng(2)
    inputs, targets = random.integers(0, 7, (3, 8)), random.integers(0, 6, (3, 8))
    valid, wanted = np.ones((3, 8), bool), random.random((3, 8)) < 0.7
    valid[0, :2] = False
    wanted[0, :2] = False
    g, _ = attention.gradient(p, inputs, valid, targets, wanted, 2)
    for name, value in p.items():
        for at in random.integers(0, value.size, 4):
            flat, step = value.reshape(-1), 1e-5
            kept = flat[at]
            flat[at] = kept + step
            up = attention.gradient(p, inputs, valid, targets, wanted, 2)[1]
            flat[at] = kept - step
            down = attention.gradient(p, inputs, valid, targets, wanted, 2)[1]
            flat[at] = kept
            assert math.isclose((up - down) / (2 * step), g[name].reshape(-1)[at], rel_tol=2e-2, abs_tol=2e-5), name


@pytest.mark.parametrize("scale", [1, 12])
def test_gradients_with_and_without_a_shift_of_the_exponents(monkeypatch, scale):
    p = {name: value.astype(np.float64) * scale for name, value in small_model().items()}
    random = np.random.default_rng(7)
    inputs, targets = random.integers(0, 7, (3, 8)), random.integers(0, 6, (3, 8))
    valid, wanted = np.ones((3, 8), bool), random.random((3, 8)) < 0.7
    valid[0, :2] = wanted[0, :2] = False
    g, loss = attention.gradient(p, inputs, valid, targets, wanted, 2)
    rows, tokens, _ = attention.sparse_gradient(p, inputs, valid, targets, wanted, 2)
    assert tokens.tolist() == np.unique(inputs).tolist()
    assert np.array_equal(rows["embed"], g["embed"][tokens])
    monkeypatch.setattr(attention, "_bounded", lambda left, right: False)
    shifted, same = attention.gradient(p, inputs, valid, targets, wanted, 2)
    assert math.isclose(loss, same, rel_tol=1e-9)
    assert all(np.allclose(value, shifted[name], rtol=1e-7, atol=1e-12) for name, value in g.items())


def test_every_token_is_scored_once_in_its_window():
    """Scores equal those of a softmax written out token by token, from the tokens that its window lets it see."""
    p, window, context, starts = small_model(), 8, 3, 2
    for value in p.values():
        value *= 5
    lengths = np.array([1, 4, 5, 6, 23, 0 + 2])
    classes = np.random.default_rng(3).integers(0, 6, lengths.sum())
    chosen, begun = attention.score_texts(p, classes, lengths, starts, window, context, at_once=2)
    at = 0
    for length in lengths.tolist():
        text = classes[at : at + length]
        for n in range(length):
            first = n // (window - context) * (window - context) - context
            seen = range(max(0, first), n + 1)
            slots = np.array([place - first for place in seen])
            read = [6 if place == 0 else text[place - 1] for place in seen]
            hidden = p["embed"][read] + p["place"][slots]
            logits = (hidden[-1] @ p["query"]) @ (hidden @ p["key"]).T / math.sqrt(5)
            weights = np.exp(logits - logits.max())
            state = hidden[-1] + (weights / weights.sum()) @ (hidden @ p["value"]) @ p["mix"]
            out = np.exp(state @ p["out"] + p["bias"])
            begins = 1 / (1 + math.exp(-float(state @ p["gate"][:, 0] + p["gate_bias"][0])))
            part, share = (out[:starts], begins) if text[n] < starts else (out[starts:], 1 - begins)
            assert math.isclose(chosen[at + n], math.log(share * out[text[n]] / part.sum()), rel_tol=1e-3, abs_tol=1e-4)
            assert math.isclose(begun[at + n], math.log(begins), rel_tol=1e-3, abs_tol=1e-4)
        at += length


def test_classes_are_distributions():
    counts = np.array([50, 0, 30, 7, 7, 1, 0, 90, 4, 2])
    begins = np.array([True, True, False, False, True, True, False, True, False, False])
    made = lm_score.subword_classes(counts, begins, 11, classes=8, shared=2)
    assert np.isclose(np.exp(made.prior).sum(), 1)
    for number in range(1, len(made.prior)):
        members = made.of == number
        if members.any():
            assert np.isclose(np.exp(made.within[members]).sum(), 1, atol=1e-5)
            assert (begins[members] == (number < made.starts)).all()
    assert (made.of > 0).all()


def test_words_of_a_slice_are_those_of_the_texts():
    texts = [None, "", " A\u00a0B  \x0bÉÀ\tz\r\n", "\u0085 x \u2003 y", "ab" * 9] * 500
    for part in (pa.array(texts), pa.array(texts).slice(777, 900)):
        words, counts = lm_score._split(part)
        want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in part.to_pylist()]
        assert counts.tolist() == [len(w) for w in want]
        assert words.to_pylist() == [w for t in want for w in t]


def check_base(rows, docs):
    words = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER)) + [None] for r in docs}
    counts = Counter()
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            counts.update(words[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel_tol=1e-9, abs_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] < 0


def test_counts_and_scores_of_a_language_that_can_be_learned(spark):
    """Words of two topics, one per text: the context tells which words come, the counts cannot."""
    draw = np.random.default_rng(4)
    topics = [[f"{a}{b}" for a in ("ka", "ro", "mi") for b in ("no", "te", "la")], [f"{a}{b}" for a in ("shu", "ber") for b in ("ing", "ton", "dle")]]
    rows = [(n, " ".join(draw.choice(topics[n % 2], 80))) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = records(lm_score.lm_scores(docs, block_words=2000))
    assert len(got) == 400
    check_base(got, records(docs))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_odd_rows(odd_docs, no_docs, spark):
    docs = odd_docs.filter("doc_id is not null and (doc_id != 1 or text not like 'another%')")
    got = records(lm_score.lm_scores(odd_docs))
    assert len(got) == odd_docs.count()
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5))
    # The sums of the base over rows whose ids are unique, or repeated in full.
    once = [r for r in records(lm_score.lm_scores(docs.dropDuplicates(["doc_id"])))]
    check_base(once, records(docs.dropDuplicates(["doc_id"])))
    assert lm_score.lm_scores(no_docs).count() == 0
    held = spark.createDataFrame([(n, "a b") for n in range(200) if zlib.crc32(str(n).encode()) % 10 == 0], "doc_id bigint, text string")
    assert {(r["train_tokens"], r["n_known"]) for r in records(lm_score.lm_scores(held))} == {(0, 0)}


def test_what_is_kept_of_the_texts_is_small(spark, monkeypatch, tmp_path):
    """Training runs are read from the encoded texts; they are not written a second time."""
    draw = np.random.default_rng(5)
    spoken = ["".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in draw.integers(2, 9, 3000)]
    docs = spark.createDataFrame([(n, " ".join(draw.choice(spoken, 500))) for n in range(200)], "doc_id bigint, text string").coalesce(1)
    kept = []

    def staged(rows, name, *options):
        made = kept_as(rows, name, *options)
        kept.extend(os.path.getsize(file.removeprefix("file://")) for file in made.inputFiles())
        return made

    kept_as = lm_score.staged
    monkeypatch.setattr(lm_score, "staged", staged)
    assert lm_score.lm_scores(docs).count() == 200
    assert sum(kept) < 3 * 200 * 500


def test_windows_of_a_round_are_those_of_its_runs():
    """Windows written out run by run, from the texts of a block."""
    draw = np.random.default_rng(6)
    lengths, sizes = np.array([0, 1, 95, 40, 130, 41]), draw.integers(1, 5, 30)
    held, draws = np.array([False, False, False, True, False, False]), np.array([0, 2, 1, 0, 0, 2])
    pieces, codes = draw.integers(0, 50, sizes.sum()), draw.integers(0, 30, lengths.sum())
    of_word = np.split(pieces, np.cumsum(sizes)[:-1])
    block = {"held": pa.scalar(held.tolist()), "draws": pa.scalar(draws.tolist(), pa.list_(pa.int32())), "lengths": pa.scalar(lengths.tolist(), pa.list_(pa.int32()))}
    packed = {"codes": codes.astype(np.uint32), "sizes": sizes.astype(np.uint32), "pieces": pieces.astype(np.uint16)}
    block |= {name: pa.scalar(lm_score._packed(value)) for name, value in packed.items()}
    classes = lm_score.SubwordClasses(draw.integers(1, 9, 50), np.zeros(50), np.zeros(9), 4)
    window, lead, seen = attention.WINDOW, attention.CONTEXT, 0
    for number in range(3):
        runs, want = lm_score._runs_of(block, number, 3), []
        for text, length, out, turn in zip(np.split(codes, np.cumsum(lengths)[:-1]), lengths, held, draws, strict=True):
            for start in [] if out else range((number - turn) % 3 * lm_score.RUN_WORDS, length, 3 * lm_score.RUN_WORDS):
                spoken = np.concatenate([of_word[word] for word in text[start : start + lm_score.RUN_WORDS]]).tolist()
                read = [99 if start == 0 else -1, *spoken]
                aim = [*classes.of[spoken], 0]
                if start:
                    aim[0] = -1
                if start + lm_score.RUN_WORDS < length:
                    read, aim = read[:-1], aim[:-1]
                skip = lead if start == 0 else 0
                for at in range(0, len(read), window - skip):
                    fill = lambda part: ([-1] * skip + list(part) + [-1] * window)[:window]
                    want.append((fill(read[at : at + window - skip]), fill(aim[at : at + window - skip])))
        seen += len(runs)
        got = [(r.tolist(), a.tolist()) for i, t in lm_score._windows(runs, np.arange(len(runs)), classes, 99) for r, a in zip(i, t, strict=True)]
        assert got == want
    assert seen == 1 + 3 + 4 + 2
