"""A small causal self-attention model over subword ids, in numpy: its forward pass, its gradient, its training steps.

It reads subwords, each with an embedding of its own. What comes next is predicted in two steps: whether a word begins (or the text ends), and which class it is among those
that begin a word or among the others. So only one part of the classes is compared for each token.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

# Slots of a window, and how many at its beginning are context whose tokens the window before has scored.
WINDOW, CONTEXT = 32, 8
DIMENSIONS = 16
RATE, BATCH_WINDOWS = 0.02, 32

Parameters = dict[str, np.ndarray]


def initial(
    classes: int,
    prior: np.ndarray,
    starts: int,
    seed: int = 42,
    dimensions: int = DIMENSIONS,
    window: int = WINDOW,
    vocabulary: int | None = None,
) -> Parameters:
    """Random small weights; the output begins at the given log probabilities of the classes, the first ``starts`` of which
    begin a word. ``vocabulary`` is how many different tokens are read; without it classes are."""
    share = np.exp(prior)
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.standard_normal(shape) * 0.1).astype(np.float32)
    square = (dimensions, dimensions)
    return {
        # One input more than there are tokens: the beginning of a text.
        "embed": draw((classes if vocabulary is None else vocabulary) + 1, dimensions),
        "place": draw(window, dimensions),
        "query": draw(*square),
        "key": draw(*square),
        "value": draw(*square),
        "mix": draw(*square),
        "out": draw(dimensions, classes),
        "bias": prior.astype(np.float32),
        "gate": np.zeros((dimensions, 1), np.float32),
        "gate_bias": np.array([np.log(share[:starts].sum() / max(1e-9, share[starts:].sum()))], np.float32),
    }


@cache
def _earlier(window: int) -> np.ndarray:
    return np.tril(np.ones((window, window), np.float32))


def _bounded(left: np.ndarray, right: np.ndarray, most: float = 60) -> bool:
    """Whether products of rows of both cannot get so large that their exponentials need a shift."""
    return np.einsum("ij,ij->i", left, left).max() * np.einsum("ij,ij->i", right, right).max() < most**2


def attend(p: Parameters, inputs: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States of a batch of windows, and what the gradient needs. What comes later, and slots before the text, cannot be seen."""
    count, window = inputs.shape
    hidden = np.take(p["embed"], inputs.ravel(), axis=0).reshape(count, window, -1)
    hidden += p["place"][:window]
    d = hidden.shape[2]
    rows = hidden.reshape(-1, d)
    query, key, value = (rows @ p[name] for name in ("query", "key", "value"))
    query *= np.float32(1 / np.sqrt(d))
    tame = _bounded(query, key)
    query, key, value = (part.reshape(hidden.shape) for part in (query, key, value))
    weights = query @ key.transpose(0, 2, 1)
    if not tame:
        seen = np.tril(np.ones((window, window), bool))[None] & valid[:, None, :]
        weights -= np.where(seen, weights, -np.inf).max(axis=2, keepdims=True, initial=-1e9)
        np.minimum(weights, 0, out=weights)
    np.exp(weights, out=weights)
    weights *= _earlier(window)
    if not valid.all():
        weights *= valid[:, None, :]
    weights /= np.maximum(weights @ np.ones((window, 1), weights.dtype), 1e-30)
    seen = weights @ value
    return hidden + (seen.reshape(-1, d) @ p["mix"]).reshape(hidden.shape), (hidden, query, key, value, weights, seen)


@dataclass
class Scorer:
    """The parameters as scoring needs them: products of matrices that are only used together are formed once."""

    embed: np.ndarray
    place: np.ndarray
    products: np.ndarray
    earlier: np.ndarray
    parts: list[tuple[np.ndarray, np.ndarray]]
    gate: np.ndarray
    gate_bias: float
    starts: int
    tame: bool

    @classmethod
    def of(cls, p: Parameters, starts: int) -> Scorer:
        dimensions = p["out"].shape[0]
        # The last column is for ones: with it, sums of weights come out of the product with the values.
        values = np.zeros((dimensions, dimensions + 1), np.float32)
        values[:, :dimensions] = p["value"] @ p["mix"]
        pairs = p["query"] @ p["key"].T * np.float32(1 / np.sqrt(dimensions))
        parts = [(np.ascontiguousarray(p["out"][:, cut]), p["bias"][cut].copy()) for cut in (slice(0, starts), slice(starts, None))]
        # How large the logits can get: below these bounds exponentials need no clipping.
        hidden = np.linalg.norm(p["embed"], axis=1).max() + np.linalg.norm(p["place"], axis=1).max()
        state = hidden * (1 + np.linalg.norm(values[:, :dimensions], 2))
        logits = state * np.linalg.norm(p["out"], axis=0).max() + np.abs(p["bias"]).max()
        tame = bool(hidden**2 * np.linalg.norm(pairs, 2) < 60 and logits < 80)
        window = len(p["place"])
        earlier = np.tril(np.ones((window, window), np.float32))
        products = np.hstack([pairs, values])
        return cls(p["embed"], p["place"], products, earlier, parts, p["gate"][:, 0], float(p["gate_bias"][0]), starts, tame)

    def __call__(self, inputs: np.ndarray, valid: np.ndarray, targets: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every target after the context slots, and of a word beginning there.

        The same as :func:`attend` and the two steps written out, in fewer passes.
        """
        count, window = inputs.shape
        hidden = np.take(self.embed, inputs, axis=0, mode="clip")
        hidden += self.place
        d = hidden.shape[2]
        both = (hidden.reshape(-1, d) @ self.products).reshape(count, window, -1)
        weights = both[:, :, :d] @ hidden.transpose(0, 2, 1)
        if not self.tame:
            np.minimum(weights, 60, out=weights)
        np.exp(weights, out=weights)
        weights *= self.earlier
        if not valid.all():
            weights *= valid[:, None, :]
        values = both[:, :, d:]
        values[:, :, -1] = 1
        seen = weights[:, context:] @ values
        state = seen[:, :, :-1] / np.maximum(seen[:, :, -1:], 1e-30)
        state += hidden[:, context:]
        flat = state.reshape(-1, state.shape[2])
        target = targets.ravel()
        odds = (flat @ self.gate + self.gate_bias).clip(-60, 60)
        begun = -np.log1p(np.exp(-odds))
        first = target < self.starts
        chosen = np.where(first, begun, begun - odds)
        for rows, (out, bias), shift in zip((np.flatnonzero(first), np.flatnonzero(~first)), self.parts, (0, self.starts), strict=True):
            if not len(rows):
                continue
            logits = flat[rows] @ out
            logits += bias
            if not self.tame:
                logits -= logits.max(axis=1, keepdims=True)
            picked = logits[np.arange(len(rows)), target[rows] - shift]
            np.exp(logits, out=logits)
            chosen[rows] += picked - np.log(logits @ np.ones(logits.shape[1], np.float32))
        return chosen.reshape(targets.shape), begun.reshape(targets.shape)


def gradient(
    p: Parameters, inputs: np.ndarray, valid: np.ndarray, targets: np.ndarray, wanted: np.ndarray, starts: int
) -> tuple[Parameters, float]:
    """Of the mean negative log probability of the wanted targets, and that mean."""
    g, tokens, loss = sparse_gradient(p, inputs, valid, targets, wanted, starts)
    rows, g["embed"] = g["embed"], np.zeros_like(p["embed"])
    g["embed"][tokens] = rows
    return g, loss


def sparse_gradient(
    p: Parameters, inputs: np.ndarray, valid: np.ndarray, targets: np.ndarray, wanted: np.ndarray, starts: int
) -> tuple[Parameters, np.ndarray, float]:
    """The same with rows for the tokens in ``inputs`` only, which come second: all others have no gradient."""
    state, (hidden, query, key, value, weights, seen) = attend(p, inputs, valid)
    d, classes = state.shape[2], p["out"].shape[1]
    flat = lambda a: a.reshape(-1, a.shape[-1])
    states, target = flat(state), targets.ravel()
    chosen = np.flatnonzero(wanted)
    count = max(1, len(chosen))
    d_states = np.zeros_like(states)
    g: Parameters = {"out": np.zeros_like(p["out"]), "bias": np.zeros_like(p["bias"])}
    first = target[chosen] < starts
    odds = states[chosen] @ p["gate"][:, 0] + p["gate_bias"][0]
    loss = float(np.logaddexp(0, np.where(first, -odds, odds)).sum())
    d_odds = (1 / (1 + np.exp(-odds.clip(-60, 60))) - first) / count
    g["gate"] = (states[chosen].T @ d_odds)[:, None]
    g["gate_bias"] = d_odds.sum(keepdims=True)
    d_states[chosen] = d_odds[:, None] * p["gate"][:, 0]
    for rows, cut in ((chosen[first], slice(0, starts)), (chosen[~first], slice(starts, classes))):
        if not len(rows):
            continue
        # The bias is one more column, so that it comes out of the same products.
        own = np.ones((len(rows), d + 1), states.dtype)
        own[:, :d] = states[rows]
        out = np.vstack([p["out"][:, cut], p["bias"][None, cut]])
        share = own @ out
        if not _bounded(own, out.T):
            share -= share.max(axis=1, keepdims=True)
        np.exp(share, out=share)
        total = share @ np.ones(share.shape[1], share.dtype)
        picked = (np.arange(len(rows)), target[rows] - cut.start)
        loss -= float(np.log(np.maximum(share[picked] / total, 1e-30)).sum())
        share *= (1 / (total * count))[:, None]
        share[picked] -= 1 / count
        d_out = own.T @ share
        g["out"][:, cut], g["bias"][cut] = d_out[:d], d_out[d]
        d_states[rows] += share @ np.ascontiguousarray(out[:d].T)
    d_state = d_states.reshape(state.shape)
    g["mix"] = flat(seen).T @ d_states
    d_seen = (d_states @ p["mix"].T).reshape(state.shape)
    d_value = weights.transpose(0, 2, 1) @ d_seen
    d_weights = d_seen @ value.transpose(0, 2, 1)
    # What the weights of a slot add up to is what it has seen.
    d_weights -= np.einsum("ijk,ijk->ij", d_seen, seen)[:, :, None]
    d_weights *= weights
    d_query = (d_weights @ key) * np.float32(1 / np.sqrt(d))
    d_key = d_weights.transpose(0, 2, 1) @ query
    d_hidden = d_states
    for name, part in (("query", d_query), ("key", d_key), ("value", d_value)):
        g[name] = flat(hidden).T @ flat(part)
        d_hidden = d_hidden + flat(part) @ p[name].T
    g["place"] = np.zeros_like(p["place"])
    g["place"][: inputs.shape[1]] = d_hidden.reshape(state.shape).sum(axis=0)
    # Only rows of tokens that were read are other than zero: sums over stretches of the slots in order of their token.
    order = np.argsort(inputs, axis=None, kind="stable")
    read = inputs.ravel()[order]
    begins = np.flatnonzero(np.append(True, read[1:] != read[:-1]))
    g["embed"] = np.add.reduceat(d_hidden[order], begins, axis=0)
    return g, read[begins], loss / count


class Adam:
    """Steps of parameters, which become parts of one array: all but the embeddings move together."""

    def __init__(self, p: Parameters, rate: float = RATE) -> None:
        self.embed, self.rate, self.step = p["embed"], rate, 0
        self.names = [name for name in p if name != "embed"]
        self.others = np.concatenate([p[name].ravel() for name in self.names])
        at = 0
        for name in self.names:
            p[name] = self.others[at : at + p[name].size].reshape(p[name].shape)
            at += p[name].size
        self.moments = [np.zeros_like(self.embed), np.zeros_like(self.embed)], [np.zeros_like(self.others), np.zeros_like(self.others)]

    def update(self, g: Parameters, read: np.ndarray) -> None:
        """One step. Of the embeddings only those of the tokens that were ``read`` move; the gradient has rows for these."""
        self.step += 1
        # The first steps are small: the averages are not known yet.
        rate = self.rate * min(1.0, self.step / 20)
        others = np.concatenate([g[name].ravel() for name in self.names])
        for values, (means, squares), rows, value in (
            (self.embed, self.moments[0], read, g["embed"]), (self.others, self.moments[1], slice(None), others)
        ):
            mean, square = means[rows], squares[rows]
            mean = mean + 0.1 * (value - mean)
            square = square + 0.01 * (value * value - square)
            means[rows], squares[rows] = mean, square
            fit = np.sqrt(square / (1 - 0.99**self.step)) + 1e-8
            values[rows] -= (rate / (1 - 0.9**self.step) * mean / fit).astype(values.dtype)


def windows_of(lengths: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover texts of these lengths: the text of each, and the first token that it scores."""
    step = window - context
    count = -(-lengths // step)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, number * step


def score_texts(
    p: Parameters,
    classes: np.ndarray,
    lengths: np.ndarray,
    starts: int,
    window: int = WINDOW,
    context: int = CONTEXT,
    at_once: int = 64,
    read: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """For every token of the texts laid end to end, the two numbers of :class:`Scorer`. ``read`` are the tokens themselves,
    without it the classes are read.

    Each token is scored once, by the window in which at least ``context`` tokens before it - or all there are - can be seen.
    """
    begin_class, scorer = p["embed"].shape[0] - 1, Scorer.of(p, starts)
    begins = np.cumsum(lengths) - lengths
    # A text is read shifted by one: the beginning predicts its first token.
    padded = np.full(len(classes) + len(lengths), begin_class, dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(classes)) + row + 1] = classes if read is None else read
    text, first = windows_of(lengths, window, context)
    chosen, begun = np.zeros(len(classes), np.float32), np.zeros(len(classes), np.float32)
    slots = np.arange(window) - context
    for at in range(0, len(text), at_once):
        t, f = text[at : at + at_once], first[at : at + at_once]
        place = f[:, None] + slots[None]
        valid = place >= 0
        there = valid & (place < lengths[t][:, None])
        inputs = padded[np.where(there, begins[t][:, None] + t[:, None] + place, 0)]
        outputs = there[:, context:]
        flat = (begins[t][:, None] + place)[:, context:][outputs]
        targets = np.zeros(outputs.shape, dtype=np.int64)
        targets[outputs] = classes[flat]
        one, two = scorer(inputs, valid, targets, context)
        chosen[flat], begun[flat] = one[outputs], two[outputs]
    return chosen, begun
