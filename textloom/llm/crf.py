"""A linear-chain conditional random field in numpy, for many sequences at once.

Sequences are flat arrays: scores (words x labels) and the length of each sequence. Inference cuts each
sequence into blocks; blocks of all sequences run side by side, and the blocks of a
sequence are tied together by the product of their transfer matrices. So a sequence of a
million words takes a few ten thousand numpy steps, and the result is that of the plain recursion.

Defined results: no sequences give empty arrays; every length is at least 1; ties go to the smaller label.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64


def _layout(lengths: np.ndarray):
    """Blocks of at most BLOCK words: their start, length, sequence and place in it. Every length is at least 1."""
    per = -(-lengths // BLOCK)
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + nth * BLOCK
    sizes = np.minimum(np.repeat(lengths, per) - nth * BLOCK, BLOCK)
    return starts, sizes, seq, nth, per


def _exp(scores: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - top, -40.0))


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The posterior of each label at each word."""
    return forward_backward(scores, lengths, trans)[1]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The forward probabilities at each word, each scaled to sum to one, and the posteriors."""
    k = scores.shape[1]
    if not len(scores):
        return np.empty((0, k)), np.empty((0, k))
    emit = _exp(scores, scores.max(1, keepdims=True))
    move = _exp(trans, trans.max())
    starts, sizes, _, nth, per = _layout(lengths)
    n = len(starts)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    alive = np.searchsorted(-sizes, -np.arange(1, BLOCK + 1), side="right")  # blocks longer than t

    # The transfer matrix of a block, from the label before it to its last label.
    whole = np.empty((n, k, k))
    whole[:] = np.eye(k)
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        step = (whole[:m] @ move) * emit[starts[:m] + t][:, None, :]
        whole[:m] = step / step.sum((1, 2), keepdims=True)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)

    # What enters a block from the left and from the right, block by block of each sequence.
    first = np.cumsum(per) - per
    left, right = np.empty((n, k)), np.empty((n, k))
    flow = np.ones((len(per), k))
    for j in range(int(per.max())):
        rows = np.flatnonzero(per > j)
        at = back[first[rows] + j]
        left[at] = flow[rows]
        out = flow[rows, None, :] @ whole[at] if j else (np.ones((len(rows), 1, k)) / k) @ whole[at]
        flow[rows] = out[:, 0] / out[:, 0].sum(1, keepdims=True)
    flow = np.ones((len(per), k))
    for j in range(int(per.max()) - 1, -1, -1):
        rows = np.flatnonzero(per > j)
        at = back[first[rows] + j]
        right[at] = flow[rows]
        out = whole[at] @ flow[rows, :, None]
        flow[rows] = out[:, :, 0] / out[:, :, 0].sum(1, keepdims=True)

    alpha, posterior = np.empty_like(emit), np.empty_like(emit)
    begins = (nth == 0)[order]
    state = left.copy()
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        came = state[:m] @ move
        if t == 0:
            came[begins[:m]] = 1.0  # a sequence begins with any label
        came *= emit[starts[:m] + t]
        came /= came.sum(1, keepdims=True)
        alpha[starts[:m] + t] = came
        state[:m] = came
    state = right.copy()
    for t in range(BLOCK - 1, -1, -1):
        m = alive[t]
        if not m:
            continue
        at = starts[:m] + t
        here = state[:m]
        post = alpha[at] * here
        posterior[at] = post / post.sum(1, keepdims=True)
        before = (here * emit[at]) @ move.T
        state[:m] = before / before.sum(1, keepdims=True)
    return alpha, posterior


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of each sequence; ties go to the smaller label. Sequences of one block run side by side, longer ones by blocks."""
    out = np.zeros(len(scores), np.int8)
    long = lengths > BLOCK
    for which, decode in ((~long, _side_by_side), (long, _by_blocks)):
        if which.any():
            at = np.flatnonzero(np.repeat(which, lengths))
            out[at] = decode(scores[at].astype(np.float64), lengths[which], trans.astype(np.float64))
    return out


def _side_by_side(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    n, k = scores.shape
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    best, came, out = scores[starts].copy(), np.zeros((n, k), np.int8), np.zeros(n, np.int8)
    for t in range(1, int(sizes[0])):
        m = alive[t]
        options = best[:m, :, None] + trans
        came[starts[:m] + t] = options.argmax(1)
        best[:m] = options.max(1) + scores[starts[:m] + t]
    label = best.argmax(1)
    for t in range(int(sizes[0]) - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        out[at] = label[:m]
        label[:m] = came[at, label[:m]]
    return out


def _by_blocks(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """As the inference: what each block makes of each label before it, then which of them is on the best path, then the labels within all blocks at once."""
    n, k = scores.shape
    out = np.zeros(n, np.int8)
    starts, sizes, _, nth, per = _layout(lengths)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes, begins = starts[order], sizes[order], (nth == 0)[order]
    alive = np.searchsorted(-sizes, -np.arange(1, BLOCK + 1), side="right")
    blocks = len(starts)
    back = np.empty(blocks, np.int64)
    back[order] = np.arange(blocks)
    first = np.cumsum(per) - per
    # best[b, i, j]: of paths from label i before block b to label j at its last word; a sequence begins with any label
    best = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        step = (best[:m, :, :, None] + trans).max(2)
        if t == 0:
            step[begins[:m]] = 0.0
        best[:m] = step + scores[starts[:m] + t][:, None, :]
    # what enters each block, then the label that its best path ends with
    entering, leaving = np.zeros((blocks, k)), np.zeros((blocks, k))
    flow = np.zeros((len(per), k))
    for j in range(int(per.max())):
        rows = np.flatnonzero(per > j)
        at = back[first[rows] + j]
        entering[at] = flow[rows]
        flow[rows] = leaving[at] = (flow[rows, :, None] + best[at]).max(1)
        flow[rows] -= flow[rows].max(1, keepdims=True)
    last = np.zeros(blocks, np.int64)
    label = np.zeros(len(per), np.int64)
    for j in range(int(per.max()) - 1, -1, -1):
        rows = np.flatnonzero(per > j)
        at = back[first[rows] + j]
        ends = per[rows] == j + 1
        last[at] = np.where(ends, leaving[at].argmax(1), label[rows])
        label[rows] = (entering[at] + best[at, :, last[at]]).argmax(1)
    # within the blocks
    came = np.zeros((n, k), np.int8)
    state = entering.copy()
    for t in range(BLOCK):
        m = alive[t]
        if not m:
            break
        options = state[:m, :, None] + trans
        if t == 0:
            options[begins[:m]] = 0.0
        came[starts[:m] + t] = options.argmax(1)
        state[:m] = options.max(1) + scores[starts[:m] + t]
    for t in range(BLOCK - 1, -1, -1):
        m = alive[t]
        at = starts[:m] + t
        out[at] = last[:m]
        last[:m] = came[at, last[:m]]
    return out


def train(
    features: list[np.ndarray], labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int, epochs: int = 6,
    rate: float = 0.3, l2: float = 1e-6, stickiness: float = 0.0, seed: int = 7
) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x labels) and transitions by adaptive gradient steps on the conditional log-likelihood.

    features: the feature ids of each word. The gradient of a batch of sequences is what was seen less what forward-backward expects."""
    weights, trans = np.zeros((n_features, n_labels)), np.eye(n_labels) * stickiness
    sums_w, sums_t = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    starts = np.cumsum(lengths) - lengths
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(lengths)), max(1, len(lengths) // 32)):
            where = np.concatenate([np.arange(starts[s], starts[s] + lengths[s]) for s in part])
            size = lengths[part]
            ids = [features[i] for i in where]
            flat, owner = np.concatenate(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])
            scores = np.zeros((len(ids), n_labels))
            np.add.at(scores, owner, weights[flat])
            alpha, post = forward_backward(scores, size, trans)
            miss = -post
            miss[np.arange(len(ids)), labels[where]] += 1
            # two labels in a row: what comes from the left, the step, and what the right adds at the second
            inside = np.ones(len(ids), bool)
            inside[np.cumsum(size) - size] = False
            b = np.flatnonzero(inside)
            seen = np.zeros_like(trans)
            np.add.at(seen, (labels[where[b - 1]], labels[where[b]]), 1)
            reached = alpha[b - 1] @ _exp(trans, trans.max())
            pair = alpha[b - 1][:, :, None] * _exp(trans, trans.max()) * (post[b] / np.maximum(reached, 1e-300))[:, None, :]
            pair /= pair.sum((1, 2), keepdims=True)
            grad_t = (seen - pair.sum(0)) / max(1, len(b)) - l2 * trans
            rows, inverse = np.unique(flat, return_inverse=True)
            grad_w = np.zeros((len(rows), n_labels))
            np.add.at(grad_w, inverse, miss[owner])
            grad_w = grad_w / len(ids) - l2 * weights[rows]
            sums_w[rows] += grad_w**2
            weights[rows] += rate * grad_w / np.sqrt(sums_w[rows])
            sums_t += grad_t**2
            trans += rate * grad_t / np.sqrt(sums_t)
    return weights, trans
