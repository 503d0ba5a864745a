"""Viterbi paths and forward-backward marginals of many chains at once.

The chains of a slice are cut into blocks of ``BLOCK`` steps, and all blocks
advance side by side. Where chains have more than one block, a transfer matrix
per block carries the state over whole blocks, so the number of Python steps
is about ``BLOCK`` plus the number of blocks of the longest chain, not its
length. Results are those of the plain recursions.
"""

from __future__ import annotations

import numpy as np

BLOCK = 256


class Blocks:
    """Blocks of all chains by falling size; ``offsets`` are the n + 1 chain boundaries."""

    def __init__(self, offsets: np.ndarray):
        lens = np.diff(offsets)
        self.counts = -(-lens // BLOCK)
        first = np.concatenate([[0], np.cumsum(self.counts)])
        chain = np.repeat(np.arange(len(lens)), self.counts)
        start = offsets[chain] + (np.arange(len(chain)) - first[chain]) * BLOCK
        size = np.minimum(BLOCK, offsets[chain + 1] - start) if len(chain) else np.zeros(0, np.int64)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.steps = int(size.max()) if len(size) else 0
        self.width = np.searchsorted(-size[order], -np.arange(self.steps), side="left")  # blocks that have step t
        self.several = bool(len(lens)) and int(self.counts.max()) > 1
        # position of step t of every block; past a block's end any position will do
        self.at = np.minimum(start[order][None, :] + np.arange(self.steps)[:, None], max(int(offsets[-1]) - 1, 0))
        self.live = np.arange(self.steps)[:, None] < size[order][None, :]
        falling = np.argsort(-self.counts, kind="stable")
        self.levels = []  # for j = 0, 1, ...: the j-th block of every chain that has one, and those chains
        for j in range(int(self.counts.max()) if len(lens) else 0):
            chains = falling[:np.searchsorted(-self.counts[falling], -j, side="left")]
            self.levels.append((place[first[chains] + j], chains))
        some = np.flatnonzero(self.counts > 0)
        self.first_of = place[first[some]] if len(some) else some
        self.last_of = place[first[some + 1] - 1] if len(some) else some

    def scatter(self, n: int, values: np.ndarray) -> np.ndarray:
        out = np.zeros((n,) + values.shape[2:], values.dtype)
        out[self.at[self.live]] = values[self.live]
        return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best state of every position: sum of ``scores`` less ``penalty`` per change of state.

    Ties go to staying in the state, then to the lowest state.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    b = Blocks(offsets)
    nb = b.at.shape[1]
    dense = scores[b.at]
    value = np.zeros((nb, k))
    if b.several:
        carry = np.full((nb, k, k), -np.inf)
        carry[:, np.arange(k), np.arange(k)] = 0.0
        for t, m in enumerate(b.width):
            c = carry[:m]
            np.maximum(c, c.max(axis=2, keepdims=True) - penalty, out=c)
            c += dense[t, :m, None, :]
        state = np.zeros((len(b.counts), k))
        for blocks, chains in b.levels:
            value[blocks] = state[chains]
            state[chains] = (state[chains][:, :, None] + carry[blocks]).max(axis=1)
    stay = np.zeros((b.steps, nb, k), bool)
    jump = np.zeros((b.steps, nb), np.int8 if k < 128 else np.int32)
    for t, m in enumerate(b.width):
        v = value[:m]
        jump[t, :m] = v.argmax(axis=1)
        top = v.max(axis=1, keepdims=True) - penalty
        stay[t, :m] = v >= top
        np.maximum(v, top, out=v)
        v += dense[t, :m]
    end = np.zeros(nb, np.int64)
    end[b.last_of] = value[b.last_of].argmax(axis=1)
    if b.several:
        back = np.tile(np.arange(k), (nb, 1))  # the state before a block that leads to each end state
        for t in range(b.steps - 1, -1, -1):
            cur = back[:b.width[t]]
            cur[:] = np.where(np.take_along_axis(stay[t, :b.width[t]], cur, axis=1), cur, jump[t, :b.width[t], None])
        for (blocks, chains), (earlier, before) in zip(b.levels[:0:-1], b.levels[-2::-1]):
            known = back[blocks, end[blocks]]
            end[earlier[:len(chains)]] = known  # both lists name the chains in the same order
    path = np.zeros((b.steps, nb), np.int64)
    for t in range(b.steps - 1, -1, -1):
        m = b.width[t]
        cur = end[:m]
        path[t, :m] = cur
        cur[:] = np.where(stay[t, np.arange(m), cur], cur, jump[t, :m])
    return b.scatter(n, path)


def marginals(weights: np.ndarray, transition: np.ndarray, offsets: np.ndarray, edges: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """State marginals of every position and, if asked for, expected transitions summed over all chains.

    ``weights`` and ``transition`` are positive factors; a chain starts from
    state 0 before its first position.
    """
    n, k = weights.shape
    if n == 0:
        return np.zeros((0, k)), np.zeros((k, k))
    b = Blocks(offsets)
    nb = b.at.shape[1]
    dense = weights[b.at]
    enter, leave = np.zeros((nb, k)), np.ones((nb, k))
    enter[:, 0] = 1.0
    if b.several:
        carry = np.tile(np.eye(k), (nb, 1, 1))
        for t, m in enumerate(b.width):
            c = carry[:m] @ transition
            c *= dense[t, :m, None, :]
            if t % 4 == 3:
                c /= c.sum(axis=(1, 2), keepdims=True)
            carry[:m] = c
        state = np.zeros((len(b.counts), k))
        state[:, 0] = 1.0
        for blocks, chains in b.levels:
            enter[blocks] = state[chains]
            s = np.einsum("ns,nse->ne", state[chains], carry[blocks])
            state[chains] = s / s.sum(axis=1, keepdims=True)
        state = np.ones((len(b.counts), k))
        for blocks, chains in reversed(b.levels):
            leave[blocks] = state[chains]
            s = np.einsum("nse,ne->ns", carry[blocks], state[chains])
            state[chains] = s / s.sum(axis=1, keepdims=True)
    forward = np.zeros((b.steps + 1, nb, k))  # before step t
    forward[0] = enter
    for t, m in enumerate(b.width):
        v = forward[t, :m] @ transition
        v *= dense[t, :m]
        v /= v.sum(axis=1, keepdims=True)
        forward[t + 1, :m] = v
    out = np.zeros((b.steps, nb, k))
    pairs = np.zeros((k, k)) if edges else None
    value = leave
    for t in range(b.steps - 1, -1, -1):
        m = b.width[t]
        p = forward[t + 1, :m] * value[:m]
        out[t, :m] = p / p.sum(axis=1, keepdims=True)
        after = dense[t, :m] * value[:m]
        if edges:
            pair = forward[t, :m, :, None] * transition * after[:, None, :]
            pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = after @ transition.T
        value[:m] = v / v.sum(axis=1, keepdims=True)
    return b.scatter(n, out), pairs
