"""A causal self-attention language model in numpy over subword ids.

One attention layer reads a window of ``CONTEXT`` ids; the next id is predicted
through a binary tree (hierarchical softmax over a Huffman code of the corpus
counts), so its probabilities sum to one at the cost of a few inner products
and the context tells any two ids apart. Every node starts at the odds that the
counts give it: the untrained model is the corpus' unigram model, and training
adds what the context tells.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

WIDTH = 8
CONTEXT = 16
#: A window moves by so many ids; each id is scored once, with CONTEXT - STRIDE ids before it at least.
STRIDE = 12
#: Windows that are worked on at once.
BATCH = 1024
RATE = np.float32(0.2)
SEED = 11

_MOST = np.float32(60)  # exponents beyond are cut, so that sums stay finite
_CAUSAL = np.tri(CONTEXT, dtype=np.float32)


@dataclass
class Tree:
    """Paths of a Huffman code, by depth: for each id its inner nodes from the leaf up and the side taken there."""

    length: np.ndarray  # of each id's path
    node: np.ndarray  # depth x id
    side: np.ndarray  # depth x id; 1.0 right, 0.0 left
    odds: np.ndarray  # log odds of the right side, by the counts

    def __post_init__(self):
        #: place of each id in the order of their paths, longest first
        self.rank = np.empty(len(self.length), dtype=np.uint16 if len(self.length) <= 1 << 16 else np.int64)
        self.rank[np.argsort(-self.length, kind="stable")] = np.arange(len(self.length))


def huffman(counts: np.ndarray) -> Tree:
    n = len(counts)
    heap = [(float(c) + 0.5, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    right = np.zeros(2 * n - 1)
    odds = np.zeros(n - 1, dtype=np.float32)
    for inner in range(n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = n + inner
        right[b] = 1.0
        odds[inner] = np.log(wb / wa)
        heapq.heappush(heap, (wa + wb, n + inner))
    root = 2 * n - 2
    # ids climb to the root together
    at, length, node, side = np.arange(n), np.zeros(n, dtype=np.int64), [], []
    while (live := at != root).any():
        length += live
        node.append(np.where(live, parent[at] - n, 0).astype(np.int32))
        side.append(np.where(live, right[at], 0).astype(np.float32))
        at = np.where(live, parent[at], root)
    return Tree(length, np.stack(node), np.stack(side), odds) if node else Tree(length, np.zeros((0, n), np.int32), np.zeros((0, n), np.float32), odds)


@dataclass
class Model:
    tree: Tree
    embed: np.ndarray  # id x WIDTH
    place: np.ndarray  # CONTEXT x WIDTH
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    out: np.ndarray
    head: np.ndarray  # inner node x WIDTH
    bias: np.ndarray  # inner node

    DENSE = ("place", "query", "key", "value", "out")

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = SEED) -> Model:
        random = np.random.default_rng(seed)
        tree = huffman(counts)

        def draw(*shape):
            return (random.standard_normal(shape) * 0.3).astype(np.float32)

        return cls(tree, draw(len(counts), WIDTH), draw(CONTEXT, WIDTH) * np.float32(0.1), *(draw(WIDTH, WIDTH) for _ in range(4)), np.zeros((len(tree.odds), WIDTH), np.float32), tree.odds.copy())

    def copy(self) -> Model:
        return Model(self.tree, *(getattr(self, n).copy() for n in ("embed", *self.DENSE, "head", "bias")))

    def _forward(self, ids: np.ndarray):
        b, c = ids.shape
        x = self.embed[ids] + self.place[:c]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ part).reshape(b, c, WIDTH) for part in (self.query * np.float32(WIDTH**-0.5), self.key, self.value))
        weight = q @ k.transpose(0, 2, 1)
        np.minimum(weight, _MOST, out=weight)
        np.exp(weight, out=weight)
        weight *= _CAUSAL[:c, :c]
        # a column of ones beside the values gives the sums of the weights
        z = weight @ np.concatenate([v, np.ones((b, c, 1), np.float32)], axis=2)
        total = z[:, :, WIDTH:]
        z = z[:, :, :WIDTH] / total
        return x, q, k, v, weight, total, z, x + (z.reshape(-1, WIDTH) @ self.out).reshape(x.shape)

    def log10(self, ids: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """log10 probability of each target where ``scored``, in order."""
        h, order, first, times, y = self._by_target(self._forward(ids)[-1][scored], target[scored])
        total = np.zeros(len(order))
        depths, _, _, across = self._paths(y)
        at = 0
        for d in depths:
            part = slice(at, at := at + d)
            n = first[d]
            # log(1 + exp(x)) of the odds of the side not taken
            odds = np.einsum("ij,ij->j", np.repeat(across[:, part], times[:d], axis=1), h[:, :n])
            np.negative(odds, out=odds)
            np.exp(np.minimum(odds, _MOST, out=odds), out=odds)
            odds += 1
            total[:n] += np.log(odds, out=odds)
        out = np.empty(len(order))
        out[order] = total * -(1 / np.log(10))
        return out

    def _by_target(self, h: np.ndarray, y: np.ndarray):
        """Contexts by their targets, the longest paths first.

        Contexts as columns, with a row of ones for the bias; their former
        places; where each different target's begin, and their number; how many
        they are; the targets. Equal targets share their paths, so what a path
        takes is fetched once for all of them.
        """
        rank = self.tree.rank[y]
        order = np.argsort(rank, kind="stable")
        rank = rank[order]
        new = np.ones(len(y), dtype=bool)
        np.not_equal(rank[1:], rank[:-1], out=new[1:])
        first = np.append(np.flatnonzero(new), len(y))
        columns = np.ones((WIDTH + 1, len(y)), dtype=np.float32)
        columns[:WIDTH] = h[order].T
        return columns, order, first, np.diff(first), y[order[first[:-1]]]

    def _paths(self, y: np.ndarray):
        """The paths of the targets, longest first, level after level.

        How many targets have a node at each depth; the nodes; 1 or -1 for the
        side taken there; as columns the nodes' vectors and biases times that.
        """
        n = np.bincount(self.tree.length[y]) if len(y) else np.zeros(1, dtype=np.int64)
        depths = len(y) - np.cumsum(n)[:-1]
        node, side = np.empty(depths.sum(), dtype=np.int32), np.empty(depths.sum(), dtype=np.float32)
        at = 0
        for level, d in enumerate(depths):
            part = slice(at, at := at + d)
            np.take(self.tree.node[level], y[:d], out=node[part], mode="clip")
            np.take(self.tree.side[level], y[:d], out=side[part], mode="clip")
        side *= 2
        side -= 1
        across = np.empty((WIDTH + 1, len(node)), dtype=np.float32)
        np.multiply(np.take(self.head, node, axis=0).T, side, out=across[:WIDTH])
        np.multiply(np.take(self.bias, node), side, out=across[WIDTH])
        return depths, node, side, across

    def windows(self, ids: np.ndarray, end: int):
        """(inputs, targets, scored) windows of one text; the end id opens the text and closes it."""
        made = list(self.window_runs(ids, end))
        return tuple(np.concatenate([m[k] for m in made]) for k in range(3))

    def window_runs(self, ids: np.ndarray, end: int):
        """The windows of one text in order, at most ``BATCH`` of them at once, however long the text is."""
        n = len(ids) + 1
        starts = np.arange(0, max(1, n - CONTEXT + STRIDE), STRIDE)
        for run in range(0, len(starts), BATCH):
            some = starts[run : run + BATCH]
            low, high = int(some[0]), min(n, int(some[-1]) + CONTEXT)
            part = np.concatenate([[end] if low == 0 else ids[low - 1 : low], ids[low:high], [end] if high == n else []]).astype(np.int32)
            at = some[:, None] + np.arange(CONTEXT)
            inside = at < n
            at = np.minimum(at, n - 1) - low
            scored = inside & ((np.arange(CONTEXT) >= CONTEXT - STRIDE) | (some == 0)[:, None])
            yield part[at], part[at + 1], scored

    def batches(self, texts, end: int):
        """(inputs, targets, scored, number of each window's text): batches of windows of many texts, in order."""
        pool, held = [], 0
        for number, ids in enumerate(texts):
            for made in self.window_runs(ids, end):
                pool.append((*made, np.full(len(made[0]), number)))
                held += len(made[0])
                if held >= BATCH:
                    together = [np.concatenate([p[k] for p in pool]) for k in range(4)]
                    yield tuple(c[:BATCH] for c in together)
                    pool, held = [[c[BATCH:] for c in together]], held - BATCH
        if held:
            yield tuple(np.concatenate([p[k] for p in pool]) for k in range(4))

    def score_texts(self, texts: list[np.ndarray], end: int) -> np.ndarray:
        """log10 probability of each text, its end included."""
        total = np.zeros(len(texts))
        for ids, target, scored, number in self.batches(texts, end):
            total += np.bincount(np.repeat(number, scored.sum(axis=1)), self.log10(ids, target, scored), minlength=len(total))
        return total

    def fresh(self) -> dict[str, np.ndarray]:
        """Squared gradients, and how often each row was touched."""
        return {name: np.zeros_like(getattr(self, name)) for name in ("embed", "head", "bias", *self.DENSE)} | {"embed_touches": np.zeros(len(self.embed)), "head_touches": np.zeros(len(self.head))}

    def train(self, ids: np.ndarray, target: np.ndarray, seen: dict[str, np.ndarray], scored: np.ndarray | None = None) -> None:
        """One Adagrad step on the targets of a batch of windows, or on those that are ``scored`` only."""
        x, q, k, v, weight, total, z, h3 = self._forward(ids)
        weight /= total
        # each id of a text counts once, and what fills up its last window does not
        here = np.flatnonzero(np.ones(target.size, dtype=bool) if scored is None else scored)
        if not len(here):
            return
        h, order, first, times, y = self._by_target(h3.reshape(-1, WIDTH)[here], target.reshape(-1)[here])
        push = np.zeros((WIDTH, len(here)), dtype=np.float32)
        depths, nodes, side, taken = self._paths(y)
        # the gradients of a node from each different target below it, the bias last, level after level
        sums = np.empty_like(taken)
        at = 0
        for d in depths:
            part = slice(at, at := at + d)
            n = first[d]
            across = np.repeat(taken[:, part], times[:d], axis=1)
            error = np.einsum("ij,ij->j", across, h[:, :n])
            np.exp(np.minimum(error, 30, out=error), out=error)
            error += 1
            np.reciprocal(error, out=error)
            across *= error
            push[:, :n] -= across[:WIDTH]
            np.multiply(h[:, :n], error, out=across)
            sums[:, part] = np.add.reduceat(across, first[:d], axis=1)
        sums *= -side
        touched = np.concatenate([times[:d] for d in depths]) if len(depths) else nodes
        head_rows, head_touches, dhead = _row_sums(nodes, sums, len(self.head), touched)
        dh = np.zeros((target.size, WIDTH), np.float32)
        dh[here[order]] = push.T
        dh3 = dh.reshape(h3.shape)
        dz = (dh @ self.out.T).reshape(h3.shape)
        da = dz @ v.transpose(0, 2, 1)
        dv = weight.transpose(0, 2, 1) @ dz
        # the same as the sums of da * weight
        da -= ((dz * z).reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(*ids.shape, 1)
        da *= weight
        dq = (da @ k).reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
        dk = (da.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)  # q holds the scale
        dv = dv.reshape(-1, WIDTH)
        dx = dh + dq @ self.query.T + dk @ self.key.T + dv @ self.value.T
        flat = x.reshape(-1, WIDTH).T
        used, touches, dembed = _row_sums(ids.reshape(-1), np.ascontiguousarray(dx.T), len(self.embed))
        gradients = {
            "embed": (used, dembed),
            "place": (slice(None), dx.reshape(h3.shape).sum(axis=0)),
            "query": (slice(None), flat @ dq),
            "key": (slice(None), flat @ dk),
            "value": (slice(None), flat @ dv),
            "out": (slice(None), z.reshape(-1, WIDTH).T @ dh),
            "head": (head_rows, dhead[:, :WIDTH]),
            "bias": (head_rows, dhead[:, WIDTH]),
        }
        scale = np.float32(1 / len(here) ** 0.5)
        for name, (rows, gradient) in gradients.items():
            gradient = gradient * scale
            square = seen[name][rows] + gradient * gradient
            seen[name][rows] = square
            getattr(self, name)[rows] -= RATE * gradient / np.sqrt(square + np.float32(1e-6))
        seen["embed_touches"][used] += touches
        seen["head_touches"][head_rows] += head_touches


def _row_sums(row: np.ndarray, values: np.ndarray, n: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that occur, how often, sums of the columns of ``values`` for each); a column stands for one occurrence, or for so many ``times``."""
    count = np.bincount(row, times, n)
    rows = np.flatnonzero(count)
    place = np.empty(n, dtype=np.int64)
    place[rows] = np.arange(len(rows))
    at = place[row]
    return rows, count[rows], np.stack([np.bincount(at, v, len(rows)) for v in values], axis=1).astype(np.float32)
