"""A gated recurrent language model in numpy, with a class-factored output.

Words of a short list are dealt to classes of ``WITHIN`` by falling count; one more class stands for
all other words. The output is the class's softmax times the word's softmax inside its class. The
input of a word is its own row of gate inputs. Truncated backpropagation goes through windows of
``WINDOW`` tokens; states, but no gradients, pass from window to window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

HIDDEN, WITHIN, WINDOW = 16, 32, 32
RATE, CLIP = 0.1, 5.0
Params = dict[str, np.ndarray]


def fresh(short: int, seed: int = 7, hidden: int = HIDDEN) -> Params:
    """``short`` words; row ``classes * WITHIN`` of the inputs stands for every other word."""
    draw = np.random.default_rng(seed)
    classes = max(1, -(-short // WITHIN))
    inside = np.zeros((classes, WITHIN), np.float32)
    inside.ravel()[short:] = -1e9
    made = {
        "gates": draw.normal(0, 0.1, (classes * WITHIN + 1, 3 * hidden)),
        "turn": draw.normal(0, 0.2, (hidden, 3 * hidden)),
        "to_class": draw.normal(0, 0.1, (hidden, classes + 1)),
        "class_bias": np.zeros(classes + 1),
        "to_word": draw.normal(0, 0.1, (classes, hidden, WITHIN)),
        "word_bias": inside,
    }
    return {k: v.astype(np.float32) for k, v in made.items()}


def advance(gates: np.ndarray, turn: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step, lanes side by side: the inputs' ``gates[3 * unit, lane]``, ``turn[3 * unit, unit]``, ``h[unit, lane]``."""
    size = h.shape[0]
    turned = turn @ h
    both = gates[: 2 * size] + turned[: 2 * size]
    np.negative(both, out=both)
    np.exp(both, out=both)
    both += 1
    np.reciprocal(both, out=both)
    keep, reset = both[:size], both[size:]
    new = reset * turned[2 * size :]
    new += gates[2 * size :]
    np.tanh(new, out=new)
    out = h - new
    out *= keep
    out += new
    return out, keep, reset, new, turned[2 * size :]


def step(p: Params, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of states ``h[lane, unit]``; laid out by unit, so that each operation runs along the lanes."""
    return tuple(x.T for x in advance(p["gates"][ids].T, p["turn"].T, h.T))


class Outputs:
    """Logits of the targets of many states at once, by class: column ``k`` belongs to place ``by[k]``.

    Ties of a class keep their order. ``states[unit, place]``; biases are the weights of a last unit that is always 1.
    """

    def __init__(self, p: Params, states: np.ndarray, target: np.ndarray, places: np.ndarray) -> None:
        self.classes = p["to_word"].shape[0]
        kind = (target // WITHIN).astype(np.int32)
        order = np.argsort(kind.astype(np.int16) if self.classes < 1 << 15 else kind, kind="stable")
        self.by, self.kind = places[order], kind[order]
        self.word = target[order] - self.kind * WITHIN
        self.ends = np.searchsorted(self.kind, np.arange(self.classes + 1))
        self.at = np.arange(len(order))
        self.states = np.empty((states.shape[0] + 1, len(order)), states.dtype)
        np.take(states, self.by, axis=1, out=self.states[:-1], mode="clip")
        self.states[-1] = 1
        self.to_class = np.vstack([p["to_class"], p["class_bias"][None]])
        self.to_word = np.concatenate([p["to_word"], p["word_bias"][:, None]], axis=1)

    def spans(self) -> Iterator[tuple[int, slice]]:
        for c in np.flatnonzero(np.diff(self.ends)):
            yield c, slice(self.ends[c], self.ends[c + 1])

    def of_class(self) -> np.ndarray:
        return self.to_class.T @ self.states

    def of_word(self) -> np.ndarray:
        """Words outside the short list, the last columns, have none."""
        x = np.empty((WITHIN, self.ends[-1]), self.states.dtype)
        for c, own in self.spans():
            x[:, own] = self.to_word[c].T @ self.states[:, own]
        return x


def settle(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the softmax of each column at its chosen row; ``x`` becomes its exponentials, whose sums come second."""
    x -= x.max(axis=0)
    own = x[chosen, np.arange(x.shape[1])]
    np.exp(x, out=x)
    sums = x.sum(axis=0)
    return own - np.log(sums), sums


def log_p(p: Params, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of the target's class, and of the target inside it (other words: class alone)."""
    out = Outputs(p, h.T, target, np.arange(len(target)))
    got = settle(out.of_class(), out.kind)[0].astype(float)
    listed = out.ends[-1]
    got[:listed] += settle(out.of_word(), out.word[:listed])[0]
    back = np.empty_like(got)
    back[out.by] = got
    return back


def score(p: Params, texts: list[np.ndarray], start: int) -> np.ndarray:
    """Natural log probability of each id sequence, the state carried through the whole of it.

    Longest first, so that the sequences still going are always the first lanes.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    total, hidden = np.zeros(len(texts)), p["turn"].shape[0]
    if not len(texts) or not sizes.max():
        return total
    flat = np.concatenate([texts[i] for i in order])
    begins, ordered = np.cumsum(sizes[order]) - sizes[order], sizes[order]
    gates, turn = np.ascontiguousarray(p["gates"].T), np.ascontiguousarray(p["turn"].T)
    h, last = np.zeros((hidden, len(texts)), np.float32), np.full(len(texts), start)
    states, targets, lanes, held = [], [], [], 0

    def flush() -> None:
        got = log_p(p, np.concatenate(states, axis=1).T, np.concatenate(targets))
        total[order] += np.bincount(np.concatenate(lanes), got, len(texts))
        states.clear(), targets.clear(), lanes.clear()

    going = len(texts)
    for t in range(int(sizes.max())):
        going = int(np.searchsorted(-ordered[:going], -t, "left"))
        h = advance(np.take(gates, last[:going], axis=1, mode="clip"), turn, h[:, :going])[0]
        target = flat[begins[:going] + t]
        states.append(h)
        targets.append(target)
        lanes.append(np.arange(going))
        last, held = target, held + going
        if held > 16_384:
            flush()
            held = 0
    if held:
        flush()
    return total


def gradients(p: Params, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[Params, np.ndarray, float]:
    """One window, ``inputs[t, lane]``; targets below 0 are padding. Also the last state and the loss."""
    steps, lanes = inputs.shape
    size, kind = h.shape[1], np.result_type(h, p["turn"])
    gates, turn = np.ascontiguousarray(p["gates"].T), np.ascontiguousarray(p["turn"].T)
    states, saved = np.empty((size, steps + 1, lanes), kind), np.empty((4, size, steps, lanes), kind)
    states[:, 0] = h.T
    for t in range(steps):
        got = advance(np.take(gates, inputs[t], axis=1, mode="clip"), turn, states[:, t])
        states[:, t + 1] = got[0]
        for kept, x in zip(saved, got[1:]):
            kept[:, t] = x
    target = targets.ravel()
    real = np.flatnonzero(target >= 0)
    n = max(len(real), 1)
    out = Outputs(p, states[:, 1:].reshape(size, -1), target[real], real)
    listed = out.ends[-1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    # The loss by the logits: probabilities less the target; then by the states, a column of zeros for padding.
    d = out.of_class()
    logs, sums = settle(d, out.kind)
    loss = -float(logs.sum())
    d /= sums
    d[out.kind, out.at] -= 1
    own = out.states @ d.T
    g["to_class"], g["class_bias"] = own[:-1], own[-1]
    by_state = np.zeros((size, len(real) + 1), kind)
    np.matmul(p["to_class"], d, out=by_state[:, :-1])
    d = out.of_word()
    logs, sums = settle(d, out.word[:listed])
    loss -= float(logs.sum())
    d /= sums
    d[out.word[:listed], out.at[:listed]] -= 1
    for c, span in out.spans():
        own = out.states[:, span] @ d[:, span].T
        g["to_word"][c], g["word_bias"][c] = own[:-1], own[-1]
        by_state[:, span] += p["to_word"][c] @ d[:, span]
    place = np.full(len(target), len(real))
    place[out.by] = out.at
    back = np.take(by_state, place, axis=1, mode="clip").reshape(size, steps, lanes)
    # What a state's gradient is multiplied by for each gate; the loop back in time only carries it.
    keep, reset, new, turned = saved
    by_new = 1 - keep
    by_new *= 1 - new * new
    factors = np.empty((3, size, steps, lanes), kind)
    np.subtract(states[:, :-1], new, out=factors[0])
    factors[0] *= keep
    factors[0] *= 1 - keep
    np.multiply(by_new, reset, out=factors[2])
    np.multiply(factors[2], turned, out=factors[1])
    factors[1] *= 1 - reset
    carried = np.zeros((size, lanes), kind)
    for t in reversed(range(steps)):
        dh = carried
        dh += back[:, t]
        by_new[:, t] *= dh
        factors[:, :, t] *= dh
        carried = p["turn"] @ factors[:, :, t].reshape(3 * size, lanes)
        dh *= keep[:, t]
        carried += dh
    g["turn"] = states[:, :-1].reshape(size, -1) @ factors.reshape(3 * size, -1).T
    # Equal inputs side by side, so that their gradients are summed in runs.
    factors[2] = by_new
    flat = inputs.ravel()
    by = np.argsort(flat.astype(np.int16) if len(p["gates"]) < 1 << 15 else flat, kind="stable")
    own = flat[by]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    g["gates"][own[first]] = np.add.reduceat(np.take(factors.reshape(3 * size, -1), by, axis=1, mode="clip"), first, axis=1).T
    return {k: v / n for k, v in g.items()}, states[:, -1].T, loss / n


class Trainer:
    """Adagrad over batches of chunks; each chunk is read window by window with its state carried."""

    def __init__(self, p: Params, start: int) -> None:
        self.p = {k: v.copy() for k, v in p.items()}
        self.squares = {k: np.full_like(v, 1e-6) for k, v in p.items()}
        self.start, self.seen, self.loss = start, 0, 0.0

    def batch(self, chunks: list[np.ndarray]) -> None:
        steps = max(len(c) for c in chunks)
        targets = np.full((steps, len(chunks)), -1)
        for k, c in enumerate(chunks):
            targets[: len(c), k] = c
        inputs = np.vstack([np.full((1, len(chunks)), self.start), np.where(targets[:-1] < 0, self.start, targets[:-1])])
        h = np.zeros((len(chunks), self.p["turn"].shape[0]), np.float32)
        for t in range(0, steps, WINDOW):
            g, h, loss = gradients(self.p, inputs[t : t + WINDOW], targets[t : t + WINDOW], h)
            n = int((targets[t : t + WINDOW] >= 0).sum())
            self.loss += loss * n
            self.seen += n
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v *= min(1.0, CLIP / max(norm, 1e-9))
                self.squares[k] += v**2
                self.p[k] -= RATE * v / np.sqrt(self.squares[k])
