"""A bidirectional LSTM labeller in numpy: training by back-propagation, labelling in batches."""

import sys

import numpy as np
from pyspark import cloudpickle

HIDDEN = 24
EPOCHS = 8
RATE = 0.01


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(width: int, rng) -> dict[str, np.ndarray]:
    """Parameters: for either direction inputs, states and biases of the gates, then the output."""
    made = {}
    for side in "fb":
        made[f"w{side}"] = rng.normal(0, width**-0.5, (width, 4 * HIDDEN))
        made[f"u{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN : 2 * HIDDEN] = 1
        made[f"c{side}"] = bias
    made["out"] = rng.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN)
    made["end"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in made.items()}


def _walk(x, w, u, c, trace=None):
    """States of one direction, steps by rows by HIDDEN."""
    gates = x @ w + c
    h = s = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
    states = np.empty((*x.shape[:2], HIDDEN), dtype=np.float32)
    for t in range(len(x)):
        z = gates[t] + h @ u
        act = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = act[:, :HIDDEN], act[:, HIDDEN : 2 * HIDDEN], act[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        old, s = s, f * s + i * g
        tanh = np.tanh(s)
        if trace is not None:
            trace.append((h, old, i, f, o, g, tanh))
        h = o * tanh
        states[t] = h
    return states


def _unwalk(dh_all, x, w, u, trace):
    """Gradients of _walk for gradients of its states."""
    dw, du, dc = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN, dtype=np.float32)
    dh = ds = np.zeros_like(dh_all[0])
    for t in range(len(x) - 1, -1, -1):
        h, old, i, f, o, g, tanh = trace[t]
        dh = dh + dh_all[t]
        ds = ds + dh * o * (1 - tanh * tanh)
        dz = np.hstack([ds * g * i * (1 - i), ds * old * f * (1 - f), dh * tanh * o * (1 - o), ds * i * (1 - g * g)])
        dw += x[t].T @ dz
        du += h.T @ dz
        dc += dz.sum(axis=0)
        dh, ds = dz @ u.T, ds * f
    return dw, du, dc


def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Steps of every row in turned order, its padding left at the end."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


def _padded(pages: list[np.ndarray]):
    lengths = np.array([len(p) for p in pages])
    x = np.zeros((int(lengths.max()), len(pages), pages[0].shape[1]), dtype=np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, lengths


def _forward(model, x, lengths, traces=None):
    turned, row = _turned(lengths, len(x)), np.arange(x.shape[1])
    back = x[turned, row]
    ahead = _walk(x, model["wf"], model["uf"], model["cf"], traces and traces[0])
    behind = _walk(back, model["wb"], model["ub"], model["cb"], traces and traces[1])
    both = np.concatenate([ahead, behind[turned, row]], axis=2)
    return _sigmoid(both @ model["out"] + model["end"]), both, back, turned, row


class _Trace(list):
    def __bool__(self):
        return True


def gradients(model, pages, labels):
    x, lengths = _padded(pages)
    traces = [_Trace(), _Trace()]
    p, both, back, turned, row = _forward(model, x, lengths, traces)
    y, mask = np.zeros_like(p), np.arange(len(x))[:, None] < lengths
    for k, own in enumerate(labels):
        y[: len(own), k] = own
    d = (p - y) * mask / mask.sum()
    dboth = d[..., None] * model["out"]
    found = {"out": (both * d[..., None]).sum(axis=(0, 1)), "end": d.sum(keepdims=True).ravel()}
    sides = (("f", x, dboth[..., :HIDDEN], traces[0]), ("b", back, dboth[..., HIDDEN:][turned, row], traces[1]))
    for side, inputs, dstates, trace in sides:
        found[f"w{side}"], found[f"u{side}"], found[f"c{side}"] = _unwalk(dstates, inputs, model[f"w{side}"], model[f"u{side}"], trace)
    return found


def train(pages: list[np.ndarray], labels: list[np.ndarray], width: int, seed: int = 3) -> dict[str, np.ndarray]:
    """Fit on pages of labelled blocks, by Adam over batches of pages of similar length."""
    rng = np.random.default_rng(seed)
    model = start(width, rng)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    batches = [order[k : k + 16] for k in range(0, len(order), 16)]
    step = 0
    for _ in range(EPOCHS):
        for at in rng.permutation(len(batches)):
            own, step = batches[at], step + 1
            found = gradients(model, [pages[k] for k in own], [labels[k] for k in own])
            for k, g in found.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                size = np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8
                model[k] = (model[k] - RATE * first[k] / (1 - 0.9**step) / size).astype(np.float32)
    return model


def label(model, pages: list[np.ndarray], cells: int = 8192) -> list[np.ndarray]:
    """Probabilities of every block of every page, batches of similar length and bounded size."""
    found: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(pages[order[stop]]) * (stop + 1 - at) <= cells:
            stop += 1
        x, lengths = _padded([pages[k] for k in order[at:stop]])
        p = _forward(model, x, lengths)[0]
        for j, k in enumerate(order[at:stop]):
            found[k] = p[: lengths[j], j]
        at = stop
    return found


cloudpickle.register_pickle_by_value(sys.modules[__name__])
