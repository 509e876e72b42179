"""Character tagger: a bidirectional LSTM scores five labels per character, a CRF scores their transitions. Numpy only."""

from __future__ import annotations

import re

import numpy as np

WINDOW, STRIDE = 96, 48
HIDDEN = 12
LABELS = 5  # 0 outside, 1 + kind inside
_TRIGGER = re.compile(r"[@0-9]")
# What is read also has at signs spelled out as in _variants: "(at)", or "at" before a domain.
READ = re.compile(r"[@0-9]|\(at\)|(?<=\s)at(?=\s+[a-z0-9-]+\.[a-z0-9-])", re.IGNORECASE | re.ASCII)


def encode(text: str) -> np.ndarray:
    """Characters as numbers below 40: digits and letters lose their value, signs that matter keep it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return _CODES[np.minimum(points, 255)]


def _codes() -> np.ndarray:
    table = np.full(256, 1, dtype=np.int64)
    for c in range(256):
        ch = chr(c)
        table[c] = 2 if ch.islower() else 3 if ch.isupper() else 4 if ch in "0123456789" else 1
    for i, ch in enumerate("@.+-() _%/:,\n=\"'"):
        table[ord(ch)] = 5 + i
    return table


_CODES = _codes()
ALPHABET = 40


def new_model(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    model = {}
    for way in "fb":
        model[f"x{way}"] = rng.normal(0, 0.3, (ALPHABET, 4 * HIDDEN))
        model[f"u{way}"] = rng.normal(0, 0.3, (HIDDEN, 4 * HIDDEN))
        model[f"c{way}"] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])
    model["w"], model["bias"] = rng.normal(0, 0.3, (2 * HIDDEN, LABELS)), np.zeros(LABELS)
    model["trans"] = np.zeros((LABELS, LABELS))
    return model


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _lstm(codes: np.ndarray, x, u, c) -> tuple[np.ndarray, list]:
    """States for codes of shape (windows, steps), first step first, and what the way back needs."""
    n, steps = codes.shape
    h, s, out, tape = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.empty((steps, n, HIDDEN)), []
    for t in range(steps):
        z = x[codes[:, t]] + h @ u + c
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        f, i, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        old_h, old_s = h, s
        s = f * s + i * g
        squashed = np.tanh(s)
        h = o * squashed
        out[t] = h
        tape.append((f, i, o, g, old_h, old_s, squashed))
    return out, tape


def _lstm_back(codes, u, tape, grad_out):
    gx, gu, gc = np.zeros((ALPHABET, 4 * HIDDEN)), np.zeros_like(u), np.zeros(4 * HIDDEN)
    gh, gs = np.zeros_like(grad_out[0]), np.zeros_like(grad_out[0])
    for t in range(len(tape) - 1, -1, -1):
        f, i, o, g, old_h, old_s, squashed = tape[t]
        gh = gh + grad_out[t]
        gs = gs + gh * o * (1 - squashed**2)
        gz = np.concatenate([gs * old_s * f * (1 - f), gs * g * i * (1 - i), gh * squashed * o * (1 - o), gs * i * (1 - g**2)], axis=1)
        np.add.at(gx, codes[:, t], gz)
        gu += old_h.T @ gz
        gc += gz.sum(0)
        gh, gs = gz @ u.T, gs * f
    return gx, gu, gc


def emissions(model: dict, codes: np.ndarray):
    forward, tape_f = _lstm(codes, model["xf"], model["uf"], model["cf"])
    backward, tape_b = _lstm(codes[:, ::-1], model["xb"], model["ub"], model["cb"])
    states = np.concatenate([forward, backward[::-1]], axis=2)
    return states @ model["w"] + model["bias"], states, tape_f, tape_b


def _lse(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, trans: np.ndarray, pairs: bool = True):
    """Label probabilities (steps, windows, labels), expected transitions if asked for, and log of the partition sum."""
    steps = len(scores)
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _lse(alpha[t - 1][:, :, None] + trans, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(trans + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    single = np.exp(alpha + beta - total[None, :, None])
    pair = np.zeros_like(trans)
    for t in range(1, steps if pairs else 1):
        pair += np.exp(alpha[t - 1][:, :, None] + trans + (scores[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
    return single, pair, total


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels, shape (windows, steps)."""
    steps, n, _ = scores.shape
    best, back = scores[0], np.zeros(scores.shape, dtype=np.int64)
    for t in range(1, steps):
        options = best[:, :, None] + trans
        back[t] = options.argmax(1)
        best = options.max(1) + scores[t]
    path = np.zeros((n, steps), dtype=np.int64)
    path[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = back[t][np.arange(n), path[:, t]]
    return path


def training_windows(text: str, spans: list[tuple[int, int, int]], per_text: int = 4):
    """Windows of a text with the spans that lie wholly inside; also ones with digits but no span."""
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = max(0, m.start() - WINDOW // 3)
        window = text[start : start + WINDOW]
        inside = [(a - start, b - start, k) for a, b, k in spans if a >= start and b <= start + WINDOW]
        if all(b <= start or a >= start + WINDOW or (a >= start and b <= start + WINDOW) for a, b, _ in spans):
            yield window, inside
        done, per_text = start + WINDOW, per_text - 1
        if not per_text:
            return


def _variants(text: str, spans: list, rng) -> tuple[str, list]:
    """The same labelled text with a span written another way: other separators, no plus, spelled-out at sign."""
    if not spans:
        return text, spans
    pick = int(rng.integers(len(spans)))
    a, b, k = spans[pick]
    piece = text[a:b]
    if k == 0:
        piece = piece.replace("@", (" at ", " @ ", "(at)")[int(rng.integers(3))]) if rng.random() < 0.5 else piece
    elif k == 3:
        digits = re.sub(r"[^0-9]", "", piece)[-10:]
        piece = (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}", f"{digits[:3]}.{digits[3:6]}.{digits[6:]}")[int(rng.integers(3))]
    elif k == 2:
        digits = re.sub(r"[^0-9]", "", piece)
        piece = (" ", "-")[int(rng.integers(2))].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    shift = len(piece) - (b - a)
    moved = [(s + shift, e + shift, j) if s >= b else (s, e, j) for s, e, j in spans if (s, e, j) != (a, b, k)]
    return text[:a] + piece + text[b:], sorted([*moved, (a, a + len(piece), k)])


def _batch(examples) -> tuple[np.ndarray, np.ndarray]:
    codes, tags = np.zeros((len(examples), WINDOW), dtype=np.int64), np.zeros((len(examples), WINDOW), dtype=np.int64)
    for r, (text, spans) in enumerate(examples):
        text = text[:WINDOW]
        codes[r, : len(text)] = encode(text)
        for a, b, k in spans:
            tags[r, a : min(b, WINDOW)] = k + 1
    return codes, tags


def train(examples: list, steps: int = 240, size: int = 32, rate: float = 0.02, seed: int = 7) -> dict:
    """Maximise the likelihood of the labelled windows with Adam; every other example is written another way.

    Without examples the model is untrained but made to answer "outside" everywhere.
    """
    model, rng = new_model(seed), np.random.default_rng(seed)
    if not examples:
        model["w"] *= 0
        model["bias"][0] = 20.0
        return model
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    for step in range(1, steps + 1):
        chosen = [examples[i] for i in rng.integers(len(examples), size=size)]
        codes, tags = _batch([_variants(*e, rng) if rng.random() < 0.5 else e for e in chosen])
        scores, states, tape_f, tape_b = emissions(model, codes)
        single, pair, _ = marginals(scores, model["trans"])
        truth = np.eye(LABELS)[tags.T]
        seen = np.zeros((LABELS, LABELS))
        np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        error = (single - truth) / size
        grads = {"w": np.einsum("tnh,tnl->hl", states, error), "bias": error.sum((0, 1)), "trans": (pair - seen) / size}
        down = error @ model["w"].T
        grads["xf"], grads["uf"], grads["cf"] = _lstm_back(codes, model["uf"], tape_f, down[:, :, :HIDDEN])
        grads["xb"], grads["ub"], grads["cb"] = _lstm_back(codes[:, ::-1], model["ub"], tape_b, down[::-1, :, HIDDEN:])
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        pace = rate * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / norm)
            m, v = moment[k] = (0.9 * moment[k][0] + 0.1 * g, 0.99 * moment[k][1] + 0.01 * g**2)
            model[k] = model[k] - pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def tag(texts: list[str], model: dict, most: int = 2000) -> list[list[tuple[int, int, int, float]]]:
    """(start, end, kind, score) over whole texts, one list per text.

    Windows overlap by half. Only those with a digit or an at sign, spelled out or not, are read, ``most`` at a time, those of all texts
    together. Each is decoded; a character gets its label from the window in which it lies most centrally, so every
    character is labelled once, and runs of a label become spans across window borders. The score is the mean probability
    of the span's labels.
    """
    places = []
    for index, text in enumerate(texts):
        starts = {max(0, k * STRIDE) for m in READ.finditer(text) for k in (m.start() // STRIDE - 1, m.start() // STRIDE)}
        places += [(index, s) for s in sorted(starts)]
    labels: list[dict[int, tuple[int, int, float]]] = [{} for _ in texts]  # position -> (from centre, label, probability)
    for first in range(0, len(places), most):
        some = places[first : first + most]
        codes, _ = _batch([(texts[i][s : s + WINDOW], []) for i, s in some])
        scores, *_ = emissions(model, codes)
        path, single = viterbi(scores, model["trans"]), marginals(scores, model["trans"], pairs=False)[0]
        sure = np.take_along_axis(single.transpose(1, 0, 2), path[:, :, None], axis=2)[:, :, 0]
        for (i, s), row, p in zip(some, path.tolist(), sure.tolist(), strict=True):
            own = labels[i]
            for t in range(min(WINDOW, len(texts[i]) - s)):
                far = abs(2 * t - WINDOW)
                if (old := own.get(s + t)) is None or far < old[0]:
                    own[s + t] = (far, row[t], p[t])
    return [_as_spans(own) for own in labels]


def _as_spans(labels: dict[int, tuple[int, int, float]]) -> list[tuple[int, int, int, float]]:
    spans: list[list] = []
    for at in sorted(labels):
        _, label, p = labels[at]
        if label and spans and spans[-1][1] == at and spans[-1][2] == label - 1:
            spans[-1][1] = at + 1
            spans[-1][3] += p
        elif label:
            spans.append([at, at + 1, label - 1, p])
    return [(a, b, k, p / (b - a)) for a, b, k, p in spans]
