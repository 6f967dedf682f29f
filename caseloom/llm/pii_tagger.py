"""Character-level BiLSTM-CRF tagger in numpy, for training and for use.

A text is cut into overlapping windows. The two directions of the LSTM score
every character of a window; where windows overlap their scores are blended
with weights that fall towards the window's edge, and one Viterbi pass over the
*whole* text with the CRF's transitions reconciles them. Nothing is truncated.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, OVERLAP = 160, 48
BATCH = 128
MODEL_FILE = Path(__file__).with_name("models") / "pii_bilstm_crf.npz"

_ASCII_DIGITS = {ord(c): str(i % 10) for i, c in enumerate("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९")}
#: Characters outside the vocabulary share one id per Unicode category.
BUCKETS = ("<pad>", "Lu", "Ll", "Lo", "M", "N", "P", "S", "Z", "C")


def bucket(ch: str) -> int:
    """Id of the category that stands for an unknown character."""
    cat = unicodedata.category(ch)
    for name in (cat, cat[0]):
        if name in BUCKETS:
            return BUCKETS.index(name)
    return BUCKETS.index("Lo") if cat[0] == "L" else BUCKETS.index("C")


class Vocabulary:
    """Ids of characters: a table over the basic plane, categories beyond it."""

    def __init__(self, chars: str) -> None:
        self.size = len(BUCKETS) + len(chars)
        known = {c: i + len(BUCKETS) for i, c in enumerate(chars)}
        plain = [chr(i).translate(_ASCII_DIGITS) for i in range(0x10000)]
        self._table = np.array([known[c] if c in known else bucket(c) for c in plain], np.int32)

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        high = points > 0xFFFF
        if high.any():
            out = self._table[np.where(high, 0, points)]
            out[high] = [bucket(chr(i)) for i in points[high]]
            return out
        return self._table[points]


#: Steps of the tables of activations for each unit of their argument.
STEPS = 256


class Activations:
    """Sigmoid and hyperbolic tangent by lookup, side by side in one table over [-reach, reach].

    Arguments come scaled by ``STEPS`` and shifted to the table's rows, which is
    folded into the weights; ``reach`` bounds every argument, so none can leave
    its table. The error is at most half a step.
    """

    def __init__(self, reach: float) -> None:
        self.half = int(np.ceil(reach)) * STEPS
        x = np.arange(-self.half, self.half + 1, dtype=np.float64) / STEPS
        self.table = np.concatenate((1 / (1 + np.exp(-x)), np.tanh(x))).astype(np.float32)
        self.sigmoid_at = self.half + 0.5
        self.tanh_at = 3 * self.half + 1.5


def lstm(tables: np.ndarray, ids: np.ndarray, wh: np.ndarray, act: Activations) -> np.ndarray:
    """Hidden states (T, 2, B, H) of both directions at once for ids (T, 2, B).

    Gates are in order i f o g; ``tables`` and ``wh`` give their arguments as rows
    of the activations' table.
    """
    steps, _, batch = ids.shape
    h4 = wh.shape[1]
    h = np.zeros((2, batch, h4), np.float32)
    c = np.zeros_like(h)
    out = np.empty((steps, 2, batch, h4), np.float32)
    z = np.empty((2, batch, 4 * h4), np.float32)
    rows = np.empty(z.shape, np.intp)
    cell = np.empty_like(h)
    cell_rows = np.empty(h.shape, np.intp)
    for t in range(steps):
        np.matmul(h, wh, out=z)
        z[0] += tables[0][ids[t, 0]]
        z[1] += tables[1][ids[t, 1]]
        np.copyto(rows, z, casting="unsafe")
        np.take(act.table, rows, out=z, mode="clip")
        c *= z[..., h4 : 2 * h4]
        c += z[..., :h4] * z[..., 3 * h4 :]
        np.multiply(c, STEPS, out=cell)
        np.clip(cell, -act.half, act.half, out=cell)
        cell += act.tanh_at
        np.copyto(cell_rows, cell, casting="unsafe")
        h = out[t]
        np.take(act.table, cell_rows, out=h, mode="clip")
        h *= z[..., 2 * h4 : 3 * h4]
    return out


class Tagger:
    """The trained model."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.vocab = Vocabulary(str(weights["chars"]))
        w = {k: v.astype(np.float32) for k, v in weights.items() if k != "chars"}
        table = np.einsum("ve,deh->dvh", w["emb"], w["wx"]) + w["b"][:, None]
        hid = self.hidden = w["wh"].shape[1]
        self.act = Activations(float(np.abs(table).max() + np.abs(w["wh"]).sum(1).max()) + 1)
        table = table * STEPS
        table[..., : 3 * hid] += self.act.sigmoid_at
        table[..., 3 * hid :] += self.act.tanh_at
        self.tables = np.ascontiguousarray(table, np.float32)  # (2, V, 4H)
        self.wh = (w["wh"] * STEPS).astype(np.float32)
        self.wo, self.bo = w["wo"], w["bo"]
        self.trans, self.start = w["trans"], w["start"]
        # what a path can gain on staying outside all details: on entering, inside and on leaving one
        stay = float(self.trans[0, 0])
        self.enter = self.trans[0, 1:] - stay
        self.inside = float(self.trans[1:, 1:].max()) - stay
        self.leave = float(self.trans[1:, 0].max()) - stay
        self.begin = self.start[1:] - self.start[0]

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str | None = None) -> Tagger:
        """The model of a weights file, read once per worker process."""
        with np.load(path or MODEL_FILE, allow_pickle=False) as f:
            return Tagger(dict(f))

    def scores(self, windows: list[np.ndarray]) -> list[np.ndarray]:
        """Emission scores (length, tags) of windows; run in batches of like length."""
        order = np.argsort([len(w) for w in windows], kind="stable")
        out: list[np.ndarray] = [None] * len(windows)  # type: ignore[list-item]
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            lens = np.array([len(windows[i]) for i in part])
            steps = int(lens.max())
            ids = np.zeros((steps, 2, len(part)), np.int32)
            for j, i in enumerate(part):
                w = windows[i]
                ids[: len(w), 0, j] = w
                ids[: len(w), 1, j] = w[::-1]
            h = lstm(self.tables, ids, self.wh, self.act)
            fwd = h[:, 0] @ self.wo[: self.hidden] + self.bo
            bwd = h[:, 1] @ self.wo[self.hidden :]
            for j, i in enumerate(part):
                n = lens[j]
                out[i] = fwd[:n, j] + bwd[:n, j][::-1]
        return out

    def emissions(self, texts: list[str]) -> list[np.ndarray]:
        """Blended scores of whole texts."""
        windows, owner = [], []
        for k, text in enumerate(texts):
            ids = self.vocab.encode(text)
            a = 0
            while len(ids):
                b = min(len(ids), a + WINDOW)
                windows.append(ids[a:b])
                owner.append((k, a, b))
                if b == len(ids):
                    break
                a = b - OVERLAP
        scored = self.scores(windows)
        out: list[np.ndarray] = [np.zeros((0, len(TAGS)), np.float32)] * len(texts)
        first = 0
        for k, text in enumerate(texts):
            last = first
            while last < len(owner) and owner[last][0] == k:
                last += 1
            if last - first == 1:
                out[k] = scored[first]
            elif last > first:
                total = np.zeros((len(text), len(TAGS)), np.float32)
                weight = np.zeros((len(text), 1), np.float32)
                for w in range(first, last):
                    _, a, b = owner[w]
                    pos = np.arange(b - a)
                    left = np.full(b - a, np.inf) if a == 0 else pos + 1.0
                    right = np.full(b - a, np.inf) if b == len(text) else b - a - pos + 0.0
                    v = np.minimum(np.minimum(left, right), OVERLAP)[:, None].astype(np.float32)
                    total[a:b] += v * scored[w]
                    weight[a:b] += v
                out[k] = total / weight
            first = last
        return out

    def _may_hold_details(self, emissions: list[np.ndarray]) -> np.ndarray:
        """Texts whose best path may leave the outside tag: all but those where even an upper bound of every stretch's gain is negative."""
        order = np.argsort([len(e) for e in emissions], kind="stable")
        keep = []
        at = 0
        while at < len(order):
            n = len(emissions[order[at]])
            part = [i for i in order[at : at + 512] if len(emissions[i]) <= max(n + 64, int(n * 1.5))]
            at += len(part)
            lens = np.array([len(emissions[i]) for i in part])
            steps = int(lens.max(initial=0))
            if not steps:
                continue
            enter = np.full((steps, len(part)), -1e9, np.float32)
            go_on = np.full((steps, len(part)), -1e9, np.float32)
            for j, i in enumerate(part):
                d = emissions[i][:, 1:] - emissions[i][:, :1]
                go_on[: lens[j], j] = d.max(1) + self.inside
                enter[: lens[j], j] = (d + self.enter).max(1)
                enter[0, j] = (d[0] + self.begin).max()
            k = enter[0]
            best = k + np.where(lens == 1, 0, self.leave)
            for t in range(1, steps):
                k = np.maximum(enter[t], k + go_on[t])
                best = np.maximum(best, k + np.where(lens == t + 1, 0, self.leave))
            keep += [i for i, b in zip(part, best) if b > -1e-3]
        return np.array(keep, np.int64)

    def decode(self, emissions: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag paths by Viterbi, in batches of like length."""
        out: list[np.ndarray] = [np.zeros(len(e), np.int8) for e in emissions]
        open_ = self._may_hold_details(emissions)
        order = open_[np.argsort([len(emissions[i]) for i in open_], kind="stable")]
        at = 0
        while at < len(order):
            n = len(emissions[order[at]])
            part = [i for i in order[at : at + 256] if len(emissions[i]) <= max(n + 64, int(n * 1.5))]
            at += len(part)
            lens = np.array([len(emissions[i]) for i in part])
            steps = int(lens.max(initial=0))
            if not steps:
                continue
            em = np.zeros((steps, len(part), len(TAGS)), np.float32)
            for j, i in enumerate(part):
                em[: lens[j], j] = emissions[i]
            back = np.zeros((steps, len(part), len(TAGS)), np.int8)
            score = self.start + em[0]
            final = np.where((lens == 1)[:, None], score, 0)
            for t in range(1, steps):
                cand = score[:, :, None] + self.trans[None]
                back[t] = cand.argmax(1)
                score = np.take_along_axis(cand, back[t][:, None, :].astype(np.int64), 1)[:, 0] + em[t]
                done = lens == t + 1
                if done.any():
                    final[done] = score[done]
            for j, i in enumerate(part):
                n = lens[j]
                if not n:
                    continue
                path = np.empty(n, np.int8)
                path[-1] = final[j].argmax()
                for t in range(n - 1, 0, -1):
                    path[t - 1] = back[t, j, path[t]]
                out[i] = path
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Spans (start, end, kind) of each text, before any exact check."""
        paths = self.decode(self.emissions(texts))
        out = []
        for path in paths:
            found: list[tuple[int, int, str]] = []
            for t in np.flatnonzero(path):
                kind, inside = KINDS[(path[t] - 1) // 2], path[t] % 2 == 0
                if found and found[-1][1] == t and found[-1][2] == kind and inside:
                    found[-1] = (found[-1][0], int(t) + 1, kind)
                else:
                    found.append((int(t), int(t) + 1, kind))
            out.append(found)
        return out
