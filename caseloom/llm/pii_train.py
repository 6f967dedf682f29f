"""Trains the tagger: ``python -m caseloom.llm.pii_train TABLES_DIR [--rows N] [--invented N] [--minutes M] [--workers N]``.

Labelled spans come from :mod:`caseloom.llm.pii_labels` over at most ``--rows``
rows of each table (the documented bound of the sample) and from invented
sentences (:mod:`caseloom.llm.pii_synthetic`). A twentieth of the rows and a
tenth of the invented sentences' carriers are held out; precision, recall and F1
of spans on both are printed.
"""

from __future__ import annotations

import argparse
import random
import re
import time
from collections import Counter

import numpy as np

from caseloom.llm import pii_labels as lab
from caseloom.llm import pii_synthetic as synthetic
from caseloom.llm.pii_tagger import BUCKETS, KINDS, MODEL_FILE, TAGS, Tagger, Vocabulary, bucket

EMB, HIDDEN = 24, 44


def lexicon(folder: str, rows: int) -> lab.Lexicon:
    """Words of names from senders written ``Name <address>``, two-word senders and signatures in other scripts, customer names and fields of key facts, and the use of words in texts, over at most ``rows`` rows of each table."""
    from caseloom.llm import names

    lex = lab.Lexicon()
    for s in set(column(folder, "inbound_message", "sender", rows)):
        head, at, _ = s.partition("<")
        if at and head.strip() or not re.search("[A-Za-z0-9@]", s) and len(s.split()) == 2:
            lex.add(head.strip())
    known = Counter(lex.given)
    for s in set(column(folder, "spike_bakery_objects", "customer_name", rows)):
        found = names.readings(s)
        if found and not found[0].org and len(found) == 1 + (len(found) > 1) and re.fullmatch(r"[^\W\d_]+\.? (?:[^\W\d_]\.? )?(?:(?i:al|el)[ -])?[^\W\d_]+", s) and s.split()[0].lower() in known:
            lex.add(s)
        elif found and not found[0].org and re.fullmatch(r"[^\W\d_]{2,} [^\W\d_]+", s) and s.split()[1].lower() in lex.family:
            lex.add(s)
    for s in column(folder, "cfpb_labels", "gold_key_facts", rows):
        for item in s.split(";"):
            key, eq, value = item.partition("=")
            if eq and re.search("(?i)holder|owner|agent|driver|signer", key):
                lex.add(value.strip())
    texts = column(folder, "inbound_message", "text", rows)
    for s in {t.rpartition("\n")[2].strip() for t in texts}:  # a message may end in a line that is its signature
        if re.fullmatch(r"[^\W\d_a-zA-Z][^\W\d_a-zA-Z\u0900-\u0963]*\S* [^\W\d_a-zA-Z]\S*(?<![.!?؟۔।])", s):
            lex.add(s)
    lex.learn_usage(texts)
    return lex


def column(folder: str, table: str, name: str, rows: int) -> list[str]:
    """The non-empty values of the first ``rows`` rows of a column."""
    import pyarrow.parquet as pq

    return [x for x in pq.read_table(f"{folder}/{table}.parquet", columns=[name])[name].to_pylist()[:rows] if x]


def labelled(texts: list[str], facts: list[str], senders: list[str], lex: lab.Lexicon) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with spans; doubtful sentences are left out of them."""
    out = []
    for t in texts:
        text, spans = "", []
        for a, b in lab.sentences(t):
            found, doubt = lab.label_sentence(t[a:b], lex)
            if doubt:
                continue
            text += random.choice((" ", " ", "\n")) if text else ""
            spans += [(len(text) + x, len(text) + y, k) for x, y, k in found]
            text += t[a:b]
        if text:
            out.append((text, sorted(spans)))
    for values, label in ((facts, lab.label_facts), (senders, lab.label_sender)):
        for t in values:
            found, doubt = label(t, lex)
            if t.strip() and not doubt:
                out.append((t, found))
    return out


_SYLLABLES = [a + b for a in "b d f g h k l m n p r s t v w y z ch sh st br gr kr".split() for b in "a e i o u an en or el in ul ai".split()]


def varied(text: str, spans: list[tuple[int, int, str]], rng: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with some Latin names, digits and cases changed, so that the tagger leans on form and context."""
    out, done, new = "", 0, []
    for a, b, k in spans:
        out += text[done:a]
        s = text[a:b]
        if k == "name" and rng.random() < 0.35 and re.fullmatch(r"[A-Za-zÀ-ÿ .\-]+", s):
            words = s.split(" ")
            for i, w in enumerate(words):
                if len(w) > 3 and rng.random() < 0.7:
                    made = "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((2, 2, 3))))
                    words[i] = made.upper() if w.isupper() else made if w.islower() else made.capitalize()
            s = " ".join(words)
        new.append((len(out), len(out) + len(s), k))
        out, done = out + s, b
    out += text[done:]
    if rng.random() < 0.06:
        low = out.lower() if rng.random() < 0.7 else out.upper()
        if len(low) == len(out):
            out = low
    return out, new


def tag_ids(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, k in spans:
        y[a:b] = 2 + 2 * KINDS.index(k)
        y[a] -= 1
    return y


def batches(rows: list, vocab: Vocabulary, rng: random.Random, size: int = 128, width: int = 144):
    """Windows of like length, in random order, as (ids, tags, lengths)."""
    cut = []
    for text, spans in rows:
        text, spans = varied(text, spans, rng)
        x, y = vocab.encode(text), tag_ids(len(text), spans)
        a = -rng.randrange(width // 2) if len(x) > width else 0
        while a < len(x):
            lo = max(a, 0)
            if a + width - lo > 8 or lo == 0:
                cut.append((x[lo : a + width], y[lo : a + width]))
            a += width
    cut.sort(key=lambda c: len(c[0]) + rng.random() * 12)
    groups = [cut[i : i + size] for i in range(0, len(cut), size)]
    rng.shuffle(groups)
    for g in groups:
        steps = max(len(x) for x, _ in g)
        ids, tags = np.zeros((steps, len(g)), np.int32), np.zeros((steps, len(g)), np.int64)
        for j, (x, y) in enumerate(g):
            ids[: len(x), j], tags[: len(y), j] = x, y
        yield ids, tags, np.array([len(x) for x, _ in g])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(em: np.ndarray, tags: np.ndarray, lens: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Mean loss and gradients of emissions, transitions and start scores."""
    steps, batch, k = em.shape
    live = np.arange(steps)[:, None] < lens[None]
    alpha = np.empty_like(em)
    alpha[0] = start + em[0]
    for t in range(1, steps):
        nxt = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + em[t]
        alpha[t] = np.where(live[t][:, None], nxt, alpha[t - 1])
    logz = _lse(alpha[-1], 1)
    beta = np.zeros_like(em)
    dtrans = np.zeros_like(trans)
    for t in range(steps - 2, -1, -1):
        step = em[t + 1] + beta[t + 1]
        b = _lse(trans[None] + step[:, None, :], 2)
        on = live[t + 1][:, None]
        beta[t] = np.where(on, b, 0)
        pair = alpha[t][:, :, None] + trans[None] + step[:, None, :] - logz[:, None, None]
        dtrans += (np.exp(np.minimum(pair, 0)) * on[:, :, None]).sum(0)
    dem = np.exp(np.minimum(alpha + beta - logz[None, :, None], 0)) * live[:, :, None]
    dstart = dem[0].sum(0)
    cols = np.arange(batch)
    gold = start[tags[0]].sum() + (np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] * live).sum() + (trans[tags[:-1], tags[1:]] * live[1:]).sum()
    for t in range(steps):
        dem[t, cols, tags[t]] -= live[t]
    np.add.at(dtrans, (tags[:-1][live[1:]], tags[1:][live[1:]]), -1)
    np.add.at(dstart, tags[0], -1)
    return (logz.sum() - gold) / batch, dem / batch, dtrans / batch, dstart / batch


def step(w: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray, lens: np.ndarray, drop: float, rng: np.random.Generator):
    """Loss and gradients of one batch."""
    steps, batch = ids.shape
    hid = w["wh"].shape[1]
    bwd = np.zeros_like(ids)
    rev = np.zeros((steps, batch), np.int64)
    for j, n in enumerate(lens):
        bwd[:n, j] = ids[:n, j][::-1]
        rev[:n, j] = np.arange(n)[::-1]
        rev[n:, j] = np.arange(n, steps)
    table = np.einsum("ve,deh->vdh", w["emb"], w["wx"]) + w["b"][None]
    p = np.stack((table[ids, 0], table[bwd, 1]), 1)
    h, c = np.zeros((2, batch, hid), np.float32), np.zeros((2, batch, hid), np.float32)
    gates, cells, hs = np.empty((steps, 2, batch, 4 * hid), np.float32), np.empty((steps + 1, 2, batch, hid), np.float32), np.empty((steps + 1, 2, batch, hid), np.float32)
    cells[0], hs[0] = c, h
    for t in range(steps):
        z = np.matmul(h, w["wh"]) + p[t]
        z[..., : 3 * hid] = 1 / (1 + np.exp(-np.clip(z[..., : 3 * hid], -30, 30)))
        z[..., 3 * hid :] = np.tanh(z[..., 3 * hid :])
        gates[t] = z
        c = z[..., hid : 2 * hid] * c + z[..., :hid] * z[..., 3 * hid :]
        h = z[..., 2 * hid : 3 * hid] * np.tanh(c)
        cells[t + 1], hs[t + 1] = c, h
    out = np.concatenate((hs[1:, 0], np.take_along_axis(hs[1:, 1], rev[:, :, None], 0)), 2)
    mask = (rng.random(out.shape, np.float32) >= drop).astype(np.float32) / (1 - drop)
    o = out * mask
    em = o @ w["wo"] + w["bo"]
    loss, dem, dtrans, dstart = crf(em.astype(np.float64), tags, lens, w["trans"].astype(np.float64), w["start"].astype(np.float64))
    dem = dem.astype(np.float32)
    g = {"trans": dtrans, "start": dstart, "bo": dem.sum((0, 1)), "wo": o.reshape(-1, 2 * hid).T @ dem.reshape(-1, len(TAGS))}
    do = (dem @ w["wo"].T) * mask
    dhs = np.stack((do[:, :, :hid], np.take_along_axis(do[:, :, hid:], rev[:, :, None], 0)), 1)
    dz_all = np.empty_like(gates)
    dh, dc = np.zeros_like(h), np.zeros_like(c)
    wht = w["wh"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        i, f, og, gg = (gates[t][..., k * hid : (k + 1) * hid] for k in range(4))
        dh = dh + dhs[t]
        tc = np.tanh(cells[t + 1])
        dc = dc + dh * og * (1 - tc * tc)
        dz = dz_all[t]
        dz[..., :hid] = dc * gg * i * (1 - i)
        dz[..., hid : 2 * hid] = dc * cells[t] * f * (1 - f)
        dz[..., 2 * hid : 3 * hid] = dh * tc * og * (1 - og)
        dz[..., 3 * hid :] = dc * i * (1 - gg * gg)
        dc = dc * f
        dh = np.matmul(dz, wht)
    g["wh"] = np.stack([hs[:-1, d].reshape(-1, hid).T @ dz_all[:, d].reshape(-1, 4 * hid) for d in (0, 1)])
    dtable = np.zeros_like(table)
    for d, x in ((0, ids), (1, bwd)):
        flat, rows = x.ravel(), dz_all[:, d].reshape(-1, 4 * hid)
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        dtable[flat[order][first], d] = np.add.reduceat(rows[order], first, 0)
    dtable[0] = 0
    g["emb"] = np.einsum("vdh,deh->ve", dtable, w["wx"])
    g["wx"] = np.einsum("ve,vdh->deh", w["emb"], dtable)
    g["b"] = dtable.sum(0)
    return loss, g


def f1(model: Tagger, rows: list) -> dict[str, tuple[float, float, float]]:
    """Precision, recall and F1 by kind, of start and kind."""
    hit, said, true = Counter(), Counter(), Counter()
    for (_, spans), found in zip(rows, model.spans([t for t, _ in rows])):
        a, b = {(s, k) for s, _, k in spans}, {(s, k) for s, _, k in found}
        for k in KINDS:
            hit[k] += sum(x[1] == k for x in a & b)
            said[k] += sum(x[1] == k for x in b)
            true[k] += sum(x[1] == k for x in a)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k]), 2 * hit[k] / max(1, said[k] + true[k])) for k in KINDS}


def _part(job: tuple) -> tuple:
    """Loss and gradients of a worker's share of a batch."""
    w, ids, tags, lens, seed = job
    return step(w, ids, tags, lens, 0.15, np.random.default_rng(seed))


def train(rows: list, held: list, minutes: float, workers: int, seed: int = 7) -> None:
    """Trains on ``rows`` for a time, each batch shared among worker processes, stores the weights and prints the quality on ``held``."""
    import multiprocessing

    rng, nrng = random.Random(seed), np.random.default_rng(seed)
    seen = Counter(c for t, _ in rows for c in t)
    chars = "".join(sorted(c for c, n in seen.items() if n >= 30 and not ("٠" <= c <= "٩" or "۰" <= c <= "۹" or "०" <= c <= "९")))
    vocab = Vocabulary(chars)
    v, k = vocab.size, len(TAGS)
    w = {
        "emb": nrng.normal(0, 0.3, (v, EMB)), "wx": nrng.normal(0, EMB**-0.5, (2, EMB, 4 * HIDDEN)), "b": np.zeros((2, 4 * HIDDEN)),
        "wh": nrng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)), "wo": nrng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, k)), "bo": np.zeros(k), "trans": np.zeros((k, k)), "start": np.zeros(k),
    }
    w = {n: x.astype(np.float32) for n, x in w.items()}
    w["b"][:, HIDDEN : 2 * HIDDEN] = 1
    m1, m2 = ({n: np.zeros_like(x) for n, x in w.items()} for _ in range(2))
    ids_of = np.array([0] * v)
    for i, c in enumerate(chars):
        ids_of[i + len(BUCKETS)] = bucket(c)
    began, n, epoch, total, shown = time.time(), 0, 0, 0.0, time.time()
    with multiprocessing.get_context("fork").Pool(workers) as pool:
        while time.time() - began < minutes * 60:
            for ids, tags, lens in batches(rows, vocab, rng, size=48 * workers):
                ids = np.where((nrng.random(ids.shape) < 0.03) & (ids >= len(BUCKETS)), ids_of[ids], ids)
                shares = [np.arange(len(lens))[i::workers] for i in range(min(workers, len(lens)))]
                jobs = [(w, ids[: lens[x].max(), x], tags[: lens[x].max(), x], lens[x], int(nrng.integers(1 << 31))) for x in map(np.array, shares)]
                parts = pool.map(_part, jobs, chunksize=1)
                loss = sum(p[0] for p in parts) / len(parts)
                g = {name: sum(p[1][name] for p in parts) / len(parts) for name in w}
                norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
                n += 1
                done = min(1.0, (time.time() - began) / (minutes * 60))
                lr = 8e-3 * min(1, n / 60) * (0.02 + 0.98 * (1 - done) ** 1.2)
                for name, x in g.items():
                    x = x * min(1.0, 8.0 / (norm + 1e-6))
                    m1[name] = 0.9 * m1[name] + 0.1 * x
                    m2[name] = 0.99 * m2[name] + 0.01 * x * x
                    w[name] -= (lr * (m1[name] / (1 - 0.9**n)) / (np.sqrt(m2[name] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
                total = 0.98 * total + 0.02 * loss
                if time.time() - shown > 60:
                    shown = time.time()
                    print(f"step {n} epoch {epoch} loss {total / (1 - 0.98**n):.3f}", flush=True)
                if done >= 1:
                    break
            epoch += 1
    saved = {x: y.astype(np.float16) for x, y in w.items()} | {"chars": np.array(chars)}
    MODEL_FILE.parent.mkdir(exist_ok=True)
    np.savez_compressed(MODEL_FILE, **saved)
    print(f"{len(rows)} texts, {n} steps, {epoch} epochs")
    for what, sample in held:
        for kind, x in f1(Tagger(saved), sample).items():
            print(f"{what}, {kind}: precision {x[0]:.4f} recall {x[1]:.4f} F1 {x[2]:.4f}", flush=True)


def main() -> None:
    arg = argparse.ArgumentParser()
    arg.add_argument("tables")
    arg.add_argument("--rows", type=int, default=40_000)
    arg.add_argument("--invented", type=int, default=24_000)
    arg.add_argument("--minutes", type=float, default=8)
    arg.add_argument("--workers", type=int, default=8)
    a = arg.parse_args()
    random.seed(7)
    lex = lexicon(a.tables, a.rows)
    texts = column(a.tables, "inbound_message", "text", a.rows)
    rows = labelled(texts, column(a.tables, "cfpb_labels", "gold_key_facts", a.rows), sorted(set(column(a.tables, "inbound_message", "sender", a.rows))), lex)
    random.shuffle(rows)
    held, rows = rows[: len(rows) // 20], rows[len(rows) // 20 :]
    made = synthetic.texts(a.invented)
    print(len(rows), "texts and", len(made), "invented ones,", sum(len(s) for _, s in rows + made), "spans", flush=True)
    train(rows + made, [("held-out rows, by label", held), ("held-out carriers", synthetic.texts(2000, held_out=True))], a.minutes, a.workers)


if __name__ == "__main__":
    main()
