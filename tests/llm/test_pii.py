"""Personal details: held-out quality, whole texts, and exact places."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import pii_synthetic as synthetic
from caseloom.llm import pii_train
from caseloom.llm.pii import checked, masked, personal_details
from caseloom.llm.pii_tagger import MODEL_FILE, OVERLAP, TAGS, WINDOW, Tagger

from .pii_sentences import sentences

@pytest.fixture(scope="module")
def tagger():
    return Tagger.load()


def test_quality_on_sentences_written_by_hand(tagger):
    """Start and kind of details in sentences that no table and no training carrier has."""
    hit = said = true = 0
    for text, spans in sentences():
        got = {(a, k) for a, _, k in checked(text, tagger.spans([text])[0])}
        want = {(a, k) for a, _, k in spans}
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    assert hit / true >= 0.85 and hit / said >= 0.9, (hit / true, hit / said)


def test_quality_on_held_out_carriers(tagger):
    scores = pii_train.f1(tagger, synthetic.texts(600, seed=99, held_out=True))
    assert scores["name"][2] >= 0.65 and scores["address"][2] >= 0.7 and scores["phone"][2] >= 0.75, scores


def test_looked_up_activations_give_the_spans_of_the_exact_functions(tagger):
    class Exact(Tagger):
        def scores(self, windows):
            w = self.exact
            out = []
            for ids in windows:
                h = []
                for d, x in ((0, ids), (1, ids[::-1])):
                    state, cell, own = np.zeros(self.hidden), np.zeros(self.hidden), []
                    for i in x:
                        z = w["table"][d, i] + state @ w["wh"][d]
                        gates = 1 / (1 + np.exp(-z[: 3 * self.hidden]))
                        n = self.hidden
                        cell = gates[n : 2 * n] * cell + gates[:n] * np.tanh(z[3 * n :])
                        state = gates[2 * n :] * np.tanh(cell)
                        own.append(state)
                    h.append(np.array(own[::-1] if d else own))
                out.append((np.concatenate(h, 1) @ self.wo + self.bo).astype(np.float32))
            return out

    with np.load(MODEL_FILE, allow_pickle=False) as f:
        raw = dict(f)
    exact = Exact(raw)
    wide = {k: v.astype(np.float64) for k, v in raw.items() if k != "chars"}
    exact.exact = {"table": np.einsum("ve,deh->dvh", wide["emb"], wide["wx"]) + wide["b"][:, None], "wh": wide["wh"]}
    texts = [t for t, _ in sentences()] + [t for t, _ in synthetic.texts(150, seed=5)]
    differ = sum(a != b for a, b in zip(tagger.spans(texts), exact.spans(texts)))
    assert differ <= len(texts) // 50, differ


def found(tagger, text):
    return [(text[a:b], k) for a, b, k in checked(text, tagger.spans([text])[0])]


def test_examples(tagger):
    text = "My name is V. Varnövock and you can reach me on O7700 900 006. Tracking number 109490841122 has not moved since Monday."
    assert found(tagger, text) == [("V. Varnövock", "name"), ("O7700 900 006", "phone")]
    text = "The Josephine cream roll from order JB-1234567 arrived squashed. Batch 953-148-5515 was printed on the lid."
    assert found(tagger, text) == []
    assert masked("call 07700 900 006 now", [(5, 18, "phone")]) == "call [PHONE] now"


def test_long_texts_are_read_whole(tagger):
    piece = "We waited 5 hours and the technician never showed up. "
    text = piece * 400 + "Write to oskrosept_fat80@inbox.test please. " + piece * 400
    assert found(tagger, text) == [("oskrosept_fat80@inbox.test", "email")]
    for shift in range(0, 2 * (WINDOW - OVERLAP), 13):  # wherever a window ends
        t = "x " * (shift // 2) + piece + "Call me back: +44 7700 900743 " + piece
        assert ("+44 7700 900743", "phone") in found(tagger, t)


def test_reconciled_paths_equal_one_search(tagger):
    rng = np.random.default_rng(0)
    emissions = [rng.normal(0, 3, (n, len(TAGS))).astype(np.float32) for n in (1, 2, 7, 40)]
    for e, path in zip(emissions, tagger.decode(emissions)):
        score = tagger.start + e[0]
        back = []
        for t in range(1, len(e)):
            c = score[:, None] + tagger.trans
            back.append(c.argmax(0))
            score = c.max(0) + e[t]
        want = [int(score.argmax())]
        for b in reversed(back):
            want.append(int(b[want[-1]]))
        assert list(path) == want[::-1]
    quiet = np.full((30, len(TAGS)), -50, np.float32)
    quiet[:, 0] = 0
    assert not tagger.decode([quiet])[0].any()


def test_operator_edges(spark):
    rows = [(1, "Call me back: +44 7700 900743", None), (1, "Call me back: +44 7700 900743", None), (2, None, "a@b.example"), (3, "", ""), (None, "Call me back: +44 7700 900743", None), (4, "nothing at all 🎂" * 50, "kitchen_tablet")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, text string, sender string, value string")
    got = personal_details(df, "id", {"text": F.col("text"), "sender": F.col("sender")}).collect()
    assert sorted((r.row_id, r.field_name, r.masked) for r in got) == [(1, "text", "Call me back: [PHONE]"), (1, "text", "Call me back: [PHONE]"), (2, "sender", "[EMAIL]")]
    assert all(s.start_pos == 15 for r in got if r.row_id == 1 for s in r.spans)
    assert personal_details(df.limit(0), "id", {"text": F.col("text")}).count() == 0


def test_training_step_lowers_the_loss():
    rng = np.random.default_rng(1)
    w = {"emb": rng.normal(0, 0.3, (20, 4)), "wx": rng.normal(0, 0.3, (2, 4, 20)), "b": np.zeros((2, 20)), "wh": rng.normal(0, 0.3, (2, 5, 20)), "wo": rng.normal(0, 0.3, (10, len(TAGS))), "bo": np.zeros(len(TAGS)), "trans": np.zeros((len(TAGS),) * 2), "start": np.zeros(len(TAGS))}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    ids, tags, lens = rng.integers(1, 20, (6, 3)).astype(np.int32), rng.integers(0, len(TAGS), (6, 3)), np.array([6, 4, 2])
    loss, g = pii_train.step(w, ids, tags, lens, 0.0, rng)
    for name in w:  # gradients by differences
        flat = int(np.abs(g[name]).argmax())
        at = np.unravel_index(flat, w[name].shape)
        if name == "emb" and at[0] == 0:
            continue
        old, eps = w[name][at], 1e-2
        w[name][at] = old + eps
        up, _ = pii_train.step(w, ids, tags, lens, 0.0, rng)
        w[name][at] = old - eps
        down, _ = pii_train.step(w, ids, tags, lens, 0.0, rng)
        w[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 0.05 * max(1, abs(g[name][at])), name
    assert loss > 0
