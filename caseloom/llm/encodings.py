"""Finding and undoing wrong decodings by character n-gram likelihood."""

from __future__ import annotations

import codecs
import html
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

def _table(codec: str) -> str:
    """The 256 characters of a codec; bytes it leaves undefined stand for control characters, as many decoders have it."""
    out = []
    for i in range(256):
        try:
            out.append(bytes([i]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(i))
    return "".join(out)


# Codecs that texts are wrongly read with, and legacy codecs they were written in.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "cp437", "cp850", "cp852", "cp866", "mac_roman", "mac_cyrillic", "koi8_r", "iso8859-2", "iso8859-15", "iso8859-6", "cp874", "cp720", "mac_latin2", "cp858", "cp860", "cp863")
#: Single-byte mix-ups are looked for among these.
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1256", "cp437", "cp850", "mac_roman")
LEGACY = ("cp1252", "cp1256", "cp850", "cp437", "mac_roman", "cp1250", "cp1251", "iso8859-6")
_TABLES = {c: _table(c) for c in READ_AS}
_MAPS = {c: codecs.charmap_build(t) for c, t in _TABLES.items()}
#: Steps back of a chain at most, of which one at most is a mix-up of two single-byte codecs.
STEPS = 3


def _encode(text: str, codec: str) -> bytes | None:
    try:
        return codecs.charmap_encode(text, "strict", _MAPS[codec])[0]
    except UnicodeEncodeError:
        return None


def chains(text: str, single: bool = True, lossy: bool = True) -> list[tuple[str, str, bool]]:
    """Candidates (chain, text, lossless) of one step back: the text encoded as it was read and decoded as it was written. ``single`` adds the mix-ups of two single-byte codecs, ``lossy`` what is left where bytes were lost."""
    out = []
    known: dict[bytes, None] = {}
    for wrong in READ_AS:
        raw = _encode(text, wrong)
        if raw is None or raw.isascii():
            continue
        if raw not in known:
            known[raw] = None
            try:
                out.append((f"{wrong}>utf-8", raw.decode("utf-8"), True))
            except UnicodeDecodeError as e:
                part = raw.decode("utf-8", "replace") if lossy else ""
                if lossy and (part.count("�") * 3 < sum(ord(c) > 127 for c in part) or e.start > 0 and len(part) < 0.8 * len(text)):
                    out.append((f"{wrong}>utf-8", part, False))
        for right in LEGACY if single and wrong in SINGLE else ():
            if right != wrong:
                out.append((f"{wrong}>{right}", codecs.charmap_decode(raw, "strict", _TABLES[right])[0], True))
    if "&" in text and (plain := html.unescape(text)) != text:
        out.append(("entities", plain, True))
    return out


FLOOR = 1e-8
#: N-grams beyond ASCII count from so many occurrences on, and from so many a character, summed over the strata; rarer ones may come from garbled rows among the clean ones, which grow with the rows. The rate is about 3 occurrences in 500 rows.
LEAST, LEAST_RATE = 3, 6e-6
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Log-likelihood that each step must gain beside the margin: little for bytes that happen to be valid UTF-8, more for two single-byte codecs, which fit each other always.
STEP_COST = {"utf-8": 0.5, "entities": 3.0}
SINGLE_COST = 4.0


@dataclass
class NgramModel:
    """Interpolated character trigrams with padding at the ends of words."""

    one: dict[str, int]
    two: dict[str, int]
    three: dict[str, int]
    total: int
    margin: float = 0.5
    cache: dict[str, float] = field(default_factory=dict, repr=False)
    fixed: dict[str, tuple] = field(default_factory=dict, repr=False)

    @staticmethod
    def build(counts: Counter) -> NgramModel:
        parts: list[dict[str, int]] = [{}, {}, {}]
        for g, n in counts.items():
            if n >= LEAST or len(g) == 1 or g.isascii():
                parts[len(g) - 1][g] = n
        return NgramModel(*parts, sum(parts[0].values()))

    def _log(self, gram: str) -> float:
        known = self.cache.get(gram)
        if known is None:
            a, b, c = gram
            p = FLOOR + 0.1 * self.one.get(c, 0) / max(1, self.total)
            if n := self.one.get(b):
                p += 0.3 * self.two.get(b + c, 0) / n
            if n := self.two.get(a + b):
                p += 0.6 * self.three.get(gram, 0) / n
            known = self.cache[gram] = math.log(p)
            if len(self.cache) > 500_000:
                self.cache.clear()
        return known

    def score(self, text: str) -> float:
        """Log-likelihood of a word or phrase."""
        padded = f"  {text} "
        return sum(self._log(padded[i : i + 3]) for i in range(len(padded) - 2))

    def gain(self, text: str) -> tuple[float, str, str, bool]:
        """(gain, chain, text, lossless) of the likeliest candidate over the text as it is.

        Every chain of up to ``STEPS`` steps is a candidate, UTF-8 and entities at
        any step and one mix-up of two single-byte codecs among them; chains that
        reach the same text are one. Behind a mix-up, which nearly every text
        allows, UTF-8 must be valid as a whole.
        """
        best = (0.0, "", text, True)
        own = self.score(text)
        front = [("", text, True, 0.0, True)]
        tried = {(text, True)}
        for _ in range(STEPS):
            found = []
            for chain, t, whole, cost, free in front:
                for step, u, ok in chains(t, free, free):
                    mixed = not step.endswith(("utf-8", "entities"))
                    key = (u, free and not mixed)
                    if key in tried or "\x00" in u:
                        continue
                    tried.add(key)
                    lost = u.count("�")
                    step_cost = STEP_COST.get(step.rpartition(">")[2], SINGLE_COST)
                    value = self.score(u.replace("�", "")) - 12.0 * lost - own - cost - step_cost
                    if value > best[0]:
                        best = (value, f"{chain} {step}".strip(), u, whole and ok)
                    found.append((f"{chain} {step}".strip(), u, whole and ok, cost + step_cost, key[1]))
            front = found
            if not front:
                break
        runs = _RUN.findall(text)
        if len(runs) > 1:  # letters of one word may have gone through different codecs
            value, now, at, whole = 0.0, text, 0, True
            for run in runs:
                at = now.index(run, at)
                options = [(self.score(now[:at] + u + now[at + len(run) :]), u, step, ok) for step, u, ok in chains(run) if "\x00" not in u and "�" not in u]
                here = self.score(now)
                if options:
                    score, u, step, ok = max(options)
                    cost = STEP_COST.get(step.rpartition(">")[2], SINGLE_COST)
                    if score - cost > here:
                        value += score - cost - here
                        now = now[:at] + u + now[at + len(run) :]
                        at += len(u)
                        continue
                at += len(run)
            if value > best[0]:
                best = (value, "by letters", now, whole)
        return best

    def repair(self, word: str) -> tuple[str, str, float]:
        """(state, text, gain) of a word: ``clean``, ``restored`` or ``lost``, and ``doubtful`` if a candidate is likelier by less than the margin."""
        known = self.fixed.get(word)
        if known is None:
            gain, _, text, whole = self.gain(word)
            if gain > 0:
                state = "doubtful" if gain <= self.margin else "restored" if whole and "�" not in text else "lost"
                known = (state, text, gain)
            else:
                known = ("lost" if "�" in word else "clean", word, 0.0)
            if len(self.fixed) > 200_000:
                self.fixed.clear()
            self.fixed[word] = known
        return known


#: Words with a character beyond ASCII, or a named entity; a no-break space may be half of a garbled letter.
WORD = re.compile(r"(?:[!-~]*(?:[^\x00-\x7f]|&(?:[A-Za-z]+\d*|#\d+);)[!-~]*)+")


def count_grams(out: Counter, words: Iterable[tuple[str, int]]) -> None:
    """Add to ``out`` the 1- to 3-grams of padded words of clean texts, each word so many times."""
    for w, n in words:
        p = f"  {w} "
        for i in range(len(p) - 2):
            out[p[i : i + 3]] += n
            out[p[i + 1 : i + 3]] += n
            out[p[i + 2]] += n
        out[" "] += n


def repair_text(model: NgramModel, text: str) -> tuple[str, str]:
    """(state, text) of a whole text: ``clean``, ``restored`` or ``lost``.

    Every word with characters beyond ASCII is judged by itself and the worst
    state wins. Words that stay in doubt are restored where the text has words
    beyond doubt, or where their gains together pass the margin.
    """
    judged = {w: model.repair(w) for w in set(WORD.findall(text))}
    states = {s for s, _, _ in judged.values()}
    doubt = sum(g for s, _, g in judged.values() if s == "doubtful")
    sure = bool(states & {"restored", "lost"}) or doubt > model.margin
    if not sure:
        return "clean", text
    keep = ("restored", "lost", "doubtful")
    out = WORD.sub(lambda m: judged[m.group(0)][1] if judged[m.group(0)][0] in keep else m.group(0), text)
    return "lost" if "lost" in states else "restored", out


def margin_of(gains: list[tuple[float, int]], total: int, least: float, garbled: float = 0.01, slack: float = 0.5) -> float:
    """The margin that held-out words do not pass, by ``slack``, and at least ``least``.

    ``gains`` are those above 0 with the words' numbers of rows, ``total`` the
    rows of all words. Some held-out rows may be garbled without an outer sign, so
    the greatest gains of up to ``garbled`` of all words' rows are taken for real
    finds.
    """
    gains, left = sorted(gains), garbled * total
    while gains and gains[-1][1] <= left:
        left -= gains.pop()[1]
    return max(least, gains[-1][0] + slack) if gains else least
