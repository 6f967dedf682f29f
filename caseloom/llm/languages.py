"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 4, words padded with
``_``) of a language in rank order. A text's own n-grams are ranked the same way
and compared with each profile by the out-of-place distance: the sum of rank
differences, with a fixed penalty for n-grams the profile lacks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

LANGUAGES = ("en", "ar", "ur", "hi", "fr", "es", "de", "pt")
PROFILE_SIZE = 2500
DOCUMENTS_PER_LANGUAGE = 250

# Sample texts of Arabic, Urdu and Hindi typed in Latin letters, for which no labelled table exists.
TYPED_IN_LATIN = {
    "ar": """
        el salam 3alaikom ana 3ayez arga3 el talab da 3ashan wesel maksoor w ma7ad yrod 3ala el telefon. ana mesh 3aref leh el 7ag ma wesel lissa.
        el mandoob gal yegi el sa3a khamsa bas ma ja. law sama7t ab3atli el fatoora el sa7ee7a. abgha floosi law sama7tom el talab wesel kharban.
        keefak inta shlonak shukran jazeelan ya akhi wallah el khedma mo zaina. el sawwag ma yrod 3alay w el akl barid. intazart sa3tain w ma7ad ja.
        ba3den galoli bukra bukra w lissa mafi 7al. el moshkila mawjooda min yom el 7ad. da3af marratain el fatoora ghalat. leesh el rusoom hatha fil fatoora.
        7abibi mumkin tsa3edni. ma 3andi wagt. inshallah tefham. ana za3lan jiddan min el khidma. wain el talabiya. el fanni ma 3eref yesalle7 el mokayyef.
        3indi moshkila ma3 el dafa3. khasamtom el mablagh marratain min 7isabi. abi arajje3 el kaika la2anha kanat 7amda. el mo9allee7 ma je wala kallamni.
        mish ma32ool el ta2kheer da. yareit 7ad yrod 3alaya. ya3ni eh el kalam da. kont mestanni min el sob7 lel leil. el soora 3indokom w kol shay wade7.
    """,
    "ur": """
        mujhe apne paise wapas chahiye kyunke cake kharab tha. aap log phone kyun nahi uthate. driver ne kaha tha paanch baje lekin woh aath baje aya.
        yeh bohat ghalat baat hai jee. mera order abhi tak nahi pohncha. assalam o alaikum bhai sahab. hum ne do ghante intezar kiya magar karigar nahi aya.
        shukriya lekin masla abhi bhi waisa hi hai. kisi ne nahi bataya ke fees kis cheez ki hai. agar masla hal na hua to main shikayat karunga. raseed mere paas hai.
    """,
    "hi": """
        mujhe mere paise wapas chahiye kyonki cake kharab tha. kripya jaldi kijiye. namaste ji, mera order kab aayega. maine photo bhej di hai usme sab saaf dikhta hai.
        humne do ghante intezaar kiya par mistri nahi aaya. pehle yeh dukaan bahut acchi thi pata nahi kya hua. koi phone nahi uthata. dhanyavaad lekin samasya abhi bhi hai.
        kisi ne nahi bataya ki shulk kis liye hai. agar hal nahi hua to main shikayat karunga. mere bete ko allergy hai aur dibbe par koi label nahi tha.
    """,
}

# Spoken names of the languages and their codes.
_NAMES = {
    "en": "en eng english", "ar": "ar ara arabic", "ur": "ur urd urdu", "hi": "hi hin hindi", "fr": "fr fra fre french",
    "es": "es spa spanish", "de": "de deu ger german", "pt": "pt por portuguese",
}
_LABELS = {w: k for k, v in _NAMES.items() for w in v.split()}


def named_language(label: str | None) -> str | None:
    """The language that a label names by code (two or three letters, with or without region) or English name; None if it names none of the known."""
    word = re.split(r"[-_]", (label or "").strip().lower(), maxsplit=1)[0].strip()
    return _LABELS.get(word)


_NOISE = re.compile(
    r"\S+\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[\w\-]+\s?(?:\[dot\]|\(dot\)|\sdot\s)\s?\w+|https?://\S+|www\.\S+|\S*@\S+(?: ?\. ?\w+)*|[\w.+\-]+\s?(?:\(at\)|\[at\])\s?[\w.\-]+|\b[A-Z]{1,4}-\d[\w\-]*|\b(?:AED|EUR|USD|GBP|INR|Rs)\b|[^\s\d]*\d[^\s]*"
)
#: A dash or an emoji before up to four words is a signature.
_SIGNED = re.compile(r"(?s)^\s*(?:[-–—~]+|[\U0001F000-\U0001FAFF☀-➿️]+)\s*[^\W\d_]\S*(?:\s+\S+){0,3}\s*$")
#: So is a line of up to four words without digits or closing punctuation below other lines.
_NAME_LINE = re.compile(r"^\s*[^\W\d_]\S*(?:\s+[^\W\d_]\S*){0,3}\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
#: Arabic typed in Latin letters writes some sounds as digits.
_ARABIZI = re.compile(r"(?<![\w@\-/.+:])(?:[A-Za-z]*[235679][A-Za-z]{2,}[235679]?[A-Za-z]*|[A-Za-z]{2,}[235679][A-Za-z]*)(?![\w@/+\-])")
_DIGIT = re.compile(r"[A-Za-z][235679]|[235679][A-Za-z]")
_NOISY = re.compile(r"[\d@/\[(]|www|\sat\s|\b(?:AED|EUR|USD|GBP|INR|Rs)\b")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"]*\"")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_HEADER = re.compile(r"(?m)^\[?\d{1,2}/\d{1,2}/\d{2,4}, [^\]\n]*?(?:\]| -) [^:\n]{1,40}: ")


def words(text: str) -> list[str]:
    """Words that carry language: no links, handles, numbers or codes; quotations only if little else is there; the letters of the sentence's main script."""
    if _SIGNED.match(text):
        return []
    plain = _HEADER.sub(" ", text) if "/" in text else text
    keep = [w for w in _ARABIZI.findall(plain) if not w.isalpha()] if _DIGIT.search(plain) else []
    plain = _NOISE.sub(" ", plain) if _NOISY.search(plain) else plain
    if keep:
        plain += " " + " ".join(keep)
    rest = _QUOTED.sub(" ", plain) if any(c in plain for c in "“«„\"") else plain
    found = _WORD.findall(_marks(rest))
    if sum(map(len, found)) < 8 and rest is not plain:
        found = _WORD.findall(_marks(plain))
    latin = sum(len(w) for w in found if _LATIN.match(w))
    total = sum(len(w) for w in found)
    if latin and latin < total:
        other = total - latin >= 0.3 * total
        found = [w for w in found if bool(_LATIN.match(w)) != other]
    lower = [w for k, w in enumerate(found) if k == 0 or not w[0].isupper()]
    if len(lower) >= 3:  # names inside a sentence tell nothing; in German enough is left
        found = lower
    return [w.lower().replace("’", "'") for w in found]


def _marks(s: str) -> str:
    """The text with vowel signs stood in for by letters, so that words of Indic scripts stay whole."""
    return s if s.isascii() else s.translate(_SIGNS)


#: Vowel signs are no word characters; each is stood in for by a letter of a private area.
_SIGNS = {c: chr(0xA000 + i) for i, c in enumerate([*range(0x0900, 0x0904), *range(0x093A, 0x0950), 0x0962, 0x0963])} | {c: None for c in [*range(0x064B, 0x0660), 0x0670]}


def ngrams(found: list[str]) -> Counter:
    """Counts of the n-grams of padded words."""
    out: Counter = Counter()
    for w in found:
        p = f"_{w}_"
        n = len(p)
        for k in (1, 2, 3, 4):
            for i in range(n - k + 1):
                out[p[i : i + k]] += 1
    out.pop("_", None)
    return out


def bare(text: str) -> str:
    """Latin letters without marks, as careless typing has them."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn" or not ("̀" <= c <= "ͯ"))


def profile_counts(language: str, texts: list[str]) -> Counter:
    """Counts for a language's profile; texts in Latin letters count with and without accents."""
    out: Counter = Counter()
    for t in texts:
        found = words(t)
        out.update(ngrams(found))
        if language in ("fr", "es", "de", "pt"):
            out.update(ngrams([bare(w) for w in found]))
    return out


@dataclass
class Profiles:
    """Rank matrix of all profiles: ``ranks[index[gram], p]`` of profile ``p``, whose language is ``languages[p]``; a language may have one for each of its scripts."""

    languages: tuple[str, ...]
    index: dict[str, int]
    ranks: np.ndarray
    penalty: float
    names: tuple[str, ...] = ()
    of: np.ndarray | None = None
    words: dict[str, np.ndarray] = field(default_factory=dict, repr=False)
    seen: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    @staticmethod
    def build(counts: dict[str, Counter], size: int = PROFILE_SIZE) -> Profiles:
        """Profiles from n-gram counts by language, with those of texts typed in Latin letters."""
        named = [(k, counts[k]) for k in LANGUAGES if counts.get(k)]
        named += [(k, profile_counts(k, [t] * 1)) for k, t in TYPED_IN_LATIN.items()]
        tops = [(k, [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]]) for k, c in named]
        index: dict[str, int] = {}
        for _, grams in tops:
            for g in grams:
                index.setdefault(g, len(index))
        ranks = np.full((len(index) + 1, len(tops)), float(size), np.float32)
        for p, (_, grams) in enumerate(tops):
            for r, g in enumerate(grams):
                ranks[index[g], p] = r
        languages = tuple(k for k, _ in tops)
        names = tuple(sorted(set(languages)))
        return Profiles(languages, index, ranks, float(size), names, np.array([names.index(k) for k in languages]))

    def distances(self, text: str) -> tuple[np.ndarray | None, int]:
        """Mean out-of-place distance to each language (of ``names``) by its nearest profile, from 0 to 1, and the number of letters; None if nothing carries language."""
        found = words(text)
        letters = sum(len(w) for w in found)
        if letters < 2:
            return None, 0
        key = " ".join(found)
        known = self.seen.get(key)
        if known is not None:
            return known, letters
        rows, counts = np.unique(np.concatenate([self._rows(w) for w in found]), return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rows, weight = rows[order], counts[order].astype(np.float32)
        place = np.arange(len(rows), dtype=np.float32)[:, None]
        out = np.minimum(np.abs(self.ranks[rows] - place), self.penalty)
        out[rows == len(self.index)] = self.penalty
        each = weight @ out / (weight.sum() * self.penalty)
        result = np.array([each[self.of == k].min() for k in range(len(self.names))])
        if len(self.seen) >= 100_000:
            self.seen.clear()
        self.seen[key] = result
        return result, letters

    def _rows(self, word: str) -> np.ndarray:
        """Matrix rows of a word's n-grams; that of unknown n-grams is the last. Kept for the words seen last."""
        known = self.words.get(word)
        if known is None:
            grams = ngrams([word])
            known = np.fromiter((self.index.get(g, len(self.index)) for g in grams.elements()), np.int64)
            if len(self.words) >= 200_000:
                self.words.clear()
            self.words[word] = known
        return known


_END = re.compile(r"(?<=[.!?؟۔।…])[\"”»)\]]*\s+|\n+")
_NO_END = re.compile(r"(?i)(?:(?<![^\W_])(?:mr|mrs|ms|dr|no|nr|avda|[^\W\d_]*str|ave|st|rd|sh|md|bzw|sr|sra|tel|approx|e\.g|i\.e|p\.m|a\.m)|(?<![^\W_])[^\W\d_])\.$")


def sentences(text: str) -> list[str]:
    """Sentences and lines of a text, without a signature at its end; abbreviations and initials end none."""
    lines = text.rstrip().split("\n")
    if len(lines) > 1 and _NAME_LINE.match(lines[-1]) and not re.search(r"[\d.!?:;,؟۔।]\s*$|\d", lines[-1]):
        text = "\n".join(lines[:-1])
    out, start = [], 0
    for m in _END.finditer(text):
        if "\n" not in m.group(0) and _NO_END.search(text[start : m.start()].rstrip("\"”»)]")):
            continue
        out.append(text[start : m.start()])
        start = m.end()
    out.append(text[start:])
    return [s for s in out if s.strip()]


#: A sentence takes its neighbour's language if that is nearly as near as the best, the more so the fewer letters it has.
SWITCH = 0.9


def path(profiles: Profiles, scored: list[tuple[np.ndarray | None, int]]) -> list[tuple[str, float] | None]:
    """Language and confidence of consecutive sentences: the path of least total distance, where a change of language costs ``SWITCH`` letters' worth of distance."""
    live = [i for i, (s, _) in enumerate(scored) if s is not None]
    out: list[tuple[str, float] | None] = [None] * len(scored)
    if not live:
        return out
    chosen = [int(scored[i][0].argmin()) for i in live]
    if len(set(chosen)) > 1:
        cost = np.array([scored[i][0] * scored[i][1] for i in live])
        best, back = cost[0].copy(), []
        stay_at = np.arange(cost.shape[1])
        for row in cost[1:]:
            move = best.min() + SWITCH
            back.append(np.where(best <= move, stay_at, int(best.argmin())))
            best = np.minimum(best, move) + row
        k = int(best.argmin())
        chosen = [k]
        for b in reversed(back):
            k = int(b[k])
            chosen.append(k)
        chosen.reverse()
    for i, k in zip(live, chosen):
        d = scored[i][0]
        own = float(d[k])
        rest = d.tolist()
        del rest[k]
        other = min(rest, default=1.0)
        out[i] = (profiles.names[k], min(1.0, max(0.0, 0.5 + 2.5 * (other - own) / max(other, 1e-6))))
    return out


def runs(profiles: Profiles, text: str) -> list[tuple[str, float, int]]:
    """Longest runs of consecutive sentences in one language as (language, confidence, letters)."""
    scored = [profiles.distances(s) for s in sentences(text)]
    out: list[tuple[str, float, int]] = []
    for found, (_, n) in zip(path(profiles, scored), scored):
        if found is None:
            continue
        if out and out[-1][0] == found[0]:
            lang, conf, m = out[-1]
            out[-1] = (lang, (conf * m + found[1] * n) / (m + n), m + n)
        else:
            out.append((found[0], found[1], n))
    return out
