"""Labels for training the tagger, from fielded columns and general formats.

No rule quotes a sentence. Names come from columns that hold names (senders
written ``Name <address>``, customer names, fields of key facts called holder,
owner, agent and the like) and are looked for in the texts; numbers, addresses
and e-mail addresses are told by national formats and by the words before them.
A sentence that stays in doubt is left out of the training data instead of being
labelled wrongly. The operator itself never calls these rules.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from caseloom.llm import names

KINDS = ("email", "phone", "id_number", "address", "name")

_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹०१२३४५६७८९", "0123456789" * 3)

# General formats of addresses, numbers and the words that announce them.
_AT, _DOT = r"\s?(?:@|\(at\)|\[at\]|\sat\s)\s?", r"(?:\.|\s?(?:\[dot\]|\(dot\)|\sdot)\s?)"
EMAIL = re.compile(rf"(?i)(?<![\w.+\-])[a-z0-9][\w.+\-]*{_AT}[a-z0-9\-]+(?:{_DOT}[a-z0-9\-]+)*?{_DOT}(?:example|test|invalid|com|net|org|io|de|fr|uk)(?:{_DOT}(?:com|org|net|invalid|test))?(?![\w])")
_RUN = re.compile(r"(?<![\w/\-.@])[+(]*[O\d](?:[ ().\-/]{0,2}\d){6,18}(?![\w@])")
_ID_ALNUM = re.compile(r"(?i)(?<![\w\-])(?:\d{8}-?[a-z]|[a-z]{2} ?\d\d ?\d\d ?\d\d ?[a-d]|[a-z]\d{7}[a-z]?)(?![\w])")
_ID_SHAPES = re.compile(r"784[- ]\d{4}[- ]\d{7}[- ]\d|784\d{12}|\d{3}[- ]\d\d[- ]\d{4}|0\d{3}[- ]\d{4}[- ]\d{4}|\d{5}-\d{7}-\d")
_PHONE_SHAPES = re.compile(r"(?:\+|00)[\d ().\-/O]+|\(\d{3,5}\)[ \d.\-]+|1? ?\d{3}([ .\-])\d{3}\1\d{4}|[0O]7\d{3}([ .\-]?)\d{3}\2\d{3}|[0O]1\d\d \d{3} \d{4}")
_NO = r"(?:\W{0,2}(?:numbers?|no\.?|nummer|número|नंबर|نمبر))?"
_ID_WORDS = re.compile(r"(?i)(?:passport|\bssn\b|social security|national id|\bid\b|n[úu]mero d\S{1,3}identi\w*|identi\w*|ausweis|\bdni\b|\bnif\b|هوي|جواز|شناخت\S*|پاسپورٹ|पहचान|आधार|पासपोर्ट)" + _NO)
_PHONE_WORDS = re.compile(r"(?i)phone|mobile|\bcell|\bcall|\bring\b|\btel|number|whatsapp|sms|llam|anruf|rufen|nummer|appel|joindre|ligu?em|\buse\b|هاتف|اتصل|على|رقم|فون|نمبر|फोन|फ़ोन|नंबर|मुझे")
_CODE_WORDS = re.compile(r"(?i)(?:track\w*|invoice|batch|order|meter|model|serial|reference|\bref\b|ticket|amount|rechnung|sendung|zähler|facture|suivi|compteur|factura|seguimiento|contador|fatura|registo|فاتورة|شحنة|عداد|طلب|बिल|ट्रैकिंग|मीटर|ऑर्डर|بل|ٹریکنگ|میٹر|آرڈر)" + _NO)

_WAY = r"(?:Street|St|Lane|Ln|Road|Rd|Drive|Dr|Avenue|Ave|Boulevard|Blvd|Court|Ct|Close|Cl|Way|Terrace|Ter|Place|Pl|Crescent|Square|Sq|Row|Grove|Hill|Walk|Mews|Gardens)\b\.?"
_UNIT = r"(?:Flat|Apt|Apartment|Unit|Suite|Villa|Building|Bldg|House|Room)\.? \w{1,5}"
_TOWN = r"(?:, [A-ZÀ-Þ][\w’']+(?: [A-ZÀ-Þ][\w’']+)?(?=[\s.,]|$))?"
ADDRESS = [
    re.compile(rf"(?<![\w])(?i:{_UNIT}, (?:\w{{3,5}} floor, )?(?:Street \d+\w?\b|(?:\d+\w? )?[\w’']+(?: [\w’']+)? {_WAY})(?:, {_UNIT})?)" + _TOWN),
    re.compile(rf"(?<![\w])(?i:\d{{1,4}}[a-d]? [^\W\d_]+(?: [^\W\d_]+)? {_WAY}(?:, {_UNIT})?)" + _TOWN),
    re.compile(r"(?i)(?<![\w])(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Rua|Travessa|Praça|Largo|Av\.) [^,.\n\d]+?,? ?\d+[a-z]?\b(?:, \d+º ?\w+)?"),
    re.compile(r"(?i)(?<![\w])\d+(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|impasse|allée) [^,.\n]+?(?=[,.]|$)"),
    re.compile(r"(?i)(?<![\w])(?:[^\W\d_]+e )?[^\W\d_]+(?:stra(?:ß|ss)e|gasse|weg|platz|allee|ufer|damm) \d+[a-z]?\b"),
    re.compile(r"(?<![\w])(?:Am|Im|An der|Auf dem|Zum|Zur) [A-ZÄÖÜ][\w]+ \d+[a-z]?\b"),
    re.compile(r"(?:فيلا|شقة|شارع|بناية|عمارة|بيت) (?:[^\W\d_]+ ){0,3}[\d٠-٩]+(?:، (?:شارع|شقة|الطابق) [\d٠-٩]+| ?، حي [^\W\d_]+)*"),
    re.compile(r"(?:मकान|फ्लैट|प्लॉट)(?: नंबर| नं)?\.? [\d०-९]+(?:, (?:गली|सेक्टर|ब्लॉक) [\d०-९]+)?(?:, [^\W\d_]+[ा-्\w]*)?"),
    re.compile(r"(?:مکان|فلیٹ|گلی)(?: نمبر)? [\d۰-۹]+(?:، (?:گلی|سیکٹر|بلاک)(?: نمبر)? [\d۰-۹]+)?(?:، [^\W\d_]+)?"),
]
_SPLIT = re.compile(r"(?<=[.!?؟۔।])\s+|\n")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0900-\u094d\u0640\u064b-\u0652’'\-](?=\w|[\u0900-\u094d]))*[\u0900-\u094d]*\.?")
PARTICLES = frozenset("al el bin ibn abd de la da van von ur rahman el-rahman".split())
_SIGNED = re.compile(r"\s*[^\w\s]+ ?([^\W\d_]+)\s*")
_SIGNATURE = re.compile(r"\s*(?:[^\w\s]+ )?((?:[A-ZÀ-Þ][^\W\d_]+|[A-Z]\.)(?: [A-Z]\.| Al| El)* [A-ZÀ-Þ][^\W\d_]+)\s*")
#: A sentence that introduces a name, or a line so short that it may be one, is in doubt without a name.
_INTRODUCED = re.compile(r"(?i)\bmy name\b|\bname is\b|je m.appelle|me llamo|hei(?:ß|ss)e\b|chamo-me|اسمي|میرا نام|मेरा नाम|\bsigned for\b")
_SHORT = re.compile(r"\W*[^\W\d_]\S*(?: [^\W\d_]\S*)?[^\w.!?؟۔।]*")
_TITLED = re.compile(r"(?i)\b(?:mr|mrs|ms|miss|dr|herr|frau|señora?|madame|sra?)\.? $")


def numbers(text: str) -> tuple[list[tuple[int, int, str]], bool]:
    """Phone and identity numbers of a sentence as (start, end, kind), and whether another number stays in doubt."""
    plain = text.translate(_DIGITS)
    out, doubt = [(m.start(), m.end(), "id_number") for m in _ID_ALNUM.finditer(plain)], False
    for m in _RUN.finditer(plain):
        s, before = m.group(0), EMAIL.sub(" / ", plain[: m.start()])
        digits = re.sub(r"\D", "", s.replace("O", "0"))
        if not 7 <= len(digits) <= 15 or any(a < m.end() and m.start() < b for a, b, _ in out):
            continue
        end = m.end() + (plain[m.end() : m.end() + 1] == ")" and s.count("(") > s.count(")"))
        last = max(((x.end(), rank, k) for rank, k, p in ((2, "", _CODE_WORDS), (1, "id_number", _ID_WORDS), (0, "phone", _PHONE_WORDS)) for x in p.finditer(before[-48:])), default=(-1, 0, None))[2]
        if last == "id_number" or _ID_SHAPES.fullmatch(s):
            out.append((m.start(), end, "id_number"))
        elif last != "" and (_PHONE_SHAPES.fullmatch(s) or last == "phone" and len(digits) >= 9):
            out.append((m.start(), end, "phone"))
        elif last is None and len(digits) >= 9 and not re.fullmatch(r"[1-9]\d{11,}", s):  # as long a number without a prefix is no phone's
            doubt = True
    return out, doubt


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of the lines and sentences of a text; a title or an initial ends none."""
    cuts, start = [], 0
    for m in _SPLIT.finditer(text):
        if m.group(0) != "\n" and re.search(r"(?i)(?:\b(?:mr|mrs|dr|no|avda|av|str|ave|rd|sh|md)|\b\w)\.$", text[start : m.start()]) and "\n" not in m.group(0):
            continue
        cuts.append((start, m.start()))
        start = m.end()
    return [(a, b) for a, b in [*cuts, (start, len(text))] if b > a]


@dataclass
class Lexicon:
    """Words of names as fielded columns have them, and how the words of texts are used otherwise."""

    given: Counter = field(default_factory=Counter)
    family: Counter = field(default_factory=Counter)
    common: Counter = field(default_factory=Counter)
    after: Counter = field(default_factory=Counter)
    behind: Counter = field(default_factory=Counter)
    kin: set[str] = field(default_factory=set)

    def add(self, name: str) -> None:
        words = [w.strip(".,").lower() for w in name.split()]
        words = [w for w in words if w and w not in PARTICLES]
        if words:
            if len(words[0]) > 1:
                self.given[words[0]] += 1
            if len(words) > 1 and len(words[-1]) > 2:
                self.family[words[-1]] += 1

    def learn_usage(self, texts: list[str]) -> None:
        """Counts the words of texts in lower case among others, and the words behind given names."""
        for t in texts:
            words = _WORD.findall(t)
            mixed = any(w[:1].isupper() for w in words) and any(w[:1].islower() for w in words)
            for w, nxt in zip(words, [*words[1:], ""]):
                low = w.strip(".").lower()
                if mixed and w[:1].islower() or not w[:1].isupper() and not w[:1].islower() and low not in self.given and low not in self.family:
                    self.common[low] += 1
                if low in self.given:
                    self.after[low, nxt.strip(".").lower()] += 1
        for (_, nxt), n in self.after.items():
            self.behind[nxt] += n

    def is_given(self, w: str) -> bool:
        return self.given[w] > 1 and self.common[w] <= 4 * self.given[w] or self.common[w] == 0 and w not in names.TITLES and self._kin(w)

    def _kin(self, w: str) -> bool:
        """Whether a word is a short form or another spelling of a given name that the columns have."""
        if not self.kin:
            known = [g for g, n in self.given.items() if n > 1 and g.isascii() and len(g) > 3]
            self.kin |= set(names.NICKNAMES) | {x for g in known if len(x := names.sound(g)) > 3 and x.isalpha()} | {p for g in known for p in names.shortened(g)}
        return w in names.NICKNAMES or len(w) > 2 and w.isascii() and (names.sound(w) in self.kin or bool(names.stems(w) & self.kin))

    def is_product(self, given: str, nxt: str) -> bool:
        """Whether a given name and the word behind it are a fixed phrase: the word follows few given names, often."""
        n = self.after[given, nxt]
        return n >= 8 and nxt not in self.family and n >= 0.3 * self.behind[nxt]


def label_names(s: str, taken: list[tuple[int, int, str]], lex: Lexicon) -> tuple[list[tuple[int, int, str]], bool]:
    """Names in the parts of a sentence that nothing else took, and whether a word stays in doubt."""
    for p in (_SIGNED, _SIGNATURE):
        m = p.fullmatch(s)
        if m and not any(lex.common[w.strip(".").lower()] for w in m.group(1).split() if w.lower() not in PARTICLES):
            return [(m.start(1), m.end(1), "name")], False
    words = [m for m in _WORD.finditer(s) if not any(a < m.end() and m.start() < b for a, b, _ in taken)]
    low = [m.group(0).strip(".").lower() for m in words]
    cased = any(m.group(0)[:1].isupper() for m in words) and any(m.group(0)[:1].islower() for m in words)
    near = lambda k: k + 1 < len(words) and words[k + 1].start() - words[k].end() <= 1 and "\n" not in s[words[k].end() : words[k + 1].start()]
    big = lambda k: words[k].group(0)[:1].isupper() or not cased
    found, doubt, i = [], False, 0
    while i < len(words):
        w, start = low[i], i
        initial = len(w) == 1 and words[i].group(0).endswith(".")
        nxt = low[i + 1] if near(i) else ""
        known = lex.is_given(w) and not lex.is_product(w, nxt)
        if known and lex.given[w] < 2 and i == 0 and nxt not in lex.family:
            known = False  # a word at the start of a sentence that only looks like a short form
        if known or initial:
            j, last = i, -1
            while near(j) and j - i < 5:
                j += 1
                if low[j] in lex.family:
                    last = j
                    break
                if low[j] in PARTICLES or len(low[j]) == 1 or (low[j] in lex.given and j == i + 1):
                    continue
                if lex.common[low[j]] <= 2 and len(low[j]) > 3 and words[j].group(0)[:1].lower() != words[j].group(0)[:1].upper() and (words[j].group(0)[:1].isupper() or not initial):
                    last = j
                break
            if last >= 0:
                end = words[last].end() - words[last].group(0).endswith(".")
                found.append((words[i].start(), end, "name"))
                i = last
            elif not initial and (big(i) or lex.common[w] == 0):
                end = words[i].end() - words[i].group(0).endswith(".")
                found.append((words[i].start(), end, "name"))
        elif w in lex.family and lex.common[w] == 0:
            if i and near(i - 1) and words[i - 1].group(0)[:1].isupper() and not lex.common[low[i - 1]] and not (found and found[-1][1] > words[i - 1].start()):
                start = i - 1
            if start < i or _TITLED.search(s[: words[i].start()]):
                found.append((words[start].start(), words[i].end() - words[i].group(0).endswith("."), "name"))
            else:
                doubt = True
        i += 1
    return found, doubt or not found and bool(_INTRODUCED.search(s) or _SHORT.fullmatch(s.strip()) and not taken)


def label_sentence(s: str, lex: Lexicon) -> tuple[list[tuple[int, int, str]], bool]:
    """Spans of one sentence, without overlaps, and whether something stays in doubt."""
    found = [(m.start(), m.end(), "email") for m in EMAIL.finditer(s)]
    for p in ADDRESS:
        found += [(m.start(), m.end(), "address") for m in p.finditer(s)]
    more, doubt = numbers(s)
    found += more
    found.sort(key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for a, b, k in found:
        while b > a and s[b - 1] in " .,;:!?":
            b -= 1
        if b > a and all(b <= x or a >= y for x, y, _ in kept):
            kept.append((a, b, k))
    persons, unsure = label_names(s, kept, lex)
    return sorted(kept + persons), doubt or unsure


#: Names of fields by the kind of their values.
_FIELDS = ((re.compile(r"(?i)address"), "address"), (re.compile(r"(?i)holder|owner|agent|driver|signer|contact name|spouse"), "name"))


def label_facts(text: str, lex: Lexicon) -> tuple[list[tuple[int, int, str]], bool]:
    """Spans of a ``name=value; ...`` list by the names of its fields, else as a sentence."""
    out, doubt = [], False
    for m in re.finditer(r"[^;]+", text):
        item = m.group(0)
        key, eq, value = item.partition("=")
        kind = next((k for p, k in _FIELDS if eq and p.search(key)), None)
        lead = len(item) - len(value.lstrip())
        if kind and value.strip():
            out.append((m.start() + lead, m.start() + len(item.rstrip()), kind))
        else:
            spans, unsure = label_sentence(item, lex)
            spans = [x for x in spans if not eq or x[2] != "name"]
            if eq and not any(k in ("phone", "id_number") for _, _, k in spans) and re.search(r"(?i)callback|phone|sms|mobile", key) and value.strip():
                spans.append((lead, len(item.rstrip()), "phone"))
            out += [(m.start() + a, m.start() + b, k) for a, b, k in spans]
            doubt |= unsure and not eq
    return sorted(out), doubt


def label_sender(text: str, lex: Lexicon) -> tuple[list[tuple[int, int, str]], bool]:
    """Spans of a sender: a number, an address, ``Name <address>`` or a name."""
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    plain = text.translate(_DIGITS).strip()
    start = len(text) - len(text.lstrip())
    if not out and re.fullmatch(r"[+(O\d][\d ().\-/O]{6,}", plain):
        return [(start, start + len(plain), "phone")], False
    head = text.split("<")[0].rstrip() if out else text.strip()
    if head.strip() and not any(a <= start for a, _, _ in out):
        words = [w.strip(".,").lower() for w in head.split()]
        if any(w in lex.given and lex.given[w] > 1 for w in words) or len(words) > 1 and words[-1] in lex.family or re.fullmatch(r"\s*[A-Z]\. (?:Al |El )?[^\W\d_]+", head):
            out.append((start, start + len(head.strip()), "name"))
        elif len(words) == 2 and not re.search("[A-Za-z]", head):
            out.append((start, start + len(head.strip()), "name"))
    return sorted(out), False
