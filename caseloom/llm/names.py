"""Reading and rewriting of names typed by people.

Short forms that are a part of the full name (Ben, Vik, Xander, Gabby), and
spellings that sound alike (Mohamed and Muhammad) follow from rules; only forms
that no rule yields are listed.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

# Short forms in common use that are no part of their full names, from general knowledge of
# English, Romance, German, Slavic and Arabic naming; names that several full names share name them all.
SHORT_FORMS = """
alec: alexander; alyosha: alexei; babette: elisabeth; becky: rebecca; beppe: giuseppe; bess: elizabeth; betsy: elizabeth; betty: elizabeth; beto: alberto, roberto; bia: beatriz;
biddy: bridget; bill: william; billie: wilhelmina, william; billy: william; bob: robert; bobby: robert; borya: boris; cecco: francesco; charo: rosario; checa: francesca; checo: sergio; chesca: francesca; chelo: consuelo; chente: vicente; chico: francisco;
chuck: charles; chucho: jesus; chuy: jesus; cindy: cynthia, lucinda; conchita: concepcion; curro: francisco; daisy: margaret; dede: andre; dick: richard; dima: dmitri; dolly: dolores, dorothy; dot: dorothy;
dottie: dorothy; ed: edgar, edmund, edward, edwin; eddie: edgar, edmund, edward, edwin; ella: eleanor, gabriella; ellie: eleanor, elizabeth; elsie: elizabeth; eugenia: yevgenia; fanny: frances; fifi: josephine; fritz: friedrich; gianni: giovanni; gigi: luigi; ginny: virginia;
goyo: gregorio; greta: margaret; grisha: grigori; gus: angus, augustus; hal: harold, henry; hank: henry; hans: johannes; harry: harold, henry; hattie: harriet; heinz: heinrich; hetty: henrietta; ike: isaac;
izzy: isabel, isadora; jack: john; jan: janet, johannes; jens: johannes; jerry: gerald, jeremy; jill: gillian; jim: james; jimmy: james; jo: joanna, johannes, joseph, josephine; jochen: joachim; joe: joseph; joey: joseph, josephine;
johnny: john, jonathan; jojo: joseph; kay: katherine; kike: enrique; kit: christopher, katherine; kitty: katherine; klaus: nikolaus; kolya: nikolai; lalo: eduardo; larry: lawrence; lex: alexander; libby: elizabeth; lisa: elizabeth;
liz: elizabeth; lizzie: elizabeth; lola: dolores; loli: dolores; lolita: dolores; lottie: charlotte; lucho: luis; madge: margaret; maggie: margaret; maisie: margaret; mandy: amanda; manolo: manuel;
masha: maria; maude: matilda; meg: margaret; memo: guillermo; mick: michael; mickey: michael; mike: michael; mikey: michael; mimmo: domenico; minnie: wilhelmina; misha: mikhail; mo: mohammed;
moe: mohammed; mohd: mohammed; md: mohammed; molly: mary; momo: mohammed; nacho: ignacio; nadya: nadezhda; nan: ann; nancy: ann; nastya: anastasia; natasha: natalia; ned: edward;
nell: eleanor, helen; nellie: eleanor, helen; neto: ernesto; nora: eleanor; olya: olga; ollie: oliver, olivia; paca: francisca; paco: francisco; paddy: patricia, patrick; pancho: francisco; paquito: francisco; pasha: pavel;
patsy: patricia, patrick; peg: margaret; peggy: margaret; pepe: jose; peppe: giuseppe; petya: pyotr; pinky: priyanka; pino: giuseppe; pip: philip; pippo: filippo; polly: mary; quique: enrique;
rex: reginald; rick: frederick, richard; ricky: richard; riri: henri; rita: margaret; robin: robert; sadie: sarah; sally: sarah; sandy: alexander, alexandra; sasha: alexander, alexandra; sepp: josef; shelly: michelle;
shura: alexander; sonya: sofia; steve: stephen; steven: stephen; sue: susan; tad: thaddeus; tanya: tatiana; ted: edward, theodore; teddy: edward, theodore; tess: theresa; tilly: matilda; tolya: anatoli;
tono: antonio; tori: victoria; toto: salvatore; trish: patricia; trudy: gertrude; uli: ulrich, ulrike; ulli: ulrich, ulrike; ulla: ulrike, ursula; uschi: ursula; vanya: ivan; vasya: vasili; vova: vladimir; willie: william; wilma: wilhelmina; xico: francisco; ze: jose; zeca: jose; zhenya: yevgenia
"""
NICKNAMES: dict[str, frozenset[str]] = {}
for _entry in SHORT_FORMS.split(";"):
    _short, _, _full = _entry.partition(":")
    NICKNAMES[_short.strip()] = frozenset(x.strip() for x in _full.split(","))

# Legal forms, words for kinds of business, titles, particles and
# entries that name nobody.
LEGAL_FORMS = frozenset("llc inc ltd gmbh fze co company corp limited plc fzco fzc sarl sa srl ag kg bv llp incorporated corporation lda ltda pvt".split())
BUSINESS = frozenset("trading catering events logistics hospitality facilities interiors school canteen services group hotel restaurant cafe bakery foods contracting holdings maintenance supplies solutions enterprises partners industries".split())
TITLES = frozenset("mr mrs ms miss dr sh sheikh sheikha eng prof sir madam mme m sr sra herr frau".split())
PARTICLES = frozenset("al el ul bin ibn bint de da van von".split())
NOBODY = re.compile(
    r"(?i)^(?:|[\W_]*|n\.?/?a\.?|none|null|nil|unknown|tbc|tba|test|customer|client|guest|cash|cash (?:sale|customer)|walk[\s\-_]?in(?: (?:customer|guest|client))?|(?:guest|customer|client|table|counter) ?#?\d*|counter sale|no name|anonymous|various|staff|shop|misc)$"
)


def fold(s: str) -> str:
    """Lower case without marks over letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("ł", "l")) if not unicodedata.combining(c)).lower()


def distance(a: str, b: str, most: int = 3) -> int:
    """Edit distance with swaps of neighbours; ``most`` + 1 stands for anything greater."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


_SOUNDS = ((r"ph", "f"), (r"bh", "v"), (r"[ck]h(?=[aouy])|ck|q|c(?![ehiy])", "k"), (r"sch|sh", "s"), (r"th", "t"), (r"dh", "d"), (r"gh", "g"), (r"x", "ks"), (r"w", "v"), (r"g(?=[ei])|g(?=a$)", "j"))


@lru_cache(maxsize=50_000)
def sound(word: str) -> str:
    """A given name by how it sounds: consonants folded over spellings, the kind of its first vowel where these are three or fewer, and whether it ends like a feminine form."""
    s = word
    for pattern, by in _SOUNDS:
        s = re.sub(pattern, by, s)
    vowel = re.search(r"[aeiouy]+", s[1:] if s[:1] == "y" else s)
    first = vowel.group(0) if vowel else ""
    kind = "1" if first == "a" else "2" if re.search(r"[iey]", first) and not re.match(r"[ou]", first) else "3" if first else "0"
    last = "a" if re.search(r"(?:a|ah|eh|elle|ette|ine)$", word) else ""
    head = "a" if s[:1] in "aeiou" else s[:1]
    body = re.sub(r"[aeiouy]", "", re.sub(r"h(?![aeiou])|(?<![aeiou])h", "", s[1:]))
    letters = re.sub(r"(.)\1+", r"\1", head + body)
    return letters + ("" if len(letters) > 3 else kind) + last


def _sounds_alike(a: str, b: str) -> bool:
    """Alike with three consonants or more."""
    return sound(a) == sound(b) and len(re.sub(r"[\da]+$", "", sound(a))) >= 3


def shortened(word: str) -> set[str]:
    """Parts that short forms of a full name come from: three letters or more at its start or end."""
    w = re.sub(r"th", "t", re.sub(r"c(?=[aouklrt])|ck", "k", word))
    return {w[:j] for j in range(3, len(w) + 1)} | {w[i:] for i in range(1, len(w) - 2)}


def stems(word: str) -> set[str]:
    """A short form as such parts: itself, and without a diminutive ending and the letter doubled before it."""
    w = re.sub(r"th", "t", re.sub(r"c(?=[aouklrt])|ck", "k", word))
    out = {w}
    cut = re.sub(r"(?:ie|ey|y|i|e|o|a|ita|ito)$", "", w)
    if len(cut) >= 3:
        out |= {cut, re.sub(r"(.)\1$", r"\1", cut)}
    return {x for x in out if len(x) >= 3}


@dataclass(frozen=True)
class Name:
    """A name as read: a person (given names, initials, family name) or an organisation (two core words and the rest)."""

    org: bool
    given: frozenset[str] = frozenset()
    typed: str = ""
    initial: str = ""
    middle: str = ""
    family: str = ""
    rest: str = ""
    cut: bool = False


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?", text)


def _person(given: list[str], family: str, middle: str, cut: bool) -> Name:
    typed = "".join(given)
    known = NICKNAMES.get(typed, frozenset({typed}) if len(typed) > 1 else frozenset())
    return Name(False, known, typed if len(typed) > 1 else "", typed[:1], middle, family, cut=cut)


@lru_cache(maxsize=50_000)
def readings(raw: str) -> tuple[Name, ...]:
    """The ways to read a name; none if it names nobody.

    Remarks in brackets, behind a slash or a spaced dash, and between stars are
    no part of it; a spaced dash behind a word for a kind of business turns the
    parts round ("Catering - A B Co"). Without a comma either end may be the
    family name, so both orders are readings; of three words and more the given
    names count alone and as one word.
    """
    text = unicodedata.normalize("NFC", raw).replace("\u00a0", " ").strip()
    text = re.sub(r"\*[^*]*\*|\([^)]*\)|\[[^\]]*\]", " ", text)
    text = re.sub(r"/.*$", " ", text) if not re.fullmatch(r"\s*n/?a\s*", text, re.I) else text
    if NOBODY.match(re.sub(r"\s+", " ", text).strip()):
        return ()
    text = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group(0).replace(".", "") + " ", text)
    left, dash, right = text.partition(" - ")
    if dash:
        words = [fold(w) for w in _words(left)]
        text = f"{right} {left}" if words and all(any(distance(w, b, 1) <= 1 for b in BUSINESS) for w in words) else left
    glued = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text) if re.fullmatch(r"\s*\S+\s*", text) else text
    tokens = [fold(w) for w in _words(glued.replace("-", " "))]
    plain = [t.rstrip(".") for t in tokens]
    if plain and plain[0] == "the":
        tokens, plain = tokens[1:], plain[1:]
    while plain and plain[0] in TITLES and len(plain) > 2:
        tokens, plain = tokens[1:], plain[1:]
    if not plain or not any(len(p) > 1 for p in plain):
        return ()
    kind = [i for i, (t, p) in enumerate(zip(tokens, plain)) if i and (p in BUSINESS or (t.endswith(".") and len(p) == 4 and any(b.startswith(p) for b in BUSINESS)) or (len(p) > 4 and any(distance(p, b, 1) <= 1 for b in BUSINESS)))]
    legal = [i for i, p in enumerate(plain) if i >= 2 and p in LEGAL_FORMS]
    if kind or legal or "&" in text:
        core = [p for i, p in enumerate(plain) if i not in kind and i not in legal and p not in ("and", "und", "et", "y")]
        return (Name(True, typed=core[0], family=core[1] if len(core) > 1 else "", rest=plain[kind[0]][:4] if kind else ""),) if core else ()
    if len(plain) == 1:
        return (Name(False, family=plain[0]),)
    comma = "," in text
    if comma:
        a = len(_words(text.split(",")[0].replace("-", " ")))
        tokens, plain = tokens[a:] + tokens[:a], plain[a:] + plain[:a]
    out: dict[Name, None] = {}
    for order in ((tokens,) if comma else (tokens, tokens[-1:] + tokens[:-1])):
        bare = [t.rstrip(".") for t in order]
        if len(bare[-1]) == 1 or bare[-1] in PARTICLES or (not comma and bare[0] in PARTICLES):
            continue
        middle = next((p for p in bare[1:-1] if len(p) == 1), "")
        long = [p for i, p in enumerate(bare[:-1]) if i == 0 or len(p) > 1]
        front = [p for p in long if p not in PARTICLES] or long
        if front:
            cut = len(bare[-1]) >= 4 and order[-1].endswith(".")
            out.setdefault(_person(front[:1], bare[-1], middle or (front[1][:1] if len(front) > 1 else ""), cut))
            if len(long) > 1 and len(front[0]) > 1:
                out.setdefault(_person(long, bare[-1], middle, cut))
    return tuple(out)


def deletions(s: str) -> set[str]:
    """The string and what is left of it without one character."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))} if len(s) >= 4 else {s}


def sure_forms(raw: str) -> set[str]:
    """Rewritings under which spellings of one entity meet: given name, its typing and its sound with the family name, each with one slip; the two core words of an organisation likewise."""
    out: set[str] = set()
    for n in readings(raw):
        if not n.typed or not n.family:
            continue
        for g in {n.typed} | (n.given if len(n.given) == 1 else set()):
            out |= {f"f|{g}|{d}" for d in deletions(n.family)} | {f"f|{d}|{n.family}" for d in deletions(g)}
            if not n.org:
                out.add(f"s|{sound(g)}|{n.family}")
    return out


#: Rules of the weaker rewritings by the round in which they apply: initials, cut names and misspelt short forms fit several classes until short forms have joined theirs, and these until names with two slips have.
ROUNDS = ("t", "pqnsw", "icd")

#: Listed short forms by what is left of them without one letter.
_NEAR: dict[str, set[str]] = {}
for _n in NICKNAMES:
    for _d in deletions(_n) if len(_n) > 3 else ():
        _NEAR.setdefault(_d, set()).add(_n)


def offers(raw: str) -> set[tuple[str, str, str]]:
    """Rewritings (rule, part, family name) of a full name that another one may stand for: initial, parts of the given name, typing, sound, cut family name, all in one word."""
    out: set[tuple[str, str, str]] = set()
    for n in readings(raw):
        if n.org or not n.typed:
            continue
        for g in {n.typed} | (n.given if len(n.given) == 1 else set()):
            for rule, parts in (("i", {g[0]}), ("p", shortened(g)), ("d", shortened(g)), ("n", {g}), ("s", {sound(g)}), ("t", deletions(g))):
                out |= {(rule, p, n.family) for p in parts}
            out |= {("q", g[i:j], n.family) for i in range(1, len(g) - 4) for j in (i + 4, i + 5)}
            out |= {("c", g, n.family[:k]) for k in range(4, len(n.family))}
        out.add(("w", "", n.typed + n.family))
    return out


def wishes(raw: str) -> set[tuple[str, str, str]]:
    """Rewritings by which a short, cut or otherwise unclear name looks for full ones."""
    out: set[tuple[str, str, str]] = set()
    for n in readings(raw):
        if n.org:
            continue
        if not n.typed and not n.initial:
            out.add(("w", "", n.family))
        elif not n.typed:
            out.add(("i", n.initial, n.family))
        else:
            if n.cut:
                out |= {("c", g, n.family) for g in n.given}
            if n.given == {n.typed}:
                out |= {("t", p, n.family) for p in deletions(n.typed)} | {("p", s, n.family) for s in stems(n.typed)} | {("s", sound(n.typed), n.family), ("q", n.typed, n.family)}
                out |= {("d", s, n.family) for d in deletions(n.typed) for s in stems(d)}
                for near in {x for d in deletions(n.typed) for x in _NEAR.get(d, ())}:
                    if distance(near, n.typed, 1) <= 1:
                        out |= {("n", g, n.family) for g in NICKNAMES[near]}
            elif len(n.given) > 1:
                out |= {("n", g, n.family) for g in n.given}
    return out


def families(raw: str) -> set[str]:
    """Family names that a spelling may have, of five letters or more: shorter ones have no slips."""
    return {n.family for n in readings(raw) if not n.org and len(n.family) >= 5}


def length(raw: str) -> int:
    """Letters of the longest given name that a spelling may have."""
    return max((len(g) for n in readings(raw) if not n.org for g in n.given), default=0)


@lru_cache(maxsize=100_000)
def may_be(raw: str, full: str) -> bool:
    """Whether a short spelling and a full one that share a rewriting agree otherwise: in middle initials, and in the family name but for a slip or what was cut off."""
    for a, b in product(readings(raw), readings(full)):
        if a.org or b.org or a.middle and b.middle and a.middle != b.middle:
            continue
        if not a.typed and not a.initial:
            if a.family == b.typed + b.family:
                return True
            continue
        x, y = (a.family, b.family[: len(a.family)]) if a.cut else (a.family, b.family)
        d = distance(x, y, 1)
        if d == 0 or d == 1 and min(len(x), len(y)) >= 5:
            return True
    return False


def _same(a: Name, b: Name) -> bool:
    if a.org or b.org:
        d = distance(a.typed, b.typed, 2) + distance(a.family, b.family, 2)
        kinds = not a.rest or not b.rest or distance(a.rest, b.rest, 2) <= 2 and a.rest[:1] == b.rest[:1]
        return bool(a.typed and b.typed) and d <= 1 and kinds
    if not a.typed or not b.typed or (a.middle and b.middle and a.middle != b.middle):
        return False
    d = distance(a.family, b.family, 2)
    if d > 1 or (d == 1 and min(len(a.family), len(b.family)) < 5):
        return False
    e = distance(a.typed, b.typed, 2)
    if e + d <= 1 or (e == 2 and d == 0 and min(len(a.typed), len(b.typed)) >= 7):
        return True
    if len(a.given) != 1 or len(b.given) != 1:
        return False
    (g,), (h,) = a.given, b.given
    return g == h or d == 0 and (_sounds_alike(g, h) or distance(g, h, 1) <= 1 and min(len(g), len(h)) >= 4)


@lru_cache(maxsize=100_000)
def same(raw_a: str, raw_b: str) -> bool:
    """Whether two spellings name the same beyond doubt: in some reading the given names are one by spelling, short form or sound, and the family names differ by a slip at most. A slip is one letter more, fewer, other or swapped, also where that makes another name (Karim, Karima)."""
    return any(_same(a, b) for a, b in product(readings(raw_a), readings(raw_b)))


def identity(raw: str) -> str | None:
    """What is left of a spelling without case, marks, titles, remarks and order; None if it names nobody."""
    found = readings(raw)
    return "\x1e".join(sorted({"\x1f".join((str(int(n.org)), n.typed, n.initial, n.middle, n.family, n.rest, str(int(n.cut)))) for n in found})) if found else None
