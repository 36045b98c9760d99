"""Personal information in free text, found by a semi-Markov conditional random field and replaced by typed placeholders.

Whole spans are scored, not words. Shapes propose candidate segments (numbers with separators, addresses round an @ or a spelled-out
one, house number and street in the word orders of several languages, words next to a known given name or the stem of a family name); any other
segment has no weight in the field. Features of the whole span and of its surroundings score each candidate for each kind, neighbouring
entities add a transition score, and dynamic programming over the candidates of a text (none longer than ``LONGEST``) chooses borders and kinds
together. The field's weights are fitted here, by gradient ascent on the exact conditional likelihood (forward-backward over the same
lattice), on sentences written by the generator in ``pii_training`` around the names of the contributors table.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtime.runtime import spread

KINDS = ("email", "phone", "id_number", "address", "name")
LONGEST = 100  # characters of an entity
NEAR = 60  # characters between entities that still see each other

GAP = r"(?:[  ]|[ \t]*\r?\n[ \t]*)"
LETTER = r"[^\W\d_]"
MARK = "̀-ͯ"
WORD = re.compile(rf"{LETTER}(?:{LETTER}|[{MARK}]|['’](?!s\b)(?={LETTER})|-(?={LETTER}))*")

# Words for streets by language, and words that tell what a following number or name is
STREETS_EN = "Street|St|Road|Rd|Lane|Ln|Drive|Dr|Terrace|Ter|Crescent|Cres|Avenue|Ave|Boulevard|Blvd|Court|Ct|Close|Way|Place|Pl|Square|Sq|Row|Hill|Walk|Mews|Parkway|Pkwy|Circle|Grove|Gardens|Alley"
STREETS_FR = "rue|avenue|av\\.|boulevard|bd|chemin|impasse|allée|place|quai|cours|route|passage|square|sentier|ruelle|venelle|faubourg"
STREETS_ES = "Calle|C/|Avenida|Avda\\.|Av\\.|Paseo|Plaza|Camino|Ronda|Carrera|Travesía|Callejón|Glorieta|Vía"
STREETS_DE = "straße|strasse|str\\.|gasse|weg|allee|platz|ring|damm|ufer|graben|steig|pfad|hof|chaussee|promenade|kai|markt|wall"
LEADS_DE = "Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Hinter der|Hinter dem|Unter den|Beim|Obere[rns]?|Untere[rns]?|Alte[rns]?|Neue[rns]?|Große[rns]?|Kleine[rns]?"
CUES = {
    "phone": "phone call text tel telephone tél mobile cell fax dial ring reach hotline number contact whatsapp sms handy telefon mobil rufnummer anrufen teléfono telefono móvil llamar téléphone portable appeler",
    "id": "ssn passport ausweis ausweisnummer personalausweis identity identitätsnummer nino dni nie nif tax steuer steuer-id steuernummer national insurance social security sécurité sociale sozialversicherungsnummer reisepass pasaporte passeport carte license licence",
    "address": "address adresse dirección live lives living resides residence home office wohnt wohnhaft anschrift büro lieferung vive habite demeurant domicilio deliver delivery delivered ship shipping moved street strasse straße calle",
    "name": "author by from to cc thanks contact ask name customer patient tenant maintainer signed-off-by reviewed-by acked-by tested-by reported-by suggested-by helped-by co-authored-by co-developed-by dear herr frau señor señora mr mrs ms dr m mme merci à bitte von an für gracias",
    "count": "order invoice article item took run job epoch build rows version port host seed hash pid bytes ns ms time rfc ticket issue release isbn sku batch id commit revision revert reverts index serial part count total limit timestamp session checksum sha",
}
CUE_OF: dict[str, tuple[str, ...]] = {}
for _kind, _words in CUES.items():
    for _w in _words.split():
        CUE_OF[_w] = (*CUE_OF.get(_w, ()), _kind)
COMPANY = frozenset("gmbh ag inc ltd llc plc sons co company corp labs group kg sa sarl bv oy ab".split())
ROBOT = re.compile(r"no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|mailer-daemon|postmaster|\bbot\b|bot$|robot|\bci\b|automat|daemon|notification|sync$|updater")

NUMBER = re.compile(r"[+(]?\(?\d(?:(?:[  ./-]|\)[ -]?|[ -]?\(|[ \t]*\r?\n[ \t]{0,12})?\d){6,}")
LONG_STREET = re.compile(rf"[0-9]{{1,5}}[A-Za-z]?{GAP}(?:[A-ZÀ-Þ][\w'’{MARK}-]*\.?{GAP}){{1,4}}(?:{STREETS_EN})\b(?!['’-])")
DOCUMENT_NO = re.compile(r"\b(?:[A-Z]{1,3}\d{5,9}[A-Z]?|\d{6,9}[- ]?[A-Z]|[A-Z]{2}(?:[ -]?\d\d){3}[ -]?[A-Z])\b")
STREET_NUMBER_FIRST = re.compile(
    rf"[0-9]{{1,5}}(?:[A-Za-z](?![A-Za-z])|{GAP}(?:bis|ter)\b)?(?:{GAP}(?:(?:[A-ZÀ-Þ][\w'’{MARK}-]*\.?{GAP}){{1,3}}?(?:{STREETS_EN})\b(?!['’-])|(?:{STREETS_FR}){GAP}(?:de la |de l['’]|du |des |de |d['’])?{LETTER}[\w'’{MARK}-]*(?:{GAP}[A-ZÀ-Þ][\w'’{MARK}-]*)*)"
    rf"|,{GAP}(?:{STREETS_FR}){GAP}(?:de{GAP}la{GAP}|de{GAP}l['’]|du{GAP}|des{GAP}|de{GAP}|d['’])?{LETTER}[\w'’{MARK}-]*(?:{GAP}[A-ZÀ-Þ][\w'’{MARK}-]*)*)")
STREET_NAME_FIRST = re.compile(
    rf"[A-ZÄÖÜ](?:(?<=C)(?:alle|/|amino|arrera|allejón)|(?<=A)(?:venida|vda\.|v\.)|(?<=P)(?:aseo|laza)|(?<=R)onda|(?<=T)ravesía|(?<=G)lorieta|(?<=V)ía){GAP}(?:de{GAP}los{GAP}|de{GAP}las{GAP}|de{GAP}la{GAP}|del{GAP}|de{GAP})?(?:[A-ZÀ-Þ][\w'’{MARK}-]*{GAP}){{0,3}}[A-ZÀ-Þ][\w'’{MARK}-]*,?{GAP}\d{{1,4}}(?:{GAP}?[a-z]\b)?"
    rf"|(?:[A-ZÄÖÜ][a-zäöüß]+{GAP}(?:(?:der|dem|den){GAP})?(?:[A-ZÄÖÜ][a-zäöüß]+{GAP})?)?[A-ZÄÖÜ][a-zäöüß-]{{2,}}(?:{STREETS_DE}){GAP}?\d{{1,4}}(?:{GAP}?[a-z]\b)?"
    rf"|(?:{LEADS_DE}){GAP}(?:[A-ZÄÖÜ][a-zäöüß-]+{GAP}){{1,3}}\d{{1,4}}(?:{GAP}?[a-z]\b)?")
LOCAL_PART = re.compile(r"[\w.+-]+\Z")
DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
SPELLED = re.compile(rf"[\w.+-]+(?:{GAP}?[\[(]at[\])]{GAP}?[\w-]+(?:(?:\.|{GAP}?[\[(]dot[\])]{GAP}?|{GAP}dot{GAP})[\w-]+)+|{GAP}at{GAP}[\w-]+(?:{GAP}dot{GAP}[\w-]+)+)")
LAST_WORDS = re.compile(r"[^\W_][\w.'’-]*")
_PARTS = re.compile(r"\d+")


def fold(word: str) -> str:
    """Lower case without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    return plain.replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ß", "ss").replace("ı", "i")


class Lexicon:
    """Given names, and stems and endings of family names, of known people."""

    def __init__(self, full_names: Iterable[str | None]):
        people = [n.split() for n in full_names if n and len(n.split()) > 1]
        self.given = {fold(p[0]) for p in people}
        families = Counter(fold(w) for p in people for w in p[-1].split("-"))
        alike: dict[str, str] = {}
        for f in families:
            if len(f) > 4:
                alike[f[:4]] = os.path.commonprefix((alike.get(f[:4], f), f))
        self.stems = {s if len(s) < 9 else s[:5] for s in alike.values()}
        self.endings = {f[-3:] for f in families if len(f) > 4}
        self.pairs = sorted((unicodedata.normalize("NFC", p[0]), unicodedata.normalize("NFC", p[-1])) for p in people)
        self.automaton = ahocorasick.Automaton()
        for word in {v for p in people for v in (p[0].lower(), unicodedata.normalize("NFC", p[0].lower()), unicodedata.normalize("NFD", p[0].lower()), fold(p[0]))}:
            self.automaton.add_word(word, ("w", len(word)))
        for stem in self.stems | {f[:4] for p in people for w in p[-1].split("-") for f in (w.lower(),) if len(f) > 4 and fold(f) != f and fold(f)[:4] != f[:4]}:
            self.automaton.add_word(stem, ("w", len(stem)))
        for sign in ("(at)", "[at]", " dot ", "[dot]", "(dot)", "dot\n"):
            self.automaton.add_word(sign, ("s", len(sign)))
        for word in [w.replace("\\", "") for w in STREETS_DE.split("|")]:
            self.automaton.add_word(word, ("d", len(word)))
        for word in {w.replace("\\", "").lower() for w in STREETS_ES.split("|")} | {re.sub(r"\[.*", "", w).lower() for w in LEADS_DE.split("|")}:
            if word not in self.automaton:
                self.automaton.add_word(word, ("e", len(word)))
        self.automaton.make_automaton()

    def family(self, word: str) -> tuple[bool, bool]:
        """Whether all parts of a family name have a known stem, and a known ending."""
        parts = [fold(p) for p in word.split("-")]
        return all(any(p[:n] in self.stems for n in (4, 5, 6, 7, 8)) for p in parts), all(p[-3:] in self.endings for p in parts)


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _shape(word: str) -> str:
    if len(word.rstrip(".")) == 1:
        return "I" if word[0].isupper() else "i"
    if word.isupper():
        return "U"
    if word[0].isupper():
        return "T"
    return "l"


def candidates(text: str, lexicon: Lexicon) -> list[tuple[int, int, str, tuple]]:
    """(start, end, kind, facts) of all segments the field can choose, in order of their ends."""
    found: dict[tuple[int, int, str], tuple] = {}
    n = len(text)
    at = text.find("@")
    while at >= 0:
        if 0 < at < n - 1 and (text[at - 1].isalnum() or text[at - 1] in "_.+-") and text[at + 1].isalnum():
            left, right = LOCAL_PART.search(text, max(0, at - 64), at), DOMAIN.match(text, at + 1, at + 100)
            if left and right:
                begin = left.start()
                while begin < at and text[begin] in "+-" and _marked(text, begin + 1):
                    begin += 1
                if begin < at:
                    found[begin, right.end(), "email"] = ("@",)
        at = text.find("@", at + 1)
    names: set[int] = set()
    streets: list[tuple[int, int]] = []  # where an address with its street first can lie
    for end, (kind, length) in lexicon.automaton.iter(_lower(text)):
        begin = end - length + 1
        if kind == "s":
            for m in SPELLED.finditer(text, max(0, begin - 70), min(n, end + 70)):
                if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] in "._+-@"):
                    found[m.start(), m.end(), "email"] = ("spelled",)
        elif kind == "d":
            if text[end + 1 : end + 16].lstrip()[:1].isdigit():
                streets.append((max(0, begin - LONGEST), min(n, end + 24)))
        elif begin == 0 or not (text[begin - 1].isalnum() or text[begin - 1] in "_@"):
            if kind == "w":
                names.add(begin)
            elif text[begin].isupper():
                streets.append((begin, min(n, begin + LONGEST + 8)))
    if names:
        _name_candidates(text, names, lexicon, found)
    for m in NUMBER.finditer(text):
        for a, b in _number_spans(text, *m.span()):
            body = text[a:b]
            groups = "-".join(str(len(g)) for g in _PARTS.findall(body))
            marks = "".join(sorted(set(c for c in body if not c.isdigit())))
            digits = sum(map(str.isdigit, body))
            facts = (groups, "+" if body[0] == "+" else "0" if body[0] == "0" else body[0] if body[0] == "(" else "n", marks, digits)
            found[a, b, "phone"] = facts
            if digits >= 8:
                found[a, b, "id_number"] = facts
    for m in DOCUMENT_NO.finditer(text):
        body = m.group()
        found[m.start(), m.end(), "id_number"] = (re.sub(r"[A-Z]", "A", re.sub(r"\d+", lambda g: str(len(g.group())), body)), "a", "", sum(map(str.isdigit, body)))
    for spans, rx, how in ([(0, n)], STREET_NUMBER_FIRST, "first"), (streets, STREET_NAME_FIRST, "last"):
        for m in (m for a, b in spans for m in rx.finditer(text, a, b)):
            a, b = m.span()
            if b - a > LONGEST or (a and (text[a - 1].isalnum() or text[a - 1] in "_.,/:#-+" and how == "first" or text[a - 1] == "_") and not _marked(text, a)) or (b < n and (text[b].isalnum() or text[b] == "_")):
                continue
            found[a, b, "address"] = (how,)
            longer = LONG_STREET.match(text, a) if how == "first" else None
            if longer and longer.end() > b:
                found[a, longer.end(), "address"] = (how,)
            cut = re.search(r"\d[ \n\t]+[a-z]\Z", m.group())
            if cut:
                found[a, a + cut.start() + 1, "address"] = (how,)
            if how == "last":  # the words before the street may belong to the sentence
                for w in re.finditer(rf"{GAP}(?=[A-ZÄÖÜ])", m.group()):
                    inner = STREET_NAME_FIRST.match(text, a + w.end())
                    if inner and inner.end() == b:
                        found[inner.start(), b, "address"] = (how,)
            if how == "first":  # a French street may end before further capitalised words
                words = [x.end() for x in re.finditer(r"[\w'’-]+", m.group())]
                for w in words[3:-1]:
                    if re.search(rf"\b(?:{STREETS_FR}){GAP}", m.group()[:w]) and m.group()[:w].split()[-1] not in ("de", "la", "du", "des"):
                        found[a, a + w, "address"] = (how,)
    return sorted(((a, b, k, f) for (a, b, k), f in found.items()), key=lambda c: (c[1], c[0], c[2]))


def _marked(text: str, a: int) -> bool:
    """Whether only the mark of an added or removed line stands between a position and the start of its line."""
    return a > 0 and text[a - 1] in "+-" and (a == 1 or text[a - 2] == "\n")


def _number_spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of 7 to 15 digits a run of digits and separators can be read as: the whole, and what is left of it when it is cut at blanks, from either
    side. Nothing may continue a span as a word, and a bracket that is closed outside isn't part of it."""
    out = []
    cuts = [(c.start() + a, c.end() + a) for c in _BLANKS.finditer(text[a:b])]
    for x, y in [(a, b), *((a, c) for c, _ in cuts), *((c, b) for _, c in cuts)]:
        if text[x] == "(" and ")" not in text[x:y]:
            x += 1
        if y - x > LONGEST or not 7 <= sum(map(str.isdigit, text[x:y])) <= 15 or not (text[y - 1].isdigit() and (text[x].isdigit() or text[x] in "+(")):
            continue
        if (y < len(text) and (text[y].isalnum() or text[y] == "_")) or (x and (text[x - 1].isalnum() or text[x - 1] in "_+")):
            continue
        out.append((x, y))
    return out


_BLANKS = re.compile(r"[ \t\r\n]+")
_JOIN = re.compile(rf"{GAP}\Z")
_INITIAL = re.compile(rf"\.{GAP}?\Z")
_COMMA = re.compile(rf",{GAP}\Z")


def _name_candidates(text: str, hits: set[int], lexicon: Lexicon, found: dict) -> None:
    for begin in hits:
        a = max(0, begin - 40)
        words = [m.span() for m in WORD.finditer(text, a, min(len(text), begin + 80))]
        here = next((i for i, (s, e) in enumerate(words) if s <= begin < e), None)
        if here is None:
            continue
        for i in range(max(0, here - 2), here + 1):
            if i == 0 and a and words[0][0] == a:
                continue
            for j in range(max(here, i + 1), min(len(words), i + 3)):
                s, e = words[i][0], words[j][1]
                if e - s > LONGEST or (s, e, "name") in found:
                    continue
                if s and (text[s - 1].isalnum() or text[s - 1] in "_@/.-+#") and not _marked(text, s):
                    continue
                if e < len(text) and (text[e].isalnum() or text[e] in "_@/+" or (text[e] in ".-" and e + 1 < len(text) and text[e + 1].isalnum())):
                    continue
                parts = [text[p:q] for p, q in words[i : j + 1]]
                between = [text[words[k][1] : words[k + 1][0]] for k in range(i, j)]
                comma = False
                for k, gap in enumerate(between):
                    if _JOIN.match(gap):
                        continue
                    if len(parts[k]) == 1 and _INITIAL.match(gap):
                        continue
                    if k == 0 and _COMMA.match(gap):
                        comma = True
                        continue
                    break
                else:
                    given = [fold(p) in lexicon.given for p in parts]
                    if comma:  # family name, given name (initial)
                        family, first = parts[0], given[1]
                        initial = len(parts[1]) == 1
                    else:
                        family, first = parts[-1], given[0]
                        initial = len(parts[0]) == 1
                    if len(family) < 3 or any(len(p) > 30 for p in parts):
                        continue
                    if len(parts) == 3 and len(parts[2 if comma else 1]) != 1:
                        if not comma:
                            continue
                    stem, ending = lexicon.family(family)
                    if not (first or initial or stem) or (initial and not (stem or family[0].isupper())):
                        continue
                    found[s, e, "name"] = (first, initial, stem, ending, comma, "".join(map(_shape, parts)), "\n" in text[s:e], fold(family))


def features(text: str, c: tuple[int, int, str, tuple]) -> list[str]:
    """Names of the features of a candidate."""
    a, b, kind, facts = c
    k = kind[:2]
    before = text[max(0, a - 48) : a]
    words = [w.lower().strip(".") for w in LAST_WORDS.findall(before)][-5:]
    out = [k, f"{k}<{words[-1] if words else ''}", f"{k}>{_next(text, b)}"]
    if len(words) > 1:
        out.append(f"{k}<<{words[-2]}")
    cues = {q for w in words for q in CUE_OF.get(w, ())}
    out += [f"{k}~{q}" for q in cues] or [f"{k}~"]
    if kind in ("phone", "id_number"):
        ahead = text[b : b + 48].partition("\n")[0].lower()
        out += [f"{k}^{q}" for w in LAST_WORDS.findall(ahead) for q in CUE_OF.get(w, ()) if q in ("id", "phone", "count")]
    edge = before[-1:] if before[-1:] in "<(\"'/=:#@_.-" else " "
    out.append(f"{k}[{edge}")
    if kind == "email":
        span = text[a:b]
        local, _, domain = span.partition("@") if "@" in span else (span, "", span.rpartition(" ")[2])
        run = text[max(0, a - 40) : a].split()[-1:] if a and not text[a - 1].isspace() else []
        out.append("em=" + facts[0])
        if ROBOT.search(local.lower()) or ROBOT.search(domain.lower()):
            out.append("em=robot")
        if run and "://" in run[0]:
            out.append("em=url")
        if text[b : b + 1] == ":" or (text[b : b + 1] == "/" and text[b + 1 : b + 2].isalnum()):
            out.append("em=remote")
        if domain.rpartition(".")[2][:1].isdigit():
            out.append("em=version")
        if local in ("git", "ci", "hg", "svn", "root"):
            out.append("em=system")
    elif kind in ("phone", "id_number"):
        groups, first, marks, digits = facts
        out += [f"{k}g{groups}", f"{k}f{first}", f"{k}m{marks}", f"{k}n{digits}", f"{k}f{first}{digits}", f"{k}g{groups}m{marks}"]
        if "phone" in cues or "id" in cues:
            out.append(f"{k}told{'phone' if 'phone' in cues else 'id'}")
        if "\n" in text[a:b]:
            out.append(f"{k}broken")
    elif kind == "address":
        out.append(f"ad{facts[0]}")
        span = text[a:b]
        out.append(f"adw{len(span.split())}")
        if re.search(r"\d[ \n\t]+[a-z]\Z", span):
            out.append("adletter" + ("." if not text[b : b + 2].strip() or text[b] in ",.;)" else _next(text, b)[:1]))
        elif re.match(r"[ \n\t]+[a-z]\b", text[b : b + 3]):
            out.append("adcut")
        if re.match(rf"{GAP}[A-ZÀ-Þ]", text[b : b + 3]):
            out.append("admore")
        french = re.search(rf"\b(?:{STREETS_FR}){GAP}(.*)", span, re.S)
        if french:
            out.append(f"adfr{sum(w[:1].isupper() for w in french.group(1).split())}")
        lead = LAST_WORDS.match(span)
        if lead and "address" in CUE_OF.get(lead.group().lower(), ()):
            out.append("adlead")
        out.append(f"adlast{span.split()[-1].lower()}" if facts[0] == "first" else "adlast")
        street = re.search(rf"\b(?:{STREETS_EN})\Z", span)
        out.append("adtype" + (street.group().lower() if street else "other"))
    else:
        given, initial, stem, ending, comma, shape, broken, family = facts
        out += [f"na{'g' * given}{'i' * initial}{'s' * stem}{'e' * ending}{',' * comma}", f"nash{shape}", f"nag{given or initial}f{stem and ending}", f"nash{shape}s{stem}"]
        if family in COMPANY or _next(text, b) in COMPANY:
            out.append("nacompany")
        if broken:
            out.append("nabroken")
    return out


_NEXT = re.compile(r"\s*([^\W_]+|[^\w\s])")


def _next(text: str, b: int) -> str:
    m = _NEXT.match(text, b, b + 24)
    return m.group(1).lower() if m else ""


class Field:
    """Weights of the field; ``transition`` scores a kind near after a kind."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in names)

    def decode(self, text: str, lexicon: Lexicon) -> list[tuple[int, int, str]]:
        """Best segmentation: chosen (start, end, kind) in order."""
        found = candidates(text, lexicon)
        if not found:
            return []
        ends = [c[1] for c in found]
        best: list[float] = []
        back: list[int] = []
        top: list[tuple[float, int]] = []  # best path ending at or before each candidate
        get = self.weights.get
        for i, c in enumerate(found):
            far = bisect_right(ends, c[0] - NEAR - 1, 0, i)  # without transition
            value, link = top[far - 1] if far else (0.0, -1)
            for j in range(far, bisect_right(ends, c[0], far, i)):
                v = best[j] + get(f"{found[j][2]}>{c[2]}", 0.0)
                if v > value:
                    value, link = v, j
            best.append(self.score(features(text, c)) + value)
            back.append(link)
            last = top[-1] if top else (0.0, -1)
            top.append((best[i], i) if best[i] > last[0] else last)
        i = top[-1][1]
        out = []
        while i >= 0:
            out.append(found[i][:3])
            i = back[i]
        return out[::-1]

    def fit(self, examples: list[tuple[str, set]], lexicon: Lexicon, rounds: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """AdaGrad on the conditional log likelihood; examples are (text, true (start, end, kind) segments)."""
        prepared = []
        for text, gold in examples:
            found = candidates(text, lexicon)
            if found:
                prepared.append((found, [features(text, c) for c in found], [c[:3] in gold for c in found]))
        power: dict[str, float] = {}
        w = self.weights
        for _ in range(rounds):
            for found, names, gold in prepared:
                grad: dict[str, float] = {}
                chosen = [i for i, g in enumerate(gold) if g]
                link = self._links(found)
                scores = [self.score(f) for f in names]
                expected, pairs = self._marginals(found, scores, link)
                for i, f in enumerate(names):
                    d = (1.0 if gold[i] else 0.0) - expected[i]
                    if abs(d) > 1e-4:
                        for x in f:
                            grad[x] = grad.get(x, 0.0) + d
                for (j, i), p in pairs.items():
                    if link[i].get(j):
                        x = link[i][j]
                        grad[x] = grad.get(x, 0.0) - p
                for j, i in zip(chosen, chosen[1:]):
                    x = link[i].get(j)
                    if x:
                        grad[x] = grad.get(x, 0.0) + 1.0
                for x, g in grad.items():
                    g -= decay * w.get(x, 0.0)
                    power[x] = power.get(x, 1e-2) + g * g
                    w[x] = w.get(x, 0.0) + rate * g / math.sqrt(power[x])
        return self

    @staticmethod
    def _links(found: list) -> list[dict[int, str | None]]:
        """For each candidate the ones that can come right before it, with the transition's name if they are near."""
        return [{j: (f"{found[j][2]}>{c[2]}" if c[0] - found[j][1] <= NEAR else None) for j in range(i) if found[j][1] <= c[0]} for i, c in enumerate(found)]

    def _marginals(self, found: list, scores: list[float], link: list[dict[int, str | None]]):
        """Forward-backward: probability of each candidate, and of each pair in a row."""
        n, get = len(found), self.weights.get
        forward = [0.0] * n
        for i in range(n):
            terms = [0.0] + [forward[j] + (get(x, 0.0) if x else 0.0) for j, x in link[i].items()]
            m = max(terms)
            forward[i] = scores[i] + m + math.log(sum(math.exp(t - m) for t in terms))
        later: list[list[tuple[int, str | None]]] = [[] for _ in range(n)]
        for i in range(n):
            for j, x in link[i].items():
                later[j].append((i, x))
        backward = [0.0] * n
        for j in range(n - 1, -1, -1):
            terms = [0.0] + [scores[i] + backward[i] + (get(x, 0.0) if x else 0.0) for i, x in later[j]]
            m = max(terms)
            backward[j] = m + math.log(sum(math.exp(t - m) for t in terms))
        whole = [0.0, *forward]
        m = max(whole)
        z = m + math.log(sum(math.exp(t - m) for t in whole))
        single = [math.exp(forward[i] + backward[i] - z) for i in range(n)]
        pairs = {(j, i): math.exp(forward[j] + (get(x, 0.0) if x else 0.0) + scores[i] + backward[i] - z) for j in range(n) for i, x in later[j]}
        return single, pairs


def train(full_names: list[str | None], sentences: int = 10000, seed: int = 7) -> tuple[Lexicon, Field]:
    """Lexicon and fitted field from the names of known people; ``sentences`` bounds the training set."""
    from loomtime.llm.pii_training import examples

    lexicon = Lexicon(full_names)
    return lexicon, Field().fit(examples(lexicon, sentences, seed), lexicon)


_KEPT: dict = {}


def _model(documents: DataFrame, people: DataFrame, name: str, max_people: int):
    names = [r[0] for r in people.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(max_people + 1).collect()]
    if len(names) > max_people:
        raise ValueError(f"more than max_people={max_people} names to learn from")
    key = hash(tuple(names))
    if _KEPT.get("key") != key:
        lexicon, field = train(names)
        _KEPT.update(key=key, names=names, weights={k: round(v, 5) for k, v in field.weights.items() if abs(v) > 1e-3})
    return documents.sparkSession.sparkContext.broadcast((names, _KEPT["weights"])), uuid.uuid4().hex


_WORKER: dict = {}


def _decoder(sent, tag: str):
    if _WORKER.get("tag") != tag:
        names, weights = sent.value
        field = Field()
        field.weights = weights
        _WORKER.update(tag=tag, lexicon=Lexicon(names), field=field)
    return _WORKER["field"], _WORKER["lexicon"]


def find_personal(documents: DataFrame, people: DataFrame, doc_id: str = "doc_id", text: str = "text", full_name: str = "full_name", max_people: int = 5000) -> DataFrame:
    """(doc_id, kind, start, end, value) of each piece of personal information; offsets and value are those of the text as written.

    Null, empty and blank texts give no row; long texts are read whole, each piece of at most ``LONGEST`` characters; repeated documents each
    report; other columns are ignored. ``people`` gives names to learn from; robots' names are to be null there. More than ``max_people``
    names raise ValueError; none at all leave only the kinds without names.
    """
    sent, tag = _model(documents, people, full_name, max_people)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, lexicon = _decoder(sent, tag)
        for batch in batches:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                if body:
                    for a, b, kind in field.decode(body, lexicon):
                        rows.append((doc, kind, a, b, body[a:b]))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "kind", "start", "end", "value"])

    given = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    return spread(given).mapInArrow(run, "doc_id bigint, kind string, start int, end int, value string")


PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}


def redact(documents: DataFrame, people: DataFrame, doc_id: str = "doc_id", text: str = "text", full_name: str = "full_name", max_people: int = 5000) -> DataFrame:
    """(doc_id, text, found): each text with its pieces of personal information replaced by placeholders of their kind, the rest unchanged; ``found``
    counts them. Null and empty texts stay as they are with 0; see ``find_personal``."""
    sent, tag = _model(documents, people, full_name, max_people)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, lexicon = _decoder(sent, tag)
        for batch in batches:
            out, counts = [], []
            for body in batch.column(1):
                body = body.as_py()
                spans = field.decode(body, lexicon) if body else []
                parts, at = [], 0
                for a, b, kind in spans:
                    parts += [body[at:a], PLACEHOLDERS[kind]]
                    at = b
                out.append("".join(parts) + body[at:] if body else body)
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "found"])

    given = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(given).mapInArrow(run, "doc_id bigint, text string, found int")
