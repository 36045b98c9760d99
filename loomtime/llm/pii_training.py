"""Invented sentences with known personal information, for fitting the field of ``pii``.

A carrier is a sentence with slots; a slot in braces is written by the maker of its name and, if the maker's kind is one of the five, is a true
segment. Carriers are put together by rule from openings, statements and forms that business letters, version control, logs and tables in general
have in common; none is taken from a corpus. Carriers without true slots are there for what looks alike and isn't.
"""

from __future__ import annotations

import random
import unicodedata

# What leads to a segment, by kind
OPENINGS = {
    "name": "our colleague|thanks to|many thanks,|signed by|written by|approved by|as agreed with|on behalf of|invoice for|attention|meeting with|the tenant|the patient|maintainer:|patch by|cc:|guest:|spoke to|questions to|"
            "Frau|Herr|Kunde:|zuständig ist|im Auftrag von|Dank an|Ansprechpartner:|Mme|M.|merci à|le client|de la part de|responsable :|Señora|Señor|el paciente|firmado por|gracias a|la inquilina|attn.",
    "email": "email:|e-mail|mail to|write to|reply to|send it to|contact|copy to|address of the owner:|E-Mail an|schreiben an|courriel :|écrire à|correo:|escribir a|mailto:|owner =|user:|sent from",
    "phone": "phone|phone:|tel.|tel:|call|mobile|cell:|fax|dial|text|ring|hotline:|by phone under|phone number is|Telefon|Tel.:|Mobil|Handy:|anrufen unter|téléphone :|tél.|appeler le|portable|teléfono|móvil:|llamar al|whatsapp|office|work|home|reception|direct line|extension|desk",
    "address": "address:|lives at|living at|the flat at|deliver to|ship to|moved to|our office at|residence:|registered at|home address|visit us at|mail the form to|wohnhaft|Büro|Wohnsitz|Filiale|Praxis|Anschrift|Anschrift:|Adresse:|wohnt|Lieferung an|adresse :|demeurant|habite au|"
               "livrer au|domicilio:|vive en|dirección:|entregar en|based at",
}
ENDINGS = [".", ",", ";", "", "", " today.", " as usual.", " (see below).", " before noon", " and wait for an answer.", " bitte.", " por favor.", " s'il vous plaît.", " for the {noun}."]

FORMS = """
Author: {name} <{email}>
Author: {login} <{email}>
Author: {name} <{robotmail}>
Author: {login} <{robotmail}>
From: {name} <{email}>
To: {email}
Cc: {name} <{email}>, {name} <{email}>
Commit: {robot} <{robotmail}>
Committer: {name} <{email}>
author {name} <{email}> {epoch} +0200
committer {login} <{robotmail}> {epoch} -0700
Signed-off-by: {name} <{email}>
Signed-off-by: {robot} <{robotmail}>
Co-authored-by: {name} <{email}>
Co-developed-by: {name} <{robotmail}>
Reviewed-by: {name} <{email}>
Acked-by: {name}
Tested-by: {name} <{email}>
Reported-by: {name} <{email}>
Suggested-by: {name}
Helped-by: {name}
Copyright (c) 2019 {name}
# maintained by {name}
// written by {name} <{email}>
 * @author {name}
@author {name} ({email})
TODO({login}): ask {name} about the {noun}
FIXME {name}: the {noun} fails
{name} <{email}>
{name} ({email})
{name}, {address}, {place}
{name}
{address}
{place}
{name}, tel. {phone}
{name} / {phone} / {email}
{conj} {name} said, the {noun} is late.
{conj} {name} left, nobody read the {noun}.
{conj} {name} and {name} asked for it
{name}, {noun} {phone}
{name}, {noun} {bare}
{name} wrote the {noun} and {name} checked it.
{name} told me that the {noun} broke.
I met {name}, {name} and {name} at the {noun} talk.
According to {name}, the {noun} is slow.
That was {name}'s idea.
Please ask {name}, phone {phone}.
You can reach {name} at {phone} or {email}.
Reach us under {phone}, {address}.
My name is {name} and I live at {address}.
I live at {address}, my {idlabel} is {docno}.
His {idlabel} {docno} was visible in the {noun}.
The {idlabel} of {name} is {docno}.
{name} ({idlabel} {docno}) uses the {noun}.
{idlabel}: {docno}
{idlabel} {docno}
{idlabel} = {docno}
SSN {ssn}
SSN: {ssn}
ssn={plainssn}
ssn {plainssn} appeared
{name} (SSN {ssn}) called {phone}.
social security number {ssn}
social insurance no. {plainssn}
tax id {taxid}
Steuernummer {taxid}
Steuer-ID: {taxid}
the {noun} shows SSN\n    {ssn} in clear
passport {docno}, phone {phone}
Die {idlabel} von {name} lautet {docno}.
Le {idlabel} de {name} est {docno}.
El {idlabel} de {name} es {docno}.
Frau {name} wohnt {address}, Telefon {phone}.
Rückfragen an {name} ({email}), {phone}.
{address}
{address}, {place}
({address})
{noun}: {address}
the {noun} {noun}: {address}
{noun} to {address}
{address} y {address}
Vive en {address} y trabaja en {place}
{address} a las {small}
wohnt {address} und kommt von {place}
M. {name} habite au {address}, tél. {phone}.
La señora {name} vive en {address}, teléfono {phone}.
write {spelled} for details
mail: {spelled}
{spelled}
Contact {spelled} or {email}.
mailto:{email}
<a href="mailto:{email}">mail</a>
email = "{email}"
email: {email}
"{email}"
({email})
{small},{name},{email},{phone}
{small};{name};{address};{phone}
{small},"{name}","{docno}",{small}.{small}
{name},{ssn},{bare}
({small}, '{name}', '{email}', '{phone}'),
({small}, '{name}', '{docno}', '{phone}'),
({small}, '{name}', '{ssn}', '{bare}');
('{name}', '{plainssn}', '{phone}')
INSERT INTO customers VALUES ({small}, '{name}', '{taxid}', '{phone}');
INSERT INTO staff (id, name, phone) VALUES ({small}, '{name}', '{bare}');
+  ('{name}', '{phone}'),
-  ('{name}', '{docno}'),
«"name": "{name}", "email": "{email}"»
«"name": "{name}", "phone": "{phone}", "age": {small}»
«"address": "{address}", "city": "{place}"»
«"ssn": "{ssn}", "id": {epoch}»
name: {name}
phone: {bare}
call {bare}
name = "{name}"
address = "{address}"
phone = "{phone}"
+    street: "{address}"
mask("{ssn}")  # SSN
mask("{docno}")  # {idlabel}
check("{taxid}")  # tax id
redact("{phone}")  # phone
Noreply mail goes out from {robotmail}.
Notices come from {robotmail}
from {robotmail} to {email}
git clone git@{domain}:{noun}/{noun}.git
git clone ssh://git@{domain}/{noun}/{noun}
origin  git@{domain}:{login}/{noun}.git (fetch)
https://{login}:{hex}@{domain}/{noun}
postgres://{login}:{hex}@{domain}:{small}/{noun}
use {noun}@{version} and {noun}-core@{version}
npm install {noun}@{version}
bump {noun}-{noun}@{version} to {version}
{noun}-{noun}@{version}
@{login} can you look at this
thanks @{login}, @{login}
Merge branch '{noun}' of {domain}:{noun}
Merge pull request #{small} from {login}/{noun}-{noun}
Date: Mon Jun 3 20:36:58 2019 +0100
2021-03-04 12:33:09 INFO {noun} {small} {epoch}
[{epoch}] {noun}: {small} ms
started at {epoch}, ended at {epoch}
time {epoch}
build {epoch} of {noun} is red
job {epoch} took {small} s
run {epoch} failed, see run {epoch}
invoice {ordno} of {small} lines
order number {ordno}
order {ordno} was paid
ticket {ordno}, issue #{small}
part number {artno}
isbn {artno}
article {artno} is gone
serial {ordno} and {artno}
batch {ordno} has {small} units
connected to {ip} port {small}
ping {ip}: {small} ms
listen on {ip}:{small}
from {small} to {epoch} rows in 2017-2023
{dotted} bytes, {dotted} rows
it weighed {dotted} grams in {small} {noun}s
the {noun} used {dotted} units of {dotted}
measured {dotted} against {dotted}
took {dotted} units for {small} items
count={epoch} limit={small} total={ordno}
seed {epoch}
retry({epoch}, {small})
assert {noun}("{epoch}") == "{epoch}"
x = [{small}, {small}, {small}, {small}]
{noun},{epoch},{small},{small}
('{noun}', {epoch}, {small})
version {version} needs {noun} {version}
id {uuid}
session {uuid} ended
index {hex}..{hex} 100644
index {seven}..{hex}
commit {hex}
revert {nine}
fixes {nine} which broke the {noun}
This reverts commit {nine}.
see commit {seven} and {nine}
sha256:{hex}{hex}
checksum {nine}-{small}
{noun} {epoch}/{small}
{small} {noun}s, {small} {noun}s and {small} {noun}s
the number {epoch} is a prime
{falsename} is new in this release.
{falsename} is enabled.
see {falsename}
the {falsename} dialog
{falsename} and {falsename} share code.
{address} {falsename} is new.
Rename {camel} to {camel}.
class {camel}:
import {camel} from '{noun}'
{company} sponsors the {noun}.
copyright {company}
the {noun} of {company} is late
{company} and {company} merged.
we {givenword} fix the {noun}
it {givenword} {noun} the {noun}
Use the {noun} of the {street}.
{street} is closed.
The map shows {street} and {street}.
{small} {Noun} Street {noun}s
{small} {Noun} Court {noun}s were tested.
{small} {Noun} Way {noun}s
level {small} {Noun}s Road {noun}
{small} roads and {small} lanes
the {Noun} lane of the {noun}
{small} place {noun}s, {small} row {noun}s
test {small} Drive {noun}s
{Noun} {small} and {Noun} {small}
Am Ende {small} {noun}s
Im Test {small} {noun}s
@@ -{small},7 +{small},9 @@ {noun}
+    return {noun}({small}, "{noun}")
-    {noun}: {noun}:{small}
SELECT {noun} FROM {noun} LIMIT {small};
diff --git a/{noun}.py b/{noun}.py
The {noun} reads the {noun} again.
Add a {noun} to the {noun} of the {noun}
{Noun} {noun}: drop the {noun}
""".strip().split("\n")


def carriers() -> list[str]:
    """The forms, and each opening before its kind with endings in turn."""
    out = list(FORMS)
    for kind, openings in OPENINGS.items():
        for i, words in enumerate(openings.split("|")):
            end = ENDINGS[(i * 5 + len(kind)) % len(ENDINGS)]
            out.append(f"{words} {{{kind}}}{end}")
            out.append(f"{words.capitalize()} {{{kind}}}{ENDINGS[(i * 3) % len(ENDINGS)]}")
            out.append(f"The {{noun}} is ready, {words} {{{kind}}}{end}")
    return out


NOUNS = "harvest lantern valley compass anchor saddle engine basket winter copper marble ribbon thunder meadow pocket needle bottle candle hammer shelter orchard pillow blanket rocket turbine circuit antenna scanner printer cabinet".split()
PLACES = "Northwick,Ellerton,12045 Brunnfeld,Saint-Aubert,Villa Serena,Lakeport,Oakham TN 37010".split(",")
DOMAINS = "example.com example.org example.net mail.example.edu post.example.co.uk firma.example societe.example empresa.example uni.example".split()
STREET_WORDS = "Elm,Park,High,Church,Long Acre,Victoria,Queen's,Saint John,St. Peter,West,Tenth,Green Hollow,River Bend,Miller's,Orchard,Twin Oaks,Sunset,Low Meadow".split(",")
STREET_ENDS = "Street St Road Rd Lane Ln Drive Dr Terrace Crescent Avenue Ave Boulevard Blvd Court Close Way Place Square Row Walk Grove Gardens".split()
GERMAN = "Schillerstraße,Goethestr.,Ahornweg,Eichenallee,Schmiedegasse,Kirchplatz,Bahnhofstraße,Südring,Oberer Graben,Untere Bergstraße,Am Alten Markt,Am Hang,Neue Gartenstraße,Im Kleinen Feld,Tulpengasse,Hafendamm,An der Mühle,Zum Wiesengrund".split(",")
FRENCH_TYPES, FRENCH_LINKS = "rue avenue boulevard chemin impasse place allée quai cours route".split(), "du ,de la ,des ,de l',de ,".split(",")
FRENCH_WORDS, FRENCH_FIRST = "Lilas République Nord Moulins Tour Château Parc Chênes Fontaine Marché Roses Marine Voltaire Saint-Louis Gare Forêt".split(), "Grand Petit Haut Bas Nouveau Quatre Belle Jeune".split()
SPANISH = "Calle de la Luna,Calle del Monte Alto,Avenida de los Pinos,Paseo del Mar,Plaza Nueva,Calle Siete Palacios,Camino del Molino,Calle Sol,Plaza de la Iglesia Vieja,Avenida del Parque Norte,Ronda de Poniente".split(",")
ID_LABELS = ["passport", "passport no.", "passport number", "ID card", "identity card no.", "national id", "national insurance number", "tax id", "tax number", "social insurance number", "driving licence", "DNI", "NIE", "NIF", "número de DNI", "pasaporte",
             "Ausweis", "Ausweisnummer", "Personalausweis", "Reisepass", "Steuer-ID", "Steuernummer", "passeport", "numéro de sécurité sociale", "carte d'identité", "NINO"]


class Maker:
    def __init__(self, lexicon, seed: int):
        self.r = random.Random(seed)
        self.pairs = lexicon.pairs or [("Alex", "Muster")]
        families = [f for _, f in self.pairs]
        self.stems = sorted({f[: max(4, len(f) // 2)] for f in families})
        self.endings = sorted({f[len(f) // 2 :] for f in families})
        self.givens = sorted({g for g, _ in self.pairs})

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def family(self) -> str:
        r = self.r
        one = lambda: r.choice(self.pairs)[1] if r.random() < 0.5 else r.choice(self.stems) + r.choice(self.endings)
        return one() + ("-" + one() if r.random() < 0.12 else "")

    def given(self) -> str:
        r = self.r
        return r.choice(self.givens) if r.random() < 0.9 else r.choice(["Anselm", "Beata", "Cyril", "Délia", "Enzo", "Freya", "Gülay", "Ximena"])

    def name(self) -> str:
        r = self.r
        g, f = self.given(), self.family()
        kind = r.random()
        text = (f"{g} {f}" if kind < 0.6 else f"{f}, {g}" if kind < 0.7 else f"{g[0]}. {f}" if kind < 0.8 else f"{g} {r.choice('ABCDEFGHJKLMNOPRSTVW')}. {f}" if kind < 0.88
                else f"{g} {f}".upper() if kind < 0.94 else f"{g} {f}".lower())
        if r.random() < 0.08:
            text = text.replace(" ", r.choice(["\n    ", "\n", "\n  "]), 1)
        return unicodedata.normalize("NFD", text) if r.random() < 0.05 else text

    def login(self) -> str:
        return self.r.choice([f"{self.given()[0].lower()}{self.family().lower()}", self.family().lower(), f"{self.given().lower()}{self.digits(2)}"])

    def domain(self) -> str:
        return self.r.choice(DOMAINS)

    def local(self) -> str:
        g, f = self.given().lower(), self.family().lower()
        return self.r.choice([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}-{f}", f"{g}{self.digits(2)}", f"{g}.{f}+git", f"{f}{self.digits(1)}"])

    def email(self) -> str:
        return f"{self.local()}@{self.domain()}"

    def robotmail(self) -> str:
        r = self.r
        return r.choice([f"noreply@{self.domain()}", f"no-reply@{self.domain()}", f"{self.digits(6)}+{self.login()}@users.noreply.{self.domain()}", f"{self.login()}@users.noreply.{self.domain()}",
                         f"{self.noun()}-bot@{self.domain()}", f"{self.noun()}-robot@ci.{self.domain()}", f"do-not-reply@{self.domain()}", f"mailer-daemon@{self.domain()}", f"notifications@{self.domain()}"])

    def robot(self) -> str:
        return self.r.choice([f"{self.noun()}-bot", f"{self.noun()}[bot]", f"{self.noun()}-robot"])

    def spelled(self) -> str:
        r, d = self.r, self.domain()
        return r.choice([f"{self.local()} at {d.replace('.', ' dot ')}", f"{self.local()} (at) {d}", f"{self.local()}[at]{d.replace('.', '[dot]')}", f"{self.local()} [at] {d}"])

    def phone(self) -> str:
        r, d = self.r, self.digits
        a, e = f"{r.choice('2346789')}{d(2)}", f"{r.choice('23456789')}{d(2)}"
        return r.choice([f"+1{a}{e}{d(4)}", f"+1 ({a}) {e}-{d(4)}", f"+1-{a}-{e}-{d(4)}", f"({a}) {e} {d(4)}", f"({a}) {e}-{d(4)}", f"{a}-{e}-{d(4)}", f"{a}.{e}.{d(4)}", self.bare(),
                         f"+44 7{d(3)} {d(6)}", f"07{d(3)} {d(3)} {d(3)}", f"07{d(3)} {d(6)}", f"0044-7{d(3)}-{d(6)}", f"0044 20 {d(4)} {d(4)}", f"020 7{d(3)} {d(4)}", f"+49 {d(2)} {d(5)} {d(3)}", f"+49 (0){d(2)} {d(6)}",
                         f"0{d(2)}/{d(5)}-{d(3)}", f"0{d(2)} {d(4)} {d(3)}", f"0{d(3)} {d(6)}", f"+33 6 {d(2)} {d(2)} {d(2)} {d(2)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"01.{d(2)}.{d(2)}.{d(2)}.{d(2)}",
                         f"+34 6{d(2)} {d(3)} {d(3)}", f"6{d(2)} {d(3)} {d(3)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"04{d(2)} {d(3)} {d(3)}", f"+{r.randint(30, 99)} {d(3)} {d(3)} {d(4)}"])

    def bare(self) -> str:
        return self.r.choice("2346789") + self.digits(9)

    def ssn(self) -> str:
        mark = self.r.choice("--- ")
        return f"{self.digits(3)}{mark}{self.digits(2)}{mark}{self.digits(4)}"

    def plainssn(self) -> str:
        return self.digits(9)

    def taxid(self) -> str:
        d = self.digits
        return self.r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}/{d(3)}/{d(5)}", d(11)])

    def docno(self) -> str:
        """Two letters of a country's passport, letters round digits, digits with a check letter, or the blocks of a social insurance number."""
        r, d = self.r, self.digits
        c = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") for _ in range(n))
        return r.choice([f"{c(2)}{d(7)}", f"{c(2)}{d(6)}", f"{c(1)}{d(8)}", f"{c(1)}{d(7)}{c(1)}", f"{c(2)}{d(6)}{c(1)}", f"{c(2)} {d(2)} {d(2)} {d(2)} {c(1)}", f"{d(8)}-{c(1)}", f"{d(8)}{c(1)}", f"{d(8)} {c(1)}",
                         f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", self.taxid()])

    def idlabel(self) -> str:
        return self.r.choice(ID_LABELS)

    def address(self) -> str:
        r = self.r
        number = str(r.randint(1, 260))
        kind = r.random()
        if kind < 0.5:
            text = f"{number}{r.choice(['', '', '', 'A', 'b'])} {r.choice(STREET_WORDS)} {r.choice(STREET_ENDS)}"
        elif kind < 0.68:
            text = r.choice(GERMAN) + " " + number + r.choice(["", "", "a", " c", " b"])
        elif kind < 0.85:
            text = number + r.choice([" ", ", ", " bis "]) + self.french()
        else:
            text = r.choice(SPANISH) + r.choice([" ", ", "]) + number
        return text.replace(" ", "\n    ", 1) if r.random() < 0.06 else text

    def french(self) -> str:
        r = self.r
        first = r.choice(FRENCH_FIRST) + " " if r.random() < 0.4 else ""
        return f"{r.choice(FRENCH_TYPES)} {r.choice(FRENCH_LINKS)}{first}{r.choice(FRENCH_WORDS)}"

    def conj(self) -> str:
        return self.r.choice("As When Since While After Before If Because Although Until Once And But So".split())

    def place(self) -> str:
        return self.r.choice(PLACES)

    def street(self) -> str:
        return self.r.choice([f"{self.r.choice(STREET_WORDS)} Street", self.french(), self.r.choice(GERMAN)])

    def noun(self) -> str:
        return self.r.choice(NOUNS)

    def Noun(self) -> str:
        return self.noun().title()

    def camel(self) -> str:
        return self.noun().title() + self.given().title()

    def givenword(self) -> str:
        return self.r.choice(["will", "may", "can", "mark"] + [g.lower() for g in self.givens[:3]])

    def falsename(self) -> str:
        return f"{self.given()} {self.Noun()}"

    def company(self) -> str:
        return f"{self.family()} {self.r.choice(['GmbH', 'Inc', 'Ltd', 'AG', 'SARL', '& Sons', 'Labs'])}"

    def hex(self) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(self.r.choice([8, 10, 40])))

    def uuid(self) -> str:
        return f"{self.digits(8)}-{self.digits(4)}-4{self.digits(3)}-{self.digits(4)}-{self.digits(12)}"

    def epoch(self) -> str:
        return str(self.r.choice([self.r.randint(10**9, 2 * 10**9), self.r.randint(10**9, 10**10 - 1), self.r.randint(10**4, 10**6)]))

    def small(self) -> str:
        return str(self.r.randint(1, 9999))

    def dotted(self) -> str:
        return f"{self.digits(3)}.{self.digits(3)}.{self.digits(4)}"

    def ordno(self) -> str:
        return self.r.choice([f"{self.digits(9)}-{self.digits(2)}", f"{self.digits(4)}-{self.digits(2)}", self.digits(10)])

    def artno(self) -> str:
        return f"{self.digits(3)}-{self.digits(2)}-{self.digits(3)}-{self.digits(4)}-{self.r.choice('0123456789X')}"

    def nine(self) -> str:
        return self.digits(self.r.choice([7, 8, 9, 9, 10]))

    def seven(self) -> str:
        return self.digits(7)

    def ip(self) -> str:
        return ".".join(str(self.r.randint(0, 255)) for _ in range(4))

    def version(self) -> str:
        return f"{self.r.randint(0, 9)}.{self.r.randint(0, 30)}.{self.r.randint(0, 30)}"


TRUE_KIND = {"name": "name", "email": "email", "spelled": "email", "phone": "phone", "bare": "phone", "ssn": "id_number", "plainssn": "id_number", "taxid": "id_number", "docno": "id_number", "address": "address"}


KEYS = {"name": "name owner contact full_name author", "email": "email mail contact e_mail", "phone": "phone tel mobile phone_number", "address": "address street home_address addr", "docno": "passport id_number document",
        "ssn": "ssn SSN", "noun": "type item title", "epoch": "id timestamp count", "small": "port age year", "hex": "hash key token", "version": "version", "login": "user login", "robotmail": "sender from"}
COLUMNS = "name name name email phone phone docno address place noun noun epoch small small hex version login".split()


def table_row(r: random.Random) -> str:
    """A line of a table: columns in any order, with any separator."""
    cells = ["{small}.{small}" if r.random() < 0.1 else f"{{{r.choice(COLUMNS)}}}" for _ in range(r.randint(2, 6))]
    quote, mark = r.choice(["", "", "'", '"']), r.choice([",", ",", ", ", ";", "|", " | ", "\t"])
    line = mark.join(quote + c + quote for c in cells)
    return r.choice(["", "", "+", "-", "+  ", "  "]) + r.choice([line, line, f"({line}),", f"[{line}]"])


def assignment(r: random.Random) -> str:
    """A setting or a field of a record, as programs and their data write it."""
    slot = r.choice(sorted(KEYS))
    key, end = r.choice(KEYS[slot].split()), r.choice(["", "", ", {place}", ","])
    return r.choice(["", "+", "-", "    "]) + r.choice([f'{key} = "{{{slot}}}{end}"', f'"{key}": "{{{slot}}}{end}"', f"{key}: {{{slot}}}{end}", f"{key}={{{slot}}}"])


def examples(lexicon, count: int, seed: int) -> list[tuple[str, set]]:
    """``count`` texts of a few carriers with their true (start, end, kind) segments."""
    make = Maker(lexicon, seed)
    r = make.r
    all_carriers = carriers()
    out = []
    for i in range(count):
        text, gold = r.choice(["", "", f"{make.noun()} the {make.noun()}. "]), set()
        picked = [all_carriers[i % len(all_carriers)], *(r.choice(all_carriers) for _ in range(r.randint(0, 2)))]
        picked += [make_one(r) for make_one in (table_row, assignment) if r.random() < 0.2]
        for carrier in picked:
            parts = carrier.replace("\\n", "\n").replace("«", "\x01").replace("»", "\x02").split("{")
            text += parts[0]
            for p in parts[1:]:
                slot, rest = p.split("}", 1)
                value = getattr(make, slot)()
                if slot in TRUE_KIND:
                    gold.add((len(text), len(text) + len(value), TRUE_KIND[slot]))
                text += value + rest
            text += r.choice(["\n", "\n\n    ", " ", "\n    "])
        out.append((text.replace("\x01", "{").replace("\x02", "}"), gold))
    return out
