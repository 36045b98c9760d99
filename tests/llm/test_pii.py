import math
import random
import re
from collections import Counter

import pytest

from loomtime.llm import pii, pii_training

NAMES = [f"{g} {f}" for g in ("Ada", "Béla", "Carl", "Dora", "Emma", "Fritz", "Grace", "Hana", "Iván", "José") for f in ("Brontini", "Brontova", "Kestrini", "Kestrova", "Malverak", "Malverini", "Tolmini", "Tolmak")]


@pytest.fixture(scope="module")
def model():
    return pii.train(NAMES, 2500)


def test_held_out(model):
    lexicon, field = model
    total, missed, wrong = Counter(), Counter(), Counter()
    for text, gold in pii_training.examples(lexicon, 700, 12345):
        got = set(field.decode(text, lexicon))
        total.update(k for _, _, k in gold)
        missed.update(k for _, _, k in gold - got)
        wrong.update(k for _, _, k in got - gold)
    for k in pii.KINDS:
        assert missed[k] <= 0.06 * total[k] and wrong[k] <= 0.06 * total[k], (k, total, missed, wrong)


def test_decoding_is_the_best_segmentation(model):
    lexicon, field = model
    text = "Reviewed-by: Ada Brontini <ada.brontini@example.org>\nCall +44 7700 900123 or 020 7946 0333, 12 Maple Street"
    found = pii.candidates(text, lexicon)
    scores = [field.score(pii.features(text, c)) for c in found]
    assert len(found) < 16

    def worth(pick):
        v = sum(scores[i] for i in pick)
        for i, j in zip(pick, pick[1:]):
            if found[j][0] - found[i][1] <= pii.NEAR:
                v += field.weights.get(f"{found[i][2]}>{found[j][2]}", 0.0)
        return v

    best = (0.0, ())
    for mask in range(1 << len(found)):
        pick = sorted((i for i in range(len(found)) if mask >> i & 1), key=lambda i: found[i][0])
        if all(found[i][1] <= found[j][0] for i, j in zip(pick, pick[1:])):
            best = max(best, (worth(pick), tuple(found[i][:3] for i in pick)))
    assert field.decode(text, lexicon) == list(best[1])
    link = field._links(found)
    single, _ = field._marginals(found, scores, link)
    z, each = 0.0, [0.0] * len(found)
    for mask in range(1 << len(found)):
        pick = [i for i in range(len(found)) if mask >> i & 1]
        if all(found[i][1] <= found[j][0] for i, j in zip(pick, pick[1:])):
            p = math.exp(worth(pick) - best[0])
            z += p
            for i in pick:
                each[i] += p
    assert single == pytest.approx([e / z for e in each], abs=1e-6)


def test_known_texts(model):
    lexicon, field = model
    text = ("Author: Ada Brontini <ada@labs.example>\nAuthor: x <9+x@users.noreply.labs.example>\nClone https://ci:99887766@code.example/a.git, git@code.example:a/b.git, pin kit@1.2.3.\n"
            "Bitte Tolmak, Carl fragen, Tel. +49 30 23125 418, Büro Lindenstraße 12 b.\nMy passport is XK0036941 and I live at 9, rue du Moulin.\nIt needed 266.973.6562 units. All texts of Kestrova GmbH were lost.\n"
            "Write dora.kestrini (at) labs.example today. Run id: 2457022493.")
    got = {(k, text[a:b]) for a, b, k in field.decode(text, lexicon)}
    assert got == {("name", "Ada Brontini"), ("email", "ada@labs.example"), ("name", "Tolmak, Carl"), ("phone", "+49 30 23125 418"), ("address", "Lindenstraße 12 b"), ("id_number", "XK0036941"),
                   ("address", "9, rue du Moulin"), ("email", "dora.kestrini (at) labs.example")}


def test_frames_and_edges(spark):
    people = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)] + [(None, 0), ("Ada Brontini", 0)], "full_name string, start int")
    long = "word 12 " * 20_000 + "Reviewed-by: Ada Brontini <ada@labs.example>"
    docs = spark.createDataFrame([(1, "Call +44 7700 900123 now", 1), (2, None, 1), (3, "", 1), (4, "  \n", 1), (5, long, 1), (1, "Call +44 7700 900123 now", 1)], "doc_id bigint, text string, kind int")
    out = pii.find_personal(docs, people).toPandas()
    assert sorted(out[out.doc_id == 5].value) == ["Ada Brontini", "ada@labs.example"] and (out.doc_id == 1).sum() == 2 and set(out.doc_id) == {1, 5}
    assert out[out.doc_id == 5].apply(lambda r: long[r.start : r.end] == r.value, axis=1).all()
    red = {r["doc_id"]: r for r in pii.redact(docs, people).collect()}
    assert red[1]["text"] == "Call [PHONE] now" and red[2]["text"] is None and red[3]["text"] == "" and red[4]["found"] == 0
    assert red[5]["text"] == "word 12 " * 20_000 + "Reviewed-by: [NAME] <[EMAIL]>"
    assert pii.find_personal(docs.limit(0), people).count() == 0
    with pytest.raises(ValueError):
        pii.find_personal(docs, people, max_people=3)


# Sentences of another source than the generator: written by hand as letters, forms and minutes; [kind|segment] marks what is to be found
LETTERS = """
Good morning, could [name|Ada Brontini] ring me back on [phone|(312) 555-0148] about the leaking tap?
The lease was countersigned by [name|Béla Kestrova], [address|48 Orchard Grove], on behalf of both parties.
Please forward the minutes to [email|carl.malverak@parish.example] before Thursday.
Applicant: [name|Malverini, Dora]; passport [id_number|KD4410925]; daytime phone [phone|+44 7911 320045].
Sehr geehrte Frau [name|Emma Tolmini], Ihre Steuernummer [id_number|48 201 993 570] fehlt im Formular.
Der Schlüssel liegt bei [name|Fritz Kestrini], [address|Kastanienweg 7], erreichbar unter [phone|089 4415 203].
Le colis est parti chez [name|Grace Brontova], [address|18 rue des Acacias], qui a signé à midi.
El contrato de [name|Iván Malverak] lleva el DNI [id_number|50331877K] y el domicilio [address|Calle del Olivo 22].
For refunds write to [email|j.tolmak@shop.example] or call [phone|0113 496 0221].
The witness, [name|José Tolmak], lives at [address|9 Chapel Lane] and can be reached by e-mail ([email|jose_tolmak@mail.example]).
Minutes taken by [name|H. Kestrini], seconded by [name|Ada Malverak].
Her national insurance number is [id_number|AB 12 34 56 C], her bank was not told.
Social security number: [id_number|511-08-7742]. Employer: Malverak Ltd.
Visitors report to [name|Carl Brontova] at reception, [address|210 Harbour Road], second floor.
Kontakt: [name|Dora Kestrova], [email|dora (at) werk.example], Mobil [phone|0172 883 4410].
Reservation in the name of [name|Emma Brontini], two nights, confirmation 88213.
Mme [name|Grace Malverini] habite [address|3 bis avenue du Parc]; son numéro est le [phone|06 14 20 33 97].
[name|FRITZ TOLMAK] signed the register; copies went to [email|archive.keeper@county.example].
The invoice 2019-44817 of Brontini GmbH was paid on 3 May 2019.
Platform 9 on Station Road is closed, take bus 114 to Market Square.
Version 4.12.0 replaces 4.11.9; checksum 6f2d99ab10 matches.
Room 1402 holds 120 people; parcel 004417 weighs 300 grams.
Do not answer, this message was sent by noreply@parish.example.
Grace periods end at noon, and Ada programs are archived.
The hotline [phone|+33 1 44 20 55 10] answers from nine.
Meet me at [address|77 Willow Court], bring [name|Hana Tolmini] along.
Entregar a [name|Iván Kestrova], [address|Avenida de la Estación 31], antes del lunes.
My tax id [id_number|33 418 205 667] was misspelt on the letter to [name|Béla Tolmak].
Send the crate to [address|6 Foundry Street], Oakham, and text [phone|07700 900 512].
Unser Büro zieht um: [address|Am Kanal 15], Telefon [phone|+49 40 55213 880].
""".strip().split("\n")


def test_sentences_of_another_source(model):
    lexicon, field = model
    total, hit, found = Counter(), Counter(), Counter()
    for line in LETTERS:
        text, gold, at = "", set(), 0
        for m in re.finditer(r"\[(\w+)\|([^]]*)\]", line):
            text += line[at : m.start()]
            gold.add((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        text += line[at:]
        got = set(field.decode(text, lexicon))
        total.update(k for _, _, k in gold)
        found.update(k for _, _, k in got)
        hit.update(k for _, _, k in got & gold)
        for x in got ^ gold:
            print("missed" if x in gold else "extra", x[2], repr(text[x[0] : x[1]]), "in", text)
    print(total, hit, found)
    assert all(hit[k] >= 0.75 * total[k] and hit[k] >= 0.75 * found[k] for k in pii.KINDS), (total, hit, found)


def test_decoding_with_random_weights(model):
    """Best score over all segmentations, whatever the signs of scores and transitions."""
    lexicon, _ = model
    r = random.Random(11)
    texts = ["Call +44 7700 900123 or 020 7946 0333 now", "Ada Brontini <ada@labs.example>, 12 Maple Street, 555-0123 4567\n    0171 555 0199", "x 0113 496 0221" + " far" * 30 + " 0113 496 0222, Béla Kestrova 12 Elm Road"]
    for text in texts * 40:
        found = pii.candidates(text, lexicon)
        assert len(found) < 15
        field = pii.Field()
        field.weights = {f: r.gauss(0, 1) for c in found for f in pii.features(text, c)} | {f"{a}>{b}": r.gauss(0, 4) for a in pii.KINDS for b in pii.KINDS}
        scores = [field.score(pii.features(text, c)) for c in found]
        best = 0.0

        def worth(pick):
            near = [(i, j) for i, j in zip(pick, pick[1:]) if found[j][0] - found[i][1] <= pii.NEAR]
            return sum(scores[i] for i in pick) + sum(field.weights[f"{found[i][2]}>{found[j][2]}"] for i, j in near)

        def grow(pick):
            nonlocal best
            best = max(best, worth(pick))
            for j in range(len(found)):
                if not pick or found[j][0] >= found[pick[-1]][1] and j > pick[-1]:
                    grow([*pick, j])

        grow([])
        of = {c[:3]: i for i, c in enumerate(found)}
        assert worth([of[x] for x in field.decode(text, lexicon)]) == pytest.approx(best)


def test_numbers_end_where_the_field_says(model):
    lexicon, field = model
    for text, number in (("Tel. 030 55213 880 3pm", "030 55213 880"), ("phone: 0113 496 0221\n    20190503", "0113 496 0221"), ("Call (020 7946 0333)", "020 7946 0333")):
        assert ("phone", number) in {(k, text[a:b]) for a, b, k in field.decode(text, lexicon)}, text
