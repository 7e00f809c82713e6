"""The small labelled table that the field of `pii` is trained from.

Lines with slots are filled from short lists by a rule with a fixed seed; invented words, headings, capitals, repeats, tables and
numbers are the lines without personal data. Every row is a text and its spans (start, end, kind) in code points.
"""

from __future__ import annotations

import random

#: What slots are filled with.
GIVEN = "Maria Peter Anna Juan Elena Thomas Sophie Karl Laura Pierre Ingrid Miguel Claire Hans Lucia James Emma Olivia David Sarah Amir Yuki Fatima Chen Priya Oleg Zoë José Jürgen Noémie".split()
FAMILY = "Lopez Schmidt Martin Garcia Müller Dubois Smith Fernandez Weber Bernard Jones Romero Fischer Moreau Taylor Novak Haddad Tanaka Singh Ivanov O'Neill Peña Lefèvre Krüger Okafor Brown Walker Nguyen Rossi Larsen".split()
STREET = "Baker Station Oak Mill Church Park High King Victoria Elm Bridge Garden".split()
STRASSE = "Hauptstraße Bahnhofstraße Gartenweg Lindenallee Schulstraße Kirchgasse Ringstraße Bergweg".split()
RUE = "Lilas Victor Hugo Gare Moulin Pasteur République Écoles Jardins".split()
TOWN = "Springfield London Berlin Lyon Sevilla Köln Nantes Boston Madrid Dresden Leeds Toulouse Valencia Bristol Hamburg".split()
MONTH = "January February March April May June July August September October November December Januar März Juli Dezember janvier février juillet août enero abril octubre".split()

#: Lines with personal data; n name, a address, b birth date, i account or identity number, c phone or spelled mail.
LINES = """My name is {n} and I live at {a}.
Name: {n}
Name: {n}, born {b}
full name = {n}; date of birth = {b}
Contact {n} for details.
Please call {n} at {c} after six.
Mr {n} signed the letter on behalf of the board.
Mrs {n} was told to wait.
Dr. {n} saw the patient at noon.
Dear Mr {n}, thank you for your letter.
Dear {n}, we have received your order.
Kind regards, {n}
Best wishes,\n{n}\n{a}
Signed: {n}
Written by {n} in the autumn.
The witness, Ms {n}, was born on {b}.
Patient: {n} DOB: {b}
DOB {b}
date of birth: {b}
She was born on {b} in a small town.
He was born on {b}.
Ship to: {n}, {a}
Address: {a}
Home address: {a}
He moved to {a} last year.
The parcel was sent to {a}.
Passport no. {i}
passport number: {i}
SSN: {i}
His social security number is {i}.
IBAN {i}
IBAN: {i}
Account number {i} was closed.
Please pay to account {i} by Friday.
Driver licence {i} expires soon.
Tel. {c}
phone: {c}
Call me at {c}.
Reach her by mail at {c}
Mobile {c} or by post to {a}
Employee: {n}, phone {c}
Customer {n} lives at {a}
Author: {n}
From: {n}\nTo: {n}
Mein Name ist {n} und ich wohne in der {a}.
Herr {n} wurde am {b} geboren.
Frau {n} hat angerufen.
geboren am {b}
Geburtsdatum: {b}
Anschrift: {a}
Adresse: {a}
Telefon {c}
Konto: {i}
Sehr geehrte Frau {n}, vielen Dank.
Mit freundlichen Grüßen {n}
Je m'appelle {n} et j'habite {a}.
Monsieur {n} est absent.
Madame {n} habite au {a}.
Nom : {n}
né le {b}
Date de naissance : {b}
Téléphone : {c}
Adresse : {a}
Cordialement, {n}
Me llamo {n} y vivo en {a}.
Señor {n}, gracias por su carta.
La señora {n} nació el {b}.
Nombre: {n}
Dirección: {a}
Teléfono: {c}
Fecha de nacimiento: {b}
Un saludo, {n}""".split("\n")

#: Lines without personal data.
PLAIN = """Licensed under the Apache License, Version 2.0.
This work is licensed under the GNU General Public License, version 3.
Released under the MIT License.
Copyright 2019 The Project Authors. All rights reserved.
The meeting is on 12 March 2021 in Room 14.
Chapter 3: The River and the Mill
The United States and the European Union signed the treaty in May.
New York Times Best Seller List of 2004
See Figure 12 and Table 4 for details.
Version 10.2.1 was released on 2020-05-04.
In January the price rose by 12 percent to 340 euros.
Monday, Tuesday and Friday are open days.
The Old Bridge Hotel has 120 rooms.
It is 14:30 and the train to London leaves from platform 9.
He read The Lord of the Rings twice.
Error 404: page not found
Total: 1,204 items, 33 missing
call the function with the name of the table
the account was closed and the address of the page has changed
Her name was never known, and nobody was told.
The phone rang again.
born in the mountains, the river is long
Die Deutsche Bahn fährt am Montag nach Berlin.
Der Name des Flusses ist nicht bekannt.
Das Haus am Fluss wurde 1904 gebaut.
La Tour Eiffel est ouverte en août.
Le nom de la ville est inconnu.
El nombre del río no se conoce.
La Guerra Civil terminó en abril de 1939.
Order 66120 has been shipped.
ISBN 978-3-16-148410-0
Part number 4711-22 is out of stock.
Add 200 g of flour and 3 eggs.
SELECT name, address FROM customers WHERE id = 12
name,address,phone
The House of Commons voted on Tuesday.""".split("\n")

#: Rows made of each line with slots, and rows of invented text.
COPIES = 8
INVENTED = 700

KINDS = ("name", "address", "birth", "account", "contact")
_SLOT = dict(zip("nabic", KINDS, strict=True))


def _digits(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice("0123456789") for _ in range(n))


def _value(rnd: random.Random, slot: str, given: list[str], family: list[str]) -> str:
    if slot == "n":
        g, f = rnd.choice(given), rnd.choice(family)
        return rnd.choice([f"{g} {f}", f"{g} {f}", f"{g} {f}", f"{g} {rnd.choice(given)} {f}", f"{g[0]}. {f}"])
    if slot == "a":
        n, town = rnd.randint(1, 240), rnd.choice(TOWN)
        return rnd.choice([f"{n} {rnd.choice(STREET)} {rnd.choice(['Street', 'Road', 'Avenue', 'Lane'])}, {town}", f"{n} {rnd.choice(STREET)} {rnd.choice(['Street', 'Road'])}", f"{rnd.choice(STRASSE)} {n}, {_digits(rnd, 5)} {town}", f"{n} rue {rnd.choice(['de la', 'des', 'du'])} {rnd.choice(RUE)}, {_digits(rnd, 5)} {town}", f"Calle {rnd.choice(RUE)} {n}, {town}"])
    if slot == "b":
        d, y = rnd.randint(1, 28), rnd.randint(1930, 2012)
        return rnd.choice([f"{d} {rnd.choice(MONTH)} {y}", f"{rnd.choice(MONTH)} {d}, {y}", f"{y}-{rnd.randint(1, 12):02d}-{d:02d}", f"{d:02d}/{rnd.randint(1, 12):02d}/{y}", f"{d:02d}.{rnd.randint(1, 12):02d}.{y}"])
    if slot == "i":
        return rnd.choice([f"{rnd.choice(['DE', 'FR', 'ES'])}{_digits(rnd, 2)} {_digits(rnd, 4)} {_digits(rnd, 4)} {_digits(rnd, 4)}", f"{rnd.choice('ABCKX')}{_digits(rnd, 8)}", f"{_digits(rnd, 3)}-{_digits(rnd, 2)}-{_digits(rnd, 4)}", _digits(rnd, 10)])
    g, f = rnd.choice(given).lower(), rnd.choice(family).lower()
    return rnd.choice([f"0{_digits(rnd, 3)} {_digits(rnd, 6)}", f"0{_digits(rnd, 2)} {_digits(rnd, 7)}", f"({_digits(rnd, 3)}) {_digits(rnd, 3)}-{_digits(rnd, 4)}", f"0{_digits(rnd, 2)}-{_digits(rnd, 7)}", f"{g} at example dot com", f"{g} dot {f} at mail dot org"])


def filled(line: str, rnd: random.Random, given: list[str] = GIVEN, family: list[str] = FAMILY) -> tuple[str, list[tuple[int, int, str]]]:
    """A line with its slots filled, and where they are."""
    text, spans, i = "", [], 0
    while i < len(line):
        if line[i] == "{":
            value = _value(rnd, line[i + 1], given, family)
            spans.append((len(text), len(text) + len(value), _SLOT[line[i + 1]]))
            text, i = text + value, i + 3
        else:
            text, i = text + line[i], i + 1
    return text, spans


def invented(rnd: random.Random) -> str:
    """Text of made-up words: sentences, headings, capitals, repeats, tables, numbers."""
    parts = "th er on an re in at ou st en ti es or nd ha le de la qu eau é í ñ sch ein ung ment ción ra po mi".split()
    word = lambda: rnd.choice("a y o é à e".split()) if rnd.random() < 0.1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))
    some = [word() for _ in range(rnd.randint(4, 24))]

    def sentences(words: list[str]) -> str:
        out = ""
        for w in words:
            out += (w.title() if not out or out.endswith((". ", "\n")) else w) + rnd.choice([" ", " ", " ", " ", ", ", ". ", ".\n"])
        return out

    kind = rnd.randint(0, 9)
    if kind == 0:
        return " ".join(w.title() for w in some)
    if kind == 1:
        return " ".join(w.upper() for w in some)
    if kind == 2:
        return rnd.choice(["", sentences(some[2:]), "".join(f"{some[1]}. " for _ in range(8))]) + rnd.choice([" ", " ", ", ", ". "]).join([rnd.choice([some[0].title(), some[0].title(), some[0], *"du Du la von Be De Der En".split()])] * rnd.randint(4, 60)) + rnd.choice(["", f" {some[1]}" * 8])
    if kind == 3:
        return " | ".join(rnd.choice([w, w.title(), _digits(rnd, rnd.randint(1, 6))]) for w in some)
    if kind == 4:
        return " ".join(rnd.choice([w, w, _digits(rnd, rnd.randint(1, 9)), f"{_digits(rnd, 2)}.{_digits(rnd, 2)}"]) for w in some)
    if kind == 5:
        return "".join(w + rnd.choice(["### ", "&&& ", "%%% ", "!! ", "$$$ ", "*** "]) for w in sentences(some).split())
    return sentences(some)


def labelled(seed: int = 3) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """All rows of the table; lines with slots stand alone or amid invented text."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(COPIES):
        for line in LINES:
            text, spans = filled(line, rnd)
            before = invented(rnd)[:160] + rnd.choice([". ", "\n", " "]) if rnd.random() < 0.5 else ""
            after = rnd.choice([" ", "\n"]) + invented(rnd)[:160] if rnd.random() < 0.5 else ""
            rows.append((before + text + after, [(s + len(before), e + len(before), k) for s, e, k in spans]))
        rows += [(line, []) for line in PLAIN]
    return rows + [(invented(rnd), []) for _ in range(INVENTED)]
