"""The small labelled table that the field of `secrets` learns from besides the tags of the base patterns.

Base patterns can't tell what they don't see, so these lines hold secrets that none of them matches: other keywords, other marks, short
or odd values, tokens of known services. Lines without a secret talk about secrets, or hold what only looks like one. A row is a
text and its spans (start, end) in code points; values are drawn by a rule with a fixed seed.
"""

from __future__ import annotations

import random

#: Lines with a secret; s is any value, t a short one, n a token of a service, w a word.
LINES = """pwd: {s}
pwd={s}
pwd = "{s}"
PWD={s}
Authorization: Bearer {n}
Authorization: Basic {s}
authorization = {n}
client_secret -> "{s}"
client secret is {s}
token = {t}
token: {t}
the token is {s}
secret: '{t}'
password = {t}
my password is {s}
password is {s}
pass: {s}
pass={s}
passphrase: {s}
passphrase "{s}"
login {w} with {s}
user {w} pass {s}
username: {w}, password - {s}
credentials {w}:{s}
access key {s}
access_key => {s}
auth: {s}
auth={n}
key = {n}
private key {s}
export GH={n}
set KEY={s}
use {n} for now
curl -H "X-Auth: {n}"
{n}
the key {n} is live
--auth {s}
mysql -u {w} -p {s}
postgres://{w}:{s}@host
bearer {n}
Passwort: {s}
Kennwort = {s}
mot de passe : {s}
contraseña: {s}""".split("\n")

#: Lines without a secret.
PLAIN = """the token was lost and the secret came out
forgot your password ? reset it on this page
password reset page for all users
the secret garden is open on Monday
a token of love
this token has 12 letters
self.token = token
token = next(tokens)
password: the word that you chose
secret: see below
the key is under the mat
pass: yes
auth: none
key = value
version = 10.2.1
id: 4711
order number 66120 has been shipped
commit by Peter on 2024-05-17
uuid 6fa459ea-ee8a-3ca4-894e-db77e160355e
card 4785380592391139 was charged
call 555-1234 or 0301234567
see https://example.com/path/page2.html for more
file report_2021_final.pdf
/usr/local/lib/python3.12/site-packages
ISBN 978-3-16-148410-0
the bearer of this letter
Authorization: required
login required
access is free
user guide, chapter 3""".split("\n")

#: Rows made of each line, and rows of invented text.
COPIES = 14
INVENTED = 300

_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _any(rnd: random.Random, n: int, letters: str = _LETTERS) -> str:
    return "".join(rnd.choice(letters) for _ in range(n))


def _word(rnd: random.Random) -> str:
    return "".join(rnd.choice("th er on an re in at ou st en ti es or nd ha le de la qu sch ein ung ment po mi".split()) for _ in range(rnd.randint(2, 4)))


def value(rnd: random.Random, slot: str) -> str:
    """A value for a slot."""
    if slot == "w":
        return _word(rnd)
    if slot == "t":
        return rnd.choice([_word(rnd)[:3] + _any(rnd, 2, "0123456789"), _any(rnd, 3) + _any(rnd, 2, "0123456789")])
    if slot == "n":
        return rnd.choice([
            "ghp_" + _any(rnd, 36), "glpat-" + _any(rnd, 20), "sk_live_" + _any(rnd, 24), "sk-" + _any(rnd, 40), "xoxb-" + _any(rnd, 11, "0123456789") + "-" + _any(rnd, 24),
            "eyJ" + _any(rnd, 30), "npm_" + _any(rnd, 36), "AIza" + _any(rnd, 35), _any(rnd, rnd.randint(28, 44)), _any(rnd, rnd.choice([16, 20, 22]), "0123456789abcdef") + "f0",
        ])
    return rnd.choice([_word(rnd) + _any(rnd, rnd.randint(1, 4), "0123456789") + rnd.choice(["", _word(rnd)]), _any(rnd, rnd.randint(8, 24)), _word(rnd).title() + rnd.choice("@!$-_.") + _any(rnd, rnd.randint(2, 4), "0123456789"), _any(rnd, rnd.randint(10, 20), "0123456789abcdef") + "a1"])


def filled(line: str, rnd: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A line with its slots filled, and where its secrets are."""
    text, spans, i = "", [], 0
    while i < len(line):
        if line[i] == "{":
            v = value(rnd, line[i + 1])
            if line[i + 1] != "w":
                spans.append((len(text), len(text) + len(v)))
            text, i = text + v, i + 3
        else:
            text, i = text + line[i], i + 1
    return text, spans


def invented(rnd: random.Random) -> str:
    """Text of made-up words, now and then with numbers or capitals."""
    out = []
    for _ in range(rnd.randint(3, 25)):
        w = _word(rnd)
        out.append(rnd.choice([w] * 12 + [w.title(), w.upper(), w + ",", w + ".", _any(rnd, rnd.randint(1, 16), "0123456789"), f"{w}!!", f"| {w}", f"{rnd.randint(1, 255)}.{rnd.randint(0, 255)}.{rnd.randint(0, 255)}.7", f"{w}.{rnd.randint(1, 99)}@mail.example.com"]))
    return " ".join(out)


def labelled(seed: int = 2, lines: list[str] = LINES) -> list[tuple[str, list[tuple[int, int]]]]:
    """All rows of the table; lines stand alone or amid invented text."""
    rnd = random.Random(seed)
    rows = []
    for _ in range(COPIES):
        for line in [*lines, *PLAIN]:
            text, spans = filled(line, rnd)
            before = invented(rnd) + rnd.choice([" ", "\n"]) if rnd.random() < 0.6 else ""
            after = rnd.choice([" ", "\n"]) + invented(rnd) if rnd.random() < 0.6 else ""
            rows.append((before + text + after, [(s + len(before), e + len(before)) for s, e in spans]))
    return rows + [(invented(rnd), []) for _ in range(INVENTED)]
