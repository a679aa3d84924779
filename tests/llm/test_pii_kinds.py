"""Recall and precision per kind, on sentences of other rules than those that the model learns from."""

import base64
import json
import random

import pytest

from corpusmill.llm import pii

FIRST = "anna maria john peter lucia omar chen fatima igor sofia".split()
LAST = "smith garcia muller rossi novak tanaka okafor jensen dubois silva".split()
HOSTS = "gmail yahoo outlook proton example company university mailbox".split()
WORDS = "sunshine dragon mountain coffee winter guitar planet orange window silver".split()
PROSE = ["We met yesterday and talked about the plan.", "The report is due on Friday.", "Please read this carefully before you go on.", "Nothing else was said about it."]


def lines(r, n=250):
    """kind, sentence and the value in it that is personal (null: none)."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    b64 = lambda x: base64.urlsafe_b64encode(x.encode()).decode().rstrip("=")
    for _ in range(n):
        name = r.choice([f"{r.choice(FIRST)}.{r.choice(LAST)}", r.choice(FIRST) + r.choice(LAST), r.choice(FIRST) + digits(2)])
        host = r.choice(HOSTS)
        yield "email_spelled", "You can find me as {} these days.", f"{name} at {host} dot com"
        yield "email_spelled", "Ask {} for the keys.", r.choice([f"{name} (at) {host} (dot) org", f"{name}[at]{host}.de", f"{name} AT {host} DOT edu"])
        yield "email_spelled", r.choice(["They looked at {}. It was late.", "We stayed there at {}. Then we left.", "He arrived at {}."]), None
        yield "secret", "db:\n  password={}\n  host=local", letters(14)
        yield "secret", "login with password={} and go on", letters(14)
        yield "secret", "user: x\npassword: {}\n", r.choice(WORDS) + r.choice(WORDS)
        yield "secret", "{{'api_key': '{}'}}", digits(3) + letters(20) + "X9"
        yield "secret", "secret = {}", r.choice(WORDS) + digits(4) + r.choice("!$%")
        yield "secret", "header {} end", f"{b64(json.dumps({'alg': 'HS256', 'typ': 'JWT'}))}.{b64(json.dumps({'sub': letters(8), 'n': digits(9)}))}.{b64(letters(32))}"
        yield "secret", r.choice(["Choose a strong password: something that nobody knows.", "The secret: always start with a plan.", "About the token: please return it when you leave."]), None
        body = digits(10)
        account = f"NL{98 - int(f'{int('I', 36)}{int('N', 36)}{int('G', 36)}{int('B', 36)}{body}{int('N', 36)}{int('L', 36)}00') % 97:02d}INGB{body}"
        yield "iban", "Send it to {} please.", account
        yield "iban", "Rückzahlung auf Konto {}", " ".join(account[k : k + 4] for k in range(0, 18, 4))
        yield "iban", f"The device has serial number NL{digits(2)} INGB {digits(4)} {digits(4)} {digits(2)} on its back.", None
        phone = f"{r.choice('23456789')}{digits(2)}{{0}}{r.choice('23456789')}{digits(2)}{{0}}{digits(4)}"
        yield "phone_local", "My mobile: {}", phone.format(r.choice("-. "))
        yield "phone_local", "call {} after six", phone.format("-")
        yield "phone_local", f"your invoice 0{digits(2)}-{digits(3)}-{digits(4)} is open", None
        yield "ssn", "his social security number is {}", f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        yield "ssn", f"ticket 9{digits(2)}-{digits(2)}-{digits(4)} was closed", None


@pytest.fixture(scope="module")
def measured():
    r = random.Random(17)
    rows = []
    for kind, sentence, value in lines(r):
        shown = sentence if value is None and "{}" not in sentence else sentence.format(value or f"{r.choice(WORDS)}")
        lead, tail = r.choice(PROSE), r.choice(PROSE)
        rows.append((kind, f"{lead}\n{shown}\n{tail}", value))
    found = pii.find([x[1] for x in rows], pii.fit_model())
    score = {k: [0, 0, 0] for k in pii.MORE}  # found, missed, wrong
    for (kind, text, value), (_, every) in zip(rows, found, strict=True):
        got = [text[a:b] for a, b, k in every if k == kind]
        if value is None:
            score[kind][2] += bool(got)
        else:
            score[kind][0 if any(value in g or g in value and 2 * len(g) > len(value) for g in got) else 1] += 1
    return {k: (a / (a + b), a / max(1, a + c)) for k, (a, b, c) in score.items()}


@pytest.mark.parametrize("kind", pii.MORE)
def test_recall_and_precision_on_other_sentences(measured, kind):
    recall, precision = measured[kind]
    print(kind, recall, precision)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)
