"""Personal data by candidate gradient boosting.

Base patterns (e-mail, IPv4, card and phone numbers) give spans that always stand.
High-recall generators propose further, overlapping spans of more kinds; boosted
trees score them by format and context, and those above the threshold of their kind
(the least with the wanted precision on examples held out) stand, best first, where
they overlap none that stands. The trees are fitted on the driver to examples made
from a fixed seed, so the same model comes out everywhere.

Defined results: a null text is empty and holds nothing; offsets are code points;
repeated rows are searched each; an empty table gives an empty result. Whole texts are
searched, in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("email_spelled", "iban", "phone_local", "secret", "ssn")
KINDS = BASE + MORE
#: Precision that a kind's threshold must reach on the examples held out.
PRECISION = 0.99

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")

#: A spelled e-mail is tried at the start of a run of its characters, or where the last one ended.
_START = r"(?<![A-Za-z0-9._%+-])"
_SPELLED = r"[A-Za-z0-9._%+-]++ ?(?i:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?i:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)++"
_spelled = re.compile(_SPELLED)

#: Generators: kind, characters one of which a text must hold, pattern.
_GENERATORS = (
    ("email_spelled", tuple(x for at in ("at", "AT", "At", "aT") for x in (f"({at})", f"[{at}]", f" {at} ")), re.compile(_START + _SPELLED)),
    ("iban", ("digit",), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("phone_local", ("digit",), re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")),
    ("secret", ("=", ":"), re.compile(r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*+[=:]\s*+[\"']?([^\s\"',;]{6,}+)")),
    ("secret", ("AKIA", "ASIA"), re.compile(r"(?<![A-Z0-9])A[KS]IA[0-9A-Z]{16}(?![0-9A-Z])")),
    ("secret", ("eyJ",), re.compile(r"(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+")),
    ("ssn", ("digit",), re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![0-9A-Za-z]|-[0-9])")),
)
_CONTEXT = (
    re.compile(r"(?i)\b(?:e-?)?mail|\b(?:contact|write|reach|kontakt|correo|courriel)"),
    re.compile(r"(?i)\b(?:tele)?phone|\b(?:tel|call|fax|mobile|cell|tél|mobil)"),
    re.compile(r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)"),
    re.compile(r"(?i)\b(?:ssn|social|security|tax id)"),
    re.compile(r"(?i)key|token|secret|pass|auth|login|credential"),
    re.compile(r"(?i)\b(?:order|invoice|version|isbn|part|serial|ticket|room|page|model|ref|no\.|required|meet|look|arrive)"),
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost non-overlapping per kind."""
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            last = m.end()
        last = max(last, at + 1)
        at = text.find("@", last)
    if not _digit.search(text):
        return found
    for m in _ip.finditer(text):
        if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _card.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _phone.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return found


def _matches(pattern: re.Pattern, text: str, again: re.Pattern | None) -> Iterator[re.Match]:
    """Matches from left to right; ``again`` is tried right where one ended."""
    if again is None:
        yield from pattern.finditer(text)
        return
    m = pattern.search(text)
    while m:
        yield m
        m = again.match(text, m.end()) or pattern.search(text, m.end())


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the generators propose; they may overlap."""
    digit, out = _digit.search(text) is not None, []
    for kind, needs, pattern in _GENERATORS:
        if any(digit if need == "digit" else need in text for need in needs):
            again = _spelled if kind == "email_spelled" else None
            out += [(*m.span(m.lastindex or 0), kind) for m in _matches(pattern, text, again)]
    return out


_spelled_dot = re.compile(r"(?i)\(dot\)|\[dot\]| dot ")
#: Endings of domains that most addresses have.
_ENDINGS = frozenset("com org net edu gov info io co uk de fr es it eu".split())
_goes_on = re.compile(r"[^\W\d_]*[.,]? [^\W\d_]+(?:[ ,.]|$)")
_spoken_of = re.compile(r"(?i)\b(?:the|your|a|an|my|our|his|her|their|this|that|any|each|every|no)\s+(?:\w+\s+)?[\w-]+[\"']?\s*[=:]\s*[\"']?$")


def _iban_holds(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span = text[start:end]
    bare = re.sub(r"[ ().-]", "", span)
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    holds = 0.0
    if kind == "iban":
        holds = float(_iban_holds(bare))
    elif kind == "ssn":
        holds = float(bare[:3] not in ("000", "666") and bare[0] != "9" and bare[3:5] != "00" and bare[5:] != "0000")
    elif kind == "phone_local":
        holds = float(bare[0] in "23456789" and bare[3] in "23456789")
    elif kind == "email_spelled":
        holds = float(span.count("(") + span.count("[") >= 1)
    elif kind == "secret":
        holds = float(any(c.isdigit() for c in span) and any(c.isalpha() for c in span))
    n = len(span)
    return [
        float(MORE.index(kind)),
        float(n),
        sum(map(str.isdigit, span)) / n,
        sum(map(str.isupper, span)) / n,
        len(set(span)) / n,
        sum(not c.isalnum() for c in span) / n,
        holds,
        float(len(max(re.findall(r"[A-Za-z]+", span), key=len, default=""))),
        *[float(bool(p.search(before) or (k == 5 and p.search(after)))) for k, p in enumerate(_CONTEXT)],
        # How it is assigned, whether prose goes on after it or speaks of it, and how an address is spelled.
        float("=" in text[max(0, start - 4) : start]),
        float(text[start - 1 : start] in ("'", '"')),
        float(bool(_goes_on.match(after))),
        float(bool(_spoken_of.search(before))),
        float(len(_spelled_dot.findall(span))),
        float(kind == "email_spelled" and re.split(r"[^A-Za-z0-9-]+", span.rstrip("])"))[-1].lower() in _ENDINGS),
    ]


# Boosted trees of depth two: (feature, threshold, left, right), each side a like split with two values.


class Trees:
    """Gradient boosting for log loss over histograms of at most 32 thresholds."""

    def __init__(self, rounds: int = 60, rate: float = 0.3):
        self.rounds, self.rate, self.trees, self.start = rounds, rate, [], 0.0

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
        best, found = 1e-9, None
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f, cuts in enumerate(self.cuts):
            for cut in cuts:
                left = x[rows, f] <= cut
                if 0 < (k := int(left.sum())) < len(rows):
                    a, b = rows[left], rows[~left]
                    gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - whole
                    if gain > best and min(k, len(rows) - k) >= 5:
                        best, found = gain, (f, float(cut))
        return found

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)))[:-1] for f in range(x.shape[1])]
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            every = np.arange(len(y))
            if not (top := self._split(x, g, h, every)):
                break
            sides = []
            for rows in (every[x[:, top[0]] <= top[1]], every[x[:, top[0]] > top[1]]):
                f, cut = self._split(x, g, h, rows) or (0, np.inf)
                low, high = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                value = [self.rate * g[r].sum() / (h[r].sum() + 1) if len(r) else 0.0 for r in (low, high)]
                sides.append((f, float(cut), *map(float, value)))
            self.trees.append((*top, *sides))
            score += self._one(self.trees[-1], x)
        return self

    @staticmethod
    def _one(tree: tuple, x: np.ndarray) -> np.ndarray:
        f, cut, left, right = tree
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, f] <= cut, side(left), side(right))

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._one(tree, x)
        return 1 / (1 + np.exp(-score))


def examples(n: int = 5000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of candidates found in made-up sentences with personal data or look-alikes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeiourstlnmdp") for _ in range(r.randint(2, 9)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    mixed = lambda k: "".join(r.choice("abcdef0123456789XKQZ") for _ in range(k))

    def iban() -> str:
        # Any country and length of the format (15 to 31), the check digits right.
        country = r.choice("ABCDEFGHILMNOPRST") + r.choice("ABCDEFGHIKLMNOPRSTUVZ")
        body = "".join(r.choice("ABCDEFGHKLMNPQRS") for _ in range(r.choice([0, 0, 4]))) + digits(r.randint(11, 22))
        number = lambda x: "".join(str(int(c, 36)) for c in x)
        whole = f"{country}{98 - int(number(body + country) + '00') % 97:02d}{body}"
        return whole if r.random() < 0.5 else " ".join(whole[k : k + 4] for k in range(0, len(whole), 4))

    letters = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    token = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-") for _ in range(k))
    named = lambda: r.choice([f"{word()}.{word()}", word() + word(), f"{word()}{r.randint(1, 99)}", f"{word()}_{word()}"])
    ending = lambda: r.choice(sorted(_ENDINGS))
    prose = lambda: " " + " ".join(word() for _ in range(r.randint(1, 5)))
    end = lambda: r.choice(["", "\n" + word(), ", " + word() + "=", "; ", '"', "\n", "." + prose(), prose()])

    def address() -> tuple[str, str]:
        at, dot = r.choice([(" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" at ", " dot "), (" AT ", " DOT "), (" (at) ", " dot "), ("[at]", "[dot]")])
        parts = [word() for _ in range(r.choice([1, 1, 1, 2]))] + [ending()]
        return r.choice(["mail ", "contact ", "write to ", "", "", word() + " "]), named() + at + dot.join(parts)

    def secret() -> tuple[str, str]:
        key = r.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "access_key", "Password", "TOKEN"])
        sign, quote = r.choice(["=", " = ", ": ", ":"]), r.choice(["", "", '"', "'"])
        made = r.choice([mixed(r.randint(8, 40)), letters(r.randint(8, 24)), word() + word(), f"{word()}{r.randint(1, 999)}{r.choice('!#$%&*')}", token(r.randint(20, 60))])
        return r.choice(["", "", "my ", "with "]) if "=" in sign or quote else "", f"{key}{sign}{quote}{made.ljust(6, 'q')}{quote}"

    def real() -> tuple[str, str, str]:
        sep = r.choice("-. ")
        kind = r.randrange(7)
        if kind < 2:
            lead, span = address() if kind == 0 else secret()
            told = kind == 1 and ": " in span and span[-1].isalpha() and not re.search("[0-9]", span)
            return lead, span, r.choice(["", "\n" + word(), "\n", ", " + word() + "=", ";"]) if told else end()
        lead, span = (
            (r.choice(["IBAN ", "account ", ""]), iban()),
            (r.choice(["phone ", "call ", "tel. ", word() + " "]), f"{r.choice('23456789')}{digits(2)}{sep}{r.choice('23456789')}{digits(2)}{sep}{digits(4)}"),
            ("", "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))),
            (r.choice(["SSN ", "social security ", ""]), f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
            (r.choice(["", "jwt ", "Bearer "]), f"eyJ{token(r.randint(10, 60))}.{token(r.randint(10, 90))}.{token(r.randint(20, 60))}"),
        )[kind - 2]
        return lead, span, end()

    def alike() -> tuple[str, str, str]:
        lead, span = r.choice(
            [
                (r.choice(["meet ", "look ", "arrive "]), f"{word()} at {word()}.{r.choice([word(), ending()])}"),
                ("", f"{word()} at {word()}. {word()}"),
                (r.choice(["serial ", "part ", "ref "]), f"{r.choice('ABCDEFGH')}{r.choice('XYZKLM')}{digits(2)} {digits(4)} {digits(4)} {digits(2)}"),
                (r.choice(["order ", "invoice ", "part "]), f"{r.choice('01')}{digits(2)}-{digits(3)}-{digits(4)}"),
                (r.choice(["order ", "ref ", "ticket "]), f"{r.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"),
            ]
            + 2 * [(r.choice(["", "the ", "your ", "a new ", "this "]), f"{r.choice(['password', 'token', 'secret', 'Token'])}: {(word() + word()).ljust(6, 'a')}")]
        )
        return lead, span, prose() + r.choice(["", " ", ". "]) if ": " in span else end()

    xs, ys = [], []
    while len(xs) < n:
        truth = r.random() < 0.5
        lead, span, rest = real() if truth else alike()
        text = " ".join(word() for _ in range(r.randint(1, 6))) + " " + lead
        start, text = len(text), text + span + rest
        for a, b, kind in candidates(text):
            if a < start + len(span) and b > start:
                xs.append(features(text, a, b, kind))
                ys.append(float(truth))
    return np.array(xs), np.array(ys)


def fit_model() -> tuple[Trees, dict[str, float]]:
    """The trees, and for each kind the least probability with the wanted precision on held-out examples."""
    x, y = examples()
    held = np.arange(len(y)) % 4 == 0
    trees = Trees().fit(x[~held], y[~held])
    p, limits = trees.probability(x[held]), {}
    for k, kind in enumerate(MORE):
        own = x[held][:, 0] == k
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[held][own][order]) / np.arange(1, own.sum() + 1)
        fine = np.flatnonzero(right >= PRECISION)
        # Half way to the next one below, where precision would be lost.
        sorted_p = np.append(p[own][order], 0.0)
        limits[kind] = max(0.5, float(sorted_p[fine[-1]] + sorted_p[fine[-1] + 1]) / 2) if len(fine) else 2.0
    return trees, limits


def free_of(base: list[tuple[int, int, str]], scored: list[tuple[float, tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
    """Of (score, span) the spans that stand: best first, each free of ``base`` and of those
    before it. A sweep parts the spans into runs that overlap; each run is decided by itself."""
    spans = sorted([(a, b, 0.0, None) for a, b, _ in base] + [(a, b, -s, kind) for s, (a, b, kind) in scored], key=lambda x: x[:3])
    out, k = [], 0
    while k < len(spans):
        end, start = spans[k][1], k
        while k < len(spans) and spans[k][0] < max(end, spans[start][0] + 1):
            end, k = max(end, spans[k][1]), k + 1
        run = spans[start:k]
        if run[0][3] is not None and len(run) == 1:
            out.append((*run[0][:2], run[0][3]))
            continue
        # What stands in the run, as disjoint intervals sorted by start.
        starts, ends = [], []
        for a, b, _, kind in run:
            if kind is None:
                if starts and a < ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
        for a, b, _, kind in sorted((x for x in run if x[3] is not None), key=lambda x: (x[2], x[0], x[1], x[3])):
            at = bisect_left(starts, b)  # those before it start before this span ends
            if not at or ends[at - 1] <= a:
                starts.insert(at, a)
                ends.insert(at, b)
                out.append((a, b, kind))
    return out


def find(texts: list[str], model: tuple[Trees, dict[str, float]]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, both by start, then kind."""
    trees, limits = model
    bases = [base_spans(t) for t in texts]
    proposed = [candidates(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    if any(proposed):
        p = trees.probability(np.array([features(t, *c) for t, found in zip(texts, proposed, strict=True) for c in found]))
        scores = iter(p.tolist())
        for base, found, out in zip(bases, proposed, added, strict=True):
            scored = [(s, c) for c in found for s in (next(scores),) if s >= limits[c[2]]]
            out += free_of(base, scored)
    rank = {kind: k for k, kind in enumerate(KINDS)}
    order = lambda s: (s[0], rank[s[2]], s[1])
    return [(sorted(b, key=order), sorted(b + added[i], key=order)) for i, b in enumerate(bases)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each run of overlapping spans becomes the mark of its first kind."""
    out, done, upto = [], 0, 0
    for a, b, kind in spans:
        if a >= upto:
            out += [text[done:a], f"[{kind.upper()}]"]
        upto = done = max(upto, b)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    model = fit_model()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = find([t or "" for t in frame["text"]], model)
            columns = {"doc_id": frame["doc_id"].astype("Int64")}
            columns |= {f"n_{kind}": [sum(s[2] == kind for s in base) for base, _ in found] for kind in BASE}
            columns["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            columns["spans"] = [joined(every) for _, every in found]
            yield pd.DataFrame(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return rows.mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by a mark; n_chars follows, a null text stays null."""
    model = fit_model()

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        found = find([t or "" for t in texts], model)
        return pd.Series([t and redacted(t, every) for t, (_, every) in zip(texts, found, strict=True)])

    out = docs.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
