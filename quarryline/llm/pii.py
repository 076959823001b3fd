"""Personal data and secrets by candidate gradient boosting (operator 7).

Base spans are what the contract's patterns find: e-mail, IPv4, payment card (Luhn) and phone, by kind
leftmost and without overlap; those that fail the check are dropped. High-recall generators propose more spans, which may overlap: disguised
e-mails (at, dot) and those at a bare host, IPs with bracketed dots and IPv6, card numbers of 13 to 19 digits with other separators, phone numbers
without a plus, and the kinds of MORE: secrets (values given to a name like password or token, long runs of letters and digits, private key
blocks), bank account numbers and identity numbers. Boosted trees judge each by the format of the span and the characters and words around it; margins are
calibrated on held-out documents and each kind has a threshold of precision LEAST_PRECISION there (0.5 at least). Of overlapping accepted
spans the likeliest stays; base spans always stay and exclude others that touch them.

Learned from about SAMPLE different texts (by a hash of the text; at most SAMPLE, and PER_DOC spans and one plain place of each) in their own contexts.
Positive are base spans as they stand, and what FORMS write in their place or at plain places: disguised base spans, national phone
numbers after a word that calls for one, and made secrets and numbers. Negative are the candidates there that fail the base checks, and what DECOYS write: dates, versions, amounts, hashes of
revisions, identifiers, settings and broken check digits. Every second form and decoy is kept for the held-out documents alone, so thresholds are set on
ways of writing that the trees have not seen. Without any text nothing is added.

Offsets are code points, ends exclusive. A null text counts as empty and has none. Rows are judged one by one, repeated ones alike; very long texts
are searched whole, in time linear in their length (but for a sort of the spans found). Other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import INT, LONG, STRING, annotate, struct, table

KINDS = ("email", "ip", "card", "phone")
#: PLAIN: places at which forms and decoys are written, again and again where there are fewer.
#: Kinds that only the method finds.
MORE = ("secret", "iban", "id")
SAMPLE, PER_DOC, PLAIN, SEED, CONTEXT, LEAST_PRECISION = 20_000, 4, 3000, 7, 40, 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins where its run of digits does, so the look-behind changes nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """By kind as in KINDS, then by start."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


_AT = re.compile(r"(?i)\s?(?:@|\(at\)|\[at\]|\{at\}|(?<=[\w])\sat(?=\s))\s?")
_HOSTLIKE = re.compile(r"(?i)[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\sdot(?=\s))\s?[A-Za-z0-9-]{1,63})*")
_GENERATORS = (
    ("ip", re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\[dot\]|,|\s\.\s)[0-9]{1,3}){3}(?![\w])")),
    ("card", re.compile(r"(?<![\w.])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![\w])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+|\()?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![\w])")),
    ("id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"(?<![\w])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\w])")),
)
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_-])")
_SIX = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})?(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:)*:(?:[0-9A-Fa-f]{1,4}:)*[0-9A-Fa-f]{1,4}(?![\w:])")
_SIGN = re.compile("[=:]")
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:api|access|auth|private|client|secret|signing)[ _-]?(?:key|id|secret)?|bearer|kennwort|passwort|contraseña|mot de passe|clave)[\"'\]]{0,2}\s{0,2}$")
_VALUE = re.compile(r"[=>]?\s{0,2}(?:[Bb]earer )?([\"'`]?)([^\s\"'`<>,;]{6,})")
_BLOCK = "-----BEGIN "


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data or secrets; they may overlap each other and base spans."""
    out: list[Span] = []
    low = text.lower()
    # all that _AT matches holds one of these
    if "@" in text or "at" in low:
        for m in _AT.finditer(text):
            begin = m.start()
            while begin > 0 and m.start() - begin < 64 and text[begin - 1] in _LOCAL:
                begin -= 1
            right = _HOSTLIKE.match(text, m.end()) if begin < m.start() else None
            if right and ("@" in m[0] or "(" in m[0] or "[" in m[0] or "{" in m[0] or "dot" in right[0].lower()):
                out.append(("email", begin, right.end()))
    if _DIGIT.search(text):
        for kind, pattern in _GENERATORS:
            out += [(kind, *m.span()) for m in pattern.finditer(text)]
        out += [("secret", *m.span()) for m in _RUN.finditer(text) if _DIGIT.search(m[0])]
    for m in _SIGN.finditer(text):
        if _NAMED.search(text[max(0, m.start() - 40) : m.start()]) and (v := _VALUE.match(text, m.end())):
            out.append(("secret", v.start(2), v.start(2) + len(v[2].rstrip(".)]}"))))
    if text.count(":") > 1:
        out += [("ip", *m.span()) for m in _SIX.finditer(text) if m[0].count(":") > 1 and _DIGIT.search(m[0])]
    at, end = text.find(_BLOCK), 0
    while at >= 0 and end >= 0:
        end = end if end > at else text.find("-----END ", at)
        close = text.find("-----", end + 9, end + 100) if end >= 0 else -1
        if "PRIVATE KEY" in text[at : at + 60] and close >= 0:
            out.append(("secret", at, close + 5))
        at = text.find(_BLOCK, max(close, at + 1))
    return list(dict.fromkeys(out))


_CUES = tuple(
    re.compile(rf"(?i)(?:{words})\W*$")
    for words in ("tel|phone|mobile|call|fax|cell|whatsapp|telefon|t\\S{0,2}l\\S{0,2}phone", "e-?mail|mail|contact|write to|correo|courriel", "card|visa|mastercard|amex|credit|karte|tarjeta|carte", "ip|host|server|addr(?:ess)?|from|ping|client", "version|v|ver|release|build|chapter|section|rfc|isbn|no|id|order|invoice|ref|nr|page|key", "commit|revision|rev|sha\\S{0,6}|hash|md5|digest|checksum|etag|uuid|guid|blob|merge", "iban|account|konto|cuenta|compte|ssn|social security|passport|ausweis|dni|nif|steuer\\S*")
)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)?[0-9]{2}(?![0-9])")


_TOLD = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "eyJ", "AIza", "-----BEGIN", "npm_", "pypi-", "SG.")


def iban(number: str) -> bool:
    n = "".join(c for c in number if c.isalnum())
    return 15 <= len(n) <= 34 and n.isascii() and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def describe(kind: str, before: str, span: str, after: str) -> list[float]:
    """Format and context of a candidate as numbers."""
    d = digits(span)
    groups = re.findall("[0-9]+", span)
    marks = [c for c in span if not c.isalnum()]
    a, b = before[-1:], after[:1]
    low = span.lower()
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(span, span[1:]))
    named = _NAMED.search(re.sub(r"\s{0,2}[=:][=>]?\s{0,2}(?:[Bb]earer )?[\"'`]?$", "", before))
    return [
        *[float(kind == k) for k in (*KINDS, *MORE)],
        len(span), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(marks), len(set(marks)), sum(c.isspace() for c in marks), marks.count("-"), marks.count("."), marks.count("/"), marks.count("(") + marks.count("["), marks.count(":"), marks.count("_"),
        float(bool(d) and luhn(d)), float(len(groups) == 4 and octets(groups)), float(13 <= len(d) <= 19), float(kind == "iban" and iban(span)),
        float(span[:1] == "+"), float(span[:2] == "00"), float(span[:1] == "0"), float(span[:1] == "("), float(d[:1] in tuple("3456") if d else 0),
        float("@" in span), float(" at " in low), float("(at)" in low or "[at]" in low or "{at}" in low), float("dot" in low), float(re.findall("[a-z]+", low)[-1:] != [] and re.findall("[a-z]+", low)[-1] in _TOP), float(sum(c.isupper() for c in span)), float(sum(c.islower() for c in span)),
        len(set(d)), float(len(span) - len(span.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))),
        turns / max(1, len(span)), len(set(span)) / max(1, len(span)), float(all(c in "0123456789abcdef" for c in low)), float(span.startswith(_TOLD)), float(named is not None), float(bool(re.search("[=:][=>]?\\s{0,2}[\"'`]?$", before))),
        float(bool(_DATE.search(span))), float(a.isalnum()), float(a.isspace() or not a), float(a in tuple("$#=\"'€£") if a else 0), float(b.isalnum()), float(b.isspace() or not b), float(b in tuple(".,;:!?)") if b else 0), float(b in tuple("%$€£\"'") if b else 0),
        *[float(bool(c.search(before))) for c in _CUES],
    ]


class Boosted:
    """Gradient-boosted trees of depth DEPTH with logistic loss on binned features."""

    DEPTH, ROUNDS, RATE, BINS = 3, 60, 0.2, 32

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS)))[:-1] for c in x.T]
        bins = self._binned(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin, n, f = np.full(len(y), self.start), len(y), x.shape[1]
        for _ in range(self.ROUNDS):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            node, feature, cut = np.zeros(n, np.int64), np.zeros(2**self.DEPTH - 1, np.int64), np.full(2**self.DEPTH - 1, self.BINS)
            for depth in range(self.DEPTH):
                first, k = 2**depth - 1, 2**depth
                slot = (node[:, None] * f + np.arange(f)) * self.BINS + bins
                g = np.bincount(slot.ravel(), np.repeat(grad, f), k * f * self.BINS).reshape(k, f, self.BINS).cumsum(2)
                h = np.bincount(slot.ravel(), np.repeat(hess, f), k * f * self.BINS).reshape(k, f, self.BINS).cumsum(2)
                gain = g**2 / (h + 1) + (g[:, :, -1:] - g) ** 2 / (h[:, :, -1:] - h + 1) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + 1)
                best = gain.reshape(k, -1).argmax(1)
                good = gain.reshape(k, -1).max(1) > 1e-9
                feature[first : first + k] = np.where(good, best // self.BINS, 0)
                cut[first : first + k] = np.where(good, best % self.BINS, self.BINS)
                node = 2 * node + (bins[np.arange(n), feature[first + node]] > cut[first + node])
            leaves = 2**self.DEPTH
            value = -np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + 1) * self.RATE
            self.trees.append((feature, cut, value))
            margin += value[node]

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], 1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins, out, rows = self._binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for depth in range(self.DEPTH):
                at = 2**depth - 1 + node
                node = 2 * node + (bins[rows, feature[at]] > cut[at])
            out += value[node]
        return out


#: How a base span is written otherwise, by kind; even places are for training, odd ones for calibration.
_MAIL_FORMS = ((" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" @ ", "."), (" AT ", " DOT "))
_IP_FORMS = ("[.]", "(.)", "[dot]", " . ")
_CARD_FORMS = (".", "/", "_", "  ")
_PHONE_CALLS = ("call ", "tel. ", "phone: ", "Telefon ", "mobile ", "Tel: ", "fax ", "WhatsApp ")
_NAMES = ("password", "token", "api_key", "secret", "passwd", "access_key", "pwd", "auth_token", "client_secret", "API key")
_GIVEN = ("{0}={1}", '{0} = "{1}"', "{0}: {1}", "{0}:'{1}'", "{0} => {1}", "{0} = {1}", '"{0}": "{1}"', "export {0}='{1}'")


_TOP = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl", "jp", "br", "ru", "in")


def _text(rng: random.Random, n: int, of: str) -> str:
    return "".join(rng.choice(of) for _ in range(n))


_HEX, _UPPER, _ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _half(forms: tuple, held: bool) -> tuple:
    return forms[int(held) :: 2]


def disguised(kind: str, span: str, rng: random.Random, held: bool) -> list[tuple[str, str, str]]:
    """Other ways to write a base span that still tell it: (kind, what stands before, span)."""
    d = digits(span)
    if kind == "email":
        name, _, host = span.partition("@")
        if rng.random() < 0.6:  # other names than those of these documents
            word = lambda n: _text(rng, rng.randrange(3, n), "abcdefghijklmnopqrstuvwxyz")
            name, host = rng.choice([word(9), f"{word(7)}.{word(9)}", word(6) + str(rng.randrange(100))]), rng.choice([f"{word(9)}.", f"mail.{word(8)}."]) + rng.choice(_TOP)
        at, dot = rng.choice(_half(_MAIL_FORMS, held))
        return [("email", rng.choice(("", "write to ", "contact ", "mail ")), name + at + host.replace(".", dot)), ("email", "", f"{name}@{host.split('.')[-2]}")]
    if kind == "ip":
        six = ":".join(_text(rng, 4, _HEX) for _ in range(8)) if held else "2001:db8::" + ":".join(_text(rng, rng.choice([1, 3, 4]), _HEX) for _ in range(3))
        return [("ip", "", span.replace(".", rng.choice(_half(_IP_FORMS, held)))), ("ip", "", six)]
    if kind == "card":
        body = d[: rng.choice([12, 13, 14, 15, 15, 15])]
        sep = rng.choice(_half(_CARD_FORMS, held))
        return [("card", "", sep.join(d[i : i + 4] for i in range(0, len(d), 4))), ("card", "", body + next(c for c in "0123456789" if luhn(body + c)))]
    parts = [d[-10:-7], d[-7:-4], d[-4:]]
    national = ("{}-{}-{}", "({}) {}-{}", "({}) {} {}", "{}.{}.{}", "0{} {} {}", "0{}/{}{}", "{}/{}{}", "{} {} {}")
    return [("phone", rng.choice(_half(_PHONE_CALLS, held)), rng.choice(_half(national, held)).format(*parts)), ("phone", "", "00" + d[:2] + " " + " ".join(parts))]


def made(rng: random.Random, held: bool) -> list[tuple[str, str, str]]:
    """Secrets and numbers: (kind, what stands before, span)."""
    # of both halves: a run of hexadecimal digits, one of letters and digits, a short one with marks
    values = (_text(rng, rng.choice([16, 18, 20, 32, 40, 64]), _HEX), _text(rng, rng.choice([12, 20, 24, 36, 43]), _ALNUM), _text(rng, rng.choice([16, 22, 40]), _ALNUM), _text(rng, rng.choice([6, 8, 10, 12]), _ALNUM) + rng.choice("!#&*-") + _text(rng, 2, _ALNUM), _text(rng, rng.choice([24, 32, 40]), _HEX), _text(rng, rng.choice([8, 10, 12]), _ALNUM) + rng.choice("$%!?+"))
    shape = rng.choice(_half(_GIVEN, held)).format(rng.choice(_half(_NAMES, held)), "\0")
    alone = ("AKIA" + _text(rng, 16, _UPPER), "ghp_" + _text(rng, 36, _ALNUM), "ASIA" + _text(rng, 16, _UPPER), "sk_live_" + _text(rng, 24, _ALNUM), "xoxb-" + _text(rng, 12, "0123456789") + "-" + _text(rng, 24, _ALNUM), "AIza" + _text(rng, 35, _ALNUM))
    body = _text(rng, rng.choice([14, 18]), "0123456789")
    country = rng.choice("DE ES GB NL AT".split() if held else "FR IT BE PT PL".split())
    check = 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97
    account = f"{country}{check:02d}{body}"
    account = " ".join(account[i : i + 4] for i in range(0, len(account), 4)) if rng.random() < 0.5 else account
    person = f"{rng.randrange(100, 900)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}"
    return [
        ("secret", shape.partition("\0")[0], rng.choice(_half(values, held))),
        ("secret", shape.partition("\0")[0], _half(values, held)[0]),
        ("secret", "", rng.choice(_half(alone, held))),
        ("iban", rng.choice(_half(("IBAN ", "account ", "Konto ", "")[:], held)), account),
        ("id", rng.choice(_half(("SSN ", "social security ", "ssn: ", "SSN: "), held)), person),
    ]


def decoys(rng: random.Random, held: bool) -> list[tuple[str, str, str]]:
    """Spans that look alike and tell nobody: (kind, what stands before, span)."""
    n = lambda k: _text(rng, k, "0123456789")
    broken = n(rng.choice([15, 15, 12, 13, 17]))
    broken += rng.choice([c for c in "0123456789" if not luhn(broken + c)])
    year, month, day = rng.randrange(1950, 2035), rng.randrange(1, 13), rng.randrange(1, 29)
    word = lambda: _text(rng, rng.choice([3, 5, 8]), "abcdefghijklmnopqrstuvwxyz")
    hexes = _text(rng, rng.choice([32, 40, 64]), _HEX)
    uuid = "-".join(_text(rng, k, _HEX) for k in (8, 4, 4, 4, 12))
    every = [
        ("card", "", broken), ("card", "", " ".join(broken[i : i + 4] for i in range(0, len(broken), 4))),
        ("phone", "", n(rng.choice([7, 8, 9, 10, 12]))), ("phone", "order ", n(rng.choice([7, 8, 9, 10]))),
        ("phone", "", f"{year}-{month:02d}-{day:02d}"), ("phone", "", f"{day:02d}.{month:02d}.{year}"),
        ("phone", "", f"{year} - {year + 3}"), ("phone", "", f"{n(3)}.{n(3)}.{n(2)}"), ("phone", "", f"{year}/{n(4)}"), ("phone", "", f"{n(1)} {n(3)} {n(3)}"),
        ("phone", "version ", f"{n(1)}.{n(1)}.{n(2)}.{n(4)}"), ("phone", "v", f"{n(2)}.{n(1)}.{n(1)}.{n(3)}"), ("phone", "ISBN ", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}"), ("card", "ISBN ", f"979-{n(2)}-{n(3)}-{n(4)}-{n(1)}"),
        ("ip", "", f"{rng.randrange(1, 300)},{rng.randrange(300, 999)},{n(3)},{n(3)}"), ("ip", "version ", f"{rng.randrange(256, 999)}.{n(1)}.{n(2)}.{n(3)}"),
        ("ip", "", f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"), ("ip", "at ", f"{rng.randrange(24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}"),
        ("email", "", f"{rng.choice(['look', 'meet', 'price', 'sold'])} @ {n(2)}.{n(2)}"), ("email", "", f"arrive at {rng.choice(['noon', 'gate'])} dot {rng.choice(['matrix', 'by'])}"),
        ("email", "", f"{word()} @ {word()}"), ("email", "", f"look at {word()} dot {word()}"),
        # pairs, so that both halves have each sort, in other words
        ("secret", rng.choice(("commit ", "merge ")), hexes), ("secret", rng.choice(("revision ", "rev ")), hexes),
        ("secret", rng.choice(("sha256:", "etag: ")), hexes), ("secret", rng.choice(("md5 ", "checksum ")), hexes),
        ("secret", "", uuid), ("secret", "uuid ", uuid),
        ("secret", "", "-".join(word() for _ in range(4)) + f"-{n(2)}"), ("secret", "", "_".join(word() for _ in range(4)) + n(1)),
        ("secret", "", "/".join(word() for _ in range(4)) + f"/{n(3)}"), ("secret", "", f"{word()}/{year}/{month:02d}/{day:02d}/{word()}"),
        ("secret", "token: ", word() + word()), ("secret", "the secret: ", word() + word()),
        ("secret", "password: ", rng.choice(("required", "optional", "********", "forgotten"))), ("secret", "password = ", rng.choice(("invalid", "expired", "changed", "prompt"))),
        ("secret", "", word() + word() + word() + n(2)), ("secret", "", word() + n(4) + word() + word()),
        ("email", "", f"{word()} at {word()} dot {word()}"), ("email", "", f"{word()} at {word()} dot {rng.choice(('by', 'on', 'matrix', 'product'))}"),
        ("iban", "", f"{_text(rng, 2, _UPPER[:26])}{n(2)} {n(4)} {n(4)} {n(2)}"), ("iban", "order ", f"{_text(rng, 2, _UPPER[:26])}{n(2)}{n(4)}{n(4)}{n(3)}"),
        ("id", "page ", f"{n(3)}-{n(2)}-{n(4)}"), ("id", "", f"{n(3)}-{n(2)}-{n(4)}"),
    ]
    return every[int(held) :: 2]


class PiiModel:
    """Trees, calibration (a, b) and thresholds by kind."""

    def __init__(self, rows: list[tuple[bool, str, str, str, str, bool]]):
        """rows: held out, kind, before, span, after, positive."""
        x = np.array([describe(*r[1:5]) for r in rows], np.float64)
        y = np.array([r[5] for r in rows], np.float64)
        out = np.array([r[0] for r in rows])
        self.trees = Boosted(x[~out], y[~out])
        margin, want = self.trees.margins(x[out]), y[out]
        a, b = 1.0, 0.0
        for _ in range(25):  # Newton steps of a logistic fit, slightly drawn to (1, 0)
            p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - want) * margin).sum() + (a - 1), (p - want).sum() + b])
            h = np.array([[(w * margin**2).sum() + 1, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1]])
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.a, self.b = float(a), float(b)
        p, kinds = self._chance(margin), np.array([r[1] for r in rows])[out]
        self.least = {}
        for k in (*KINDS, *MORE):
            own = kinds == k
            order = np.argsort(-p[own], kind="stable")
            hits = np.cumsum(want[own][order]) / np.arange(1, own.sum() + 1)
            good = np.flatnonzero(hits >= LEAST_PRECISION)
            self.least[k] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1

    def _chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -50, 50)))

    def more(self, text: str, base: list[Span]) -> list[Span]:
        """Accepted candidates that touch neither base spans nor each other."""
        free = _clear(candidates(text), sorted((s, e) for _, s, e in base))
        if not free:
            return []
        chance = self._chance(self.trees.margins(np.array([describe(k, text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT]) for k, s, e in free])))
        found = sorted((-round(float(p), 6), s, -e, k) for p, (k, s, e) in zip(chance, free) if p >= self.least[k])
        starts: list[int] = []
        out: dict[int, Span] = {}
        for _, s, e, k in found:
            at = bisect.bisect_left(starts, -e)  # accepted spans don't overlap, so the last that begins before the end decides
            if not at or out[starts[at - 1]][2] <= s:
                bisect.insort(starts, s)
                out[s] = (k, s, -e)
        return list(out.values())


def _clear(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """Spans that overlap none of the taken ones."""
    joined: list[list[int]] = []
    for s, e in taken:
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    starts = [s for s, _ in joined]
    out = []
    for c in spans:
        i = bisect.bisect_left(starts, c[2])
        if not i or joined[i - 1][1] <= c[1]:
            out.append(c)
    return out


def fit(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> PiiModel | None:
    """A model from about sample different texts, and at most so many, or None without any."""
    total = docs.count()
    place = F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")))
    some = docs.select("text", place.alias("place")).where(F.pmod("place", F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, total))))
    found = T.ArrayType(struct(kind=STRING, base=INT, before=STRING, span=STRING, after=STRING))

    def make():
        def work(texts: list) -> list:
            out = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                near = _clear(candidates(t), sorted((s, e) for _, s, e in base))
                spans = [(1, *x) for x in base[:PER_DOC]] + [(0, *x) for x in near[:PER_DOC]]
                plain = t.find(" ", len(t) // 2) + 1
                if plain and not base and not near:
                    spans.append((2, "", plain, plain))
                out.append([{"kind": k, "base": b, "before": t[max(0, s - CONTEXT) : s], "span": t[s:e], "after": t[e : e + CONTEXT]} for b, k, s, e in spans if e - s <= 200])
            return [out]

        return work

    seen = annotate(some, make, struct(found=found), carry=("place",)).where("size(found) > 0")
    seen = seen.groupBy("place").agg(F.first("found").alias("found")).orderBy("place").limit(sample).collect()
    rng, out, plain = random.Random(seed), [], {False: [], True: []}
    for r in seen:
        held = r["place"] % 4 == 0
        for s in r["found"]:
            kind, before, span, after = s["kind"], s["before"], s["span"], s["after"]
            put = lambda made, y, before=before, after=after, held=held: [(held, k, (before + b)[-CONTEXT:], x, after, y) for k, b, x in made]
            if s["base"]:
                plain[held].append((before, after))
            if s["base"] == 1:
                out += put([(kind, "", span), *disguised(kind, span, rng, held)], True)
                out += put(rng.sample(decoys(rng, held), 4), False)
            elif s["base"] == 0:
                # what looks like a secret there may be one: it teaches nothing
                out += put([(kind, "", span)], False) if kind not in MORE else []
    for held, places in plain.items():
        for i in range(PLAIN // (3 if held else 1) if places else 0):
            before, after = places[i % len(places)]
            out += [(held, k, (before + b)[-CONTEXT:], x, after, True) for k, b, x in rng.sample(made(rng, held), 2)]
            out += [(held, k, (before + b)[-CONTEXT:], x, after, False) for k, b, x in rng.sample(decoys(rng, held), 5)]
    both = [{r[5] for r in out if r[0] == h} for h in (False, True)]
    return PiiModel(out) if both == [{True, False}] * 2 else None


def line(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: ((*KINDS, *MORE).index(x[0]), x[1], x[2])))


FOUND = struct(n_email=LONG, n_ip=LONG, n_card=LONG, n_phone=LONG, base_sha256=STRING, spans=STRING, n_spans=LONG, n_secret=LONG)


def find(docs: DataFrame, model: PiiModel | None, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry, counts and digest of the base spans, all spans of every row, how many they are and how many of them are secrets."""

    def make():
        def work(texts: list) -> list:
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                added = model.more(t, base) if model else []
                rows.append((*[sum(s[0] == k for s in base) for k in KINDS], hashlib.sha256(line(base).encode()).hexdigest(), line(base + added), len(base) + len(added), sum(s[0] == "secret" for s in added)))
            return [list(c) for c in zip(*rows)]

        return work

    return annotate(docs, make, FOUND, text, carry)


def redact(text: str, spans: str) -> str:
    """The text with each span of find() replaced by its kind in brackets."""
    parts, at = [], 0
    for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if s >= at:
            parts += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, fit(docs))
