"""Personal data: spans by fixed patterns, and further ones by a semi-Markov conditional random field.

The field scores whole candidate segments (their shape, digits, separators, checks and surroundings) for each type, and
a dynamic program over segments of bounded length chooses boundaries and types together. It is trained on labelled
sentences that rules draw, and adds what the fixed patterns don't cover: written-out addresses, numbers without a plus,
cards in other groupings. Only the surroundings of digits, at signs and written-out signs are scored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache
from math import exp, inf, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NO_DIGIT = str.maketrans("", "", " ().+-")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return not (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, an at sign and a domain with a dot; each at sign is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: by kind, then start; a match that fails its kind's check is dropped."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].translate(NO_DIGIT)
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(m[0].translate(NO_DIGIT)) <= 15]
    return out


TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.DOTALL)
TRIGGER = re.compile(r"[0-9@]+")
WRITTEN = re.compile(r"(?i)[\[({<]\s?at\s?[\])}>]|\bdot\b")
LONGEST, AROUND, BITS = 32, 64, 15
#: Ends of domain names that the model knows.
ENDS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "co"}


class Sentence:
    """Tokens of a stretch of text and the hashed features of its candidate segments."""

    def __init__(self, text: str) -> None:
        self.tokens = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.size = len(self.tokens)
        self.plain = [self._plain(k) for k in range(self.size)]
        self.segments = [(i, j, f) for j in range(1, self.size + 1) for i in range(max(0, j - LONGEST), j) if (f := self._features(i, j))]

    @staticmethod
    def _hash(feature: str) -> int:
        return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") & (1 << BITS) - 1

    def _plain(self, k: int) -> int:
        t = self.tokens[k][0]
        return 0 if t.isalpha() else 1 if t.isdigit() else 2 if t.isspace() else 3

    def _word(self, k: int, step: int) -> str:
        for _ in range(4):
            if not 0 <= k < self.size:
                return "^"
            if self.plain[k] == 0:
                return self.tokens[k][0].lower()
            if self.plain[k] == 1:
                return "0"
            k += step
        return "-"

    def _features(self, i: int, j: int) -> list[int]:
        own = [t[0] for t in self.tokens[i:j]]
        kinds = self.plain[i:j]
        if kinds[-1] > 1 or (kinds[0] > 1 and own[0] not in "+(") or any(t in "\n\t\r" for t in own):
            return []
        signs = [t.lower() if t.lower() in ("at", "dot") else "a" for t, k in zip(own, kinds, strict=True) if k == 0]
        at = "@" in own or "at" in signs
        digits = "".join(t for t, k in zip(own, kinds, strict=True) if k == 1)
        if not (at and len(own) >= 5 and signs and ("dot" in signs or "." in own)) and not (len(digits) >= 4 and "a" not in signs):
            return []
        shape = "".join(
            f"d{min(len(t), 7)}" if k == 1 else (t.lower() if t.lower() in ("at", "dot") else "a") if k == 0 else "_" if k == 2 else t for t, k in zip(own, kinds, strict=True)
        )
        before = self.plain[i - 1] if i else 2
        behind = self.plain[j] if j < self.size else 2
        near = self.tokens[i - 1][0] if i and before == 3 else str(before)
        next_ = self.tokens[j][0] if j < self.size and behind == 3 else str(behind)
        if next_ in ".,;:!?" and j + 1 < self.size and self.plain[j + 1] < 2:
            next_ += "x"
        parts = "".join(own).split(".")
        names = [
            "bias", f"shape {shape}", f"digits {min(len(digits), 20)}", f"dots {min(own.count('.'), 5)}", f"marks {''.join(sorted({t for t, k in zip(own, kinds, strict=True) if k > 1}))}",
            f"first {own[0] if kinds[0] > 1 else kinds[0]}", f"last {kinds[-1]}", f"before {near}", f"behind {next_}", f"left {self._word(i - 1, -1)}", f"right {self._word(j, 1)}",
            f"luhn {13 <= len(digits) <= 19 and luhn(digits)}", f"bytes {len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}", f"at {at}",
            f"groups {'-'.join(str(len(t)) for t, k in zip(own, kinds, strict=True) if k == 1)}" if not signs else f"end {own[-1].lower() in ENDS} {len(signs) > 2}",
            f"start {digits[:1]}{len(digits)}" if not signs else "letters", f"beside {'a_a' in shape} {len(signs) > 12}",
        ]
        return [self._hash(n) for n in names]


class Field:
    """Weights of segments by type and of single tokens outside."""

    def __init__(self) -> None:
        self.segment, self.outside = np.zeros((1 << BITS, len(KINDS))), np.zeros(4)

    def scores(self, s: Sentence) -> list[list[float]]:
        return [self.segment[f].sum(axis=0).tolist() for _, _, f in s.segments]

    def sums(self, s: Sentence, scores: list[list[float]]) -> tuple[list[float], list[float]]:
        """Logarithms of the summed weights of all segmentations of every prefix and every suffix."""

        def add(a: float, b: float) -> float:
            return max(a, b) + log1p(exp(-abs(a - b))) if min(a, b) > -1e300 else max(a, b)

        fore, back = [0.0] + [-1e308] * s.size, [-1e308] * s.size + [0.0]
        outside = self.outside.tolist()
        ending: list[list[int]] = [[] for _ in range(s.size + 1)]
        starting: list[list[int]] = [[] for _ in range(s.size + 1)]
        for k, (i, j, _) in enumerate(s.segments):
            ending[j].append(k)
            starting[i].append(k)
        for j in range(1, s.size + 1):
            fore[j] = fore[j - 1] + outside[s.plain[j - 1]]
            for k in ending[j]:
                for x in scores[k]:
                    fore[j] = add(fore[j], fore[s.segments[k][0]] + x)
        for i in range(s.size - 1, -1, -1):
            back[i] = back[i + 1] + outside[s.plain[i]]
            for k in starting[i]:
                for x in scores[k]:
                    back[i] = add(back[i], back[s.segments[k][1]] + x)
        return fore, back

    def chances(self, s: Sentence) -> list[list[float]]:
        """The posterior of every candidate segment and type."""
        scores = self.scores(s)
        fore, back = self.sums(s, scores)
        return [[exp(min(0.0, fore[i] + x + back[j] - fore[-1])) for x in row] for (i, j, _), row in zip(s.segments, scores, strict=True)]

    def learn(self, examples: list[tuple[str, list[Span]]], rounds: int = 8, rate: float = 0.5, seed: int = 1) -> Field:
        """Maximises the conditional likelihood by stochastic gradient steps."""
        made = []
        for text, spans in examples:
            s = Sentence(text)
            truth = {(a, b): KINDS.index(kind) for kind, a, b in spans}
            made.append((s, {k: y for k, (i, j, _) in enumerate(s.segments) if (y := truth.get((s.tokens[i][1], s.tokens[j - 1][2]))) is not None}))
        order = random.Random(seed)
        for turn in range(rounds):
            order.shuffle(made)
            step = rate / (1 + turn)
            for s, truth in made:
                chance = self.chances(s)
                out = np.zeros(4)
                np.add.at(out, s.plain, 1.0)
                wrong = out * 0
                for k, row in enumerate(chance):
                    i, j, f = s.segments[k]
                    g = -np.array(row)
                    if k in truth:
                        g[truth[k]] += 1
                    if np.abs(g).max() > 1e-4:
                        np.add.at(self.segment, f, step * (g - 1e-3 * self.segment[f].mean(axis=0)))
                        cover = np.bincount(s.plain[i:j], minlength=4)
                        wrong -= cover * g.sum()
                self.outside += 0.02 * step * wrong
        return self

    def best(self, s: Sentence, scores: list[list[float]], price: float = 0.0) -> list[tuple[int, int]]:
        """(segment, type) of the segmentation of greatest score, each segment's score less price; ties take fewer segments.

        The best segmentation of every prefix follows from those of shorter ones: a token outside, or a segment of at
        most LONGEST tokens of any type behind a shorter prefix. Boundaries and types are so chosen together.
        """
        top, back = [0.0] + [-inf] * s.size, [None] * (s.size + 1)
        ending: list[list[tuple[int, int, int, float]]] = [[] for _ in range(s.size + 1)]
        for k, ((i, j, _), row) in enumerate(zip(s.segments, scores, strict=True)):
            ending[j] += [(i, k, y, x - price) for y, x in enumerate(row)]
        outside = self.outside.tolist()
        for j in range(1, s.size + 1):
            top[j] = top[j - 1] + outside[s.plain[j - 1]]
            for i, k, y, x in ending[j]:
                if top[i] + x > top[j]:
                    top[j], back[j] = top[i] + x, (i, k, y)
        out, j = [], s.size
        while j:
            if back[j] is None:
                j -= 1
            else:
                j, k, y = back[j]
                out.append((k, y))
        return out[::-1]

    def spans(self, text: str, odds: float = 1.5) -> list[Span]:
        """The spans of the best segmentation, in which a span must be worth that many times what it replaces."""
        s = Sentence(text)
        return [(KINDS[y], s.tokens[s.segments[k][0]][1], s.tokens[s.segments[k][1] - 1][2]) for k, y in self.best(s, self.scores(s), log(odds))] if s.segments else []


def labelled_sentences(n: int = 900, seed: int = 2) -> list[tuple[str, list[Span]]]:
    """Sentences with their spans, drawn from rules for personal data and for numbers and words that look like it."""
    rng = random.Random(seed)
    words = "an er on the in re nd ha ti st and of to call me mail at from with write card pay host server order number page chapter version see room total price since until tel phone contact visa".split()
    first, last = "ana john maria peter lena paul".split(), "smith lopez meier durand khan novak".split()

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def whole(k: int) -> str:
        d = rng.choice("3456") + digits(k - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def email() -> str:
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" @ ", ".")])
        name = rng.choice([rng.choice(first), rng.choice(first) + rng.choice([".", "_", dot]) + rng.choice(last), rng.choice(last) + digits(2)])
        end = rng.choice(sorted(ENDS - {"co"})) if rng.random() < 0.8 else "co" + dot + "uk"
        return name + at + rng.choice(["mail", "example", "post", "web"]) + rng.choice(["", digits(1)]) + dot + end

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b}{c}", f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    def card() -> str:
        d = whole(16)
        return rng.choice([" ", "-", "", "."]).join(d[k : k + 4] for k in range(0, 16, 4)) if rng.random() < 0.8 else f"{(d := whole(15))[:4]} {d[4:10]} {d[10:]}"

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def bad_card() -> str:
        d = digits(16)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    noise = [
        lambda: f"{rng.randint(1900, 2050)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2050)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: digits(rng.choice([4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 20])), bad_card, bad_card, lambda: f"{digits(2)},{digits(3)}.{digits(2)}", lambda: f"{digits(4)}-{digits(4)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(3)}.{digits(3)}", lambda: "at the dot on the page", lambda: "look at a.b", lambda: f"{digits(3)}-{digits(2)}", lambda: "dot com", lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
        lambda: "0x" + hashlib.md5(digits(3).encode()).hexdigest(), lambda: hashlib.sha1(digits(3).encode()).hexdigest(), lambda: f"{digits(4)} {digits(4)}", lambda: f"{digits(1)}.{digits(6)}",
    ]
    kinds = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) + rng.choice([" ", " ", ": ", ". ", ", "])
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                value = kinds[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = rng.choice(noise)()
            text += value + rng.choice([" ", " ", ". ", ", ", "\n"])
        out.append((text, spans))
    return out


@cache
def default_field() -> Field:
    return Field().learn(labelled_sentences())


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text round digits, at signs and written-out signs; those that touch are one."""
    found = [m.span() for m in TRIGGER.finditer(text)] if "@" in text or DIGIT.search(text) else []
    if any(x in text for x in ("dot", "DOT", "Dot", "at]", "at)", "at}", "at>", "AT]", "AT)")):
        found = sorted([*found, *(m.span() for m in WRITTEN.finditer(text))])
    if not found:
        return
    start, end = max(0, found[0][0] - AROUND), 0
    for a, b in found:
        if end and a - AROUND > end:
            yield start, end
            start = a - AROUND
        end = max(end, b + AROUND)
    yield start, min(len(text), end)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, these and the field's further ones, which overlap none of them), both by kind, then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more: list[Span] = []
    for start, end in stretches(text):
        # whole words at both ends
        while start and text[start - 1].isalnum():
            start -= 1
        while end < len(text) and text[end].isalnum():
            end += 1
        # what lies between base spans
        at = start
        for a, b in [*((a, b) for a, b in taken if a < end and b > start), (end, end)]:
            if a > at and (DIGIT.search(text, at, a) or WRITTEN.search(text, at, a) or "@" in text[at:a]):
                more += [(kind, at + x, at + y) for kind, x, y in field.spans(text[at:a])]
            at = max(at, b)
    if not more:
        return base, base
    return base, sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def _found(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", field)
                n = [sum(s[0] == kind for s in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs(doc_id, text).

    Counts and digest are those of the fixed patterns, spans all of them; positions are code points. A null text counts
    as empty. Every row stands by itself: repeated rows give repeated results, a null doc_id stays null, and an empty
    table gives an empty result; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", F.col("text")).mapInArrow(_found(field or default_field()), f"doc_id {kind}, {columns}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """text with every span replaced by its kind in brackets; of overlapping spans the first to start counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
    return "".join([*out, text[at:]])
