"""Personal data: fixed base patterns, and a semi-Markov conditional random field for what they miss.

The field scores whole candidate segments: a segment of up to MOST_TOKENS tokens with a type gets the weights of what
holds of it as a whole (digits in it, checksum, separators, brackets, what stands at its edges), plus a weight for the
types of neighbouring segments. Segmentation and types of a stretch are chosen together by dynamic programming over
segment ends. Entities are bounded: MOST_TOKENS tokens, with one ``@`` or bracketed "at" and a dot behind it, or of
LEAST_DIGITS to MOST_DIGITS digits and what may stand between them. Text without any is all outside and needs no pass;
that is part of the model, not a shortcut around it. Every step is linear in the length of a text.

Weights are fitted by stochastic gradient ascent on the conditional likelihood of segmentations, on a bounded sample
of documents with base matches and on variants of those matches that the base patterns don't cover.
"""

from __future__ import annotations

import hashlib
import random
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import held, slices

# The base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Documents with base matches that the field is fitted on, at most: the first by hash of the id.
SAMPLE = 150
#: Stretches that the field is fitted on, at most: the fixed ones and a seeded sample of whole stretches.
MOST_WINDOWS = 200
#: Characters of a stretch that the field is fitted on, about: the cut is after the entity or token that it falls in.
MOST_CHARS = 400
EPOCHS = 8
#: Tokens of an entity, at most: an address of eight names takes 8 + 7 * 5 with " [dot] " and " [at] " between them.
MOST_TOKENS = 44
LEAST_DIGITS, MOST_DIGITS = 7, 20
#: Characters of an entity without an "at", besides digits.
_BETWEEN = frozenset(" ().+/[]-")
#: Characters of an entity, at most, and so those that a stretch reaches to either side of what makes one possible.
REACH = 160
#: Tokens that one lattice takes; longer stretches are cut with an overlap of MOST_TOKENS at either side.
LATTICE_TOKENS = 1024
#: Posterior from which a segment that no base pattern matches is reported, unless held-out variants allow a lower one.
SURE = 0.95
#: Posteriors that are tried, and the precision that each kind has to have on held-out variants and look-alikes.
_LEVELS, LEAST_PRECISION = (0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995), 0.99
#: Invented texts that the field is fitted on and, others, that its posteriors are chosen on.
INVENTED, HELD_OUT = 400, 400
OUTSIDE = len(KINDS)
LABELS = len(KINDS) + 1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
#: Every run of digits, with the three that follow it if they do: a run that begins no address is passed over as a whole.
_RUN_OR_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
#: In brackets, or as a word between blanks where what follows is a name and a "dot" as well.
_BRACKET_AT = re.compile(r"[\[(] ?at ?[\])]|\bat\b(?= [A-Za-z0-9-]{1,63} dot [A-Za-z])", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"[\[(] ?dot ?[\])]|\bdot\b", re.IGNORECASE)
_ANCHOR = re.compile(r"@|[\[(] ?(?:at|dot) ?[\])]|\bat (?=[A-Za-z0-9-]{1,63} dot [A-Za-z])|(?<= )dot (?=[A-Za-z])|[0-9](?:[ ().+/\[\]-]{0,3}[0-9])*", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, in order of kind and start; matches that fail their test are dropped."""
    out: list[Span] = []
    # A local part never holds an "@", so each is looked at once: from the start of its local part, or from the match before.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    if _DOTTED.search(text):
        for m in _RUN_OR_IP.finditer(text):
            if m.group(1) and all(map(_small, m.group().split("."))):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of words around "@", bracketed "at" or "dot" and runs of enough digits, joined where at most two characters part them.

    A bracketed word stands between the words that it joins, so those come along. A word is followed for REACH
    characters at most.
    """
    found: list[tuple[int, int]] = []
    for m in _ANCHOR.finditer(text):
        start, end = m.span()
        if found and end <= found[-1][1]:
            continue
        if "0" <= text[start] <= "9" and end - start - sum(map(m.group().count, _BETWEEN)) < LEAST_DIGITS:
            continue
        if text[start] in "[(adAD":
            start -= start > 0 and text[start - 1] == " "
            end += end < len(text) and text[end] == " "
        least, most = max(0, start - REACH), min(len(text), end + REACH)
        while start > least and not text[start - 1].isspace():
            start -= 1
        while end < most and not text[end].isspace():
            end += 1
        # A word that is cut here is too long for an entity: no part of it is taken for a word.
        while start == least > 0 and start < m.start() and text[start - 1].isalnum() and text[start].isalnum():
            start, least = start + 1, least + 1
        while end == most < len(text) and end > m.end() and text[end].isalnum() and text[end - 1].isalnum():
            end, most = end - 1, most - 1
        if found and start - found[-1][1] <= 2:
            found[-1] = (min(start, found[-1][0]), max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def _holds_anchor(part: str) -> bool:
    return any(m[0] not in "0123456789" or sum(map(str.isdigit, m)) >= LEAST_DIGITS for m in map(re.Match.group, _ANCHOR.finditer(part)))


def candidates(text: str, spans: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, end) by tokens of the segments that can be entities, by end, then from the nearest start on."""
    tokens = [text[a:b] for a, b in spans]
    place = {a: i for i, (a, _) in enumerate(spans)}
    after = {b: i + 1 for i, (_, b) in enumerate(spans)}
    # Of each token: where an "at", or a dot, that begins with it ends.
    at = {i: i + 1 for i, t in enumerate(tokens) if t == "@"}
    at |= {place[m.start()]: after[m.end()] for m in _BRACKET_AT.finditer(text) if m.start() in place and m.end() in after}
    dot = {i: i + 1 for i, t in enumerate(tokens) if t == "."}
    dot |= {place[m.start()]: after[m.end()] for m in _BRACKET_DOT.finditer(text) if m.start() in place and m.end() in after}
    digit = [len(t) if "0" <= t[0] <= "9" else 0 for t in tokens]
    between = [_BETWEEN.issuperset(t) for t in tokens]
    out = []
    last_at = -1
    for e in range(1, len(tokens) + 1):
        if e - 1 in at:
            last_at = e - 1
        tail = tokens[e - 1]
        if not (tail[0].isalnum() or tail == ")"):
            continue
        digits, numeric, ats, dotted = 0, True, 0, False
        for b in range(e - 1, max(-1, e - 1 - MOST_TOKENS), -1):
            if spans[e - 1][1] - spans[b][0] > REACH:
                break
            digits += digit[b]
            numeric = numeric and (digit[b] > 0 or between[b]) and digits <= MOST_DIGITS
            if not numeric and not ats and last_at < max(0, e - MOST_TOKENS):
                break
            ats += at.get(b, e + 1) <= e
            if ats > 1:
                break
            dotted = dotted or (not ats and dot.get(b, e + 1) <= e)
            head = tokens[b][0]
            if ats and dotted and b not in at and (head.isalnum() or head in "_%+"):
                out.append((b, e))
            elif not ats and numeric and digits >= LEAST_DIGITS and (digit[b] or head in "+("):
                out.append((b, e))
    return out


_DIGITS = (7, 9, 11, 12, 13, 16, 17, 20)
#: Words before a segment that say what it is, in lower case, by kind; and those that say it is something else.
_CUES = tuple(re.compile(p) for p in (r"mail|write|contact|reach", r"\bip\b|host|server|addr", r"card|visa|paid|pay|charge", r"tel|phone|call|mobile|fax|ring|dial", r"isbn|issn|order|ref|no\.|\bid\b|version|page|total|date|serial"))
_SHAPES = tuple(re.compile(p) for p in (r"0[1-9].*", r"00.*", r"\(.*", r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}", r"(19|20)[0-9]{2}[ ./-].*", r"97[89][ -].*", r"[0-9]{4}([./ -]+)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", r"[0-9]{1,3}( ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}"))
#: Characters before a segment that cues are looked for in.
_CONTEXT = 16
FEATURES = 16 + len(_DIGITS) + 1 + len(_CUES) + len(_SHAPES) + 2


@lru_cache(maxsize=50_000)
def _features(segment: str, before: str, after: str) -> bytes:
    """What holds of a segment as a whole, and of the characters beside it."""
    context, before = before.lower(), before[-1:]
    digits = re.sub("[^0-9]", "", segment)
    parts = segment.split(".")
    halves = re.split(r"@|\s*[\[(] ?at ?[\])]\s*| at ", segment, flags=re.IGNORECASE)
    groups = [len(g) for g in re.findall("[0-9]+", segment)]
    f = [
        1.0,
        "@" in segment,
        _BRACKET_AT.search(segment) is not None,
        len(halves) == 2 and re.fullmatch(r"[\w.%+-]+((\s*[\[(] ?dot ?[\])]\s*| dot )[\w.%+-]+)*", halves[0]) is not None,
        len(halves) == 2 and re.fullmatch(r"[A-Za-z0-9-]+((\.|\s*[\[(] ?dot ?[\])]\s*| dot )[A-Za-z0-9-]+)+", halves[1]) is not None,
        segment[0] == "+",
        re.fullmatch(r"\+?[0-9 ().-]+", segment) is not None,
        "(" in segment and ")" in segment and segment.index("(") < segment.rindex(")"),
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts),
        13 <= len(digits) <= 19 and luhn(digits),
        len(groups) > 1 and set(groups[:-1]) == {4},
        len(groups) in (2, 3, 4, 5) and 2 <= min(groups) and max(groups) <= 5 and not set(segment) - set("0123456789+() -."),
        len(groups) == 1 and len(segment) == len(digits),
        any(c.isalpha() for c in segment),
        segment[0].isspace() or segment[-1].isspace() or segment[-1] in "-.,;(:" or segment[0] in "-.,;):",
        (before.isalnum() and segment[0].isalnum()) or (after.isalnum() and segment[-1].isalnum()) or (before in "+.-/" and before != "") or after in ("-", "/", "@"),
    ]
    bucket = sum(len(digits) >= d for d in _DIGITS)
    f += [bucket == i for i in range(len(_DIGITS) + 1)]
    f += [c.search(context) is not None for c in _CUES]
    f += [c.fullmatch(segment) is not None for c in _SHAPES]
    f += [" dot " in segment and " at " in segment, len(digits) > 0 and ("[" in segment or "]" in segment)]
    return np.array(f, np.float64).tobytes()


class Lattice:
    """The segments of one stretch, by end, with their features: single tokens and candidates, ``gold`` spans in any case."""

    def __init__(self, text: str, before: str = "", after: str = "", gold: Sequence[Span] = ()):
        self.spans = [m.span() for m in _TOKEN.finditer(text)]
        n = len(self.spans)
        starts, ends = {a: i for i, (a, _) in enumerate(self.spans)}, {b: i + 1 for i, (_, b) in enumerate(self.spans)}
        #: Gold spans by tokens; a span that begins or ends inside a token is an error of whoever gives it.
        self.gold = [(kind, starts[a], ends[b]) for kind, a, b in gold]
        can = {*candidates(text, self.spans), *((b, e) for _, b, e in self.gold)}
        self.begin, self.end, rows = [], [], []
        self.by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for e, b in sorted({(e, b) for b, e in can} | {(e, e - 1) for e in range(1, n + 1)}):
            self.by_end[e].append(len(rows))
            self.begin.append(b)
            self.end.append(e)
            lo, hi = self.spans[b][0], self.spans[e - 1][1]
            context = text[max(0, lo - _CONTEXT) : lo] if lo >= _CONTEXT else (before + text[:lo])[-_CONTEXT:]
            rows.append(_features(text[lo:hi], context, text[hi : hi + 1] or after))
        self.x = np.frombuffer(b"".join(rows), np.float64).reshape(-1, FEATURES)
        pairs = list(zip(self.begin, self.end, strict=True))
        #: Outside segments are single tokens; entities need an anchor.
        self.barred = np.zeros((len(rows), LABELS), bool)
        self.barred[[p not in can for p in pairs], :OUTSIDE] = True
        self.barred[[e - b > 1 for b, e in pairs], OUTSIDE] = True
        self.n = n

    def scores(self, w: np.ndarray) -> np.ndarray:
        s = self.x @ w
        s[self.barred] = -1e9
        return s


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """Weights of features by type (the last is outside) and of neighbouring types (a further row for the start)."""

    def __init__(self) -> None:
        self.w = np.zeros((FEATURES, LABELS))
        self.t = np.zeros((LABELS + 1, LABELS))
        #: Posterior from which a segment of each kind is reported.
        self.sure = np.full(OUTSIDE, SURE)

    def passes(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probabilities, up to a constant, of reaching each end with each type and of going on from there; scores."""
        s = lattice.scores(self.w)
        begin = np.array(lattice.begin)
        alpha = np.full((lattice.n + 1, LABELS + 1), -1e9)
        alpha[0, LABELS] = 0.0
        enter = np.zeros((lattice.n + 1, LABELS))
        for e in range(lattice.n + 1):
            if e:
                rows = lattice.by_end[e]
                alpha[e, :LABELS] = _logsum(s[rows] + enter[begin[rows]], 0)
            enter[e] = _logsum(alpha[e][:, None] + self.t, 0)
        beta = np.full((lattice.n + 1, LABELS), -1e9)
        beta[lattice.n] = 0.0
        ahead: list[list[int]] = [[] for _ in range(lattice.n + 1)]
        for i, b in enumerate(lattice.begin):
            ahead[b].append(i)
        end = np.array(lattice.end)
        go = np.full((lattice.n + 1, LABELS), -1e9)
        for b in range(lattice.n - 1, -1, -1):
            rows = ahead[b]
            go[b] = _logsum(s[rows] + beta[end[rows]], 0)
            beta[b] = _logsum(self.t[:LABELS] + go[b][None, :], 1)
        self._enter, self._go = enter, go
        return alpha, beta, s

    def posteriors(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each (segment, type), and of each pair of neighbouring types at each place, summed."""
        alpha, beta, s = self.passes(lattice)
        total = _logsum(alpha[lattice.n][:LABELS], 0)
        begin, end = np.array(lattice.begin), np.array(lattice.end)
        segment = np.exp(np.minimum(0, self._enter[begin] + s + beta[end] - total))
        pair = np.exp(np.minimum(0, alpha[: lattice.n, :, None] + self.t[None] + self._go[: lattice.n, None, :] - total)).sum(axis=0)
        return segment, pair

    def best(self, lattice: Lattice) -> list[tuple[int, int]]:
        """(segment, type) of the best segmentation, left to right."""
        s = lattice.scores(self.w)
        score = np.full((lattice.n + 1, LABELS + 1), -1e9)
        score[0, LABELS] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for e in range(1, lattice.n + 1):
            rows = lattice.by_end[e]
            into = score[[lattice.begin[r] for r in rows]][:, :, None] + self.t[None]
            came = into.argmax(axis=1)
            value = into.max(axis=1) + s[rows]
            pick = value.argmax(axis=0)
            for y in range(LABELS):
                score[e, y] = value[pick[y], y]
                back[e, y] = (rows[pick[y]], int(came[pick[y], y]))
        path, e, y = [], lattice.n, int(score[lattice.n, :LABELS].argmax())
        while e > 0:
            row, previous = back[e, y]
            path.append((row, y))
            e, y = lattice.begin[row], previous
        return path[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, rate: float = 0.5, keep: float = 1e-3) -> Field:
        """Stochastic gradient ascent with a step of its own for each weight."""
        data = []
        for text, spans in examples:
            lattice = Lattice(text, gold=spans)
            at = {(b, e): r for r, (b, e) in enumerate(zip(lattice.begin, lattice.end, strict=True))}
            gold, place = [], 0
            for kind, b, e in sorted(lattice.gold, key=lambda x: x[1]):
                assert (b, e) in at and not lattice.barred[at[b, e], kind], "an entity is no candidate"
                if place <= b:  # of overlapping entities the first
                    gold += [(at[i, i + 1], OUTSIDE) for i in range(place, b)] + [(at[b, e], kind)]
                    place = e
            gold += [(at[i, i + 1], OUTSIDE) for i in range(place, lattice.n)]
            if lattice.n:
                data.append((lattice, gold))
        rng = random.Random(1)
        sw, st = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6)
        for _ in range(epochs):
            rng.shuffle(data)
            for lattice, gold in data:
                segment, pair = self.posteriors(lattice)
                gw, gt = -(lattice.x.T @ segment) - keep * self.w, -pair - keep * self.t
                before = LABELS
                for row, y in gold:
                    gw[:, y] += lattice.x[row]
                    gt[before, y] += 1
                    before = y
                sw += gw**2
                st += gt**2
                self.w += rate * gw / np.sqrt(sw)
                self.t += rate * gt / np.sqrt(st)
        return self


def variants(text: str, spans: list[Span], rng: random.Random) -> tuple[str, list[Span]]:
    """The stretch with its entities in a form that the base patterns don't match, or as it is."""
    out, place, kept = [], 0, []
    length = 0
    for kind, lo, hi in sorted(spans, key=lambda x: x[1]):
        if lo < place:
            continue
        entity = text[lo:hi]
        if rng.random() < 0.5:
            if kind == 0:
                entity = entity.replace("@", rng.choice([" (at) ", " [at] ", "(at)"]))
                entity = entity.replace(".", rng.choice([".", " [dot] "])) if "[at]" in entity else entity
            elif kind == 3 and not text[max(place, lo - 1) : lo].isdigit():
                entity = re.sub(r"^\+[0-9]+[ -]?", "", entity) if rng.random() < 0.6 and sum(c.isdigit() for c in entity) > 10 else entity.replace("+", "00", 1)
        gap = text[place:lo]
        out += [gap, entity]
        length += len(gap)
        kept.append((kind, length, length + len(entity)))
        length += len(entity)
        place = hi
    return "".join(out) + text[place:], kept


# Fixed examples, so that a table without any match gives a usable field: invented entities and what only looks like them.
_EXAMPLES = (
    "jo.lee@mail.example.com", "write to (ana+x@example.org).", "+1 (555) 010-9999", "call +44 20 7946 0958 now", "192.0.2.17", "4111 1111 1111 1111", "5500-0055-5555-5559", "378282246310005",
    "2024-01-31 12:30:59", "1234567890123456789012", "v1.2.3.4.5.6.7", "@handle", "12345678", "0x1234567890ab", "3.14159265358979", "10000000 20000000", "id=20240131000017", "00000000-0000-0000-0000-000000000000",
    "b2738823e8272e17ae68ce8fbcf259ea872fca78", "1,234,567,890", "1999-2024, 2001-2002", "99.99.99.999.99", "8765432109876543",
)


_WORDS = "the we you sent plan office north paper later today green river meeting list house about under letter since".split()
_NAMES = "jo ana bob lee mia sam kim max eva tom".split()
_DOMAINS = "mail example site post web team".split()


def _luhn_number(rng: random.Random, length: int) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(length - 2))
    body = rng.choice("3456") + body
    return next(body + c for c in "0123456789" if luhn(body + c))


def _email(rng: random.Random) -> tuple[str, str]:
    at, dot = rng.choice([(" (at) ", "."), (" [at] ", "."), ("(at)", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), (" AT ", " DOT "), (" at ", " dot ")])
    inner = dot if "dot" in dot.lower() and " at " not in at.lower() and rng.random() < 0.3 else "."
    user = rng.choice([rng.choice(_NAMES), rng.choice(_NAMES) + inner + rng.choice(_NAMES), f"{rng.choice(_NAMES)}_{rng.randint(1, 99)}", f"{rng.choice(_NAMES)}{rng.randint(1, 99)}"])
    host = dot.join([rng.choice(_DOMAINS), *([rng.choice(_DOMAINS)] if rng.random() < 0.3 and " at " not in at.lower() else []), rng.choice(["com", "org", "net", "de", "co"])])
    return rng.choice(["mail ", "write to ", "contact: ", "reach me at ", "", ""]), user + at + host


def _ip(rng: random.Random) -> tuple[str, str]:
    parts = [str(rng.choice([10, 172, 192, rng.randint(100, 255)])), *[str(rng.randint(10, 255)) for _ in range(3)]]
    return rng.choice(["host ", "server ", "ip ", "", "from "]), rng.choice(["[.]", "(.)", " . "]).join(parts)


def _card(rng: random.Random) -> tuple[str, str]:
    number, sep = _luhn_number(rng, 16), rng.choice([".", "/", "  ", " - "])
    return rng.choice(["card ", "visa ", "paid with ", "", "charge "]), sep.join(number[i : i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random) -> tuple[str, str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    area = rng.choice("23456789") + d(2)
    forms = [
        f"00{rng.choice([44, 49, 33, 1])} {rng.choice('123456789')}{d(1)} {d(4)} {d(4)}", f"00{rng.choice([44, 49, 33])}{d(9)}", f"({area}) {d(3)}-{d(4)}", f"({area}) {d(3)} {d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}",
        f"0{rng.choice('123456789')}{d(1)} {d(4)} {d(4)}", f"0{rng.choice('123456789')}{d(2)}/{d(7)}", f"0{rng.choice('123456789')}{d(3)} {d(6)}", f"(0{rng.choice('123456789')}{d(1)}) {d(4)} {d(4)}",
    ]
    return rng.choice(["call ", "tel ", "tel. ", "phone: ", "fax ", "ring me on ", "mobile ", "", ""]), rng.choice(forms)


def _look_alike(rng: random.Random) -> tuple[str, str]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    year, month, day = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    failing = _luhn_number(rng, 16)
    failing = failing[:-1] + str((int(failing[-1]) + rng.randint(1, 9)) % 10)
    sep = rng.choice([" ", "-", ".", "/", "  "])
    forms = [
        ("", f"{year}-{month:02}-{day:02} {rng.randint(0, 23):02}:{rng.randint(0, 59):02}"), ("", f"{day:02}.{month:02}.{year}"), ("from ", f"{year}-{year + 3}, {year + 5}-{year + 9}"), ("isbn ", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"), ("", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"),
        ("total ", f"{d(1)},{d(3)},{d(3)},{d(3)}"), ("", f"{rng.randint(1, 9)}{d(1)} {d(3)} {d(3)}"), ("order ", f"{year}/{d(4)}/{d(4)}"), ("ref ", f"{d(4)}-{d(4)}-{d(4)}"), ("version ", f"{d(2)}.{d(1)}.{d(1)}.{d(4)}"), ("", f"3.14{d(10)}"),
        ("id ", d(rng.randint(7, 20))), ("", d(rng.randint(7, 20))), ("", sep.join(failing[i : i + 4] for i in range(0, 16, 4))), ("", "".join(rng.choice("0123456789abcdef") for _ in range(32))), ("", f"{d(8)}-{d(4)}-{d(4)}-{d(4)}-{d(12)}"),
        ("page ", f"{d(2)} ({year}) {d(3)}-{d(3)}"), ("", f"@{rng.choice(_NAMES)}"), ("", f"{rng.choice(_NAMES)} looked at {rng.choice(_WORDS)}.{rng.choice(_WORDS)}"), ("", f"a dot on the map at {rng.choice(_WORDS)}"), ("", f"{d(3)} + {d(3)} - {d(4)}"), ("", f"{d(8)} {d(8)}"), ("", f"{rng.choice(_WORDS)} [at] {rng.choice(_WORDS)} (dot)"),
    ]
    return rng.choice(forms)


def invented(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Texts with one entity in a form that the base patterns miss, or with what only looks like one; a seed fixes them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        maker = (_email, _phone, _look_alike, _card, _phone, _look_alike, _ip, _look_alike, _email, _look_alike)[i % 10]
        cue, entity = maker(rng)
        words = lambda: " ".join(rng.choice(_WORDS) for _ in range(rng.randint(0, 4)))
        front = f"{words()} {cue}".lstrip()
        text = front + entity + rng.choice(["", ".", ",", " " + words()])
        kind = {_email: 0, _ip: 1, _card: 2, _phone: 3}.get(maker)
        base = base_spans(text)
        spans = [] if kind is None else [(kind, len(front), len(front) + len(entity))]
        if not spans or not any(a < spans[0][2] and b > spans[0][1] for _, a, b in base):
            out.append((text, spans or base))
    return out


def _in_stretches(examples: list[tuple[str, list[Span]]]) -> list[tuple[str, list[Span]]]:
    """The stretches of the texts, with the spans inside them."""
    return [(t[lo:hi], [(k, a - lo, b - lo) for k, a, b in spans if lo <= a and b <= hi]) for t, spans in examples for lo, hi in windows(t)]


def tune(field: Field, held_out: list[tuple[str, list[Span]]]) -> dict[str, tuple[float, float, float]]:
    """Choose each kind's posterior on texts that the field was not fitted on; (posterior, precision, recall) by kind."""
    field.sure = np.full(OUTSIDE, _LEVELS[0])
    scored: list[list[tuple[float, bool]]] = [[] for _ in KINDS]
    wanted = [0] * OUTSIDE
    for text, spans in held_out:
        base = base_spans(text)
        for k, a, b in spans:
            wanted[k] += (k, a, b) not in base
        for level in _LEVELS:
            field.sure[:] = level
            for span in added_spans(field, text, base):
                scored[span[0]].append((level, span in spans))
    told = {}
    for k, name in enumerate(KINDS):
        at = {level: [ok for at, ok in scored[k] if at == level] for level in _LEVELS}
        right = [level for level in _LEVELS if sum(at[level]) >= LEAST_PRECISION * len(at[level])]
        level = right[0] if right else 1.0
        field.sure[k] = level
        found = at.get(level, [])
        told[name] = (level, sum(found) / len(found) if found else 1.0, sum(found) / wanted[k] if wanted[k] else 1.0)
    return told


def _stretch_end(text: str, lo: int, hi: int, spans: list[Span], most_chars: int) -> int:
    """Where the stretch is cut: at ``most_chars``, or after the entities and the token that this falls in."""
    cut = lo + most_chars
    if cut >= hi:
        return hi
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        cut = b if a < cut < b else cut
    inside = next((m.end() for m in _TOKEN.finditer(text, lo, hi) if m.start() < cut <= m.end()), cut)
    return min(hi, inside)


def stretches_of(text: str, most_windows: int = MOST_WINDOWS, most_chars: int = MOST_CHARS) -> list[tuple[str, list[Span]]]:
    """The first ``most_windows`` stretches of a text, each cut after about ``most_chars``, with the base matches inside."""
    spans = sorted(base_spans(text), key=lambda x: x[1])
    begins = [a for _, a, _ in spans]
    out = []
    for lo, hi in windows(text)[:most_windows]:
        near = spans[bisect_left(begins, lo) : bisect_left(begins, hi)]
        stretch = text[lo : _stretch_end(text, lo, hi, near, most_chars)]
        out.append((stretch, sorted((k, a - lo, b - lo) for k, a, b in near if b <= lo + len(stretch))))
    return out


def examples_of(texts: list[str], seed: int = 11, most_windows: int = MOST_WINDOWS, most_chars: int = MOST_CHARS) -> list[tuple[str, list[Span]]]:
    """What the field learns from the fixed examples and the given texts; see :func:`varied`."""
    return varied([s for t in texts for s in stretches_of(t, most_windows, most_chars)], seed, most_windows)


def varied(stretches: list[tuple[str, list[Span]]], seed: int = 11, most_windows: int = MOST_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Stretches with their base matches, once as they are and once varied, the fixed ones first; a seed fixes the draws.

    ``most_windows`` bounds their number, by a sample of whole stretches.
    """
    rng = random.Random(seed)
    out, fixed = [], []
    for known, found in ((True, [s for t in _EXAMPLES for s in stretches_of(t)]), (False, stretches)):
        for stretch, inside in found:
            out.append((stretch, inside))
            if inside:
                out.append(variants(stretch, inside, rng))
        if known:
            fixed, out = out, []
    if len(fixed) + len(out) > most_windows:
        out = rng.sample(out, min(len(out), max(0, most_windows - len(fixed))))
    return fixed + _in_stretches(invented(INVENTED, seed)) + out


def _pieces(tokens: int) -> list[tuple[int, int, int, int]]:
    """(first, end, own first, own end) of the lattices over so many tokens: what begins in its own part is theirs."""
    step = LATTICE_TOKENS - 2 * MOST_TOKENS
    if tokens <= LATTICE_TOKENS:
        return [(0, tokens, 0, tokens)]
    return [(max(0, i - MOST_TOKENS), min(tokens, i + step + MOST_TOKENS), i, i + step) for i in range(0, tokens, step)]


def added_spans(field: Field, text: str, base: list[Span]) -> list[Span]:
    """Segments that the field is sure of and that touch no base match."""
    out = []
    taken = np.array(sorted((a, b) for _, a, b in base), np.int64).reshape(-1, 2)
    # Base matches may overlap, so a segment is free if no match that begins before its end reaches beyond its start.
    begins, reach = taken[:, 0], np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

    def free(a: int, b: int) -> bool:
        before = int(np.searchsorted(begins, b))
        return before == 0 or reach[before - 1] <= a

    for lo, hi in windows(text):
        # An added segment lies between base matches, so a stretch where nothing is left there has nothing to add.
        edges = taken[np.searchsorted(reach, lo, side="right") : np.searchsorted(begins, hi)]
        gaps = zip([lo, *np.maximum.accumulate(edges[:, 1]).tolist()], [*edges[:, 0].tolist(), hi], strict=True)
        if not any(a < b and _holds_anchor(text[a:b]) for a, b in gaps):
            continue
        spans = [m.span() for m in _TOKEN.finditer(text, lo, hi)]
        for first, end, own, own_end in _pieces(len(spans)):
            a, b = spans[first][0], spans[end - 1][1]
            tokens = [(x - a, y - a) for x, y in spans[first:end]]
            if not any(free(a + tokens[i][0], a + tokens[j - 1][1]) for i, j in candidates(text[a:b], tokens)):
                continue
            lattice = Lattice(text[a:b], text[max(0, a - _CONTEXT) : a], text[b : b + 1])
            path = field.best(lattice)
            if all(y == OUTSIDE for _, y in path):
                continue
            segment, _ = field.posteriors(lattice)
            for row, y in path:
                if y != OUTSIDE and segment[row, y] >= field.sure[y] and own <= first + lattice.begin[row] < own_end:
                    x, z = a + lattice.spans[lattice.begin[row]][0], a + lattice.spans[lattice.end[row] - 1][1]
                    if free(x, z):
                        out.append((y, x, z))
    return out


def field_of(key: str, shared) -> Field:
    def build() -> Field:
        field = Field()
        field.w, field.t, field.sure = shared.value
        return field

    return held(f"field {key}", build)


_LIKELY = r"@|\+[0-9]|[0-9]{4}[ -]?[0-9]{4}|[0-9]\.[0-9]+\.[0-9]"


def fit_field(
    docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS, most_chars: int = MOST_CHARS,
) -> Field:
    """The field fitted on at most ``sample`` different documents that look as if they held base matches, the first by hash.

    Only rows whose hash is below a bound are looked at; the bound follows from the number of rows and is raised until
    there are enough. Tasks cut the stretches, so that what reaches the driver is bounded by the three parameters.
    """
    chance = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(chance.alias("h"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = [stretches_of(t, most_windows, most_chars) for t in texts]
            stretch = pa.array([[s for s, _ in f] for f in found], pa.list_(pa.string()))
            spans = pa.array([[[x for span in inside for x in span] for _, inside in f] for f in found], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([part.column(0), stretch, spans], ["h", "stretches", "spans"])

    n, share = docs.count(), 64.0
    while True:
        bound = min(1.0, share * sample / max(1, n))
        near = rows.filter(F.pmod("h", F.lit(1 << 40)) < int(bound * (1 << 40))).filter(F.col("text").rlike(_LIKELY))
        slim = near.mapInArrow(cut, "h long, stretches array<string>, spans array<array<int>>").dropDuplicates(["h"])
        order = F.pmod("h", F.lit(1 << 40))
        found = slim.orderBy(order, "h").limit(sample).collect()
        if len(found) >= sample or bound == 1:
            break
        share *= 8
    stretches = [(s, list(zip(flat[::3], flat[1::3], flat[2::3], strict=True))) for r in found for s, flat in zip(r.stretches, r.spans, strict=True)]
    field = Field().fit(varied(stretches, most_windows=most_windows))
    tune(field, invented(HELD_OUT, seed=-1))
    return field


def named(spans: list[Span]) -> str:
    """kind:start:end by kind as listed, then start, joined by commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    out, place = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[place:a], f"[{KINDS[k].upper()}]"]
        place = b
    return "".join(out) + text[place:]


def find_pii(
    docs: DataFrame, sample: int = SAMPLE, mask: bool = False, id_col: str = "doc_id", text_col: str = "text", most_windows: int = MOST_WINDOWS, most_chars: int = MOST_CHARS,
) -> DataFrame:
    """Personal data in every whole text of ``docs``.

    Returns for each row: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans (base matches and
    what the field adds, by kind and start; offsets in code points, end exclusive) and added (the latter alone). With
    ``mask`` the result is ``docs`` itself with spans replaced in the text by their kind, a null text staying null.
    Null and empty texts have no spans. Very long texts are read whole, in time linear in their length. Rows are worked
    on where they are; null and repeated ids are rows like any other, repeated rows give equal results. Of spans of two
    kinds that overlap both are base matches; of equally good segmentations the field takes the one whose segments
    begin first. Other columns are ignored (with ``mask``: kept). An empty table gives no rows. ``sample``,
    ``most_windows`` and ``most_chars`` bound only what the field is fitted on: documents, stretches of them, and about
    the characters of a stretch.
    """
    field = fit_field(docs, sample, id_col, text_col, most_windows, most_chars)
    shared = docs.sparkSession.sparkContext.broadcast((field.w, field.t, field.sure))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field_of(key, shared)
        for part, texts in slices(batches):
            rows = []
            for t in texts:
                base = base_spans(t)
                rows.append((base, added_spans(model, t, base)))
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in rows], pa.int64()) for kind in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(named(base).encode()).hexdigest() for base, _ in rows], pa.string())
            spans, added = (pa.array([named(s) for s in column], pa.string()) for column in ([b + m for b, m in rows], [m for _, m in rows]))
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, spans, added], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "added"])

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = field_of(key, shared)
        for part, texts in slices(batches, text_col):
            at = part.schema.get_field_index(text_col)
            present = part.column(at).is_valid().to_pylist()
            new = []
            for t, there in zip(texts, present, strict=True):
                base = base_spans(t)
                new.append(masked(t, base + added_spans(model, t, base)) if there else None)
            yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    if mask:
        return docs.mapInArrow(hide, docs.schema)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, added string")
