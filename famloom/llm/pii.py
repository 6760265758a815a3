"""Personal data by patterns and a semi-Markov conditional random field.

Patterns give the base spans.  The field adds others: a region of neighbouring
chunks (runs free of white space, across one line break at a time) that hold
digits or ``@`` is cut into segments of up to ``LONGEST`` chunks, each scored as a
whole (shape, digits, checksums, the words before it) for each type that its form
allows, and a Viterbi pass over segments chooses boundaries and types together.
Segments of several chunks are numbers in groups; one chunk, such as a long key
or a JSON web token, is looked at whole at any length.  Chunks outside such
regions can only be plain, so regions are independent of one another.

The field is trained here, by gradient ascent on the likelihood (semi-Markov
forward-backward) of ``SENTENCES`` generated sentences, the bound of its sample.

Defined results: a null text is empty and has no spans; spans of the field that
touch a base span are dropped; equal rows get equal results; texts, spans and
the distance of a span's words have no limit of length; an empty table gives no
rows; other columns are kept (``redact``) or left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from famloom.llm.common import arrow_batches

BASE, EXTRA = ("email", "ip", "card", "phone"), ("secret", "ssn")
KINDS = (*BASE, *EXTRA)
#: Chunks in a segment, at most; training sentences; passes over them.
LONGEST, SENTENCES, PASSES = 6, 420, 6

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start alone: later starts in it fail as it does, and no match ends inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(number)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                free = m.end()
            else:  # what was looked at belongs to this @ alone
                free = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    found = [(a, b, "email") for a, b in emails(text)]
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 3 or len(p) == 3 and p <= "255" for x in m[0].split("."))]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if 14 <= m.end() - m.start() < 64 and 14 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=_by_start)


def _by_start(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# --- the field -----------------------------------------------------------------

#: Neighbouring chunks with a digit or @, with one line break at most between two.
_REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:(?:[ \t]++(?:\r?\n[ \t]*+)?|\r?\n[ \t]*+)[^\s0-9@]*+[0-9@]\S*+)*")
_CHUNK, _WORD = re.compile(r"\S+"), re.compile(r"[A-Za-z0-9]+")
_OPEN, _CLOSE = "\"'<[{|*#`", "\"'>]}.,;:!?*#$%&|`"
#: Words before a segment that are features.
_HINTS = frozenset("token key secret password apikey api bearer pwd auth phone tel call fax mobile ssn social security number card visa ip host email mail contact commit sha md5 order page version isbn id year invoice ref".split())
_LABELS = ("", *KINDS)
# Forms of the types.
_MAIL = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@.]+")
_IP4 = re.compile(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:[:/][0-9]{1,5})?")
_IP6 = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}")
_GROUPS = re.compile(r"[0-9](?:[ -]?[0-9])*")
_CALL = re.compile(r"[+(]?[0-9][0-9\s().-]*[0-9]")
_SSN = re.compile(r"[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}")
_CODE = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=~-]{16,}|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A chunk that may be part of a number in groups.
_PART = re.compile(r"[+(]{0,2}[0-9][0-9().-]*|[(][0-9]+[)]")


#: What a chunk may set a code equal to.
_NAMED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*(?:=|:|=>)[\"'`]?(?=[^/])")


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """What a chunk holds without marks around it; of ``name=code`` the code."""
    while a < b and text[a] in _OPEN:
        a += 1
    while b > a and text[b - 1] in _CLOSE:
        b -= 1
    if (m := _NAMED.match(text, a, b)) and b - m.end() >= 16 and _CODE.fullmatch(text, m.end(), b):
        a = m.end()
    return a, b


def _is_ip(span: str) -> bool:
    if m := _IP4.fullmatch(span):
        return all(int(x) <= 255 for x in m[1].split("."))
    if not _IP6.fullmatch(span):
        return False
    try:
        ipaddress.IPv6Address(span)
    except ValueError:
        return False
    return True


def allowed(span: str, n: int) -> list[int]:
    """Labels but plain that a span of ``n`` digits may have by its form."""
    out = []
    if "@" in span:
        return [_LABELS.index("email")] if _MAIL.fullmatch(span) else out
    if _is_ip(span):
        out.append(_LABELS.index("ip"))
    if 7 <= n <= 15 and _CALL.fullmatch(span) and not _IP4.fullmatch(span):
        out.append(_LABELS.index("phone"))
    if 13 <= n <= 19 and _GROUPS.fullmatch(flat := re.sub(r"\s+", " ", span)) and luhn(digits(flat)):
        out.append(_LABELS.index("card"))
    if n == 9 and _SSN.fullmatch(span):
        out.append(_LABELS.index("ssn"))
    if len(span) >= 16 and _CODE.fullmatch(span):
        out.append(_LABELS.index("secret"))
    return out


def features(span: str, n: int, chunks: int, hints: list[str], quoted: bool) -> list[str]:
    """Of a whole segment of ``n`` digits."""
    shape = re.sub(r"9{5,}", "9+", re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", re.sub(r"\s*\n\s*", "\n", span))))
    out = ["bias", f"chunks{chunks}", f"digits{min(n, 20)}", f"shape{shape}", *(f"hint{w}" for w in hints)] + ["nohint"] * (not hints)
    out += ["quoted"] * quoted + ["at"] * ("@" in span) + ["plus"] * span.startswith("+") + ["paren"] * ("(" in span) + ["broken"] * ("\n" in span)
    if _CODE.fullmatch(span):
        parts = [x for x in re.split(r"[/_.~+=-]", span) if x]
        words = sum(x.isalpha() and len(x) > 2 for x in parts)
        kind = "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span) else "jwt" if "." in span else "mixed" if re.search("[A-Z]", span) and re.search("[a-z]", span) else "low"
        out += ["code", f"code{kind}", f"code{min(len(span) // 8, 8)}", *(f"code{w}" for w in hints), f"parts{min(len(parts), 4)}"] + ["wordy"] * (2 * words >= len(parts)) + ["nohintcode"] * (not hints)
    return out


class Chunks:
    """The chunks of a region, with what every segment of them asks for."""

    def __init__(self, text: str, start: int, region: str, words: list[tuple[int, int]]):
        self.text, self.words = text, words
        self.at = [(start + c.start(), start + c.end()) for c in _CHUNK.finditer(region)]
        self.core = [_trimmed(text, a, b) for a, b in self.at]
        self.many = [sum("0" <= x <= "9" for x in text[s:e]) for s, e in self.core]
        self.part = [bool(_PART.fullmatch(text, s, e)) for s, e in self.core]

    def __len__(self) -> int:
        return len(self.at)

    def _hints(self, at: int) -> list[str]:
        """Of the two words before ``at`` those that are hints, wherever they stand."""
        k = bisect_left(self.words, (at, 0))
        near = [self.text[a:b].lower() for a, b in self.words[max(0, k - 2) : k] if b - a < 12]
        return [w for w in near if w in _HINTS]

    def ends(self, i: int) -> Iterator[int]:
        """Ends of segments from chunk ``i``: itself, and on as long as the chunks can be one number."""
        yield i + 1
        n = self.many[i]
        for j in range(i + 1, min(i + LONGEST, len(self))):
            n += self.many[j]
            if not (self.part[j - 1] and self.part[j]) or self.core[j - 1][1] != self.at[j - 1][1] or self.core[j][0] != self.at[j][0] or n > 19:
                return
            yield j + 1

    def segment(self, i: int, j: int) -> tuple[list[str], list[int]] | None:
        """Features of a segment and the labels it may have; plain chunks that can be nothing else have no features, other segments are none."""
        s, e = self.core[i][0], self.core[j - 1][1]
        n = sum(self.many[i:j])
        may = allowed(self.text[s:e], n) if s < e and (n >= 7 or "@" in self.text[s:e] or j == i + 1) else []
        if not may:
            return ([], [0]) if j == i + 1 else None
        quoted = s > self.at[i][0] and self.text[s - 1] in "\"'`"
        return features(self.text[s:e], n, j - i, self._hints(s), quoted), [*([0] if j == i + 1 else []), *may]


class Field:
    """Weights by feature and label, and for the step from one label to the next."""

    #: Feature sets whose scores are remembered.
    KEPT = 1 << 15

    def __init__(self, names: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.names, self.weights, self.steps = names, weights, steps
        self._known: dict[tuple[int, ...], list[float]] = {}

    def segments(self, chunks: Chunks) -> Iterator[tuple[int, int, tuple[int, ...], list[int]]]:
        """(first chunk, end, features, labels it may have)."""
        for i in range(len(chunks)):
            for j in chunks.ends(i):
                if (got := chunks.segment(i, j)) is not None:
                    yield i, j, tuple(self.names[f] for f in got[0] if f in self.names), got[1]

    def score(self, found: tuple[int, ...]) -> list[float]:
        got = self._known.get(found)
        if got is None:
            if len(self._known) >= self.KEPT:
                self._known.clear()
            got = self._known[found] = self.weights[list(found)].sum(axis=0).tolist()
        return got

    def best(self, chunks: Chunks) -> list[tuple[int, int, int]]:
        """(first chunk, end, label) of the best segmentation."""
        n, k, steps = len(chunks), range(len(_LABELS)), self.steps.tolist()
        low = float("-inf")
        best = [[low] * len(_LABELS) for _ in range(n + 1)]
        back: list[list] = [[None] * len(_LABELS) for _ in range(n + 1)]
        best[0][0] = 0.0
        for i, j, found, labels in self.segments(chunks):
            score, row = self.score(found), best[i]
            for y in labels:
                before = max(k, key=lambda x: row[x] + steps[x][y])  # noqa: B023
                value = row[before] + steps[before][y] + score[y]
                if value > best[j][y]:
                    best[j][y], back[j][y] = value, (i, before)
        out, j, y = [], n, max(k, key=lambda x: best[n][x])
        while j:
            i, before = back[j][y]
            out.append((i, j, y))
            j, y = i, before
        return out[::-1]


def _sum_exp(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis=axis)


def generated(seed: int = 4, many: int = SENTENCES) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences of made-up words with personal data and numbers that look alike, and their spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "tion", "la", "be", "sch", "ou", "in", "the", "re")) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def code(n: int, of: str = "0123456789abcdef") -> str:
        return "".join(r.choice(of) for _ in range(n))

    def card() -> str:
        x = number(15)
        x = next(x + d for d in "0123456789" if luhn(x + d))
        sep = r.choice(("", "", " ", "-"))
        return sep.join(x[i : i + 4] for i in range(0, 16, 4))

    alnum = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def secret() -> str:
        n = r.choice((20, 24, 32, 40, 40, 64, 100, 300))
        x = r.choice((code(n), code(n, alnum), code(n, alnum), code(n, alnum + "_-"), code(n, alnum + "+/") + "==", f"eyJ{code(20, alnum)}.eyJ{code(60, alnum)}.{code(43, alnum)}"))
        return x if re.search("[0-9]", x) and re.search("[a-zA-Z]", x) else "a1" + x[2:]

    area, line = lambda: number(3), lambda: f"{number(3)}-{number(4)}"
    kinds = {
        "email": lambda: ("", f"{word()}{r.choice(('', '.', '_'))}{number(2)}@{word()}{number(1)}.{r.choice(('com', 'org', 'example.com'))}", ""),
        "ip": lambda: (r.choice(("", "host ", "ip ")), r.choice((".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(code(4) for _ in range(8)), f"fe80::{code(4)}:{code(4)}")), ""),
        "card": lambda: (r.choice(("", "card ", "visa ")), card(), ""),
        "phone": lambda: r.choice((("", f"+1 ({area()}) {line()}", ""), ("call ", f"({area()}) {line()}", ""), ("phone ", f"{area()}-{line()}", ""), ("tel ", f"+{number(2)} {number(3)} {number(3)} {number(4)}", ""), ("call ", line(), ""), ("", f"{area()}-{line()}", ""), ("", f"+1 {area()}\n{line()}", ""), ("phone: ", f"({area()})\n{line()}", ""))),
        "secret": lambda: r.choice((('token = "', secret(), '"'), ("password: ", secret(), ""), ("secret key ", secret(), ""), ("bearer ", secret(), ""), ('apikey="', secret(), '"'), ("api_key: ", secret(), ""), ('API_KEY="', secret(), '"'), ("token=", secret(), ""), ("password is ", secret(), ""), ('"token": "', secret(), '"'))),
        "ssn": lambda: (r.choice(("ssn ", "social security number ", "ssn: ")), f"{number(3)}-{number(2)}-{number(4)}", ""),
    }
    plain = (
        lambda: f"version {number(1)}.{number(1)}.{number(1)}", lambda: f"in {r.randint(1800, 2050)}-{number(2)}-{number(2)}", lambda: f"order {number(8)}", lambda: f"commit {code(40)}", lambda: f"page {number(3)} of {number(3)}",
        lambda: f"{number(3)},{number(3)},{number(3)}", lambda: f"isbn 978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{number(16)[:15]}{number(6)}", lambda: f"sha {code(32)}", lambda: f"{number(10)}", lambda: f"md5 {code(32)}",
        lambda: f"{number(4)} {number(4)} {number(2)}", lambda: f"invoice {number(3)}-{number(2)}-{number(4)}", lambda: f"{word()} @ {number(2)}",
        lambda: f"https://{word()}.com/{word()}/{code(16)}?q={number(1)}", lambda: f"http://{word()}.org/{number(4)}/{number(2)}/{word()}-{word()}", lambda: f"/usr/{word()}/{word()}{number(1)}/{word()}-{number(3)}", lambda: f"{word()}/{word()}{number(1)}/{word()}/{word()}",
        lambda: f"{code(8)}-{code(4)}-{code(4)}-{code(4)}-{code(12)}", lambda: f"{word()}-{number(4)}-{word()}-v{number(1)}-{word()}", lambda: f"IMG_{number(8)}_{number(6)}_{word()}", lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}:{number(2)}",
        lambda: line(), lambda: f"{number(5)}\n{number(5)}\n{number(4)}", lambda: f"{number(3)} {number(4)}\n{number(3)} {number(4)}", lambda: f"{code(40)} {word()}", lambda: f"id {code(24)}", lambda: f"id={code(24)}", lambda: f"sha256:{code(64)}", lambda: f"commit={code(40)}", lambda: f"{word()}_{word()}_{number(4)}_{word()}_{word()}",
        lambda: f"{number(8)} {number(8)}", lambda: f"{number(8)} {number(8)} {number(8)}", lambda: f"{number(6)} {number(5)} {number(4)}", lambda: f"ref {number(12)}", lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{number(4)}.{number(2)}.{number(2)}.{number(4)}",
    )
    out = []
    for k in range(many):
        text, spans = f"{word()} {word()} ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.62:
                kind = KINDS[(k + r.randint(0, 1)) % len(KINDS)]
                before, span, after = kinds[kind]()
                text += before
                spans.append((len(text), len(text) + len(span), kind))
                text += span + after
            else:
                text += r.choice(plain)()
            text += r.choice((" ", ". ", ", ", "### ")) + r.choice(("", f"{word()} "))
        out.append((text.rstrip(), spans))
    return out


def _gold(chunks: Chunks, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(chunks):
        hit = next((s for s in spans if chunks.at[i][0] <= s[0] < chunks.at[i][1]), None)
        j = i + 1
        while hit and j < len(chunks) and chunks.at[j][0] < hit[1]:
            j += 1
        out.append((i, j, _LABELS.index(hit[2]) if hit else 0))
        i = j
    return out


def regions(text: str) -> Iterator[Chunks]:
    """Regions in which something can be found."""
    words = None
    for m in _REGION.finditer(text):
        if possible_region(m[0]):
            if words is None:
                words = [w.span() for w in _WORD.finditer(text)]
            yield Chunks(text, m.start(), m[0], words)


@lru_cache(maxsize=2)
def trained(seed: int = 4, many: int = SENTENCES, passes: int = PASSES, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """The field of greatest likelihood for the generated sentences, by AdaGrad on each in turn; the same on every run."""
    names: dict[str, int] = {}
    data = [(c, _gold(c, spans)) for text, spans in generated(seed, many) for c in regions(text)]
    for c, _ in data:
        for i in range(len(c)):
            for j in c.ends(i):
                for f in (c.segment(i, j) or ([], []))[0]:
                    names.setdefault(f, len(names))
    k = len(_LABELS)
    field = Field(names, np.zeros((len(names), k)), np.zeros((k, k)))
    seen_w, seen_s = np.full_like(field.weights, 1e-2), np.full_like(field.steps, 1e-2)

    def closed(labels: list[int]) -> np.ndarray:
        out = np.full(k, -np.inf)
        out[labels] = 0
        return out

    cut = [{(i, j): (list(found), closed(labels)) for i, j, found, labels in field.segments(c)} for c, _ in data]
    for _ in range(passes):
        for (c, gold), segments in zip(data, cut, strict=True):
            if any((i, j) not in segments or not np.isfinite(segments[i, j][1][y]) for i, j, y in gold):
                continue
            n = len(c)
            score = {x: field.weights[found].sum(axis=0) + may for x, (found, may) in segments.items()}
            ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
            ahead[0, 0], behind[n] = 0, 0
            for j in range(1, n + 1):
                ahead[j] = _sum_exp(np.array([_sum_exp(ahead[i][:, None] + field.steps, 0) + s for (i, e), s in score.items() if e == j]), 0)
            for i in range(n - 1, -1, -1):
                behind[i] = _sum_exp(np.array([_sum_exp(field.steps + (s + behind[e])[None, :], 1) for (b, e), s in score.items() if b == i]), 0)
            whole = _sum_exp(ahead[n])
            up_w, up_s = np.zeros_like(field.weights), np.zeros_like(field.steps)
            for (i, j), s in score.items():
                both = np.exp(ahead[i][:, None] + field.steps + (s + behind[j])[None, :] - whole)
                up_s -= both
                np.subtract.at(up_w, segments[i, j][0], both.sum(axis=0))
            before = 0
            for i, j, y in gold:
                np.add.at(up_w, (segments[i, j][0], y), 1)
                up_s[before, y] += 1
                before = y
            for w, up, seen in ((field.weights, up_w - decay * field.weights, seen_w), (field.steps, up_s - decay * field.steps, seen_s)):
                seen += up * up
                w += rate * up / np.sqrt(seen)
    field._known.clear()
    return field


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """What the field finds in a whole text."""
    return [(c.core[i][0], c.core[j - 1][1], _LABELS[y]) for c in regions(text) for i, j, y in field.best(c) if y]


def possible_region(region: str) -> bool:
    """No segment of a region with few digits, without @ and without long codes is possible."""
    return "@" in region or region.count(".") >= 3 or region.count(":") >= 2 or sum("0" <= x <= "9" for x in region) >= 7 or any(len(x) >= 16 for x in region.split())


def spans(text: str, field: Field | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    more = field_spans(text, field) if field else []
    ends: list[tuple[int, int]] = []  # base spans, those that overlap made one
    for x, y, _ in base:
        if ends and x < ends[-1][1]:
            ends[-1] = (ends[-1][0], max(y, ends[-1][1]))
        else:
            ends.append((x, y))
    kept = []
    for x, y, kind in more:
        at = bisect_left(ends, (y, 0)) - 1  # the last that begins before y
        if at < 0 or ends[at][1] <= x:
            kept.append((x, y, kind))
    return base, sorted(base + kept, key=_by_start)


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def redacted(text: str, found: list[tuple[int, int, str]]) -> str:
    """Spans replaced by <KIND>; what overlaps is replaced once, under the first kind."""
    out, at = [], 0
    for a, b, kind in found:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    arrow_batches(docs.sparkSession)
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digest, every = [[] for _ in BASE], [], []
            for x in b.column("text"):
                base, found = spans(x.as_py() or "", field)
                for k, kind in enumerate(BASE):
                    counts[k].append(sum(s[2] == kind for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    src = docs.select("doc_id", "text")
    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, " + "".join(f"n_{k} long, " for k in BASE) + "base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, ``n_chars`` (if there) counted anew, all else as it is; a null text stays null."""
    arrow_batches(docs.sparkSession)
    field = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x.as_py() for x in b.column("text")]
            new = [None if x is None else redacted(x, spans(x, field)[1]) for x in texts]
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
