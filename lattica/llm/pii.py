"""PII: base patterns, and a skip-chain conditional random field over the tokens that could be personal data.

Tokens are runs without white space. Only tokens with a digit or an at sign can carry a label (email, ip, card, phone or
none); all others are fixed to none, which cuts the chain into short segments. Potentials: a log-linear unary term on
the token's shape and neighbouring words, a transition term between neighbouring tokens of a segment, and a skip term
between tokens of a document that are equal after dropping punctuation, or end in the same seven digits. Equal tokens
are linked in a row, occurrence to next occurrence, so links grow with the tokens. Loopy sum-product message passing over
all edges of the document, until no message changes any more, gives each token's label probabilities; a repeated token thus takes evidence from its
other places. Weights are learned piecewise on generated, labelled documents: softmax regression for the unary term,
smoothed log odds for transitions and skips.

Base spans always stay; runs of tokens with the same label of probability CONFIDENCE or more that meet no base span are
added. Defined cases: null counts as empty; empty texts have no spans; texts of any length are scanned whole; repeated
rows are scanned each for itself; columns with a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from lattica.llm.common import append_columns, as_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
CONFIDENCE = 0.85
#: Message passing ends when no message changes by more than this.
TOLERANCE = 1e-3

#: Fixed patterns. Possessive where that changes no match, so that long runs cost linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+")
_HAS = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What the pattern local@domain finds, leftmost and non-overlapping, in linear time: one look at each at sign."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; kinds in listed order where starts are equal."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _HAS.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- features of a token

_HINTS = {
    "email": ("mail", "email", "e-mail", "contact", "courriel", "correo"),
    "ip": ("ip", "host", "server", "addr", "address"),
    "card": ("card", "visa", "mastercard", "carte", "karte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "teléfono", "téléphone"),
}
_EDGE = ".,;:!?\"'()[]{}<>|#$%&*"
N_FEATURES = 32


def strip(token: str) -> tuple[int, int]:
    """Where a token's core starts and ends, without punctuation around it."""
    a, b = 0, len(token)
    while a < b and token[a] in _EDGE and not (token[a] == "(" and token[a + 1 : a + 2].isdigit()):
        a += 1
    while b > a and token[b - 1] in _EDGE and not (token[b - 1] == ")" and token[b - 2 : b - 1].isdigit()):
        b -= 1
    return a, b


def features(core: str, before: str, after: str) -> np.ndarray:
    """Binary features of a token's core and its neighbouring words."""
    f = np.zeros(N_FEATURES)
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    f[0] = 1
    f[1] = "@" in core
    f[2] = bool(re.fullmatch(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+", core))
    f[3] = bool(re.fullmatch(r"[\w.%+-]+@[\w-]+", core))
    f[4] = bool(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}(:\d+)?", core))
    f[5] = core.count(".") == 3 and not letters
    f[6] = core.startswith("+")
    f[7] = bool(re.fullmatch(r"\+\d{1,3}", core))
    f[8] = bool(re.fullmatch(r"\(\d{2,4}\)", core))
    f[9] = bool(re.fullmatch(r"\d{3}[-.]\d{4}", core))
    f[10] = bool(re.fullmatch(r"\(?\d{3}\)?[-.]?\d{3}[-.]\d{4}", core))
    f[11] = not letters and 14 <= digits <= 19
    f[12] = f[11] and luhn("".join(c for c in core if "0" <= c <= "9"))
    f[13] = not letters and digits == 4 and len(core) == 4
    f[14] = not letters and 7 <= digits <= 13
    f[15] = digits < 4
    f[16] = letters > 0 and digits > 0
    f[17] = letters > 0 and "@" not in core
    f[18] = not letters and digits > 19
    f[19] = bool(re.fullmatch(r"(19|20)\d\d", core))
    for k, kind in enumerate(KINDS):
        f[20 + k] = any(before.startswith(h) for h in _HINTS[kind])
    f[24] = bool(re.search(r"\d", before)) and not any(c.isalpha() for c in before)
    f[25] = bool(re.search(r"\d", after)) and not any(c.isalpha() for c in after)
    f[26] = core.count("-") >= 2
    f[27] = ":" in core or "/" in core
    f[28] = before.startswith("+")
    f[29] = before.endswith(")")
    f[30] = 5 <= digits <= 6
    f[31] = "=" in core or '"' in core
    return f


class Token:
    __slots__ = ("a", "b", "core", "x", "key", "tail", "near")

    def __init__(self, text: str, start: int, end: int, before: str, after: str, near: bool):
        a, b = strip(text[start:end])
        self.a, self.b = start + a, start + b
        self.core = text[self.a : self.b]
        self.x = features(self.core, before, after)
        digits = "".join(c for c in self.core if "0" <= c <= "9")
        self.key = re.sub(r"[^\w@]", "", self.core.lower())
        self.tail = digits[-7:] if len(digits) >= 7 and not any(c.isalpha() for c in self.core) else ""
        self.near = near  # the token right before can carry a label too


def tokens(text: str) -> list[Token]:
    out, last = [], -2
    for m in TOKEN.finditer(text):
        s, e = m.span()
        before = text[max(0, s - 30) : s].split()
        after = text[e : e + 30].split()
        near = last >= 0 and not text[last:s].strip() and s - last <= 2
        out.append(Token(text, s, e, before[-1].lower().strip(_EDGE.replace(")", "")) if before else "", after[0] if after else "", near))
        last = e
    return out


class Field:
    """Weights of the three potentials."""

    def __init__(self, unary: np.ndarray, transition: np.ndarray, skip: np.ndarray):
        self.unary, self.transition, self.skip = unary, transition, skip

    def probabilities(self, found: list[Token]) -> np.ndarray:
        """Label probabilities of a document's tokens after loopy message passing."""
        n, k = len(found), len(LABELS)
        u = np.stack([t.x for t in found]) @ self.unary
        pairs, tables = [], []
        for i, t in enumerate(found):
            if i and t.near:
                pairs.append((i - 1, i))
                tables.append(self.transition)
        for attribute in ("key", "tail"):
            last: dict[str, int] = {}
            for i, t in enumerate(found):
                v = getattr(t, attribute)
                if v:
                    if v in last and (attribute == "key" or found[last[v]].key != t.key):
                        pairs.append((last[v], i))
                        tables.append(self.skip)
                    last[v] = i
        if pairs:
            e = np.array(pairs)
            source, target = np.concatenate([e[:, 0], e[:, 1]]), np.concatenate([e[:, 1], e[:, 0]])
            w = np.stack(tables)
            w = np.concatenate([w, w.transpose(0, 2, 1)])
            m = len(pairs)
            back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
            message, belief = np.zeros((2 * m, k)), u.copy()
            by_source = np.argsort(source, kind="stable")
            first = np.searchsorted(source[by_source], np.arange(n + 1))
            active, step, rounds = np.arange(2 * m), 0.7, 0
            while len(active):
                out = (belief[source[active]] - message[back[active]])[:, :, None] + w[active]
                top = out.max(1)
                new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                change = new - message[active]
                moved = np.abs(change).max(1) > TOLERANCE
                now = active[moved]
                message[now] += step * change[moved]
                np.add.at(belief, target[now], step * change[moved])
                # only messages from where something has changed, and those still on their way, can change next
                nodes = np.unique(target[now])
                count = first[nodes + 1] - first[nodes]
                after = by_source[np.repeat(first[nodes] - np.cumsum(count) + count, count) + np.arange(count.sum())]
                active = np.union1d(now, after)
                rounds += 1
                # news has crossed the document by now: what still moves goes round in circles, and is damped until it ends
                if rounds > 50 + 2 * n:
                    step *= 0.97
                    if step < 1e-3:
                        break
            np.add.at(u, target, message)
        u -= u.max(1, keepdims=True)
        p = np.exp(u)
        return p / p.sum(1, keepdims=True)


def _example(r: np.random.Generator) -> list[tuple[str, int]]:
    """A generated document as (token, label); personal data repeats, sometimes in a shorter form."""
    word = lambda: "".join(r.choice("the an er on re in ed nd ha at en es of or nt ea ti to it st".split(), r.integers(1, 4)))
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def card() -> str:
        d = num(15)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def entity(kind: int) -> list[list[tuple[str, int]]]:
        """Forms of one entity: full, then shorter ones."""
        if kind == 1:
            local, host = f"{word()}.{num(2)}", f"{word()}{num(1)}.{r.choice(['com', 'org', 'net'])}"
            return [[(f"{local}@{host}", 1)], [(f"{local}@{host}", 1)]]
        if kind == 2:
            ip = ".".join(str(v) for v in r.integers(1, 255, 4))
            return [[(ip, 2)], [(f"{ip}:{r.integers(80, 9000)}", 2)]]
        if kind == 3:
            c = card()
            split = r.random() < 0.3
            return [[(c[i : i + 4], 3) for i in range(0, 16, 4)] if split else [(c, 3)], [(c, 3)]]
        area, a, b = num(3), num(3), num(4)
        full = [(f"+{r.integers(1, 99)}", 4), (f"({area})", 4), (f"{a}-{b}", 4)]
        return [full, [(f"({area})", 4), (f"{a}-{b}", 4)] if r.random() < 0.5 else [(f"{area}-{a}-{b}", 4)], [(f"{a}-{b}", 4)]]

    noise = [lambda: num(r.integers(1, 4)), lambda: f"20{num(2)}", lambda: f"19{num(2)},", lambda: f"{num(1)}.{num(1)}", lambda: f"{num(2)}/{num(2)}/20{num(2)}", lambda: num(r.integers(5, 9)), lambda: f"{num(3)}-{num(4)}", lambda: num(16), lambda: word() + num(2), lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: f'"{num(10)}a{num(12)}"', lambda: num(r.integers(20, 30)), lambda: num(4)]
    segments: list[list[tuple[str, int]]] = []
    for k in r.integers(1, 5, r.integers(1, 4)):
        forms = entity(int(k))
        for _ in range(r.integers(1, 4)):
            form = forms[0] if r.random() < 0.6 else forms[r.integers(len(forms))]
            hint = [(str(r.choice(_HINTS[KINDS[form[0][1] - 1]])), 0)] if r.random() < 0.4 else []
            segments.append([*hint, *form])
    for _ in range(r.integers(1, 7)):
        segments.append([(noise[r.integers(len(noise))](), 0) for _ in range(1 + (r.random() < 0.3))])
    out: list[tuple[str, int]] = []
    for i in r.permutation(len(segments)):
        out += [(word(), 0) for _ in range(r.integers(0, 6))] + segments[i]
    return out + [(word(), 0)]


@cache
def trained_field(n: int = 700, seed: int = 5) -> Field:
    """The field, learned from generated documents; the same one each time."""
    r = np.random.default_rng(seed)
    x, y, moves, same, apart = [], [], np.full((5, 5), 0.5), np.full((5, 5), 0.5), np.full((5, 5), 0.5)
    for _ in range(n):
        example = _example(r)
        text, places = "", {}
        for t, label in example:
            places[len(text)] = label
            text += t + " "
        found = tokens(text)
        labels = []
        for t in found:
            start = text.rfind(" ", 0, t.a) + 1
            labels.append(places[start])
        for i, t in enumerate(found):
            x.append(t.x)
            y.append(labels[i])
            if i and t.near:
                moves[labels[i - 1], labels[i]] += 1
            for j in range(i):
                equal = t.key == found[j].key or t.tail and t.tail == found[j].tail
                (same if equal else apart)[labels[j], labels[i]] += 1
    same, apart = same + same.T, apart + apart.T  # which of two equal tokens comes first says nothing
    x, y = np.array(x), np.array(y)
    w, v = np.zeros((N_FEATURES, 5)), np.zeros((N_FEATURES, 5))
    for _ in range(600):
        s = x @ w
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        v = 0.9 * v + x.T @ p / len(y) + 0.0005 * w
        w -= 0.8 * v
    p = np.bincount(y, minlength=5) / len(y)
    transition = np.log(moves / moves.sum()) - np.log(np.outer(p, p) + 1e-4)
    skip = np.log(same / same.sum()) - np.log(apart / apart.sum())
    return Field(w, 0.7 * np.clip(transition, -4, 4), 0.7 * np.clip(skip, -4, 4))


def scan_text(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    if not _HAS.search(text):
        return [], []
    base = base_spans(text)
    found = tokens(text)
    if not found:
        return base, base
    p = field.probabilities(found)
    best = p.argmax(1)
    sure = (best > 0) & (p.max(1) >= CONFIDENCE)
    more, i = [], 0
    while i < len(found):
        if not sure[i]:
            i += 1
            continue
        j = i
        # phones, and cards in groups of a few digits, go on over several tokens
        while j + 1 < len(found) and sure[j + 1] and best[j + 1] == best[i] and found[j + 1].near and (best[i] == 4 or best[i] == 3 and len(found[j].key) < 14 > len(found[j + 1].key)):
            j += 1
        more.append((found[i].a, found[j].b, LABELS[best[i]]))
        i = j + 1
    starts = np.array([b[0] for b in base], np.int64)
    ends = np.maximum.accumulate(np.array([b[1] for b in base], np.int64)) if base else starts
    free = []
    for a, b, kind in more:
        k = int(np.searchsorted(starts, b))
        if b > a and (not k or ends[k - 1] <= a):
            free.append((a, b, kind))
    return base, sorted(base + free, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FIELDS = [StructField(f"n_{k}", LongType()) for k in KINDS] + [StructField("base_sha256", StringType()), StructField("spans", StringType())]


def scan(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """docs with counts and digest of the base spans, and all spans as kind:start:end (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained_field())
    at = docs.columns.index(text_col)

    def make():
        weights = shared.value

        def work(batch):
            rows = []
            for text in as_text(batch.column(at)):
                base, spans = scan_text(text, weights)
                kinds = [k for _, _, k in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

        return work

    return append_columns(docs, FIELDS, make)
