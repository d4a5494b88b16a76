"""Secret scans: base patterns, and a character convolutional network over every candidate token in its context.

A candidate is a base match, or a run of at least MIN_CANDIDATE key characters of any kind; such runs are cut at base
matches, and each piece of MIN_CANDIDATE characters or more is one. Every candidate goes through the network (embedding,
one convolution, maximum over positions, logistic output), which sees its characters and those around it. One longer
than BODY is seen whole, in windows of BODY characters that overlap by half. A base match is a span whatever the network
says, and gets the network's probability; of other candidates the windows found are joined, and run on to the ends of
the letters and digits they cut. The network is trained on labelled findings: generated ones of known kinds in generated
surroundings, alone or inside longer runs, and, as hard negatives, ordinary candidates. Its output is calibrated on
findings it wasn't trained on, and of the thresholds that keep the asked recall there, the one of best F1 is used.

Defined cases: null counts as empty; an empty text has no spans; texts of any length are scanned whole; repeated rows
are scanned each for itself; `scan` replaces columns with a result's name, `redact` keeps all columns but the text and
n_chars as they are, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField

from lattica.llm.common import append_columns, as_text, private
from lattica.llm.gbdt import sigmoid

#: Fixed patterns; letters of the words before the separator in either case.
ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

MIN_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Characters of the candidate and of each side that the network sees.
BODY, SIDE = 40, 20
WIDTH = BODY + 2 * SIDE
RECALL = 0.97
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-.:;,\"'(){}[]<>@#$%&*!?|\\ \n"
_CODE = np.full(0x250, 1, np.int64)
for _i, _c in enumerate(_ALPHABET):
    _CODE[ord(_c)] = _i + 2
_CODES = len(_ALPHABET) + 2  # 0: outside the text, 1: any other character


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns; kinds in listed order where starts are equal."""
    order = {"assign": 0, "access": 1, "hex": 2}
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def candidates(text: str, base: list[tuple[int, int, str]] = []) -> list[tuple[int, int]]:
    """Spans of tokens that could be secrets: runs of key characters without what base spans (sorted) cover."""
    out, k, covered = [], 0, 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][0] < end:
            if base[k][0] - max(at, covered) >= MIN_CANDIDATE:
                out.append((max(at, covered), base[k][0]))
            covered = max(covered, base[k][1])
            k += 1
        if end - max(at, covered) >= MIN_CANDIDATE:
            out.append((max(at, covered), end))
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The parts of a candidate that the network sees one at a time: all of it, or overlapping windows of BODY characters."""
    if end - start <= BODY:
        return [(start, end)]
    return [(a, a + BODY) for a in [*range(start, end - BODY, BODY // 2), end - BODY]]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters around and in a window."""
    seen = text[max(0, start - SIDE) : end + SIDE]
    chars = np.minimum(np.frombuffer(seen.encode("utf-32-le", "surrogatepass"), np.uint32), 0x24F)
    out = np.zeros(WIDTH, np.int64)
    at = max(0, SIDE - start)
    out[at : at + len(chars)] = _CODE[chars]
    return out


class Network:
    """Embedding, convolution of width 5, rectifier, maximum and mean over positions, logistic output; trained by Adam."""

    def __init__(self, seed: int = 7, size: int = 12, filters: int = 24, width: int = 5):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": r.normal(0, 0.3, (_CODES, size)),
            "w": r.normal(0, 1 / np.sqrt(size * width), (width * size, filters)),
            "b": np.zeros(filters),
            "v": r.normal(0, 0.2, 2 * filters),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        # the convolution of embedded characters, as sums of one table a place in the window: codes x filters
        size, m = self.p["e"].shape[1], x.shape[1] - self.width + 1
        z = np.repeat(self.p["b"][None, None], len(x), 0)
        for t in range(self.width):
            z = z + (self.p["e"] @ self.p["w"][t * size : (t + 1) * size])[x[:, t : t + m]]
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([a.max(1), a.mean(1)], 1)
        return a, top, pooled, pooled @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = [self._forward(x[k : k + 512])[-1].astype(float) for k in range(0, len(x), 512)]
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.logits(x) + self.shift)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 7, batch: int = 64, rate: float = 0.005, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for k in range(0, len(y), batch):
                rows = order[k : k + batch]
                xb, yb = x[rows], y[rows]
                a, top, pooled, out = self._forward(xb)
                d = ((sigmoid(out) - yb) / len(rows)).astype(np.float32)
                m, f = a.shape[1:]
                g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
                dp = d[:, None] * self.p["v"]
                da = np.repeat(dp[:, None, f:] / m, m, 1)
                i, j = np.arange(len(rows))[:, None], np.arange(f)[None]
                da[i, top, j] += dp[:, :f]
                dz = (da * (a > 0)).reshape(-1, f)
                g["b"] = dz.sum(0)
                size = self.p["e"].shape[1]
                one = np.zeros((*xb.shape, _CODES), np.float32)
                np.put_along_axis(one, xb[:, :, None], np.float32(1), 2)
                g["w"], g["e"] = np.zeros_like(self.p["w"]), np.zeros_like(self.p["e"])
                for t in range(self.width):
                    table = one[:, t : t + m].reshape(-1, _CODES).T @ dz
                    part = slice(t * size, (t + 1) * size)
                    g["w"][part] = self.p["e"].T @ table
                    g["e"] += table @ self.p["w"][part].T
                step += 1
                for name, grad in g.items():
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad * grad
                    self.p[name] = self.p[name] - rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-7)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling; then, of the thresholds that keep the recall on these findings, the one of best F1 nearest 0.5."""
        s = self.logits(x)
        b = np.array([1.0, 0.0])
        f = np.stack([s, np.ones_like(s)], 1)
        for _ in range(50):
            p = sigmoid(f @ b)
            h = (f * (p * (1 - p))[:, None]).T @ f + 0.01 * np.eye(2)
            b = b - np.linalg.solve(h, f.T @ (p - y) + 0.01 * (b - np.array([1.0, 0.0])))
        self.scale, self.shift = float(b[0]), float(b[1])
        q = self.probability(x)
        best = (-1.0, 0.0, 0.5)
        for t in np.linspace(0.02, 0.98, 49):
            hit = ((q >= t) & (y == 1)).sum()
            if hit >= recall * (y == 1).sum():
                f1 = 2 * hit / max(1, (q >= t).sum() + (y == 1).sum())
                best = max(best, (round(float(f1), 4), -abs(float(t) - 0.5), float(t)))
        # no threshold keeps the recall: the lowest one does the most
        self.threshold = best[2] if best[0] >= 0 else 0.02


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates in generated surroundings, half of them secrets."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    full = lower + upper + digit
    syllables = "the an er on re in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve und ich ein que ado".split()
    known = (
        "about after again against before between because children different document every example family government"
        " house important information international language large little morning mountain nothing number other people"
        " question reading research school something special system through together under university water where which"
        " without world writing year configuration management performance available anything words notes files data user"
        " abend arbeit bericht durch entwicklung freundschaft gesellschaft geschwindigkeit haus kinder lich keit heit ung"
        " schaft nicht sprache strasse verantwortung verwaltung wirtschaft wissenschaft zwischen zeit zusammen schule"
        " aujourd apres avec beaucoup chose comme connaissance developpement entre enfant gouvernement homme jour maison"
        " monde notre pendant petit pour quelque semaine temps toujours travail ville ment tion ance ence able less ness"
        " ahora antes ciudad cuando desarrollo desde despues donde escuela gente hacia hombre manera mejor mientras mundo"
        " nuestro palabra porque siempre tiempo trabajo cion dad mente ing ly ous the and of in to der die das und le la el"
    ).split()
    # parts that long words are made of
    morphemes = (
        "ver be ent er zer ge un vor nach aus ein auf ab an zu sch ach ich isch lich keit heit ung schaft nis tum sam bar haft"
        " en em es te st tz ng der die das des nicht und in zu bei hand land werk zeug berg haus arbeit zeit stadt recht"
        " re con com dis pro pre inter trans sub des par sur ment tion sion ance ence eux aux eau que eur oir age ette"
        " cion mente dad miento ador ista able ible ar er ir ado ido ando endo os as la el lo"
        " an on in th the he her ed ing ly ness ful less est ion ti al ic ous ive ize ha nd nt ere re ou"
    ).split()
    word = lambda: "".join(r.choice(syllables, r.integers(1, 5))) if r.random() < 0.5 else str(r.choice(known))
    # one long word, of syllables, known words or both
    compound = lambda low, high: "".join(r.choice(syllables + known * int(r.integers(0, 2)), r.integers(6, 16)))[: r.integers(low, high)]
    prose = lambda k: " ".join(word() for _ in range(k))
    x, y = [], []
    secrets = [
        lambda: pick(full, r.integers(20, 64)),
        lambda: pick(full + "+/", 40),
        lambda: r.choice(["ghp_", "gho_", "sk-", "pk_live_", "sk_live_", "xoxb-", "glpat-", "SG."]) + pick(full, r.integers(20, 40)),
        lambda: "AIza" + pick(full + "-_", 35),
        lambda: "eyJ" + pick(full + "-_", r.integers(30, 60)),
        lambda: pick(upper + digit, r.integers(20, 40)),
        lambda: pick("0123456789ABCDEF", r.integers(24, 64)),
        lambda: pick(full + "+/", 42) + "=" * r.integers(1, 3),
        lambda: pick(lower + upper, r.integers(20, 41)),
        lambda: pick(upper, r.integers(20, 41)),
        lambda: pick(lower, r.integers(20, 41)),
        lambda: pick("0123456789abcdef", r.integers(24, 65)),
        lambda: "AKIA" + pick(upper + digit, r.integers(16, 21)),
        lambda: r.choice(["password", "passwd", "secret", "token", "api_key", "apikey"]) + r.choice(["=", ":", "='"]) + pick(full + "_-", r.integers(10, 33)),
    ]
    plain = [
        lambda: "-".join([word(), word(), word(), str(r.integers(1, 3000))]) + word(),
        lambda: "_".join([word(), word(), word() + str(r.integers(0, 99))]) + word(),
        lambda: "/".join([word(), word(), str(r.integers(1990, 2030)), pick(digit, 2), word()]),
        lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        lambda: word() + word() + word() + word() + str(r.integers(0, 999)),
        lambda: "=" * r.integers(16, 40) + pick(digit, 1) + "a",
        lambda: str(r.integers(1990, 2030)) + "-" + pick(digit, 2) + "-" + pick(digit, 2) + "T" + pick(digit, 6) + "-" + pick(digit, 4),
        lambda: (word() + word()).upper() + "-" + str(r.integers(100, 99999)) + "-" + word().upper() + word().upper(),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + "V" + str(r.integers(1, 30)) + word().capitalize() + word(),
        lambda: "a" * r.integers(10, 30) + "1" * r.integers(6, 20),
        lambda: compound(16, 24),
        lambda: compound(16, 40),
        lambda: compound(16, 30).capitalize(),
        lambda: compound(16, 30).upper(),
        lambda: "".join(word().capitalize() for _ in range(r.integers(3, 9))),
        lambda: str(r.choice(["-", "_", "/", "="])).join(word() for _ in range(r.integers(4, 12))),
        lambda: str(r.choice(list("=-_+/ax0"))) * r.integers(16, 60),
        lambda: pick(digit, 16),
        lambda: pick(digit, r.integers(16, 41)),
        lambda: pick(digit, r.integers(16, 20)),
        lambda: "".join(r.choice(morphemes, 12))[: r.integers(16, 26)],
        lambda: "".join(r.choice(morphemes, 12))[: r.integers(16, 26)].capitalize(),
    ]
    # paths around a secret, or without one
    around = lambda: "/".join(word() + (str(r.integers(0, 99)) if r.random() < 0.2 else "") for _ in range(r.integers(4, 12)))
    named = ["key = ", "auth: ", 'bearer "', "credentials=", "secret key is ", "access ", "Authorization: Bearer ", "client_secret ", "private ", ""]
    bland = ["see ", "file ", "in ", "id ", "version ", "the ", "page ", "href=\"/", "build ", ""]
    for i in range(n):
        positive = i % 2 == 0
        token, tries = "", 0
        while len(token) < MIN_CANDIDATE and tries < 20:
            token = str((secrets if positive else plain)[r.integers(len(secrets if positive else plain))]())
            tries += 1
        lead = r.choice(named if positive and r.random() < 0.5 else bland)
        text = prose(4) + " " + lead
        start = len(text)
        at, size = 0, len(token)  # of the secret or plain token in its run
        if r.random() < 0.15:
            before = around() + "/"
            token, at = before + token + "/" + around(), len(before)
        text += token + r.choice([" ", '" ', ", ", ".\n", "; "]) + prose(4)
        if r.random() < 0.15:
            text = text[: start] + token + text[start + len(token) :].upper()
        # of a run's windows, one of those that show most of the token
        shown = windows(start, start + len(token))
        most = [min(b, start + at + size) - max(a, start + at) for a, b in shown]
        best = [w for w, m in zip(shown, most) if m == max(most)]
        x.append(encode(text, *best[r.integers(len(best))]))
        y.append(float(positive))
    return np.array(x), np.array(y)


@cache
def trained_network(n: int = 8000, seed: int = 3) -> Network:
    """The network, trained and calibrated on labelled findings; the same one each time."""
    network = Network()
    network.train(*labelled_findings(n, seed))
    network.calibrate(*labelled_findings(n // 3, seed + 1))
    return network


def scan_text(text: str, network: Network) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], list[float], int]:
    """Base spans, all spans (those of the network have kind cnn), the network's probability of each, and how many
    candidates it scored."""
    base = base_spans(text)
    pieces = candidates(text, base)
    seen = [(k, w) for k, (a, b, _) in enumerate(base) for w in windows(a, b)] + [(len(base) + k, w) for k, c in enumerate(pieces) for w in windows(*c)]
    if not seen:
        return base, base, [], 0
    sure = [0.0] * len(base)
    more: list[tuple[int, int, str]] = []
    odds: list[float] = []
    for i in range(0, len(seen), 512):
        part = seen[i : i + 512]
        for (k, (a, b)), q in zip(part, network.probability(np.array([encode(text, *w) for _, w in part])).tolist()):
            if k < len(base):
                sure[k] = max(sure[k], q)
            elif q >= network.threshold:
                start, end = pieces[k - len(base)]
                while a > start and text[a - 1].isalnum() and text[a].isalnum():
                    a -= 1
                while b < end and text[b].isalnum() and text[b - 1].isalnum():
                    b += 1
                if more and a < more[-1][1]:
                    more[-1] = (min(a, more[-1][0]), max(b, more[-1][1]), "cnn")
                    odds[-1] = max(odds[-1], q)
                else:
                    more.append((a, b, "cnn"))
                    odds.append(q)
    rank = {"assign": 0, "access": 1, "hex": 2, "cnn": 3}
    every = sorted(zip(base + more, sure + odds), key=lambda s: (s[0][0], rank[s[0][2]]))
    return base, [s for s, _ in every], [q for _, q in every], len(base) + len(pieces)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


FIELDS = [
    StructField("n_assign", LongType()),
    StructField("n_access", LongType()),
    StructField("n_hex", LongType()),
    StructField("base_sha256", StringType()),
    StructField("spans", StringType()),
    StructField("probabilities", StringType()),
    StructField("n_scored", LongType()),
]


def scan(docs: DataFrame, text_col: str = "text", network: Network | None = None) -> DataFrame:
    """docs with counts and digest of the base spans, all spans as kind:start:end (code points), the network's
    probability of each span, and the number of candidates it scored."""
    shared = docs.sparkSession.sparkContext.broadcast(network or trained_network())
    at = docs.columns.index(text_col)

    def make():
        net = shared.value

        def work(batch):
            rows = []
            for text in as_text(batch.column(at)):
                base, spans, odds, n = scan_text(text, net)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), digest, joined(spans), ",".join(f"{q:.3f}" for q in odds), n))
            types = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()]
            return [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]

        return work

    return append_columns(docs, FIELDS, make)


def redacted(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """text with every span (sorted, they may overlap) replaced by a mark."""
    parts, last = [], 0
    for a, b, _ in spans:
        if a >= last:
            parts += [text[last:a], mark]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", network: Network | None = None) -> DataFrame:
    """docs (columns as given) with every span replaced by a mark; n_chars, where present, follows. No document goes."""
    shared = docs.sparkSession.sparkContext.broadcast(network or trained_network())
    clean, hit = private(docs, "clean", "hit")
    at = docs.columns.index("text")

    def make():
        net = shared.value

        def work(batch):
            texts, hits = [], []
            for text in batch.column(at).to_pylist():
                spans = scan_text(text or "", net)[1]
                texts.append(redacted(text, spans, mark) if spans else text)
                hits.append(len(spans))
            return [pa.array(texts, pa.string()), pa.array(hits, pa.int32())]

        return work

    found = append_columns(docs, [StructField(clean, StringType()), StructField(hit, IntegerType())], make)
    new = {c: F.col(f"`{c}`") for c in docs.columns}
    new["text"] = F.col(clean)
    if "n_chars" in new:
        new["n_chars"] = F.when(F.col(hit) > 0, F.char_length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return found.select(*[v.alias(c) for c, v in new.items()])
