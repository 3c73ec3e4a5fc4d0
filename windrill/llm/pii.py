"""Personal data by candidate gradient boosting (operator 7).

High-recall generators propose overlapping spans: e-mail addresses (also written with "at" and "dot"), dotted and colon network
addresses, card-like and phone-like digit groups with any separators, account and identity numbers, and secrets (long tokens, and
what is assigned to a key word). Boosted trees score each candidate by its format (digits, separators, checksums, group lengths,
entropy, kinds of characters) and by its context (cue words before it, what touches it, whether it holds a base span); a
calibrated threshold for each kind selects spans, the better score first. Spans of the base rules always stay; a scored span may
extend over one, but one within a base span adds nothing and is left out.

The trees are fitted here, on TRAINING made-up passages from a fixed seed (a bounded sample that doesn't depend on the corpus).
What is in a passage says the label: a person's or an account's data, or a decoy of like format (orders, dates, versions,
commits, file names, measures); cues and contexts are drawn for both with other odds, so no feature repeats the label. Half of
the passages calibrate: scores pass through isotonic regression, and a kind's threshold is the least one whose precision on that
half reaches PRECISION.

Base rules, leftmost and non-overlapping for each kind: e-mail, ip (parts at most 255), card (12 to 19 digits that pass the Luhn
check), phone (a plus sign and 9 to 15 digits). Their patterns are run in time linear in the text: e-mails are grown from each
at sign, and no match starts inside a digit run.

Cases: null or empty text has no span. A null doc_id is kept as it is. Positions are code points, ends exclusive. Texts of any
length are scanned whole. Ties: of overlapping candidates with one score the first by start, then by kind as listed, then the
shorter. Repeated rows are scanned each for themselves; further columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, small

KINDS = ("email", "ip", "card", "phone", "account", "secret")
TRAINING, PRECISION = 8000, 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(number)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    out: list[tuple[int, int, str, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, 0, "email", m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _ANY.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            d = digits(m[0]) if m.end() - m.start() < 64 else ""
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, "card", m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


# ---- candidates -------------------------------------------------------------------------------------------------------

_GENERATORS = (
    ("email", re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ./-]{1,2}[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![\w.])(?:00|\+)?[(]?[0-9]{1,4}[)]?(?:[ ./-]{1,2}[(]?[0-9]{2,4}[)]?){2,4}(?!\w)")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("secret", re.compile(r"(?<![\w+/=-])(?=[\w+/-]{0,40}?[0-9])[A-Za-z0-9_][A-Za-z0-9_+/-]{15,}={0,2}(?![\w+/=-])")),
    ("secret", re.compile(r"(?:token|secret|passw(?:or)?d|pwd|passwort|contraseña|mot de passe|key|credential)[\"']?\s{0,3}(?:=|:|is|ist|es|est)\s{0,3}[\"']?(?P<v>[^\s\"',;]{6,200})", re.I)),
)
_PREFILTER = re.compile(r"[0-9@]|[(\[ ]at[)\] ]|token|secret|passw|pwd|contrase|mot de passe|key|credential", re.I)
_AT = re.compile(r"@| at |at\)|at\]", re.I)
_CUES = {
    "email": re.compile(r"mail|contact|write|reach", re.I),
    "ip": re.compile(r"\bip\b|host|server|address|login", re.I),
    "card": re.compile(r"card|visa|master|credit|debit|karte|tarjeta|carte", re.I),
    "phone": re.compile(r"phone|tel|call|mobile|fax|contact|telefon|tél", re.I),
    "account": re.compile(r"iban|account|ssn|social|konto|cuenta|compte|tax id", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|key|credential|bearer|auth", re.I),
}
_AGAINST = re.compile(r"order|invoice|version|isbn|date|page|ref|serial|hash|commit|build|part no|line|file|image|sha", re.I)


def mod97(s: str) -> bool:
    s = s.replace(" ", "")
    try:
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    except ValueError:
        return False


def entropy(s: str) -> float:
    """Bits for each character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def describe(text: str, kind: str, s: int, e: int, holds_base: bool = False) -> list[float]:
    span, before, after = text[s:e], text[max(0, s - 40) : s], text[e : e + 12]
    d = digits(span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    last = re.split(r"[^A-Za-z0-9]+", span)[-1]
    return [
        KINDS.index(kind), len(span), len(d), len(groups), max(groups, default=0), min(groups, default=0), len(set(d)),
        float(12 <= len(d) <= 19 and luhn(d)), float(kind == "account" and span[:1].isalpha() and mod97(span)), float(span[:1] == "+" or span[:2] == "00"), float("(" in span), span.count("-"), span.count("."), span.count(" "), span.count("/"),
        float("@" in span), float(bool(re.search(r"[(\[]", span))), float(bool(_CUES[kind].search(before))), float(any(c.search(before) for k, c in _CUES.items() if k != kind)), float(bool(_AGAINST.search(before))),
        float(after[:1].isalnum()), float(before[-1:].isalnum()), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), sum(c.isalpha() for c in span), float(d.startswith("0")), float(bool(re.match(r"(19|20)[0-9]{2}", d))),
        entropy(span), sum(c in "0123456789abcdefABCDEF" for c in span) / len(span), sum(c.isupper() for c in span) / len(span), sum(c in "aeiouAEIOU" for c in span) / len(span), span.count("_"), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in ("\"", "'") and after[:1] == before[-1:]), float(holds_base),
        float(bool(re.search(r"\.\s", span))), len(last), float(last.islower()), float(bool(re.search(r"[(\[]? ?(?:dot|at) ?[)\]]", span, re.I))), float(bool(re.search(r"[a-z] ?\. ?[a-z]", span))),
    ]


def candidates(text: str) -> list[tuple[str, int, int]]:
    if not _PREFILTER.search(text):
        return []
    has_digit, has_at = bool(re.search(r"[0-9]", text)), bool(_AT.search(text))
    found = set()
    for kind, g in _GENERATORS:
        if has_at if kind == "email" else has_digit or "v" in g.groupindex:
            found.update((kind, *m.span("v" if "v" in g.groupindex else 0)) for m in g.finditer(text))
    return sorted(found, key=lambda c: (c[1], c[2], c[0]))


# ---- boosted trees ----------------------------------------------------------------------------------------------------


class Boosted:
    """Gradient boosting of depth-limited regression trees on the logistic loss, over binned features."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.forest: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple] = []
            self._grow(tree, b, g, h, np.arange(len(y)), 0, f)
            self.forest.append(tree)
        return self

    def _grow(self, tree, b, g, h, rows, depth, f) -> int:
        me = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = self.rate * total_g / (total_h + 1.0)
        tree.append((-1, 0, value, 0, 0))
        best = (1e-3, -1, 0)
        if depth < self.depth and len(rows) >= 20:
            for j in range(b.shape[1]):
                n = len(self.edges[j]) + 1
                sg, sh = np.bincount(b[rows, j], g[rows], n).cumsum()[:-1], np.bincount(b[rows, j], h[rows], n).cumsum()[:-1]
                if len(sg):
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
        if best[1] < 0:
            f[rows] += value
            return me
        left = b[rows, best[1]] <= best[2]
        a = self._grow(tree, b, g, h, rows[left], depth + 1, f)
        c = self._grow(tree, b, g, h, rows[~left], depth + 1, f)
        tree[me] = (best[1], best[2], 0.0, a, c)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        f = np.full(len(x), self.start)
        for tree in self.forest:
            at = np.zeros(len(x), np.int64)
            t = np.array([n[:2] + n[3:] for n in tree], np.int64)
            v = np.array([n[2] for n in tree])
            while True:
                inner = np.flatnonzero(t[at, 0] >= 0)
                if not len(inner):
                    break
                n = t[at[inner]]
                at[inner] = np.where(b[inner, n[:, 0]] <= n[:, 1], n[:, 2], n[:, 3])
            f += v[at]
        return f


def isotonic(f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, calibrated probabilities), by pooling neighbours that aren't in order."""
    order = np.argsort(f, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(f[order], y[order]):
        blocks.append([v, 1, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, s2 = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][2] = s2
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


_CUE_WORDS = {
    "email": ["mail:", "contact", "write to", "e-mail", "reach us at"], "ip": ["server", "host", "ip address", "login from", "ip"], "card": ["card", "visa", "credit card no.", "Karte", "paid with"],
    "phone": ["call", "tel.", "phone:", "mobile", "Telefon", "fax"], "account": ["IBAN", "account", "SSN", "Konto", "social security"], "secret": ["token =", "api_key:", "password:", "secret =", "auth token", "key ="],
}
_DECOY_CUES = ["order", "invoice no.", "version", "ref", "serial", "page", "date", "commit", "sha", "file", "isbn", "build", "line", "image"]


def _generated(rng: random.Random) -> tuple[str, str, int, int, int]:
    """(text, kind, start, end, label) of one made-up passage; the label says what was put in."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiourstlnmdgbk") for _ in range(rng.randint(2, 8)))
    some = lambda letters, a, z: "".join(rng.choice(letters) for _ in range(rng.randint(a, z)))
    sep = rng.choice(["-", " ", ".", "/"])
    kind = rng.choice(KINDS)
    good = rng.random() < 0.5
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", ".")])
        if good:
            span = f"{word()}{rng.choice(['.', '', '_'])}{word()}{at}{word()}{rng.choice(['', '-' + word(), n(1)])}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        else:
            span = f"{word()} at {word()}" + "".join(rng.choice([". ", ". ", "."]) + rng.choice([word(), word().capitalize()]) for _ in range(rng.randint(1, 3)))
    elif kind == "ip":
        if good:
            span = rng.choice([":".join(f"{rng.randrange(65536):x}" for _ in range(8)), f"fe80::{rng.randrange(65536):x}:{rng.randrange(65536):x}", f"2001:{rng.randrange(65536):x}:{rng.randrange(65536):x}::{rng.randrange(256):x}"])
        else:
            span = rng.choice([":".join(n(2) for _ in range(rng.randint(4, 6))), ":".join(n(1) for _ in range(4)), ":".join(f"{rng.randrange(16):x}" for _ in range(5))])
    elif kind == "card":
        d = rng.choice("3456") + n(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        if not good:
            d = rng.choice([n(16), n(12), f"{rng.randint(1900, 2099)}{n(8)}"])
        span = sep.join(d[k : k + 4] for k in range(0, len(d), 4))
    elif kind == "phone":
        if good:
            span = rng.choice([f"({n(3)}) {n(3)}-{n(4)}", f"00{n(2)} {n(3)} {n(3)} {n(3)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)}/{n(3)} {n(4)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(3)}.{n(3)}.{n(4)}"])
        else:
            span = rng.choice([f"{rng.randint(1900, 2099)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{rng.randint(1900, 2099)}", f"{n(1)}.{n(2)}.{n(3)}", f"{n(4)} {n(4)} {n(4)}", f"{n(3)} {n(2)} {n(4)}", f"{n(1)}-{n(3)}-{n(4)}-{n(1)}", f"{n(2)}/{n(2)}/{n(4)}"])
    elif kind == "account":
        body = n(18)
        check = next(f"{k:02d}" for k in range(2, 99) if mod97(f"DE{k:02d}{body}"))
        if good:
            iban = f"DE{check}{body}"
            span = rng.choice([iban, " ".join(iban[k : k + 4] for k in range(0, len(iban), 4)), f"{rng.randint(100, 772):03d}-{rng.randint(1, 99):02d}-{n(4)}"])
        else:
            span = rng.choice([f"{rng.choice(['PN', 'EN', 'IS', 'XR'])}{n(2)}{n(12)}", f"{rng.choice(['QT', 'LK'])}{n(2)}{n(8)}", f"{n(3)}-{n(2)}-{n(4)}", f"{rng.choice(['AB', 'QX'])}{n(2)} {n(4)} {n(4)}"])
    elif good:
        alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        span = rng.choice([some("0123456789abcdef", 32, 64), some(alphabet, 20, 48), f"AKIA{some('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16, 16)}", f"ghp_{some(alphabet, 36, 36)}", f"sk-{some(alphabet, 32, 48)}", some(alphabet + "+/", 38, 42) + "==", word().capitalize() + n(3) + rng.choice("!?#$") + word()])
    else:
        span = rng.choice([f"{word()}_{word()}_{word()}_{n(4)}", f"{word()}-{word()}-{word()}-{n(2)}", f"{word()}/{word()}/{word()}/{n(4)}", some("0123456789abcdef", 40, 40), n(rng.randint(16, 24)), f"IMG_{n(8)}_{n(6)}", word() + word() + n(2) + word()])
    cue = rng.random()
    if good:
        lead = rng.choice(_CUE_WORDS[kind]) if cue < 0.8 else word() if cue < 0.97 else rng.choice(_DECOY_CUES)
    else:
        lead = rng.choice(_DECOY_CUES) if cue < 0.5 else word() if cue < 0.95 else rng.choice(_CUE_WORDS[kind])
    quote = rng.choice(["", "", '"', "'"]) if kind == "secret" else ""
    before = f"{word()} {word()}, {lead} {quote}"
    return f"{before}{span}{quote} {word()} {word()}.", kind, len(before), len(before) + len(span), int(good)


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, tuple[np.ndarray, np.ndarray], dict[str, float]]:
    """(trees, calibration, threshold of each kind); the same in every process."""
    rng = random.Random(20240301)
    made = [_generated(rng) for _ in range(TRAINING)]
    x = np.array([describe(t, k, s, e) for t, k, s, e, _ in made], float)
    y = np.array([m[4] for m in made], float)
    half = TRAINING // 2
    trees = Boosted().fit(x[:half], y[:half])
    f, rest = trees.score(x[half:]), y[half:]
    curve = isotonic(f, rest)
    p = calibrated(curve, f)
    threshold = {}
    for j, kind in enumerate(KINDS):
        own = x[half:, 0] == j
        for t in np.unique(np.r_[p[own], 1.0]):
            chosen = own & (p >= t)
            if t >= 0.5 and (not chosen.any() or rest[chosen].mean() >= PRECISION):
                threshold[kind] = float(t)
                break
        else:
            threshold[kind] = 2.0
    return trees, curve, threshold


def calibrated(curve: tuple[np.ndarray, np.ndarray], f: np.ndarray) -> np.ndarray:
    return curve[1][np.minimum(np.searchsorted(curve[0], f), len(curve[1]) - 1)]


def all_spans(texts: list[str], fitted=None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; fitted: what model() gave."""
    trees, curve, threshold = fitted or model()
    base = [base_spans(t) for t in texts]
    proposed = [(i, *c) for i, t in enumerate(texts) for c in candidates(t)]
    # a candidate within a base span adds nothing; one that holds or touches a base span may extend it
    proposed = [(i, k, s, e) for i, k, s, e in proposed if not any(bs <= s and e <= be for _, bs, be in base[i])]
    extra: list[list] = [[] for _ in texts]
    if proposed:
        x = np.array([describe(texts[i], k, s, e, any(s < be and bs < e for _, bs, be in base[i])) for i, k, s, e in proposed], float)
        p = calibrated(curve, trees.score(x))
        ranked = sorted(((-q, i, s, KINDS.index(k), e) for (i, k, s, e), q in zip(proposed, p) if q >= threshold[k]))
        for _, i, s, k, e in ranked:
            if not any(s < oe and os < e for _, os, oe in extra[i]):
                extra[i].append((KINDS[k], s, e))
    return [(b, sorted(b + x, key=lambda v: (v[1], KINDS.index(v[0]), v[2]))) for b, x in zip(base, extra)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one, named for the first."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        for b in small(batches):
            cols: list[list] = [[] for _ in range(6)]
            for base, every in all_spans([t or "" for t in b.column("text").to_pylist()], shared.value):
                kinds = [k for k, _, _ in base]
                for c, k in zip(cols, KINDS[:4]):
                    c.append(kinds.count(k))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(every))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], [x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def redact_table(docs: DataFrame) -> DataFrame:
    """docs with redacted text (null stays null); all columns stay."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches):
        k = names.index("text")
        for b in small(batches):
            texts = b.column(k).to_pylist()
            new = [None if t is None else redact(t, every) for t, (_, every) in zip(texts, all_spans([t or "" for t in texts], shared.value))]
            yield b.set_column(k, "text", pa.array(new, b.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents", "doc_id", "text"))
