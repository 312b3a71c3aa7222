"""Personal data: base patterns, and boosted trees over candidates that the patterns do not cover.

High-recall generators propose spans that may overlap (spelled-out addresses, national phone numbers, identity and
account numbers, IPv6). Gradient-boosted trees, trained here on generated examples, score each candidate by its format
and its context. Scores are calibrated by Platt scaling on held-out examples, and each kind has the lowest threshold
that keeps the wanted precision there. Of accepted candidates that overlap, the best score stays; base spans always stay.

Defined cases: a null or empty text has no spans; texts are read whole, whatever their length; repeated rows each get their
own result; of candidates with one score the first, then the shorter, then the first kind by name is taken; positions are
code points; an empty table gives no rows; other columns are not read (``redact`` returns them as they are and counts
``n_chars`` anew), whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import base_digest, count_kind, find_spans, spelled, two_columns

KINDS = ("email", "ip", "card", "phone", "account", "identity")
LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

# Candidate generators: loose on purpose, the trees decide. Bounds are those of the formats: five groups of digits in a
# phone number, 34 characters in an account number, eight groups in an address, nineteen digits in a card number.
GENERATORS = (
    ("email", b"@([{<", re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\{at\}|<at>)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|<dot>)\x20?[A-Za-z0-9-]++)++")),
    ("phone", b"", re.compile(rb"(?<![0-9])(?:00|\()?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,5}+){1,4}(?![0-9])")),
    ("identity", b"-", re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", b"", re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ip", b":", re.compile(rb"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")),
    ("card", b"", re.compile(rb"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){2,3}(?:[./_][0-9]{1,3})?(?![0-9])")),
)
# Context words, lower case, by what they speak for.
CONTEXT = (
    (b"mail", b"e-mail", b"contact", b"write", b"reach"),
    (b"phone", b"tel", b"call", b"mobile", b"fax", b"dial", b"whatsapp"),
    (b"card", b"visa", b"mastercard", b"credit", b"cvv"),
    (b"iban", b"account", b"bank", b"transfer", b"konto"),
    (b"ssn", b"social", b"security number", b"identity", b"tax id"),
    (b"ip", b"host", b"server", b"address", b"login"),
    (b"version", b"isbn", b"order", b"invoice", b"page", b"date", b"price", b"part", b"item", b"ratio", b"score", b"build", b"figure", b"year"),
)
ANY_DIGIT = bytes(120 if 48 <= c <= 57 else 32 for c in range(256))


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = c - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple]:
    """The four fixed patterns, by kind, then start."""
    out = []
    last, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > last and raw[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(raw, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end(), True, 1.0))
            last = m.end()
        at = raw.find(b"@", max(at + 1, last))
    out += [("ip", m.start(), m.end(), True, 1.0) for m in IP.finditer(raw) if all(len(d := p.lstrip(b"0")) <= 3 and int(d or b"0") <= 255 for p in m[0].split(b"."))]
    for m in CARD.finditer(raw):
        if m.end() - m.start() >= 13:
            d = m[0].translate(None, b" -")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end(), True, 1.0))
    if b"+" in raw:
        out += [("phone", m.start(), m.end(), True, 1.0) for m in PHONE.finditer(raw) if 9 <= len(m[0].translate(None, b" ().-+")) <= 15]
    return out


def candidates(raw: bytes) -> list[tuple[str, int, int]]:
    number = b"x" in raw.translate(ANY_DIGIT)
    out = []
    for kind, need, pattern in GENERATORS:
        if (number or kind == "email") and (not need or any(raw.find(need[k : k + 1]) >= 0 for k in range(len(need)))):
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(raw)]
    return out


def mod97(b: bytes) -> bool:
    b = b.replace(b" ", b"")
    return len(b) >= 15 and int("".join(str(int(chr(c), 36)) for c in b[4:] + b[:4])) % 97 == 1


def features(raw: bytes, kind: str, start: int, end: int) -> list[float]:
    span = raw[start:end]
    before, after = raw[max(0, start - 48) : start].lower(), raw[end : end + 24].lower()
    digits = span.translate(None, bytes(c for c in range(256) if not 48 <= c <= 57))
    groups = re.findall(rb"[0-9]+", span)
    tail = re.split(rb"[^A-Za-z]+", span)[-1]
    return [
        float(KINDS.index(kind)), end - start, len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, digits[0] - 48 if digits else -1, luhn(digits) if digits else 0,
        span.count(b"."), span.count(b"-"), span.count(b" "), span.count(b"/"), span.count(b":"), span.count(b"("), span.count(b"@"), len(tail),
        mod97(span) if kind == "account" else 0, b"::" in span, any(c in b"abcdefABCDEF" for c in span), sum(len(g) > 1 and g[:1] == b"0" for g in groups),
        before[-1:] in (b"", b" ", b"\n", b"\t", b":", b"(", b",", b";"), after[:1] in (b"", b" ", b"\n", b".", b",", b")", b";"), before[-1:] in b"$#/=." and before != b"", before.rstrip().endswith((b":", b"=")),
        *[any(w in before or w in after for w in words) for words in CONTEXT],
    ]


class Trees:
    """Gradient boosting with logistic loss over quantile-binned features; trees of fixed depth."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        n, width = x.shape
        self.start = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.start)
        self.trees = []
        flat = binned + np.arange(width) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            leaf, tree = np.zeros(n, np.int64), []
            for level in range(self.depth):
                nodes = 1 << level
                cells = (leaf[:, None] * (width * self.bins) + flat).ravel()
                g, h = (np.bincount(cells, np.repeat(v, width), nodes * width * self.bins).reshape(nodes, width, self.bins) for v in (grad, hess))
                left_g, left_h = g.cumsum(2), h.cumsum(2)
                all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
                gain = left_g**2 / (left_h + self.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + self.ridge) - all_g**2 / (all_h + self.ridge)
                gain[:, :, -1] = 0
                best = gain.reshape(nodes, -1).argmax(1)
                which, cut = best // self.bins, best % self.bins
                none = gain.reshape(nodes, -1).max(1) <= 1e-9
                value = np.array([np.inf if none[k] or cut[k] >= len(edges[which[k]]) else edges[which[k]][cut[k]] for k in range(nodes)])
                tree.append((which, value))
                leaf = leaf * 2 + (x[np.arange(n), which[leaf]] > value[leaf])
            size = 1 << self.depth
            weight = -self.rate * np.bincount(leaf, grad, size) / (np.bincount(leaf, hess, size) + self.ridge)
            score += weight[leaf]
            self.trees.append((tree, weight))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.start), np.arange(len(x))
        for tree, weight in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for which, value in tree:
                leaf = leaf * 2 + (x[row, which[leaf]] > value[leaf])
            out += weight[leaf]
        return out


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Generated candidates in context with their truth: no outside data, the same for one seed."""
    r = np.random.default_rng(seed)
    pick = lambda *a: a[r.integers(len(a))]
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(pick("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ou", "la", "ch") for _ in range(r.integers(1, 5)))

    def check97(country: str, body: str) -> str:
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{98 - rest:02d}{body}"

    def true() -> tuple[str, str]:
        k = r.integers(6)
        if k == 0:
            at, dot = pick((" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "(dot)"), (" @ ", "."), ("{at}", "{dot}"))
            return pick("mail ", "contact: ", "write to ", ""), f"{word()}{pick('.', '_', '')}{word()}{at}{word()}{dot}{pick('com', 'org', 'net', 'de', 'fr')}"
        if k == 1:
            return pick("phone ", "tel: ", "call ", "mobile ", "fax: "), pick(f"({num(3)}) {num(3)}-{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"00{num(2)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}")
        if k == 2:
            return pick("ssn ", "social security number ", "identity: ", "tax id "), f"{r.integers(100, 899)}-{r.integers(10, 99)}-{r.integers(1000, 9999)}"
        if k == 3:
            full = check97(pick("DE", "FR", "ES", "GB", "NL"), num(pick(16, 18, 20)))
            return pick("iban ", "account: ", "bank transfer to ", ""), pick(full, " ".join(full[i : i + 4] for i in range(0, len(full), 4)))
        if k == 4:
            return pick("ip ", "host ", "login from ", "server "), ":".join(f"{v:x}" for v in r.integers(1, 65535, 8))
        body = pick("4", "5", "6") + num(14)
        full = body + next(d for d in "0123456789" if luhn((body + d).encode()))
        return pick("card ", "visa: ", "credit card "), pick(".", "/", "_").join(full[i : i + 4] for i in range(0, 16, 4))

    def false() -> tuple[str, str]:
        k = r.integers(6)
        if k == 0:
            return pick("", "price ", "ratio "), f"{word()} {pick('@ ', '(at) ')}{num(2)}.{num(2)}"
        if k == 1:
            return pick("version ", "order ", "invoice ", "date ", "page ", "isbn ", "", "part "), pick(f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)}", f"{num(2)}/{num(2)}/{num(4)}", f"{num(3)}-{num(2)}", f"{num(3)}-{num(5)}-{num(2)}", f"{num(4)} {num(4)}", f"{num(2)}.{num(2)}", f"{num(4)}-{num(4)}", f"{num(2)} {num(3)} {num(3)}")
        if k == 2:
            return pick("part ", "order ", "item ", "build ", ""), f"{num(3)}-{num(2)}-{num(4)}"
        if k == 3:
            return pick("part ", "item ", "build ", ""), f"{pick('AB', 'XK', 'PN', 'DE')}{num(2)}{num(4)}{num(4)}{pick('', num(4))}"
        if k == 4:
            return pick("score ", "ratio ", "date ", ""), ":".join(num(2) for _ in range(r.integers(4, 6)))
        return pick("item ", "order ", "figure ", ""), pick(".", "/", "_").join(num(4) for _ in range(3))

    xs, ys, kinds = [], [], []
    while len(xs) < n:
        good = bool(r.integers(2))
        lead, body = true() if good else false()
        text = f"{word()} {word()} {lead}{body}{pick(' ', '. ', ', ', chr(10))}{word()} {word()}".encode()
        at = text.index(body.encode())
        for kind, start, end in candidates(text):
            if start < at + len(body) and end > at:
                xs.append(features(text, kind, start, end))
                ys.append(good and start <= at + 1 and end >= at + len(body) - 1)
                kinds.append(kind)
    return np.array(xs, float), np.array(ys, float), kinds


@lru_cache(1)
def trained(n: int = 6000, seed: int = 7, precision: float = 0.99) -> tuple[Trees, np.ndarray, np.ndarray]:
    """The trees, Platt's slope and shift, and each kind's threshold on the calibrated probability."""
    x, y, _ = examples(n, seed)
    trees = Trees().fit(x, y)
    hx, hy, _ = examples(n // 2, seed + 1)
    s, fit = trees.score(hx), np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-(fit[0] * s + fit[1])))
        w, d = p * (1 - p) + 1e-9, p - hy
        a = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        fit -= np.linalg.solve(a, np.array([(d * s).sum(), d.sum()]))
    p = 1 / (1 + np.exp(-(fit[0] * s + fit[1])))
    cuts = np.full(len(KINDS), 2.0)
    for k in range(len(KINDS)):
        mine = hx[:, 0] == k
        order = np.argsort(-p[mine], kind="stable")
        if mine.any():
            right = np.cumsum(hy[mine][order]) / np.arange(1, mine.sum() + 1)
            if (ok := np.flatnonzero(right >= precision)).size:
                cuts[k] = max(0.5, p[mine][order][ok[-1]])
    return trees, fit, cuts


def spans_of(text: str, model=None) -> list[tuple]:
    """(kind, start, end, base, score): base spans and accepted candidates, by kind as listed, then start."""
    raw = text.encode("ascii", "replace")  # one byte for each code point; '?' is in no pattern
    out = base_spans(raw)
    found = candidates(raw)
    if found and out:
        taken = sorted((s[1], s[2]) for s in out)
        starts, ends = [t[0] for t in taken], list(accumulate((t[1] for t in taken), max))
        found = [c for c in found if not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[1]]
    if found:
        trees, fit, cuts = model or trained()
        p = 1 / (1 + np.exp(-(fit[0] * trees.score(np.array([features(raw, *c) for c in found], float)) + fit[1])))
        best = sorted((-round(float(v), 9), c[1], c[2], c[0]) for v, c in zip(p, found, strict=True) if v >= cuts[KINDS.index(c[0])])
        starts, ends = [], []
        for v, start, end, kind in best:
            k = bisect_left(starts, start)
            if (k == 0 or ends[k - 1] <= start) and (k == len(starts) or starts[k] >= end):
                starts.insert(k, start)
                ends.insert(k, end)
                out.append((kind, start, end, False, -v))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` of every text, one narrow pass without a shuffle; the model is fitted once on the driver."""
    model = trained()
    return find_spans(two_columns(df, id_col, text_col), lambda: lambda text: spans_of(text, model))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with each span's text replaced by its kind in brackets; null stays null."""
    import pyarrow as pa
    import pyarrow.compute as pc

    model, at = trained(), df.columns.index(text_col)

    def cut(text: str) -> str:
        out, last = [], 0
        for kind, start, end, *_ in sorted(spans_of(text, model), key=lambda s: (s[1], -s[2])):
            if start >= last:
                out += [text[last:start], f"[{kind.upper()}]"]
            last = max(last, end)
        return "".join([*out, text[last:]]) if out else text

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * (8 << 20) / max(1, batch.nbytes)))
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = pa.array([t and cut(t) for t in part.column(at).to_pylist()], part.column(at).type)
                columns = [texts if i == at else c for i, c in enumerate(part.columns)]
                if "n_chars" in part.schema.names:
                    i = part.schema.get_field_index("n_chars")
                    columns[i] = pc.utf8_length(texts).cast(part.column(i).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *[count_kind(k) for k in ("email", "ip", "card", "phone")], base_digest(), spelled("spans").alias("spans"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return digest(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("text"))))
