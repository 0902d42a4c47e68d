"""Personal data: candidates of high recall, chosen by gradient boosting.

Base patterns with checks give spans that always stay. Generators propose more spans, which may
overlap each other; boosted trees score them by format and context, and the threshold that reaches
the wanted precision on held-out examples decides which of them are redacted as well.

* Null texts count as empty. Positions are code points, ends exclusive.
* Spans of one kind never overlap. A proposed span that touches a base span, or a better proposed
  one, leaves; of equal scores the earlier and then the longer span stays.
* The model is trained on examples made from formats by a fixed seed, and on candidates of a bounded
  sample of the texts (``max_texts``), labelled by the base checks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
MAX_TEXTS = 1000
PRECISION = 0.995
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# Digit runs are taken whole, and never entered in their middle: linear on any text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")


def digits(text: str) -> str:
    return _NOT_DIGIT.sub("", text)


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from every @ outwards: linear on any text."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns that pass their checks, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 13 <= len(n := digits(m[0])) <= 19 and luhn(n):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- candidates

_AT = re.compile(r" ?(?:\(at\)|\[at\]|@) ?| at ", re.I)
_DOTTED = re.compile(r"[A-Za-z0-9-]{2,40}(?:(?: ?(?:\(dot\)|\[dot\]|\.) ?| dot )[A-Za-z0-9-]{2,20}){1,4}", re.I)
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+(-])\+?\(?[0-9][0-9 ().-]{5,28}[0-9](?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_WORD_BEFORE = re.compile(r"([A-Za-z]{2,20})\W{0,6}$")
_GROUP = re.compile(r"[0-9]+")
_HINTS = {
    "email": {"mail", "email", "contact", "write", "address", "e"},
    "ip": {"ip", "host", "server", "address", "from", "node"},
    "card": {"card", "visa", "pay", "payment", "credit", "number"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telephone", "cell"},
    "secret": {"token", "key", "secret", "password", "pwd", "apikey", "credential", "bearer"},
}


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data; kinds and spans may overlap."""
    out = []
    if "@" in text or "at" in text:
        for m in _AT.finditer(text):
            domain = _DOTTED.match(text, m.end())
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in _LOCAL:
                start -= 1
            if domain and start < m.start():
                out.append(("email", start, domain.end()))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(digits(m[0]))
            if 7 <= n <= 15:
                out.append(("phone", *m.span()))
            if 12 <= n <= 19:
                out.append(("card", *m.span()))
            if m[0].count(".") == 3:
                out.append(("ip", *m.span()))
        for m in _TOKEN.finditer(text):
            if _DIGIT.search(m[0]):
                out.append(("secret", *m.span()))
    return out


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 2]
    number = digits(span)
    groups = [len(g) for g in _GROUP.findall(span)]
    words = set(w.lower() for w in re.findall(r"[A-Za-z]+", before))
    last = _WORD_BEFORE.search(before)
    letters = sum(c.isascii() and c.isalpha() for c in span)
    return [
        *(float(kind == k) for k in KINDS),
        float(end - start),
        float(len(number)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(groups[-1] if groups else 0),
        float(groups[0] if groups else 0),
        letters / (end - start),
        float(len(set(span))) / (end - start),
        float(luhn(number)) if len(number) >= 12 else -1.0,
        float(all(int(g) <= 255 for g in span.split(".") if g.isdigit() and len(g) < 9)) if span.count(".") == 3 else -1.0,
        float(span[0] == "+"),
        float("(" in span and ")" in span),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count(" ")),
        float("@" in span),
        float("(at)" in span.lower() or "[at]" in span.lower()),
        float(" dot " in span.lower() or "(dot)" in span.lower() or "[dot]" in span.lower()),
        float(any(c.isdigit() for c in span) and letters > 0),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False))),
        float(bool(words & _HINTS[kind])),
        float(bool(last) and last[1].lower() in _HINTS[kind]),
        float(before[-1:] in "\"'=:" and bool(before)),
        float(after[:1] in "\"'"),
        float(after[:1] == "" or after[:1] in " \n.,;!?)\"'"),
    ]


# ---- boosting


@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features: arrays of split feature, split value and leaf."""

    bias: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    values: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, v, leaf in zip(self.features, self.values, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(f):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > v[node])
            out += leaf[node - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24) -> Trees:
    """Logistic gradient boosting: each tree splits its nodes level by level by the second-order gain."""
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], axis=1)
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(float(np.log(share / (1 - share))))
    raw = np.full(n, model.bias)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, value, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            if len(rows) >= 10:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(k):
                    if not len(cuts[j]):
                        continue
                    m = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], m))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], m))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    i = int(gain.argmax())
                    if gain[i] > best:
                        best, feature[at], value[at] = gain[i], j, cuts[j][i]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > value[at])
        leaf = node - inner
        size = 2**depth
        weight = -rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
        raw += weight[leaf]
        model.features.append(feature)
        model.values.append(value)
        model.leaves.append(weight)
    return model


def made_examples(n: int = 3000, seed: int = 5) -> list[tuple[str, str, int, int, int]]:
    """Labelled candidates from formats: (text, kind, start, end, label)."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))

    def card(valid: bool) -> str:
        body = pick("4", "51", "37", "6011") + num(14)
        body = body[: pick(15, 14, 12)]
        last = next(c for c in "0123456789" if luhn(body + c))
        body += last if valid else str((int(last) + 1 + int(rng.integers(9))) % 10)
        return " ".join(body[i : i + 4] for i in range(0, len(body), 4)) if rng.random() < 0.4 else body

    def hex_(k: int) -> str:
        return "".join("0123456789abcdef"[int(c)] for c in rng.integers(0, 16, k))

    def one() -> tuple[str, str, int]:
        kind = pick(*KINDS)
        good = bool(rng.random() < 0.5)
        if kind == "email":
            at, dot = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("@", "."), (" @ ", "."))
            name = f"{word()}.{num(2)}" if rng.random() < 0.5 else f"{word()}{pick('.', '_', '')}{word()}"
            if good:
                return f"{name}{at}{word()}{dot}{pick('com', 'org', 'net', 'example.com', 'de')}", kind, 1
            return f"{word()} at {word()}. {word()}", kind, 0
        if kind == "phone":
            a, b, c = num(3), num(3), num(4)
            if good:
                return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"1-{a}-{b}-{c}", f"+49 {a} {b}{c}"), kind, 1
            y, m = 1900 + int(rng.integers(150)), int(rng.integers(1, 13))
            return pick(f"{y}-{m:02d}-{num(2)}", num(int(rng.integers(7, 16))), f"{y} {y + 1}", f"{num(3)}.{num(6)}", f"{y}-{m:02d}-{num(2)} {num(2)}", f"{num(2)} {num(2)} {num(2)} {num(2)}"), kind, 0
        if kind == "card":
            return card(good), kind, int(good)
        if kind == "ip":
            limit = 256 if good else 1000
            parts = [str(int(v)) for v in rng.integers(0 if good else 256, limit, 4)]
            return ".".join(parts), kind, int(good)
        if good:
            return pick(hex_(32), hex_(40), hex_(64), "sk-" + hex_(24) + word().upper(), hex_(20).upper() + word()), kind, 1
        return pick(f"{word()}-{word()}-{word()}-{word()}-{num(2)}", f"{word()}_{word()}_{word()}_{word()}{num(1)}", num(int(rng.integers(20, 30)))), kind, 0

    out = []
    for _ in range(n):
        span, kind, label = one()
        hint = pick(*sorted(_HINTS[kind])) if rng.random() < (0.3 if label else 0.1) else word()
        quote = '"' if kind == "secret" and rng.random() < 0.6 else ""
        sep = pick(" ", ": ", " = ", " ") if quote or rng.random() < 0.3 else " "
        head = f"{word()} {word()} {hint}{sep}{quote}"
        out.append((f"{head}{span}{quote}{pick('', ' ', '. ', ', ')}{word() if rng.random() < 0.8 else ''}", kind, len(head), len(head) + len(span), label))
    # A word glued to the end would change the span: keep those that end at a border.
    return [e for e in out if not (e[0][e[3] : e[3] + 1].isalnum())]


@dataclass
class Model:
    trees: Trees
    threshold: float


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of texts as examples, labelled by the base checks where those can tell."""
    for batch in batches:
        x, y = [], []
        for text in batch.column(1).to_pylist():
            known = base_spans(text)
            for kind, a, b in candidates(text):
                label = any(k == kind and s < b and a < e for k, s, e in known)
                other = any(s < b and a < e for _, s, e in known)
                if kind != "secret" and (label or not other and kind in ("card", "ip")):
                    x.append(describe(text, kind, a, b))
                    y.append(float(label))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.float64())], names=["x", "y"])


def train(documents: DataFrame | None = None, id: str = "doc_id", text: str = "text", max_texts: int = MAX_TEXTS, precision: float = PRECISION, max_found: int | None = None) -> Model:
    """Fit on made examples and on at most ``max_found`` candidates of at most ``max_texts`` texts, and calibrate on a third held out.

    ``max_found`` is the number of made examples if not given, so that these are at least half.
    """
    made = made_examples()
    x = [describe(t, k, a, b) for t, k, a, b, _ in made]
    y = [float(label) for *_, label in made]
    if documents is not None:
        # Ids first: whole texts of the sample only travel to it.
        told = documents.filter(F.col(text).rlike("[0-9]"))
        chosen = told.select(id).orderBy(F.xxhash64(id), id).limit(max_texts).distinct()
        sample = told.select(id, F.col(text).alias("t")).join(F.broadcast(chosen), id)
        found = sample.mapInArrow(_confirmed, "x array<double>, y double").orderBy(F.xxhash64("x"), "x", "y").limit(len(made) if max_found is None else max_found)
        for row in found.collect():
            x.append(row["x"])
            y.append(row["y"])
    x, y = np.array(x), np.array(y)
    order = np.random.default_rng(11).permutation(len(y))
    held, used = order[: len(y) // 3], order[len(y) // 3 :]
    trees = boost(x[used], y[used])
    p = trees.probability(x[held])
    by = np.argsort(-p)
    right = np.cumsum(y[held][by]) / np.arange(1, len(by) + 1)
    enough = np.flatnonzero(right >= precision)
    return Model(trees, float(max(0.9, p[by[enough[-1]]])) if len(enough) else 1.1)


def find(documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> Column:
    """A column of all spans of ``text``: base ones and those that the model adds."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPAN)
    def spans(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        for texts in parts:
            base = [base_spans(t) if t else [] for t in texts]
            more: list[tuple[int, str, int, int]] = []
            rows = []
            for i, t in enumerate(texts):
                for kind, a, b in candidates(t) if t else ():
                    if not any(x < b and a < y for _, x, y in base[i]):
                        more.append((i, kind, a, b))
                        rows.append(describe(t, kind, a, b))
            added: dict[int, list] = {}
            if rows:
                p = known.trees.probability(np.array(rows))
                best = sorted(zip(-np.round(p, 9), more, strict=True), key=lambda m: (m[0], m[1][0], m[1][2], -m[1][3], m[1][1]))
                for q, (i, kind, a, b) in best:
                    if -q >= known.threshold and not any(x < b and a < y for _, x, y in added.get(i, ())):
                        added.setdefault(i, []).append((kind, a, b))
            out = []
            for i in range(len(texts)):
                both = [(*s, True) for s in base[i]] + [(*s, False) for s in added.get(i, ())]
                both.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append([{"kind": k, "start": a, "end": b, "base": o} for k, a, b, o in both])
            yield pd.Series(out)

    return spans(F.col(text))


def _redacted(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join(parts) + text[at:]


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind; spans that overlap become one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_redacted(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    return run(text, spans)


def listed(spans: Column, base_only: bool = False) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    if base_only:
        spans = F.filter(spans, lambda s: s["base"])
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count(spans: Column, kind: str) -> Column:
    """Base spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long")
