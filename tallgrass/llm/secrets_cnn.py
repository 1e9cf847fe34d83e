"""Operator 7: secret scans by rules and a character convolutional network in numpy.

The rules give base spans.  The network scores every candidate, the values that
rules find and every other long token (where rules find a part of a token, the
rest of it), together with the characters around it;
a token longer than its window is seen in overlapping windows, of which the
highest score counts.  Spans of rules stay whatever their score; other tokens
become spans by theirs.
It is trained on labelled findings: generated ones of known kinds, and findings
in a bounded sample of documents, drawn by a hash of their text, that rules and
plain words label.  Its scores are calibrated on findings kept apart, and the
threshold of each kind is the highest that keeps the recall asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, arrow_schema, table, text_rows

_WORDS = ("password", "passwd", "secret", "token", "api_?key")
_CASED = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _WORDS)
ASSIGN = re.compile(rf"""({_CASED})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
#: Tokens that are words or numbers, alone or joined: in the sample they are no secrets.
PLAIN = re.compile(r"(?:(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+)(?:[/_=+-]+|$))+")
#: What documents with findings of the rules hold, for Spark to draw them.
TELLING = r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:passw(or)?d|secret|token|api_?key)[\"']?\x20*[:=]"
KINDS = ("assign", "access", "hex", "cnn")
#: Bounds of the training set: generated findings, rows that the documents are drawn from, documents, those of one source and kind, and findings of one label in a document.
GENERATED, SAMPLE_ROWS, SAMPLE_DOCS, SAMPLE_EACH, SAMPLE_FINDINGS = 3_200, 40_000, 600, 150, 4
#: Windows that the network scores at a time.
WINDOWS = 512
RECALL, BEFORE, INSIDE, AFTER, FILTERS, WIDTH, EPOCHS = 0.95, 24, 40, 8, 16, 5, 8
OUT = "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, n_sure long, score double, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the rules, sorted; leftmost and non-overlapping within a kind."""
    found, low = [], text.lower()
    if any(w in low for w in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the network scores, as (start, end, kind): the values of the rules' spans ``taken``, in their order, then all other tokens.

    A token has 12 characters and more with a digit, or 16 and more with a
    letter.  Where rules have found a part of a token, what is left on either
    side, and between, is a token of its own; so nothing beside a finding hides.
    """
    found = [(ASSIGN.match(text, s).start(2) if k == 0 else s, e, k) for s, k, e in taken]
    told, first = sorted((s, e) for s, _, e in taken), 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while first < len(told) and told[first][1] <= at:
            first += 1
        k = first
        while at < end:
            # the next span that reaches into the token, if there is one
            while k < len(told) and told[k][1] <= at:
                k += 1
            start, after = told[k] if k < len(told) and told[k][0] < end else (end, end)
            if start - at >= 12 and worth(text, at, start):
                found.append((at, start, 3))
            at = max(at, after)
    return found


def worth(text: str, start: int, end: int) -> bool:
    """Whether a token can be a secret: it has a digit, or 16 characters and a letter."""
    return bool(DIGIT.search(text, start, end) or (end - start >= 16 and LETTER.search(text, start, end)))


#: Classes of characters that the network tells apart; the last channel marks the token itself.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "=", "_-", ".", "\"'", " \t\n", ":", "@")
_CLASS = {c: i for i, cs in enumerate(_CLASSES) for c in cs}
CHANNELS, SPAN = len(_CLASSES) + 2, BEFORE + INSIDE + AFTER


def places(start: int, end: int) -> list[tuple[int, int]]:
    """Windows over a token: the token, or overlapping parts of a longer one, so that half a window's length is whole in one of them."""
    last = end - INSIDE
    return [(start, end)] if last <= start else [(s, s + INSIDE) for s in [*range(start, last, INSIDE // 2), last]]


#: A character's code is its class, one more for each; those of the token itself come after all others; 0 is no character.
_OTHER = len(_CLASSES)
CODES = 2 * (_OTHER + 1) + 1
_CODE = np.array([1 + _CLASS.get(chr(i), _OTHER) for i in range(128)] + [1 + _OTHER], np.uint8)
_ONE_HOT = np.zeros((CODES, CHANNELS), np.float32)
for _i in range(_OTHER + 1):
    _ONE_HOT[1 + _i, _i] = _ONE_HOT[2 + _OTHER + _i, _i] = _ONE_HOT[2 + _OTHER + _i, -1] = 1


def codes_of(text: str) -> np.ndarray:
    return _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


def coded(codes: np.ndarray, start: int, end: int) -> np.ndarray:
    """A token, or the first ``INSIDE`` characters of a longer one, and the characters around it, as codes."""
    end, left = min(end, start + INSIDE), max(0, start - BEFORE)
    out = np.zeros(SPAN, np.uint8)
    out[BEFORE - (start - left) : BEFORE] = codes[left:start]
    out[BEFORE : BEFORE + end - start] = codes[start:end] + np.uint8(1 + _OTHER)
    right = codes[end : end + AFTER]
    out[BEFORE + INSIDE : BEFORE + INSIDE + len(right)] = right
    return out


def window(text: str, start: int, end: int) -> np.ndarray:
    """``coded`` as one-hot classes, the last channel marks the token."""
    return _ONE_HOT[coded(codes_of(text), start, end)]


@dataclass
class Network:
    """Convolution, rectifier, maximum and mean over places, one logistic unit; then Platt's calibration and a threshold for each kind."""

    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (0.5,) * len(KINDS)
    pairs: list[np.ndarray] | None = None

    @staticmethod
    def start(seed: int = 0) -> Network:
        r = np.random.default_rng(seed)
        return Network(r.normal(0, 0.2, (WIDTH * CHANNELS, FILTERS)), np.zeros(FILTERS), r.normal(0, 0.2, 2 * FILTERS), 0.0)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        strips = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), SPAN - WIDTH + 1, -1)
        h = np.maximum(strips @ self.kernel + self.bias, 0)
        pooled = np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1)
        return pooled @ self.dense + self.offset, (strips, h, pooled)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> None:
        names, rng, step = ("kernel", "bias", "dense", "offset"), np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(np.asarray(getattr(self, k), float)) for k in names} for _ in range(2))
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                z, (strips, h, pooled) = self.forward(x[at])
                g = (1 / (1 + np.exp(-z)) - y[at]) / len(at)
                back = g[:, None] * self.dense
                top = (h == h.max(axis=1, keepdims=True)) & (h > 0)
                gh = (top / np.maximum(top.sum(axis=1, keepdims=True), 1) * back[:, None, :FILTERS] + back[:, None, FILTERS:] / h.shape[1]) * (h > 0)
                grads = {"kernel": np.tensordot(strips, gh, ((0, 1), (0, 1))), "bias": gh.sum(axis=(0, 1)), "dense": pooled.T @ g, "offset": g.sum()}
                step += 1
                for k in names:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grads[k], 0.999 * v[k] + 0.001 * grads[k] ** 2
                    setattr(self, k, getattr(self, k) - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, z: np.ndarray, y: np.ndarray, kind: np.ndarray, recall: float) -> None:
        """Platt's scaling of raw scores of findings by Newton steps, then for each kind the highest threshold that keeps the recall."""
        a, b = 1.0, 0.0
        goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w, g = p * (1 - p) + 1e-6, p - goal
            step = np.linalg.solve([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]], [(g * z).sum(), g.sum()])
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = float(a), float(b)
        found = []
        for k in range(len(KINDS)):
            hits = np.sort(self.scaled(z)[(y > 0) & (kind == k)])
            found.append(float(min(hits[int((1 - recall) * len(hits))], 0.999)) if len(hits) else 0.5)
        self.thresholds = tuple(found)

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(self.forward(x)[0])

    def raw(self, codes: np.ndarray) -> np.ndarray:
        """``forward`` of coded windows: the filters' answers are looked up by pairs of neighbours, which is all that a one-hot product does."""
        if self.pairs is None:
            each = (_ONE_HOT @ self.kernel.reshape(WIDTH, CHANNELS, FILTERS)).astype(np.float32)
            self.pairs = [(each[k][:, None] + each[k + 1][None]).reshape(-1, FILTERS) if k + 1 < WIDTH else each[k] for k in range(0, WIDTH, 2)]
        places = SPAN - WIDTH + 1
        two = codes[:, :-1].astype(np.intp) * CODES + codes[:, 1:]
        h = np.broadcast_to(self.bias.astype(np.float32), (len(codes), places, FILTERS)).copy()
        for k, table in zip(range(0, WIDTH, 2), self.pairs, strict=True):
            h += np.take(table, (two if k + 1 < WIDTH else codes)[:, k : k + places], axis=0)
        np.maximum(h, 0, out=h)
        return np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ self.dense + self.offset

    def highest(self, findings: list[tuple[str, int, int]]) -> np.ndarray:
        """Raw scores of tokens (text, start, end), each the highest of its windows; so many windows at a time."""
        out, seen, codes = np.full(len(findings), -np.inf), None, np.zeros(0, np.uint8)
        at, rows = [], []

        def told() -> None:
            if rows:
                np.maximum.at(out, at, self.raw(np.array(rows)))
            at.clear()
            rows.clear()

        for i, (text, s, e) in enumerate(findings):
            if text is not seen:
                seen, codes = text, codes_of(text)
            for p in places(s, e):
                at.append(i)
                rows.append(coded(codes, *p))
                if len(rows) == WINDOWS:
                    told()
        told()
        return out


def generated(n: int = GENERATED, seed: int = 0) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, start, end, label): keys of several alphabets after telling words; ids, names, numbers, digests and place holders elsewhere."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    run = lambda chars, k: "".join(chars[i] for i in r.integers(len(chars), size=k))
    size = lambda least, most: int(r.integers(least, most))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: run(low, size(2, 9))
    keys = [
        lambda: run(low + up + dig, size(20, 64)), lambda: run(low + up + dig + "+/", size(24, 64)) + pick(("", "=", "==")), lambda: run(dig + "ABCDEF", size(32, 65)), lambda: run(dig + "abcdef", size(24, 65)),
        lambda: "AKIA" + run(up + dig, 16), lambda: run(low, 3) + "_" + run(low + up + dig, 36), lambda: run(low + up, size(20, 64)), lambda: run(low + dig, size(16, 40)),
    ]
    others = [
        lambda: "-".join(word() for _ in range(4)) + run(dig, 2), lambda: "_".join(word() for _ in range(4)) + run(dig, 1), lambda: f"20{run(dig, 2)}-{run(dig, 2)}-{run(dig, 2)}T{run(dig, 6)}", lambda: word() * 3 + word() * 2 + run(dig, 3),
        lambda: "/".join(word() for _ in range(4)) + "/" + run(dig, 3), lambda: run(dig, 4) + "-" + "-".join(word().upper() for _ in range(3)), lambda: "item" + run(dig, 12), lambda: word() * 2 + word() * 2 + run(low, 8),
        lambda: "/".join(word() for _ in range(size(6, 16))), lambda: "".join(word().title() for _ in range(5)), lambda: "_".join(word().upper() for _ in range(5)), lambda: run(dig, size(12, 24)), lambda: word() + run(dig, size(10, 14)),
    ]
    asked = lambda: pick(("password", "Passwd", "SECRET", "token", "api_key", "apikey")) + pick((": ", " = ", "=", '": "', ' = "'))
    out = []
    for i in range(n):
        left, right, label = f"{word()} {word()} {word()} ", f" {word()} {word()}", i % 2
        token = pick(keys if label else others)()
        if i % 8 == 1:  # a key within a path, as a window that is not in line with it may show it
            head, tail = (pick("/-_=").join(word() for _ in range(size(4, 8))) for _ in range(2))
            key, left = run(low + up + dig, 40), f"{left}/{head}/"
            at = len(left) + size(-10, 11)
            out.append((f"{left}{key}/{tail}-{word()}{right}", at, at + INSIDE, 1))
            continue
        if i % 8 in (2, 3):  # what rules find: assigned keys, and assigned words or one character again and again
            left += asked()
            token = token if label else pick((lambda: run(low, size(6, 14)), lambda: pick("xX.-_0") * size(6, 24), lambda: "_".join(word() for _ in range(3)), lambda: "EXAMPLE" * 2))()
        elif i % 8 in (4, 5):  # access ids that spell words, and digests that their words name
            token = pick(keys[3:5])() if label else pick((lambda: "AKIA" + (word() + word() + word() + word()).upper().ljust(16, "X")[:16], lambda: pick("0f") * size(24, 40), lambda: "0123456789abcdef" * 2))()
        elif label:
            left += pick(("", "key ", "auth: ", 'key = "', "bearer ", "credential=", "private_key: ", "pwd: "))
        out.append((left + token + right, len(left), len(left) + len(token), label))
    return out


def sampled(docs: DataFrame, most_docs: int = SAMPLE_DOCS, each: int = SAMPLE_EACH, most: int = SAMPLE_FINDINGS) -> list[tuple[str, int, int, int]]:
    """Labelled findings in at most ``most_docs`` different texts: values that a rule finds, and plain tokens that none finds.

    Texts are drawn by their hash, first some ``SAMPLE_ROWS`` and of these
    ``each`` of every source (if there are sources) with and without what the
    rules look for, so neither the order of files nor copies decide; of a text,
    ``most`` findings of each label.
    """
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit("")
    rows = docs.select(text.alias("text"), F.xxhash64(text, F.lit(29)).alias("h"), source.alias("source"))
    rows = rows.where(F.pmod("h", F.lit(1 << 20)) < (1 << 20) * share)
    order = Window.partitionBy("source", "told").orderBy("h")
    marks = rows.select("h", "source", F.col("text").rlike(TELLING).alias("told"))
    drawn = marks.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= each).select("h").distinct().orderBy("h").limit(most_docs)
    hashes = [r["h"] for r in drawn.collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("text string, start int, end int, label int")
        for b in batches:
            found = []
            for t in b["text"]:
                text = t.as_py()
                spans = [(s, e, int(k < 3)) for s, e, k in candidates(text, base_spans(text)) if k < 3 or PLAIN.fullmatch(text, s, e)]
                spans.sort(key=lambda x: hashlib.md5(text[x[0] : x[1]].encode()).digest())
                few = [x for y in (0, 1) for x in [x for x in spans if x[2] == y][:most]]
                found += [(text[max(0, s - 64) : e + 64], s - max(0, s - 64), e - max(0, s - 64), y) for s, e, y in few]
            yield arrow_rows(schema, found)

    texts = rows.where(F.col("h").isin(hashes)).groupBy("h").agg(F.first("text").alias("text")).select("text")
    return sorted(tuple(r) for r in texts.mapInArrow(run, "text string, start int, end int, label int").collect())


def kind_of(text: str, start: int, end: int) -> int:
    """The rule that finds a value, or 3."""
    return next((k for s, e, k in candidates(text, base_spans(text)) if (s, e) == (start, end) and k < 3), 3)


def train(findings: list[tuple[str, int, int, int]], recall: float = RECALL) -> Network:
    """Four of five findings train, the fifth calibrates."""
    y = np.array([f[3] for f in findings], float)
    kept = np.arange(len(y)) % 5 == 0
    kept = kept[np.random.default_rng(1).permutation(len(y))]
    shown = [(window(t, *p), label) for (t, s, e, label), k in zip(findings, kept, strict=True) if not k for p in places(s, e)]
    net = Network.start()
    net.train(np.array([x for x, _ in shown]), np.array([label for _, label in shown], float))
    apart = [f[:3] for f, k in zip(findings, kept, strict=True) if k]
    net.calibrate(net.highest(apart), y[kept], np.array([kind_of(*f) for f in apart]), recall)
    return net


def scored(text: str, net: Network) -> list[tuple[int, int, int, float]]:
    """Every candidate that is a span as (start, kind, end, score), in the order of spans, the network's last among equals."""
    taken = base_spans(text)
    if not (seen := candidates(text, taken)):
        return []
    score = net.scaled(net.highest([(text, s, e) for s, e, _ in seen])).tolist()
    spans = [(*span, p) for span, p in zip(taken, score, strict=False)]
    return sorted(spans + [(s, k, e, p) for (s, e, k), p in zip(seen, score, strict=True) if k == 3 and p >= net.thresholds[3]])


def told(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """Counts and spans (``kind:start:end`` in code points) of every whole text.

    ``n_sure`` counts the rules' spans whose score reaches the threshold of
    their kind, ``score`` is the highest of a span (null where there is none).
    A null text is empty and has no spans; repeated rows and null ids return as
    they are, an empty table gives an empty one, other columns are dropped.
    """
    net = net or train(generated() + sampled(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(OUT)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                spans = scored(text.as_py(), net)
                kinds, base = [x[1] for x in spans], told([x for x in spans if x[1] < 3])
                sure = sum(k < 3 and p >= net.thresholds[k] for _, k, _, p in spans)
                rows.append((doc_id, *(kinds.count(k) for k in range(4)), sure, max((x[3] for x in spans), default=None), hashlib.sha256(base.encode()).hexdigest(), told(spans)))
            yield arrow_rows(schema, rows)

    return text_rows(docs).mapInArrow(run, OUT)


MASK = "[secret]"


def masked(text: str, net: Network) -> str:
    """The text with the value of every finding masked; names of assigned secrets stay."""
    places = [(ASSIGN.match(text, s).start(2) if k == 0 else s, e) for s, k, e, _ in scored(text, net)]
    out, at = [], 0
    for s, e in sorted(places):
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """All rows and columns of ``docs``; texts with findings have them masked, and ``n_chars`` follows. Null texts stay null."""
    net = net or train(generated() + sampled(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            text = [None if t.as_py() is None else masked(t.as_py(), net) for t in b["text"]]
            new = {"text": text, "n_chars": [None if t is None else len(t) for t in text]}
            columns = [pa.array(new[c], b.schema.field(c).type) if c in new else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op7_char_cnn_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
