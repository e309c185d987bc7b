"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The field's nodes are the tokens that hold a digit or "@"; every other token is outside by definition, which cuts a
document into short chains. Neighbouring nodes share a transition potential, and a node shares a skip potential with
the first node of the document that is similar to it (the same letters and digits, or the same last digits of a long
number), however far away: all mentions of a number are two steps from each other. Loopy message passing over both kinds
of edges gives each node's label, so that a number is labelled alike wherever it is repeated.

The field learns from a bounded sample of documents: from the places of the fixed patterns and of written-out secrets,
and from copies in which a mention is rewritten so that no pattern finds it (a phone number without "+", a card number
with dots, an address without its domain's end), half of them with the true mention elsewhere in the document. So it
adds what the patterns miss: such mentions, and secrets, which have no pattern of their own.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import order_hash, table

# Kinds in their order, and the pattern of each.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: The same matches in linear time: a run that can't match is not tried again from its middle.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LINEAR = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": re.compile(PATTERNS["phone"]),
}
#: A character without which a pattern can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Secrets that are written out: what the field learns this kind from.
SECRET = re.compile(r"\b(?:token|key|secret|password) ?[=:] ?\"?([0-9a-f]{24,})")

#: Documents that the field learns from, steps of its training, and the most rounds of message passing.
SAMPLE_DOCS, STEPS, ROUNDS = 1500, 80, 40
#: Copies of a sampled document with a rewritten mention.
COPIES = 2
#: Message passing ends when no message changes by more than this.
TOLERANCE = 1e-3
#: Of a sampled document: the most nodes, the longest node, and the characters beside nodes.
SAMPLE_NODES, NODE_CHARS, CONTEXT = 64, 256, 32
#: Last digits by which long numbers are similar.
LAST_DIGITS = 7
#: Least probability of a label for a span that the field adds.
MIN_PROBABILITY = 0.9
ALL_KINDS = [*KINDS, "secret"]
LABELS = ["", *ALL_KINDS]
DIGITS, HEX = set("0123456789"), set("0123456789abcdefABCDEF")
HIT = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
#: Texts, and characters, of an Arrow batch that make one graph (one longer text makes one by itself), and edges that
#: are looked at together.
SLICE_ROWS, SLICE_CHARS, SLICE_EDGES = 512, 1 << 20, 1 << 14


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern meets its further condition."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in found.split(".")))
    digits = re.sub("[^0-9]", "", found)
    return 10 <= len(digits) <= 15 if kind == "phone" else 14 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the matches of the email pattern, from one "@" to the next."""
    end, at = 0, text.find("@")
    while at >= 0:
        start, domain = at, DOMAIN.match(text, at + 1)
        while domain and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = domain.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and then kind; matches that fail are dropped."""
    out = []
    for order, kind in enumerate(KINDS):
        if NEEDS[kind] not in text:
            continue
        for start, end in emails(text) if kind == "email" else (m.span() for m in LINEAR[kind].finditer(text)):
            if holds(kind, text[start:end]):
                out.append((start, order, end, kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


def nodes(text: str) -> list[tuple[int, int]]:
    """Start and end of the tokens with a digit or "@"."""
    out, end = [], 0
    for hit in HIT.finditer(text):
        if hit.start() < end:
            continue
        start = hit.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        gap = SPACE.search(text, hit.end())
        end = gap.start() if gap else len(text)
        out.append((start, end))
    return out


def features(token: str, before: str = "") -> list[bool]:
    """Of a token and the characters before it."""
    digits = sum(c in DIGITS for c in token)
    letters = sum(c.isalpha() for c in token)
    core = token.strip(".,;:!?\"'()[]{}<>")
    at = token.find("@")
    parts = core.split(".")
    return [
        True,
        at > 0,
        at > 0 and "." in token[at:],
        set(core) <= DIGITS,
        letters > 0,
        letters > digits,
        digits == 0,
        1 <= digits <= 2,
        digits == 3,
        4 <= digits <= 6,
        7 <= digits <= 9,
        10 <= digits <= 13,
        14 <= digits <= 19,
        digits > 19,
        token.startswith("+"),
        "(" in token and ")" in token,
        "-" in core and not letters,
        len(parts) == 4 and all(p and set(p) <= DIGITS and len(p) <= 3 for p in parts),
        len(parts) == 2 and not letters,
        "=" in token or "/" in token,
        '"' in token,
        token[-1:] in ".,;:!?",
        set(core) <= DIGITS and 14 <= digits <= 19 and luhn(core),
        14 <= digits <= 19 and not letters and luhn("".join(c for c in core if c in DIGITS)),
        len(core) >= 24 and set(core) <= HEX,
        len(core) >= 24 and set(core) <= HEX and 0 < digits < len(core),
        before.rstrip().endswith(("=", ":")),
        any(x in before.lower() for x in ("token", "key", "secret", "password")),
        digits == 10 and not letters,
        len(re.split("[^0-9]+", core)) >= 3 and not letters and digits >= 7,
        len(re.split("[^0-9]+", core)) == 4 and not letters and digits <= 12,
    ]


N_FEATURES = len(features("x1"))
WHOLE_NUMBER, LONG_CODE = 12, 24  # the features of 14 to 19 digits, and of long hexadecimal codes


@dataclass
class Graph:
    """The nodes of many texts: features, tokens' places, and edges (from, to) of both kinds."""

    of: np.ndarray
    spans: list[tuple[int, int]]
    x: np.ndarray
    alone: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def normal_form(token: str) -> str:
    """What makes tokens similar: their letters and digits."""
    return re.sub(r"[\W_]", "", token.lower())


def similar_to(token: str) -> list[str]:
    """Names that similar tokens share: the token's letters and digits, and the last digits of a long number."""
    form = normal_form(token)
    digits = "".join(c for c in form if c in DIGITS)
    return [form, f"#{digits[-LAST_DIGITS:]}"] if len(digits) >= LAST_DIGITS and digits == form else [form]


def build(texts: list[str]) -> Graph:
    of, spans, rows, alone, chain, skip = [], [], [], [], [], []
    for i, text in enumerate(texts):
        first: dict[str, int] = {}
        before = None
        for start, end in nodes(text):
            me, token = len(spans), text[start:end]
            of.append(i)
            spans.append((start, end))
            rows.append(bytes(features(token, text[max(0, start - 16) : start])))
            near = before is not None and text[before:start].isspace()
            if near:
                chain.append((me - 1, me))
                alone[-1][1] = False
            alone.append([not near, True])
            skip += sorted({(other, me) for name in similar_to(token) if (other := first.setdefault(name, me)) != me})
            before = end
    pairs = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    return Graph(np.array(of, np.int64), spans, np.frombuffer(b"".join(rows), np.uint8).reshape(-1, N_FEATURES).astype(float), np.array(alone, bool).reshape(-1, 2), *pairs)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def passed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log sums over the labels of x plus the potentials w, for every label of the other end."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ np.exp(w))


class Field:
    """Weights of the field and its inference; labels are LABELS, the first is "outside"."""

    def __init__(self, unary: np.ndarray, transition: np.ndarray, similar: np.ndarray):
        self.unary, self.transition, self.similar = unary, transition, similar

    @classmethod
    def empty(cls) -> Field:
        k = len(LABELS)
        return cls(np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k)))

    def potentials(self, g: Graph) -> np.ndarray:
        """Of each node by itself; a neighbour that is no node is outside."""
        return g.x @ self.unary + g.alone[:, :1] * self.transition[0] + g.alone[:, 1:] * self.transition[:, 0]

    def pass_messages(self, g: Graph, own: np.ndarray, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Log beliefs of nodes, and the messages along edges (to the right, to the left), by parallel loopy belief
        propagation until the messages of a text rest, or for so many rounds. Every text rests by itself, so its beliefs
        don't depend on the texts beside it; edges are looked at in slices."""
        kinds = [(g.chain, self.transition), (g.skip, self.similar)]
        sent = [(np.zeros((len(e), own.shape[1])), np.zeros((len(e), own.shape[1]))) for e, _ in kinds]
        moving = [np.arange(len(e)) for e, _ in kinds]

        def belief(some: list[np.ndarray]) -> np.ndarray:
            b = own.copy()
            for (e, _), (right, left), m in zip(kinds, sent, some, strict=True):
                np.add.at(b, e[m, 1], right[m])
                np.add.at(b, e[m, 0], left[m])
            return b

        for _ in range(rounds):
            if not sum(map(len, moving)):
                break
            b = belief(moving)
            moved = np.zeros(int(g.of[-1]) + 1)
            for (e, w), (right, left), some in zip(kinds, sent, moving, strict=True):
                for at in range(0, len(some), SLICE_EDGES):
                    m = some[at : at + SLICE_EDGES]
                    source, sink = e[m, 0], e[m, 1]
                    to_right, to_left = passed(b[source] - left[m], w), passed(b[sink] - right[m], w.T)
                    for old, new in ((right, to_right), (left, to_left)):
                        new = new - log_sum(new, 1)[:, None]
                        np.maximum.at(moved, g.of[source], np.abs(old[m] - new).max(1))
                        old[m] = 0.5 * old[m] + 0.5 * new
            moving = [m[moved[g.of[e[m, 0]]] >= tolerance] for (e, _), m in zip(kinds, moving, strict=True)]
        b = belief([np.arange(len(e)) for e, _ in kinds])
        return b - log_sum(b, 1)[:, None], sent

    def along(self, g: Graph, b: np.ndarray, sent: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Log beliefs of the edges of both kinds, from what pass_messages() gives."""
        pairs = []
        for e, w, (right, left) in zip((g.chain, g.skip), (self.transition, self.similar), sent, strict=True):
            p = (b[e[:, 0]] - left)[:, :, None] + (b[e[:, 1]] - right)[:, None, :] + w
            pairs.append(p - log_sum(log_sum(p, 2), 1)[:, None, None])
        return pairs

    def expected(self, g: Graph, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of all weights' features."""
        b, sent = self.pass_messages(g, own, 8)
        chain, skip = self.along(g, b, sent)
        p = np.exp(b)
        transition = np.exp(chain).sum(0)
        transition[0] += (p * g.alone[:, :1]).sum(0)
        transition[:, 0] += (p * g.alone[:, 1:]).sum(0)
        return g.x.T @ p, transition, np.exp(skip).sum(0)

    def fit(self, g: Graph, seen: np.ndarray, steps: int = STEPS, rate: float = 0.3, decay: float = 1e-3) -> Field:
        """Gradient ascent on the likelihood of the labels `seen` (-1: unknown). Expected counts come from message
        passing, once with the seen labels held and once without."""
        if not len(g.of):
            return self
        held = np.zeros((len(g.of), len(LABELS)))
        known = seen >= 0
        held[known] = -50
        held[known, seen[known]] = 0
        params = [self.unary, self.transition, self.similar]
        size = [np.zeros_like(p) for p in params]
        for _ in range(steps):
            own = self.potentials(g)
            for p, s, with_, without in zip(params, size, self.expected(g, own + held), self.expected(g, own), strict=True):
                slope = (with_ - without) / len(g.of) - decay * p
                s += slope**2
                p += rate * slope / (np.sqrt(s) + 1e-8)
        self.similar[:] = (self.similar + self.similar.T) / 2
        return self


def known_spans(text: str) -> list[tuple[int, int, str]]:
    """What the field learns from: the base, and written-out secrets."""
    return base_spans(text) + [(*m.span(1), "secret") for m in SECRET.finditer(text)]


def rewritten(found: str, kind: str, rng: np.random.Generator) -> str:
    """A mention as no pattern finds it."""
    digits = "".join(c for c in found if c in DIGITS)
    if kind == "phone":
        local = digits[-10:]
        return [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", digits][rng.integers(4)]
    if kind == "card":
        return "./"[rng.integers(2)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == "ip":
        return found.replace(".", "-")
    if kind == "email":
        return found[: found.index(".", found.index("@"))]
    return found.upper()


def masked(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]] | None:
    """text with one of its mentions rewritten, in half of the cases with the true mention behind it, and what the field
    should find in it."""
    spans = known_spans(text)
    if not spans:
        return None
    start, end, kind = spans[rng.integers(len(spans))]
    own = rewritten(text[start:end], kind, rng)
    more = f" and {text[start:end]}" if rng.integers(2) else ""
    new = text[:start] + own + text[end:] + more
    return new, [*known_spans(new), (start, start + len(own), kind)]


def seen_labels(g: Graph, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Labels of nodes after the spans of their texts; -1 for long codes that no span tells of."""
    out = np.where(g.x[:, LONG_CODE] > 0, -1, 0)
    for i, (of, (start, end)) in enumerate(zip(g.of, g.spans, strict=True)):
        kinds = [k for s, e, k in spans[of] if s < end and start < e]
        if kinds:
            out[i] = LABELS.index(kinds[0])
    return out


def gist(text: str) -> str:
    """The nodes of a text with what stands beside them; of more than SAMPLE_NODES, runs of four from all of the text."""
    found = [(s, e) for s, e in nodes(text) if e - s <= NODE_CHARS]
    if len(found) > SAMPLE_NODES:
        runs = SAMPLE_NODES // 4
        found = [x for i in range(runs) for x in found[i * len(found) // runs :][:4]]
    out: list[list[int]] = []
    for start, end in found:
        low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
        if low and (gap := SPACE.search(text, low, start)):
            low = gap.start()
        elif low:
            low = start
        while end < high < len(text) and not text[high - 1].isspace():
            high -= 1
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return " ".join(text[a:b] for a, b in out)


def train(docs: DataFrame, key: str, text: str, sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted to a bounded sample: of the documents with a digit or "@", the first sample_docs in a fixed
    pseudo-random order of key, the least text where a key is repeated, and of each the gist. Without such documents all
    weights are 0."""
    some = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").rlike("[0-9@]"))
    chosen = some.select("k").distinct().orderBy(order_hash(F.col("k").cast("string")), "k").limit(sample_docs)

    @F.pandas_udf("string")
    def short(texts: pd.Series) -> pd.Series:
        return texts.map(gist)

    rows = some.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("t").alias("t")).select("k", short("t").alias("t")).orderBy("k").collect()
    return learn([r["t"] for r in rows])


def learn(texts: list[str], seed: int = 8) -> Field:
    """A field fitted to texts and to copies of them with rewritten mentions."""
    rng = np.random.default_rng(seed)
    pairs = [(t, known_spans(t)) for t in texts]
    pairs += [new for t in texts for _ in range(COPIES) if (new := masked(t, rng))]
    if not pairs:
        return Field.empty()
    g = build([t for t, _ in pairs])
    return Field.empty().fit(g, seen_labels(g, [s for _, s in pairs]))


def added(texts: list[str], base: list[list[tuple[int, int, str]]], field: Field) -> list[list[tuple[int, int, str]]]:
    """Spans that the field adds to the base of each text: runs of neighbouring nodes of one label, without the
    punctuation around them, that touch no span of the base. One node of a run must reach MIN_PROBABILITY, the others
    half."""
    g = build(texts)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(g.of):
        return out
    p = np.exp(field.pass_messages(g, field.potentials(g))[0])
    label = np.where(p.max(1) >= 0.5, p.argmax(1), 0)
    starts = [[s for s, _, _ in spans] for spans in base]
    reach = [list(itertools.accumulate((e for _, e, _ in spans), max)) for spans in base]

    def touches(of: int, start: int, end: int) -> bool:
        before = bisect.bisect_left(starts[of], end)
        return before > 0 and reach[of][before - 1] > start

    joined = np.zeros(len(g.of), bool)
    joined[g.chain[:, 1]] = True
    i = 0
    while i < len(label):
        j = i + 1
        parts = LABELS[label[i]] in ("card", "phone") and not g.x[i, WHOLE_NUMBER]  # other kinds are one token each
        while parts and j < len(label) and joined[j] and label[j] == label[i]:
            j += 1
        if label[i] and p[i:j, label[i]].max() >= MIN_PROBABILITY:
            of, start, end = int(g.of[i]), g.spans[i][0], g.spans[j - 1][1]
            text = texts[of]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
                end -= 1
            if start < end and not touches(of, start, end):
                out[of].append((start, end, LABELS[label[i]]))
        i = j
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind; of overlapping spans the first counts, and takes the others in."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and number of rows of each run of texts that makes one graph."""
    first = chars = 0
    for i, n in enumerate(pc.utf8_length(texts).to_pylist()):
        if i > first and (i - first == SLICE_ROWS or chars + (n or 0) > SLICE_CHARS):
            yield first, i - first
            first, chars = i, 0
        chars += n or 0
    if first < len(texts):
        yield first, len(texts) - first


def find(docs: DataFrame, text: str, field: Field, redact: bool = False, column: str = "spans") -> DataFrame:
    """docs with a column of spans (kind, start, end in code points, base), by start and then kind; it replaces a column
    of docs of that name.

    With redact, the spans in the text are also replaced by their kinds. A null text is an empty one: no spans, and it
    stays null. Rows keep their number, and their other columns.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != column.lower()))
    schema = T.StructType([*docs.schema.fields, T.StructField(column, SPANS)])
    at = docs.columns.index(text)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, rows in slices(whole.column(at)):
                batch = whole.slice(first, rows)
                own = batch.column(at).to_pylist()
                texts = [t or "" for t in own]
                base = [base_spans(t) for t in texts]
                spans = []
                for b, more in zip(base, added(texts, base, field), strict=True):
                    both = [(*x, True) for x in b] + [(*x, False) for x in more]
                    spans.append(sorted(both, key=lambda x: (x[0], ALL_KINDS.index(x[2]))))
                columns = list(batch.columns)
                if redact:
                    columns[at] = pa.array([t if t is None else redacted(t, [x[:3] for x in s]) for t, s in zip(own, spans, strict=True)], pa.string())
                found = pa.array([[{"kind": k, "start": s, "end": e, "base": b} for s, e, k, b in x] for x in spans], ARROW_SPANS)
                yield pa.RecordBatch.from_arrays([*columns, found], names=schema.fieldNames())

    return docs.mapInArrow(search, schema)


def said(spans):
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda x: x == kind


def op8_private_data(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, "text", train(docs, "doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(F.filter("spans", lambda x: x["base"])["kind"], _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """What base_sha256 says of spans."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
