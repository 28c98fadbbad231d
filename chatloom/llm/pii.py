"""Personal data by patterns and a skip-chain conditional random field (operator 12).

Patterns find what is written in full. The field finds other mentions of the same data in a document: a telephone number
without its plus sign, a card number with dots, the name part of an address. Its variables are the document's *units*, words
that hold a digit or an @ (number-like words in a row are one unit); all other words are plain text by definition and enter as
context. Neighbouring units share a potential, and so do distant units that are equal or similar: the same digits, the same
last eight digits, the same name part. Units inside a pattern's span are observed. Loopy message passing, over all documents
of a slice at once, gives each other unit its marginal; a unit that is more likely data than not is a span.

The field is trained on a bounded sample of documents that have spans: to each its spans are added once more in another
spelling, and once more with other digits or letters, which are plain text. Weights maximise the pseudo-likelihood.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm.common import thinned
from chatloom.llm.workers import in_small_batches, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents of the training sample, the longest of them in characters, and documents among which they are sought.
SAMPLE, SAMPLE_CHARS, POOL = 1000, 20_000, 50_000
#: A unit is data where its marginal is at least this.
THRESHOLD = 0.5
#: Rounds of message passing at most, and the change in a message that ends them.
ROUNDS, SETTLED = 30, 1e-3
#: Hash buckets of features.
FEATURES = 1 << 11
_CHAIN, _EQUAL, _SIMILAR, _SHORT = range(4)

# Runs that cannot be given back keep each pattern linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-")

_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().:/_-]*")
_ACTIVE = re.compile("[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FIRST, _LAST = re.compile("[A-Za-z0-9+@(]"), frozenset(string.ascii_letters + string.digits + ")")
#: Bytes of texts whose units are judged together, and messages computed at once.
TOGETHER, MESSAGES = 1 << 19, 1 << 16

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d * 2 - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            end = found.end()
            yield 0, begin, end
        at = max(at + 1, end if found else 0)


def _ips(text: str) -> Iterator[Span]:
    for chain in _DOTTED.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield 1, at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """What the patterns find, leftmost and without overlap within a kind: (kind, start, end) by kind, then start."""
    found = list(_emails(text)) if "@" in text else []
    found += _ips(text)
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        found += ((3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15)
    return found


@dataclass
class Units:
    """Units of some documents: where they are, what is known of them, their features and the edges between them."""

    doc: list[int] = field(default_factory=list)
    span: list[tuple[int, int]] = field(default_factory=list)
    known: list[int] = field(default_factory=list)  # a label, or -1
    features: list[list[int]] = field(default_factory=list)
    edges: list[tuple[int, int, int]] = field(default_factory=list)  # unit, later unit, potential


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def _size(n: int) -> int:
    return next(i for i, top in enumerate((0, 3, 7, 9, 12, 15, 16, 19, 1 << 60)) if n <= top)


def _describe(unit: str, before: str, after: str) -> tuple[list[int], list[tuple[int, str]]]:
    """Feature buckets of a unit, and the keys (potential, key) by which it is equal or similar to others."""
    digits = "".join(c for c in unit if "0" <= c <= "9")
    groups = re.findall("[0-9]+", unit[:200])
    letters = any(c in string.ascii_letters for c in unit)
    seen = "".join(sorted({c for c in unit[:200] if not c.isalnum()}))
    about = f"{letters}{'@' in unit}"
    quad = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    names = ["bias", f"about {about}", f"digits {about}{_size(len(digits))}", f"groups {about}{min(len(groups), 5)}", f"seen {about}{seen}", f"plus {unit[:1] == '+'}", f"quad {quad}{about}",
             f"luhn {13 <= len(digits) <= 19 and luhn(digits)}{about}", f"domain {'.' in unit.partition('@')[2]}{about}", f"before {before}", f"after {after}"]
    low = unit.lower()
    keys = [(_EQUAL, f"w{low}")]
    if letters or "@" in unit:
        local = re.split(r"@|\(at\)|\[at\]", low)[0]
        if len(local) > 3:
            keys.append((_SIMILAR, f"l{local}"))
    elif len(digits) >= 8:
        keys += [(_EQUAL, f"d{digits}"), (_SIMILAR, f"e{digits[-8:]}")]
    elif len(digits) >= 4:
        keys.append((_SHORT, f"d{digits}"))
    return [_bucket(n) for n in names], keys


def _inner(text: str, begin: int, end: int) -> tuple[int, int]:
    """A word without the marks around it; nothing, if there is nothing else."""
    first = _FIRST.search(text, begin, end)
    if first is None:
        return begin, begin
    begin = first.start()
    while end > begin and text[end - 1] not in _LAST:
        end -= 1
    return begin, end


def _tokens(text: str, base: list[Span]) -> Iterator[tuple[int, int]]:
    """Words with a digit or an @, and words that are the whole name part of an address found in the text, if it has marks."""
    names = {text[s:e].partition("@")[0].lower() for k, s, e in base if k == 0}
    names = {x for x in names if len(x) > 3 and any(c in "._%+-" for c in x.strip("._%+-"))}
    if not names:
        yield from (m.span() for m in _TOKEN.finditer(text))
        return
    for m in _WORD.finditer(text):
        begin, end = m.span()
        if _ACTIVE.search(text, begin, end) or text[slice(*_inner(text, begin, end))].lower() in names:
            yield begin, end


def collect(units: Units, doc: int, text: str, base: list[Span]) -> None:
    """Add the units of a text. Edges join a unit to the next one with the same key, so there are a few for each unit."""
    tokens: list[tuple[int, int, bool]] = []
    for begin, end in _tokens(text, base):
        number = _NUMBER.fullmatch(text, begin, end) is not None
        if number and tokens and tokens[-1][2] and tokens[-1][1] + 1 == begin and text[begin - 1] == " ":
            tokens[-1] = (tokens[-1][0], end, True)
        else:
            tokens.append((begin, end, number))
    spans = sorted((s, e, k) for k, s, e in base)
    last: dict[str, int] = {}
    reach, at, ended = -1, 0, -2
    for begin, end, _ in tokens:
        start, stop = _inner(text, begin, end)
        if start == stop:
            continue
        me = len(units.doc)
        known = -1
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if at < len(spans) and spans[at][0] < stop:
            known = spans[at][2] + 1
        before = text[max(0, begin - 60) : begin].split()
        after = text[end : end + 60].split()
        context = ["".join(c for c in (x[i] if x else "").lower() if c.isalpha())[:20] for x, i in ((before, -1), (after, 0))]
        features, keys = _describe(text[start:stop], *context)
        units.doc.append(doc)
        units.span.append((start, stop))
        units.known.append(known)
        units.features.append(features)
        if ended >= 0 and not text[ended:begin].strip():
            units.edges.append((reach, me, _CHAIN))
        linked = set()
        for kind, key in keys:
            other = last.get(key)
            last[key] = me
            if other is not None and other not in linked:
                linked.add(other)
                units.edges.append((other, me, kind))
        reach, ended = me, end


@dataclass(frozen=True)
class Field:
    """Log potentials: of a unit's features and label, and of two units' labels by kind of edge."""

    node: np.ndarray  # FEATURES x labels
    edge: np.ndarray  # kinds of edges x labels x labels


LABELS = len(KINDS) + 1  # 0: plain text


def _evidence(units: Units) -> np.ndarray:
    """Feature buckets of each unit, as many for all."""
    return np.array(units.features, np.int64)


def marginals(model: Field, units: Units) -> np.ndarray:
    """Each unit's label probabilities by loopy message passing; known units have their label."""
    n = len(units.doc)
    node = model.node[_evidence(units)].sum(1)
    known = np.array(units.known)
    fixed = np.flatnonzero(known >= 0)
    node[fixed] = -1e6
    node[fixed, known[fixed]] = 0
    if units.edges:
        e = np.array(units.edges)
        # Each edge both ways: from, to, potential by (label of from, label of to), and where the message back is.
        source, sink = np.append(e[:, 0], e[:, 1]), np.append(e[:, 1], e[:, 0])
        tables, which = np.concatenate([model.edge, model.edge.transpose(0, 2, 1)]), np.append(e[:, 2], e[:, 2] + len(model.edge))
        back = np.roll(np.arange(2 * len(e)), len(e))
        message = np.zeros((2 * len(e), LABELS))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, sink, message)
            new = np.empty_like(message)
            for at in range(0, len(new), MESSAGES):
                some = slice(at, at + MESSAGES)
                new[some] = np.logaddexp.reduce((belief[source[some]] - message[back[some]])[:, :, None] + tables[which[some]], axis=1)
            new -= np.logaddexp.reduce(new, axis=1)[:, None]
            change = np.abs(new - message).max()
            message = 0.5 * message + 0.5 * new if change > SETTLED else new
            if change <= SETTLED:
                break
        np.add.at(node, sink, message)
    node -= node.max(1, keepdims=True)
    share = np.exp(node)
    return share / share.sum(1, keepdims=True) if n else share


def _fit(units: Units, labels: np.ndarray, steps: int = 300, rate: float = 0.1, penalty: float = 1e-3) -> Field:
    """Weights of greatest penalised pseudo-likelihood: each unit's label given its features and its neighbours' labels."""
    x, e = _evidence(units), np.array(units.edges).reshape(-1, 3)
    n, true = len(labels), np.eye(LABELS)[labels]
    around = np.zeros((4, 2, n, LABELS))  # by kind of edge and side: labels of the neighbours
    for kind in range(4):
        some = e[e[:, 2] == kind]
        np.add.at(around[kind, 0], some[:, 1], true[some[:, 0]])
        np.add.at(around[kind, 1], some[:, 0], true[some[:, 1]])
    node, edge = np.zeros((FEATURES, LABELS)), np.zeros((4, LABELS, LABELS))
    moments = [np.zeros_like(w) for w in (node, node, edge, edge)]
    for step in range(1, steps + 1):
        score = node[x].sum(1) + sum(around[k, 0] @ edge[k] + around[k, 1] @ edge[k].T for k in range(4))
        score -= score.max(1, keepdims=True)
        share = np.exp(score)
        wrong = (share / share.sum(1, keepdims=True) - true) / n
        d_node = penalty * node
        np.add.at(d_node, x.ravel(), np.repeat(wrong, x.shape[1], axis=0))
        d_edge = penalty * edge + np.array([around[k, 0].T @ wrong + wrong.T @ around[k, 1] for k in range(4)])
        for w, d, m, v in ((node, d_node, moments[0], moments[1]), (edge, d_edge, moments[2], moments[3])):
            m *= 0.9
            m += 0.1 * d
            v *= 0.999
            v += 0.001 * d * d
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        edge[1:] = (edge[1:] + edge[1:].transpose(0, 2, 1)) / 2  # equality has no direction
    return Field(node, edge)


def _other_spelling(kind: int, found: str, rng: random.Random) -> str:
    """Another way to write the same data, one that the patterns mostly do not find."""
    digits = "".join(c for c in found if "0" <= c <= "9")
    if kind == 0:
        local, _, domain = found.partition("@")
        return rng.choice([local, local, f"{local}@{domain.partition('.')[0]}", f"{local}(at){domain}", f"{local}[at]{domain}"])
    if kind == 1:
        return rng.choice("-:/_").join(found.split("."))
    if kind == 2:
        return rng.choice([".", "/", "_"]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    rest = digits[rng.choice([0, 0, 1, 2]) :]
    return rng.choice(["", "", "0"]) + rng.choice(["", " ", "-", ".", "/"]).join(rest[max(i - 3, 0) : i] for i in range((len(rest) - 1) % 3 + 1, len(rest) + 1, 3))


def _other_data(found: str, rng: random.Random) -> str:
    """The same spelling with other letters and digits."""
    return "".join(rng.choice(string.digits) if c.isdigit() else rng.choice(string.ascii_lowercase) if c.isalpha() else c for c in found)


def _with_mentions(text: str, rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text with more mentions of its spans' data and of other data at its end, and their (start, end, label)."""
    words = [w for w in text.split()[:500] if not _ACTIVE.search(w)] or ["a"]
    pieces: list[tuple[str, int]] = []
    for kind, start, end in base_spans(text)[:20]:
        spelled = _other_spelling(kind, text[start:end], rng)
        pieces.append((spelled, kind + 1))
        for _ in range(rng.randrange(1, 4)):
            pieces += [(_other_data(spelled, rng), 0)] * rng.randrange(1, 3)
    parts, size, told = [text], len(text), []
    for piece, label in pieces:
        filler = "\n" + " ".join(rng.choices(words, k=rng.randrange(2, 8))) + " "
        told.append((size + len(filler), size + len(filler) + len(piece), label))
        parts += [filler, piece]
        size += len(filler) + len(piece)
    return "".join([*parts, " ", rng.choice(words)]), told


def train(texts: list[str], seed: int = 12) -> Field | None:
    """Fit the field on these texts; without a span in any of them there is nothing to learn, and no field."""
    rng, units, labels = random.Random(seed), Units(), []
    for doc, text in enumerate(texts):
        whole, told = _with_mentions(text, rng)
        first = len(units.doc)
        collect(units, doc, whole, base_spans(whole))
        for i in range(first, len(units.doc)):
            start, stop = units.span[i]
            meant = max((label for s, e, label in told if s < stop and start < e), default=0)
            labels.append(units.known[i] if units.known[i] >= 0 else meant)
    return _fit(units, np.array(labels)) if any(labels) else None


def find(model: Field | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the patterns' spans, and all spans, by kind and start."""
    units, base = Units(), []
    for doc, text in enumerate(texts):
        base.append(base_spans(text))
        collect(units, doc, text, base[-1])
    out = [(b, list(b)) for b in base]
    if model is not None and units.doc:
        share = marginals(model, units)
        best = share[:, 1:].argmax(1)
        sure = share[np.arange(len(best)), best + 1] >= THRESHOLD
        for i in np.flatnonzero(sure & (np.array(units.known) < 0)).tolist():
            out[units.doc[i]][1].append((int(best[i]), *units.span[i]))
    return [(b, sorted(a)) for b, a in out]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def _run(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part, raw in slices(batches, 1, TOGETHER):
        texts = [x.decode() if x else "" for x in raw]
        some = [i for i, x in enumerate(texts) if _ACTIVE.search(x)]
        found: list[tuple[list[Span], list[Span]]] = [([], [])] * len(texts)
        for i, x in zip(some, find(model.value, [texts[i] for i in some]), strict=True):
            found[i] = x
        counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in range(len(KINDS))]
        digest = [hashlib.sha256(_told(b).encode()).hexdigest() for b, _ in found]
        yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest), pa.array([_told(a) for _, a in found])], schema=schema)


def sample(docs: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS, pool: int = POOL) -> list[str]:
    """Texts for training: of about ``pool`` documents by hash of id and text those up to ``chars`` characters that may hold a
    span, and of these ``rows`` by smallest hash."""
    may = F.col("text").rlike(r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){15}")
    texts = thinned(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), pool, "doc_id", "text")
    found = texts.where(may & (F.length("text") <= chars))
    return [r.text for r in found.orderBy(F.xxhash64("text", "doc_id"), "text").limit(rows).collect()]


def personal_data(docs: DataFrame, model: Field | None) -> DataFrame:
    """Personal data of every document: doc_id, n_email, n_ip, n_card, n_phone (what the patterns find), base_sha256 (of
    these spans, written kind:start:end, by kind and start, joined by commas), spans (all spans, in the same form).

    Places are code points, ends exclusive. Null and empty text: nothing. Null doc_id, repeated rows: each row is judged.
    Long texts count whole. Empty table: no rows. Without a model the patterns' spans are all. Other columns are not read.
    """
    rows = in_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES times labels
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    return rows.mapInArrow(lambda b: _run(b, shared, schema), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
