"""Personal data by patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers; their
spans always stay. A field over the tokens that hold a digit or an at sign adds
spans that the patterns miss. Its nodes are such tokens, with log-linear weights on
their shapes and neighbours; neighbouring nodes share transition potentials; and
nodes that repeat or resemble each other anywhere in the document (the same string,
the same digits, the same last seven digits, the same name before an at sign) share
skip potentials, each with the next one of its kind. Nodes in pattern spans are
observed. Loopy belief propagation carries their labels along the skip edges, so
that `555-2485` is a phone number where `+1 (988) 555-2485` stands elsewhere in the
text. Each document's messages pass until they settle, whatever other documents are at
hand. All potentials are trained together, by pseudo-likelihood: each node's label given
its features, its neighbours' labels and those of its similar nodes, and given its features
alone, on pattern spans in a bounded sample of documents.

Cases: a null or empty text has no spans. Overlapping spans of different kinds all
count. Texts are read whole; the patterns are matched in time linear in the text.
Rows that repeat an id each get their result. Without a sample to learn from, the
field adds nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_text, place_of
from millrace.session import ship

KINDS = ("email", "ip", "card", "phone")
#: About so many documents of so many characters in all, drawn by a hash of their ids, are read to train the field,
#: of them only those of at most so many characters, and about so many of their tokens used.
SAMPLE_DOCUMENTS, SAMPLE_CHARACTERS, SAMPLE_LONGEST, SAMPLE_TOKENS = 8000, 40_000_000, 200_000, 20000
BUCKETS = 1 << 12
ROUNDS, RATE, PENALTY = 150, 0.2, 1e-3
#: What a token of which nothing is known has for being no personal data.
PRIOR = 4.0
#: A document's messages move by this part of the way at a time and have settled where none moves by more than that. After as
#: many sweeps as the document has nodes, and so many more, steps shrink by a factor a sweep, so that messages that turn in circles settle too.
STEP, SETTLED, PATIENCE, SHRINK = 0.5, 5e-5, 100, 0.97
#: Skip potentials start from counts, with so many agreeing and disagreeing pairs more; no potential is over the bound.
AGREE, DISAGREE, BOUND = 10.0, 0.5, 4.0

_HINT = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGE = " \t\r\n.,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts)


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by start, then kind."""
    if not _HINT.search(text):
        return []
    found: list[Span] = []
    end = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append((start, end, 0))
    found += [(*m.span(), 1) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def overlong(text: str) -> list[tuple[int, int]]:
    """Places where a pattern runs over several numbers and so finds none: of these nothing is learned."""
    found = []
    if _HINT.search(text):
        found = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() > 19 and len(re.sub("[^0-9]", "", m.group())) > 19]
        if "+" in text:
            found += [m.span() for m in _PHONE.finditer(text) if len(re.sub("[^0-9]", "", m.group())) > 15]
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


#: Digits of a whole number by kind, and the most of one; other kinds are never in pieces.
_WHOLE, _MOST = {2: 14, 3: 10}, {2: 19, 3: 15}


def _one_number(text: str, a: Span, b: Span) -> bool:
    """Whether two neighbours of one kind are pieces of one number: neither is a number by itself, and both together are not too long for one."""
    kind = a[2]
    if kind not in _WHOLE or text[a[1] : b[0]].strip(_EDGE) or text[b[0]] == "+":
        return False
    sizes = [len(re.sub("[^0-9]", "", text[s[0] : s[1]])) for s in (a, b)]
    return sum(sizes) <= _MOST[kind] and sizes[1] < _WHOLE[kind] and (sizes[0] < _WHOLE[kind] or kind == 3)


class Graph:
    """Nodes, features and edges of some documents in flat arrays; label 0 is none, label k + 1 is kind k, -1 is unknown."""

    def __init__(self) -> None:
        self.at = array("q")  # document, start, end of each node
        self.label = array("b")
        self.features = array("i")  # as many of each node
        self.chain = array("q")  # two nodes of each edge
        self.skip = array("q")

    def add(self, document: int, text: str, base: list[Span], gold: bool = False) -> None:
        """Adds a document; where `gold`, nodes outside the spans, and not in an overlong match, are known to be none."""
        keys, owners = array("Q"), array("q")
        last, upto, inside = -2, 0, []
        vague = overlong(text) if gold else []
        for i, place, token, before, after in _hinted(text):
            while upto < len(base) and base[upto][0] < place + len(token):
                inside.append(base[upto])
                upto += 1
            inside = [s for s in inside if s[1] > place]
            core = token.strip(_EDGE) or token
            start = place + token.find(core)
            node = len(self.label)
            self.at.extend((document, start, start + len(core)))
            over = [s[2] for s in inside if s[0] < start + len(core) and s[1] > start]
            none = gold and not any(a < start + len(core) and b > start for a, b in vague)
            self.label.append(min(over) + 1 if over else 0 if none else -1)
            self.features.extend(_features(token, core, before, after))
            if last == i - 1:
                self.chain.extend((node - 1, node))
            last = i
            for key in _keys(core):
                keys.append(xxhash.xxh64_intdigest("\0".join(key).encode("utf-8", "surrogatepass")))
                owners.append(node)
        key, owner = np.asarray(keys), np.asarray(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        again = np.flatnonzero(key[1:] == key[:-1])
        pairs = np.unique(np.stack((owner[again], owner[again + 1]), 1), axis=0)
        self.skip.frombytes(pairs[pairs[:, 0] < pairs[:, 1]].astype(np.int64).tobytes())


def _hinted(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Number, place, token and the tokens before and after of each token with a digit or an at sign."""
    before, held = "^", None
    for i, m in enumerate(_TOKEN.finditer(text)):
        token = m.group()
        if held is not None:
            yield (*held, token)
        held = (i, m.start(), token, before) if _HINT.search(token) else None
        before = token
    if held is not None:
        yield (*held, "$")


def _features(token: str, core: str, before: str, after: str) -> list[int]:
    """Buckets of a token's features. What the patterns check is part of each shape, so a number that
    fails the check is not taken for one that passes."""
    digits = re.sub("[^0-9]", "", core)
    parts = core.split(".")
    valid = f"{14 <= len(digits) <= 19 and luhn(digits):d}{len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and _octets(parts):d}"
    exact = re.sub("[0-9]", "9", re.sub(r"[^\W\d_]+", "a", token[:64]))
    rough = re.sub("9+", "9", exact)
    named = [f"x{exact}/{valid}", f"r{rough}/{valid}", f"n{len(digits)}/{valid}/{'@' in core:d}{token[0] == '+':d}", f"b{before[:20].lower()}", f"a{after[:20].lower()}"]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in named]


def _keys(core: str) -> list[tuple[str, str]]:
    """What makes two tokens similar."""
    keys = [("same", core.lower())]
    digits = re.sub("[^0-9]", "", core)
    if len(digits) >= 7 and not re.search("[A-Za-z]", core):
        keys += [("digits", digits), ("end", digits[-7:])]
    name = core.partition("@")[0].lower()
    if len(name) >= 4 and re.search("[a-z]", name):
        keys.append(("name", name))
    return keys


class Field:
    """Weights of the field: unary by feature bucket, transition and skip potentials."""

    def __init__(self, unary: np.ndarray, bias: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.bias, self.chain, self.skip = unary, bias, chain, skip

    @classmethod
    def train(cls, graph: Graph) -> Field:
        """Maximises the pseudo-likelihood by Adam: unary weights, transitions and the reward of agreement together.

        Each node is learned from twice, with its neighbours' labels and with these masked, so
        that neither the neighbours nor the node's own features are all that tells a label.
        Transitions and the reward start from counts, and are drawn back to them. All transitions
        between two different kinds are one potential: how often two kinds are neighbours depends
        on what the patterns run over, so only that they are can be learned. Nodes of which
        nothing is known are left out.
        """
        n, labels = len(KINDS) + 1, np.array(graph.label, np.int64)
        chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))
        chain, skip = (e[(labels[e] >= 0).all(1)] for e in (chain, skip))
        known = np.flatnonzero(labels >= 0)
        chosen = known[:: max(1, -(-len(known) // SAMPLE_TOKENS))]
        x = np.array(graph.features, np.int64).reshape(len(labels), -1)[chosen]
        width, y = x.shape[1], labels[chosen]
        # How many neighbours of each label a node has: before it, after it, and similar ones.
        before, after, alike = np.zeros((3, len(labels), n))
        np.add.at(before, (chain[:, 1], labels[chain[:, 0]]), 1)
        np.add.at(after, (chain[:, 0], labels[chain[:, 1]]), 1)
        np.add.at(alike, (skip[:, 0], labels[skip[:, 1]]), 1)
        np.add.at(alike, (skip[:, 1], labels[skip[:, 0]]), 1)
        before, after, alike = (np.concatenate((m[chosen], np.zeros((len(chosen), n)))) for m in (before, after, alike))
        x, y = np.concatenate((x, x)), np.concatenate((y, y))
        mixed = ~np.eye(n, dtype=bool)
        mixed[0] = mixed[:, 0] = False
        w, b = np.zeros((BUCKETS, n)), np.zeros(n)
        b[0] = PRIOR
        lift, agreement = _lift(chain, labels, n), _agreement(skip, labels, n)
        lift[mixed] = max(0.0, lift[mixed].mean())
        c, r = lift.copy(), agreement
        first, second = [np.zeros_like(w), np.zeros_like(c), 0.0], [np.zeros_like(w), np.zeros_like(c), 0.0]
        for step in range(1, ROUNDS + 1):
            p = _softmax(w[x].sum(1) + b + before @ c + after @ c.T + r * alike)
            p[np.arange(len(y)), y] -= 1
            slopes = (
                np.stack([np.bincount(x.ravel(), np.repeat(p[:, k], width), BUCKETS) for k in range(n)], 1) / len(y) + PENALTY * w,
                (before.T @ p + p.T @ after) / len(y) + PENALTY * (c - lift),
                float((p * alike).sum()) / len(y) + PENALTY * (r - agreement),
            )
            moves = []
            for i, g in enumerate(slopes):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                moves.append(RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
            w = w - moves[0]
            c = np.clip(c - moves[1], -BOUND, BOUND)
            c[mixed] = c[mixed].mean()
            r = float(np.clip(r - moves[2], 0, BOUND))
        return cls(w, b, c, np.eye(n) * r)

    def decode(self, graph: Graph) -> np.ndarray:
        """The most likely label of each node, by loopy sum-product belief propagation in each document."""
        labels = np.array(graph.label, np.int64)
        n, k = len(labels), len(self.bias)
        document = np.unique(np.array(graph.at, np.int64).reshape(n, -1)[:, 0], return_inverse=True)[1]
        features = np.array(graph.features, np.int32).reshape(n, -1)
        own = np.tile(self.bias.astype(np.float32), (n, 1))
        for column in features.T:
            own += self.unary[column].astype(np.float32)
        known = labels >= 0
        own[known] = -50.0
        own[known, labels[known]] = 0.0
        # Four kinds of messages: along the chain and back, along the skips and back.
        ends = [np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip)]
        source = [ends[0][:, 0], ends[0][:, 1], ends[1][:, 0], ends[1][:, 1]]
        target = [source[1], source[0], source[3], source[2]]
        through = [np.exp(m).astype(np.float32) for m in (self.chain, self.chain.T, self.skip, self.skip.T)]
        message = [np.zeros((len(x), k), np.float32) for x in source]
        belief = own.copy()
        moving = np.ones(document.max(initial=-1) + 1, bool)
        waits = PATIENCE + np.bincount(document, minlength=len(moving))
        for sweep in count():
            step = (STEP * SHRINK ** np.maximum(0, sweep - waits)).astype(np.float32)
            moved = np.zeros(len(moving), np.float32)
            found = []
            for i in range(4):
                live = np.flatnonzero(moving[document[source[i]]])
                out = belief[source[i][live]] - message[i ^ 1][live]
                out -= out.max(1, keepdims=True)
                new = np.log(np.exp(out, out=out) @ through[i])
                new -= new.max(1, keepdims=True)
                np.maximum.at(moved, document[source[i][live]], np.abs(new - message[i][live]).max(1, initial=0))
                found.append((live, new))
            for i, (live, new) in enumerate(found):
                message[i][live] += step[document[source[i][live]], None] * (new - message[i][live])
            belief = own.copy()
            for i in range(4):
                for label in range(k):
                    belief[:, label] += np.bincount(target[i], message[i][:, label], n).astype(np.float32)
            moving &= moved * step > SETTLED
            if not moving.any():
                break
        return belief.argmax(1)

    def added(self, texts: dict[int, str], graph: Graph) -> dict[int, list[Span]]:
        """Spans of unobserved nodes with a label; neighbours that are pieces of one number are one span."""
        found: dict[int, list[Span]] = defaultdict(list)
        if len(graph.label):
            labels = self.decode(graph)
            at = np.array(graph.at, np.int64).reshape(len(labels), 3)
            new = np.flatnonzero((labels > 0) & (np.array(graph.label) < 0))
            for (document, start, end), label in zip(at[new].tolist(), labels[new].tolist(), strict=True):
                own = found[document]
                if own and own[-1][2] == label - 1 and _one_number(texts[document], own[-1], (start, end, label - 1)):
                    start = own.pop()[0]
                own.append((start, end, label - 1))
        return found

    def dump(self) -> str:
        rows = np.flatnonzero(np.abs(self.unary).max(1) > 1e-3)
        return json.dumps([rows.tolist(), self.unary[rows].round(4).tolist(), self.bias.tolist(), self.chain.tolist(), self.skip.tolist()])

    @classmethod
    def load(cls, text: str | None) -> Field | None:
        if text is None:
            return None
        rows, weights, bias, chain, skip = json.loads(text)
        unary = np.zeros((BUCKETS, len(bias)))
        if rows:
            unary[rows] = weights
        return cls(unary, np.array(bias), np.array(chain), np.array(skip))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pairs(edges: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(labels[edges[:, 0]] * n + labels[edges[:, 1]], minlength=n * n).reshape(n, n).astype(float)


def _lift(edges: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """How much more often two labels are neighbours than by chance, in logarithms."""
    c = _pairs(edges, labels, n)
    by_chance = c.sum(1, keepdims=True) * c.sum(0, keepdims=True) / max(1.0, c.sum())
    return np.clip(np.log((c + 1) / (by_chance + 1)), -BOUND, BOUND)


def _agreement(edges: np.ndarray, labels: np.ndarray, n: int) -> float:
    """A reward for two similar tokens with one label, from how often pattern spans treat them alike."""
    c = _pairs(edges, labels, n)
    alike = np.trace(c)
    return float(np.clip(np.log((alike + AGREE) / (c.sum() - alike + DISAGREE)), 0, BOUND))


def fit(documents: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> Field | None:
    """Trains the field on the pattern spans of about `sample` documents, in one task of bounded size.

    Documents are drawn by a hash of id and text, so that rows that share an id are not drawn together.
    """
    seen = documents.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).first()
    if not seen["n"]:
        return None
    ship(documents.sparkSession)
    share = min(1.0, sample / seen["n"], SAMPLE_CHARACTERS / max(1, seen["size"] or 0))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    short = F.length("text") <= SAMPLE_LONGEST
    texts = documents.where(drawn & short).select("text").distinct().where(F.col("text").rlike("[0-9@]"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        graph = Graph()
        for i, text in enumerate(sorted(frame["text"])):
            graph.add(i, text, base_spans(text), gold=True)
        if not len(graph.label):
            return pd.DataFrame({"field": []})
        return pd.DataFrame({"field": [Field.train(graph).dump()]})

    got = texts.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "field string").first()
    return Field.load(got["field"] if got else None)


def find(texts: list[str | None], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans and all spans of each text."""
    base = [base_spans(t or "") for t in texts]
    extra: dict[int, list[Span]] = {}
    if field is not None:
        graph, held = Graph(), {}
        for i, t in enumerate(texts):
            if t and _HINT.search(t):
                held[i] = t
                graph.add(i, t, base[i])
        extra = field.added(held, graph)
    return [(b, sorted(b + extra.get(i, []), key=lambda s: (s[0], s[2], s[1]))) for i, b in enumerate(base)]


#: Texts, and characters of them, whose fields are decoded in one go; a longer text is one by itself.
TOGETHER, CHARACTERS = 500, 2_000_000


def _each(texts: list[str | None], field: Field | None) -> Iterator[tuple[list[Span], list[Span]]]:
    held: list[str | None] = []
    size = 0
    for t in texts:
        if held and (len(held) == TOGETHER or size + len(t or "") > CHARACTERS):
            yield from find(held, field)
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    yield from find(held, field)


def spans(documents: DataFrame, field: Field | None) -> DataFrame:
    """Counts of pattern spans by kind, their digest, and all spans, of documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(field.dump() if field else None)
    kind = documents.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]

    def make():
        own = Field.load(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            found = list(_each(b.column(1).to_pylist(), own))
            columns = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            return pa.RecordBatch.from_arrays(
                [b.column(0), *columns, pa.array(digest, pa.string()), pa.array([joined(a) for _, a in found], pa.string())],
                names=["doc_id", *counts, "base_sha256", "spans"],
            )

        return batch

    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in counts)}, base_sha256 string, spans string"
    return map_text(documents.select("doc_id", "text"), schema, make)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    parts, at, upto = [], 0, 0
    for start, end, kind in found:
        if start < upto:
            upto = max(upto, end)
            continue
        parts += [text[max(at, upto) : start], f"[{KINDS[kind].upper()}]"]
        at = upto = end
    return "".join([*parts, text[max(at, upto) :]])


def redact(documents: DataFrame, field: Field | None) -> DataFrame:
    """The documents, with all their columns, without personal data in text; n_chars follows the text."""
    shared = documents.sparkSession.sparkContext.broadcast(field.dump() if field else None)
    place = place_of(documents, "text")

    def make():
        own = Field.load(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(place).to_pylist()
            new = [t if t is None else redacted(t, a) for t, (_, a) in zip(texts, _each(texts, own), strict=True)]
            columns = list(b.columns)
            columns[place] = pa.array(new, b.schema.field(place).type)
            return pa.RecordBatch.from_arrays(columns, schema=b.schema)

        return batch

    clean = map_text(documents, documents.schema, make)
    return clean.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean
