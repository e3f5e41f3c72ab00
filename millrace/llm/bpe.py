"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as a state machine.

How far to the right can a symbol change what becomes of those to its left? Take the
merges in order of rank, over a text with and without a continuation. The two runs
first differ where the continuation begins; the place where they differ moves left
only when a token x that ends there is merged in one run and not in the other. So x
is the left part of that merge, and the right part begins with the token whose merge
moved the place before, at a lower rank. The longest such chain of left parts is the
merge list's sufficient lookahead: one pass over the merges finds it (lookahead()).

The transducer holds a window of that many symbols and some more, merges it, emits
the tokens that end before the lookahead, and goes on from there, so its memory does not
grow with the word. All words go through it; what it gives for those of up to
REMEMBERED_CHARACTERS is remembered. A text is split into words by blocks of BLOCK
characters, or up to the end of a longer word. Decoding maps each id to its bytes; these
go through a state machine that gives out text as soon as a character's last byte is there.

Cases: a null or empty text has no ids and decodes to the empty text. Strings of
special tokens in a text are their ids. Rows that repeat an id each get their result.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from millrace.llm.common import byte_symbols, map_text

#: Symbols that a window has beyond the lookahead and the longest token.
STEP = 256
#: Words of up to so many characters are remembered with their ids, so many of them; then all are forgotten.
REMEMBERED_CHARACTERS, REMEMBERED = 64, 300_000
#: Characters of a text that are split into words at once, unless a word is longer.
BLOCK = 1 << 16

_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(kinds: str, last: int = 256) -> str:
    """The characters of a regex class: those under `last` whose category begins with one of `kinds`."""
    return "".join(re.escape(chr(c)) for c in range(last) if unicodedata.category(chr(c))[0] in kinds)


def _space(last: int = 256) -> str:
    return "".join(re.escape(chr(c)) for c in range(last) if regex.match(r"\p{White_Space}", chr(c)))


_LATIN = re.compile(f"{_CONTRACTIONS}|[{_class('L')}]+|[{_class('N')}]|[^{_space()}{_class('LN')}]+")


class Merges:
    """A tokenizer file whose words end in a mark: its symbols, merges, and their lookahead."""

    def __init__(self, definition: str):
        parsed = json.loads(definition)
        model = parsed["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.surface = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges)}
        bytes_of = {b: c for c, b in byte_symbols().items()}
        self.inner = [self.ids[bytes_of[b]] for b in range(256)]
        self.final = [self.ids[bytes_of[b] + self.end] for b in range(256)]
        self.length = {i: 1 for i in (*self.inner, *self.final)}
        for a, b, c in self.merges:
            self.length[c] = self.length[a] + self.length[b]
        self.longest = max(self.length.values())
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        left_part = {c: a for a, _, c in self.merges}
        reach: dict[int, int] = {}
        for a, b, _ in self.merges:
            before, part = 0, b
            while part is not None:
                before = max(before, reach.get(part, 0))
                part = left_part.get(part)
            reach[a] = max(reach.get(a, 0), self.length[a] + before)
        return max(reach.values(), default=0)

    def merged(self, symbols: list[int]) -> list[int]:
        """All merges of a sequence of symbols: the lowest rank first, from the left."""
        rank = self.rank
        if len(symbols) < 128:
            get, none = rank.get, (len(rank), 0)
            pairs = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            while pairs:
                best = min(pairs)
                if best is none:
                    break
                i = pairs.index(best)
                symbols[i : i + 2] = [best[1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = get((best[1], symbols[i + 1]), none)
                if i:
                    pairs[i - 1] = get((symbols[i - 1], best[1]), none)
            return symbols
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(rank[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(symbols) or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                if (p := (symbols[i], symbols[after[i]])) in rank:
                    heapq.heappush(heap, (rank[p][0], i, *p))
            if before[i] >= 0 and (p := (symbols[before[i]], symbols[i])) in rank:
                heapq.heappush(heap, (rank[p][0], before[i], *p))
        return [s for s in symbols if s >= 0]

    def encode_word(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word that comes in parts; each as soon as no continuation can change it."""
        transducer = Transducer(self)
        for part in data:
            yield from transducer.push(part)
        yield from transducer.finish()


class Transducer:
    """The bytes of one word in, its ids out. The state is a window of symbols, and the last byte, of which it is
    not known yet whether it ends the word."""

    def __init__(self, merges: Merges):
        self._merges = merges
        self._full = merges.lookahead + merges.longest + STEP
        self._window: list[int] = []
        self._last: int | None = None

    def push(self, data: bytes) -> list[int]:
        """The ids that no continuation can change any more."""
        merges, window, stable_ids = self._merges, self._window, []
        for at in range(0, len(data), STEP):
            some = data[at : at + STEP]
            if self._last is not None:
                window.append(merges.inner[self._last])
            window += [merges.inner[b] for b in some[:-1]]
            self._last = some[-1]
            if len(window) >= self._full:
                stable, place = len(window) - merges.lookahead, 0
                for token in merges.merged(window.copy()):
                    if place + merges.length[token] > stable:
                        break
                    place += merges.length[token]
                    stable_ids.append(token)
                del window[:place]
        return stable_ids

    def finish(self) -> list[int]:
        """The ids that are left at the end of the word; then the next word may come."""
        if self._last is None:
            return []
        rest = self._merges.merged([*self._window, self._merges.final[self._last]])
        self._window, self._last = [], None
        return rest


class Decoder:
    """Ids to text, step by step. The state is the bytes of a character that has begun, and whether a token came before.

    surfaces: give the tokens as the vocabulary writes them, with one space between
    them; else the text that they stand for, with a space after each word.
    """

    def __init__(self, merges: Merges, surfaces: bool = True):
        self.between = b" " if surfaces else b""
        if surfaces:
            self._bytes = {i: t.encode() for i, t in merges.surface.items()}
        else:
            symbols = byte_symbols()
            final = {i: t.endswith(merges.end) for t, i in merges.ids.items()}
            plain = {i: t.removesuffix(merges.end) for t, i in merges.ids.items()}
            self._bytes = {i: bytes(symbols[c] for c in t) + b" " * final[i] for i, t in plain.items()}
            self._bytes |= {i: t.encode() for t, i in merges.special.items()}
        self.reset()

    def reset(self) -> None:
        self._characters = codecs.getincrementaldecoder("utf-8")("replace")
        self._begun = False

    def bytes_of(self, tokens: Iterable[int]) -> bytes:
        """The bytes of some tokens in a row."""
        return self.between.join(map(self._bytes.__getitem__, tokens))

    def feed(self, data: bytes) -> str:
        """The text that is complete after the bytes of some more tokens."""
        data = self.between + data if self._begun else data
        self._begun = True
        return self._characters.decode(data)

    def push(self, token: int) -> str:
        return self.feed(self._bytes[token])

    def finish(self) -> str:
        rest = self._characters.decode(b"", True)
        self.reset()
        return rest


class Coder:
    """Encodes and decodes whole texts in blocks, with a bounded memory of words."""

    def __init__(self, definition: str):
        self.merges = Merges(definition)
        own = Tokenizer.from_str(definition)
        self._normal, self._split = own.normalizer, own.pre_tokenizer
        self._symbols = byte_symbols()
        special = sorted(self.merges.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self._transducer = Transducer(self.merges)
        self._decoder = Decoder(self.merges)
        self._known: dict[str, tuple[int, bytes, bytes]] = {}

    def words(self, text: str) -> Iterator[list[str]]:
        """The normalised words of a text without special tokens, block by block."""
        at = 0
        while at < len(text):
            to = at + BLOCK
            if to < len(text):
                cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to))
                while cut < at and to < len(text):  # a word longer than a block
                    found = re.compile("[ \n]").search(text, to)
                    cut = found.start() if found else len(text)
                to = cut
            block = text[at : to + 1]
            at = to + 1
            try:
                block.encode("latin-1")
            except UnicodeEncodeError:
                # The file's own rules say what is a letter beyond the first 256 code points.
                pieces = self._split.pre_tokenize_str(self._normal.normalize_str(block))
                yield [bytes(self._symbols[c] for c in piece).decode() for piece, _ in pieces]
            else:
                yield _LATIN.findall(block.lower())

    def _coded(self, ids: list[int]) -> tuple[int, bytes, bytes]:
        """Number of some ids in a row, their decimals, and their bytes, which are still to go through the decoder."""
        return len(ids), " ".join(map(str, ids)).encode(), self._decoder.bytes_of(ids)

    def _remember(self, word: str) -> tuple[int, bytes, bytes]:
        found = self._coded([*self._transducer.push(word.encode("utf-8", "surrogatepass")), *self._transducer.finish()])
        if len(self._known) >= REMEMBERED:
            self._known.clear()
        self._known[word] = found
        return found

    def _long(self, word: str) -> Iterator[list[tuple[int, bytes, bytes]]]:
        for i in range(0, len(word), BLOCK):
            if ids := self._transducer.push(word[i : i + BLOCK].encode("utf-8", "surrogatepass")):
                yield [self._coded(ids)]
        yield [self._coded(self._transducer.finish())]

    def _parts(self, text: str) -> Iterator[list[tuple[int, bytes, bytes]]]:
        """What the transducer gives, in order; words that are not too long are remembered with it."""
        known = self._known
        for segment in self._special.split(text) if self._special else [text]:
            if segment in self.merges.special:
                yield [self._coded([self.merges.special[segment]])]
                continue
            for block in self.words(segment):
                if max(map(len, block), default=0) <= REMEMBERED_CHARACTERS:
                    yield [known.get(w) or self._remember(w) for w in block]
                    continue
                for word in block:
                    if len(word) <= REMEMBERED_CHARACTERS:
                        yield [known.get(word) or self._remember(word)]
                    else:
                        yield from self._long(word)

    def encode(self, text: str | None) -> Iterator[int]:
        for part in self._parts(text or ""):
            for _, ids, _ in part:
                yield from map(int, ids.split())

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        self._decoder.reset()
        for token in ids:
            yield self._decoder.push(token)
        yield self._decoder.finish()

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of their decimals joined by spaces, and SHA-256 of the decoded text."""
        n, ids, decoded, between = 0, hashlib.sha256(), hashlib.sha256(), b""
        self._decoder.reset()
        for part in self._parts(text or ""):
            if part:
                counts, a, b = zip(*part, strict=True)
                n += sum(counts)
                ids.update(between + b" ".join(a))
                decoded.update(self._decoder.feed(self._decoder.between.join(b)).encode())
                between = b" "
        decoded.update(self._decoder.finish().encode())
        return n, ids.hexdigest(), decoded.hexdigest()


def _definition(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def encoded(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array of int) of documents (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(_definition(tokenizer))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        coder = Coder(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([list(coder.encode(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

        return batch

    return map_text(documents.select("doc_id", "text"), f"doc_id {kind}, ids array<int>", make)


def decoded(encodings: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    shared = encodings.sparkSession.sparkContext.broadcast(_definition(tokenizer))
    kind = encodings.schema["doc_id"].dataType.simpleString()

    def make():
        coder = Coder(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = pa.array(["".join(coder.decode(ids or ())) for ids in b.column(1).to_pylist()], pa.string())
            return pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

        return batch

    return map_text(encodings.select("doc_id", "ids"), f"doc_id {kind}, text string", make)


def digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents (doc_id, text), without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(_definition(tokenizer))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        coder = Coder(shared.value)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, text = zip(*map(coder.digests, b.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return batch

    return map_text(documents.select("doc_id", "text"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
