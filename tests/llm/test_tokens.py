"""Packing and byte-pair encoding."""

import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe, packing
from millrace.llm.common import byte_symbols
from millrace.session import table
from tests.conftest import rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe._definition(WORD))


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(WORD)


def expected(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    text = reference.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def odd_texts():
    random.seed(11)
    yield from (None, "", " ", "it's we'll 'tis ''s x'S", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "!!'s--'", "ΑΣ ΣΑΣ İıSS ﬁ ǅ 漢字かな")
    for c in range(0x2000):
        yield f"a{chr(c)}b{chr(c)}{chr(c)}1'{chr(c)}"
    for _ in range(300):
        yield "".join(chr(random.choice([random.randrange(32, 127), random.randrange(0x80, 0x600), random.randrange(0x3000, 0xD7FF), random.randrange(0xE000, 0x1F9FF)])) for _ in range(60))
    for k in (70, 600, 1500, 9000):
        yield "".join(random.choices("etaoinshr", k=k))
        yield "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=k)) + " x"
    yield from ("a" * 5000, "ab" * 3000, "the" * 2000, "!" * 3000, "é" * 3000, "inin" * 1500 + "ing", "x " * 70000, "y" * 140_000)


def test_encoding_equals_the_library(coder, reference):
    for text in odd_texts():
        assert coder.digests(text) == expected(reference, text), ascii(text)[:80]


def test_small_windows_give_the_same(coder, reference, monkeypatch):
    monkeypatch.setattr(bpe, "STEP", 1)
    random.seed(2)
    for _ in range(30):
        word = "".join(random.choice(["in", "th", "an", "re", "ing", "tion", "er", "on", "the", "ed"]) for _ in range(900))
        assert list(coder.merges.encode_word([word.encode()])) == reference.encode(word, add_special_tokens=False).ids


def test_lookahead_is_sufficient_for_small_merge_lists():
    """All words over a small alphabet: a token that ends before the lookahead never changes with what follows."""
    symbols = byte_symbols()
    vocab = [c for c in symbols] + [c + "</w>" for c in symbols]
    random.seed(4)
    for _ in range(40):
        merges, known = [], ["a", "b", "c"]
        for _ in range(6):
            pair = (random.choice(known), random.choice(known))
            if "".join(pair) not in known and len("".join(pair)) < 7:
                merges.append(list(pair))
                known.append("".join(pair))
        tokens = vocab + ["".join(m) for m in merges]
        m = bpe.Merges(json.dumps({"model": {"end_of_word_suffix": "</w>", "vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}, "added_tokens": []}))
        for _ in range(60):
            data = bytes(random.choices(b"abc", k=24))
            whole = m.merged([m.inner[b] for b in data])
            ends = [sum(m.length[t] for t in whole[: i + 1]) for i in range(len(whole))]
            for cut in range(m.lookahead, 24):
                place = 0
                for token in m.merged([m.inner[b] for b in data[:cut]]):
                    place += m.length[token]
                    if place <= cut - m.lookahead:
                        assert place in ends


def test_streams_round_trip(spark, odd, reference):
    got = {r["doc_id"]: r["ids"] for r in bpe.encoded(odd, WORD).collect()}
    for r in odd.collect():
        assert got[r["doc_id"]] == reference.encode(r["text"] or "", add_special_tokens=False).ids
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(bpe.encoded(odd, WORD), WORD).collect()}
    assert all(back[i] == reference.decode(ids, skip_special_tokens=False) for i, ids in got.items())


def test_decoder_gives_text_when_a_character_is_whole(coder):
    decoder = bpe.Decoder(coder.merges)
    assert [decoder.push(320), decoder.push(320), decoder.finish()] == ["a</w>", " a</w>", ""]
    plain = bpe.Decoder(coder.merges, surfaces=False)
    ids = [coder.merges.inner[b] for b in "漢".encode()[:2]] + [coder.merges.final["漢".encode()[2]]]
    assert [plain.push(i) for i in ids] == ["", "", "漢 "]
    assert [plain.push(ids[0]), plain.push(320), plain.finish()] == ["", "\ufffda ", ""]


def test_text_comes_back(coder):
    plain = bpe.Decoder(coder.merges, surfaces=False)
    for text in ("Hello WORLD, it's 2024!", "éà ñandú 漢字かな \U0001f600", "a\n\nb", ""):
        words = [w for block in coder.words(text) for w in block]
        got = "".join(plain.push(i) for i in coder.encode(text)) + plain.finish()
        assert got.split() == words


def test_bpe_table(spark, data, odd, empty, reference):
    documents = table(spark, data, "documents")
    got = {r[0]: r[1:] for r in rows(bpe.digests(documents, WORD))}
    assert all(got[r["doc_id"]] == expected(reference, r["text"]) for r in documents.collect())
    assert bpe.digests(odd, WORD).count() == 11
    assert bpe.digests(empty, WORD).count() == 0


def test_packing_ids_equal_the_library():
    ids, first = packing.Ids(open(BYTE, encoding="utf-8").read()), Tokenizer.from_file(BYTE)
    assert ids.fast is not None
    for text in odd_texts():
        assert ids(text or "").tolist() == first.encode(text or "", add_special_tokens=False).ids, ascii(text)[:80]


def plain_two_fit(lengths, capacity):
    """Bin by bin, piece by piece: as patterns() but over single pieces."""
    left, bins = Counter(lengths), []
    while +left:
        left = +left
        room, here = capacity, []
        for n in sorted(left, reverse=True):
            while left[n] and n <= room:
                left[n] -= 1
                here.append(n)
                room -= n
        if room:
            s, best = min(here), None
            for a in left:
                for b in left:
                    if left[a] and left[b] and (a != b or left[a] > 1) and s < a + b <= room + s and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best:
                here.remove(s)
                left[s] += 1
                for n in best:
                    left[n] -= 1
                    here.append(n)
        bins.append(sum(here))
    return bins


def test_patterns_pack_like_single_pieces():
    random.seed(6)
    for _ in range(60):
        lengths = [random.choice([random.randrange(1, 101), random.randrange(30, 60)]) for _ in range(random.randrange(1, 120))]
        made = packing.patterns(dict(Counter(lengths)), 100)
        packed = Counter()
        for bin_, times in made:
            assert sum(n * c for n, c in bin_.items()) <= 100
            packed.update({n: c * times for n, c in bin_.items()})
        assert packed == Counter(lengths)
        assert sum(t for _, t in made) == len(plain_two_fit(lengths, 100))


def test_two_fit_replaces_the_smallest():
    assert packing.patterns({60: 1, 38: 1, 30: 1, 10: 1}, 100) == [({60: 1, 30: 1, 10: 1}, 1), ({38: 1}, 1)]


def check_packing(documents, got):
    ids = Tokenizer.from_file(BYTE)
    bins = defaultdict(list)
    by = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"]].append(r)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc_id, text in documents:
        own = ids.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by[doc_id], key=lambda r: (r["piece"], r["start"]))
        starts = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces})
        at = 0
        for k, (piece, start, length, crc) in enumerate(starts):
            assert (piece, start) == (k, at) and (k == 0 or length == 1024)
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[at : at + length]))
            at += length
        assert at == len(own)


def test_packing_table(spark, data, odd, empty):
    documents = table(spark, data, "documents")
    got = packing.pack(packing.pieces(documents, BYTE)).collect()
    check_packing([(r["doc_id"], r["text"]) for r in documents.collect()], got)
    total = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 1024) * 1.05 + 1
    got = packing.pack(packing.pieces(odd, BYTE)).collect()
    check_packing([(r["doc_id"], r["text"]) for r in odd.collect()], got)
    assert sum(1 for r in got if r["doc_id"] == 1) == 2
    assert packing.pack(packing.pieces(empty, BYTE)).count() == 0


def test_every_word_goes_through_the_transducer_and_the_state_machine(monkeypatch):
    coder, reference = bpe.Coder(bpe._definition(WORD)), Tokenizer.from_file(WORD)
    pushed, fed = [], []
    push, feed = bpe.Transducer.push, bpe.Decoder.feed
    monkeypatch.setattr(bpe.Transducer, "push", lambda self, data: pushed.append(data) or push(self, data))
    monkeypatch.setattr(bpe.Decoder, "feed", lambda self, data: fed.append(data) or feed(self, data))
    text = "The cat, the dog and 漢字 " + "a" * 200_000 + " the cat"
    want = reference.encode(text, add_special_tokens=False).ids
    got = coder.digests(text)
    assert got[0] == len(want) and got[2] == hashlib.sha256(reference.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert b"".join(pushed).count(b"a" * 1000) == 200 and {b"the", b"cat", b"dog", "漢字".encode()} <= set(pushed)
    assert sum(len(x.split()) for x in fed) == len(want)
    assert len(pushed) < 20  # words that come again are remembered
