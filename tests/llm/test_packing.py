import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_awkward_documents(awkward, empty):
    tokenizer = Tokenizer.from_file(PATH)
    expected = Counter()
    for r in awkward.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            expected[(r["doc_id"], at, len(part) // 4, zlib.crc32(part), len(ids))] += 1
    rows = packing.pack(awkward, PATH, keep_ids=True).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and sorted(ends) == list(range(len(ends)))
    assert packing.pack(empty, PATH).count() == 0


def test_parted_texts_have_the_same_ids():
    tokenizer = Tokenizer.from_file(PATH)
    for text in ("One, two. THREE... 3.14, 1,000. it's, é. ,x .y z.", "<|EndOfText|> A, <|endoftext|> b.", "İstanbul, ΣΑΣ. ſ,", "", "a.\nb,\tc"):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        data, offsets = packing.parted(raw, np.array([0, len(raw)]))
        ids = b"".join(packing.Words(PATH).ids(data[offsets[0] : offsets[1]].split()))
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def ids_of_parted(texts: list[str], words: packing.Words) -> list[list[int]]:
    raw = [t.encode() for t in texts]
    data, offsets = packing.parted(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    return [np.frombuffer(b"".join(words.ids(data[a:b].split())), "<u4").tolist() for a, b in zip(offsets, offsets[1:])]


def test_capitals_before_marks_have_the_same_ids():
    """Every ASCII capital with every combining mark, and with a mark of a lower class between."""
    tokenizer, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    texts = ["al-H\u0331arf, T\u0308. J\u030c W\u030a Y\u030a T\u0344", "T\u0591\u0308 H\u05b0\u0331a", "\u00dcber Die Stra\u00dfe, \u201cHello\u201d ABC. \u212aELVIN"]
    texts += [" ".join(f"x{chr(c)}{chr(m)}Y." for m in range(0x300, 0x370)) for c in range(65, 91)]
    assert ids_of_parted(texts, words) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_kind_of_word_has_the_same_ids():
    """Signs beside letters and digits, apostrophes with their endings, characters beyond ASCII, and plain words of any length."""
    tokenizer, words, texts = Tokenizer.from_file(PATH), packing.Words(PATH), []

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("ab stTvelr'.,-_<|>/0123456789 \n"), st.characters(max_codepoint=127), st.sampled_from("é\u0301ß漢²½\u00a0\u2028\u0660\u02bc\u2019")), max_size=14))
    def gather(t):
        texts.append(t)

    gather()
    texts += ["a-b_c/d 12.5% v1.2.3, (x) it's 'tis o'clock, 9's rock'n'roll don't. l'été, naïve-2 a1b2", "http://host-1.example.org:8080/x?y=1&z=%20#a", "\x00a\x1fb\x7f1"]
    texts += ["".join(chr(97 + (i * i * k + k) % 26) for i in range(n)) for n in range(1, 60) for k in (3, 7)] + ["zq" * 3_000]
    assert ids_of_parted(texts, words) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_case_is_decided_word_by_word():
    """A neighbour with a special token or a mark changes nothing about a text's words."""
    words = packing.Words(PATH)
    texts = ["One, TWO", "<|endoftext|> Three, a<|b, <|EndOfText|>,", "One, TWO", "H\u0331arf", "One, TWO"]
    raw = [t.encode() for t in texts]
    data, offsets = packing.parted(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    found = [data[a:b] for a, b in zip(offsets, offsets[1:])]
    assert found[0] == found[2] == found[4] == b"one , two"
    assert found[1] == b"<|endoftext|> three , a<|b, <|EndOfText|>," and found[3] == raw[3]
    tokenizer = Tokenizer.from_file(PATH)
    assert ids_of_parted(texts, words) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="THJWYaks .,<|é\u0308\u0331\u030a\u0344\u0591漢İſ'1\n", max_size=30), max_size=4))
def test_parted_mixtures_have_the_same_ids(texts):
    tokenizer = _TOKENIZER
    assert ids_of_parted(texts, _WORDS) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


_TOKENIZER, _WORDS = Tokenizer.from_file(PATH), packing.Words(PATH)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_use_every_piece_once_within_capacity(histogram):
    used: Counter = Counter()
    for times, parts in packing.plan(dict(histogram), 40):
        assert times > 0 and sum(n * k for n, k in parts) <= 40
        for n, k in parts:
            used[n] += times * k
    assert used == Counter(histogram)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=6), st.integers(1, 60))
def test_best_fill_is_the_fullest(counts, room):
    reach = {0}
    for n, c in counts.items():
        reach |= {x + n * k for x in reach for k in range(c + 1)}
    found = packing.best_fill(counts, sorted(counts, reverse=True), room)
    assert sum(n * k for n, k in found) == max(x for x in reach if x <= room)
    assert all(k <= counts[n] for n, k in found)


def test_words_survive_a_change_of_generation(monkeypatch):
    monkeypatch.setattr(packing, "WORDS_KEPT", 3)
    words, texts = packing.Words(PATH), [[b"alpha", b"beta"], [b"gamma", b"delta"], [b"alpha", b"omega", b"beta", b"pi"]]
    fresh = Tokenizer.from_file(PATH)
    for t in texts:
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids(t)] == [fresh.encode(w.decode(), add_special_tokens=False).ids for w in t]
