import hashlib
import math
import random

import pytest
import xxhash

from millrace.llm import digest


def order(doc: tuple) -> tuple:
    h = xxhash.xxh64_intdigest(doc[1].encode(), 42)
    return (doc[0] is None, -(doc[0] or 0), h - 2**64 if h >= 2**63 else h, doc[1])


def plain_codes(text: bytes) -> list[int]:
    """The length's byte, then how many of the sorted counters at a quarter, half and three quarters each counter exceeds."""
    closed, counts = text + b"\0\0", [0] * 512
    for i in range(len(text)):
        triplet = int.from_bytes(closed[i : i + 3], "big")
        counts[triplet * 2654435761 % 2**32 >> 23] += 1
    level = sorted(counts)
    return [min(255, round(8 * math.log2(len(text) + 1))), *(sum(c > level[k] for k in (128, 256, 384)) for c in counts)]


def plain_likeness(a: list[int], b: list[int]) -> float:
    return max(0.0, 1 - (sum(abs(x - y) for x, y in zip(a[1:], b[1:])) + 2 * min(32, abs(a[0] - b[0]))) / (1.25 * 512))


def plain_text(codes: list[int]) -> str:
    four = [codes[1 + i : 5 + i] for i in range(0, 512, 4)]
    return bytes([codes[0], *(a << 6 | b << 4 | c << 2 | d for a, b, c, d in four)]).hex()


def plain(docs: list[tuple]) -> list[tuple]:
    """Every column of the operator, from the definitions."""
    docs, out = sorted(docs, key=order), []
    for i, (doc_id, text) in enumerate(docs):
        follow, half = docs[(i + 1) % len(docs)][1], len(text) // 2
        edited = (text[: len(text) - half] + follow[:half]).encode()
        a, b, c = plain_codes(text.encode()), plain_codes(edited), plain_codes(follow.encode())
        out.append((str(doc_id), len(text), hashlib.sha256(edited).hexdigest(), plain_text(a), plain_text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in df.collect())


def test_every_column_against_the_definitions(awkward, monkeypatch):
    docs = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    assert got(digest.fingerprints(awkward)) == plain(docs)
    monkeypatch.setattr(digest, "PART_BYTES", 100)
    monkeypatch.setattr(digest, "RANGE_ROWS", 3)
    assert got(digest.fingerprints(awkward.repartition(5))) == plain(docs)


def test_null_and_repeated_ids_are_cut_into_ranges(spark, monkeypatch):
    """A third of the rows without an id, a third with one id: no range holds all of either."""
    monkeypatch.setattr(digest, "RANGE_ROWS", 10)
    r = random.Random(2)
    docs = [(i if i % 3 else None if i % 2 else 77, " ".join(str(r.randrange(50)) for _ in range(r.randrange(12)))) for i in range(240)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(digest.fingerprints(df)) == plain(docs)
    rows = df.selectExpr("doc_id", "text", "xxhash64(text) as h")
    sizes = digest.ranged(rows).groupBy("range").count().collect()
    assert max(x["count"] for x in sizes) < 40 and len(sizes) > 12


@pytest.mark.parametrize("n", [1, 2, 3, 99, 100, 101, 102, 200, 201, 350])
def test_long_texts_are_counted_in_parts(monkeypatch, n):
    monkeypatch.setattr(digest, "PART_BYTES", 100)
    text = random.Random(n).randbytes(n)
    assert digest.codes([b"x", text, b""])[1].tolist() == plain_codes(text)


def test_awkward_documents(awkward, empty):
    docs = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    docs.sort(key=order)
    expected = []
    for i, (doc_id, text) in enumerate(docs):
        follow, half = docs[(i + 1) % len(docs)][1], len(text) // 2
        expected.append((str(doc_id), len(text), hashlib.sha256((text[: len(text) - half] + follow[:half]).encode()).hexdigest()))
    rows = digest.fingerprints(awkward).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert all(abs(digest.likeness_of(r["fingerprint"], r["edited_fingerprint"]) - r["near_edited"]) < 1e-12 for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert digest.fingerprints(empty).count() == 0


def test_ranges_of_many_documents(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_ROWS", 7)
    rows = [(i * 3, f"text {i} " * (i % 9)) for i in range(200)]
    found = {r["doc_id"]: r for r in digest.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    texts = dict(rows)
    for i in range(200):
        text, follow = texts[i * 3], texts[((i - 1) % 200) * 3]
        half = len(text) // 2
        assert found[i * 3]["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + follow[:half]).encode()).hexdigest()


def test_a_single_row_is_its_own_next(spark):
    row = digest.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and row["near_next"] == 1.0


def test_likeness_orders_edits():
    text = " ".join(f"word{i * i}" for i in range(300))
    other = " ".join(f"term{i * 7}" for i in range(300))
    a, b, c = digest.codes([text.encode(), (text[:-200] + other[:200]).encode(), other.encode()])
    assert digest.likeness(a[None], a[None])[0] == 1.0
    assert digest.likeness(a[None], b[None])[0] > digest.likeness(a[None], c[None])[0]
