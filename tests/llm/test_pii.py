import hashlib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text: str) -> list:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@ab%_é\n", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789 .-+()@ab dot at\n", max_size=60))
def test_the_model_keeps_base_spans_and_overlaps_none(text):
    base, every = pii.all_spans(text, pii.weights())
    assert set(base) <= set(every)
    added = [s for s in every if s not in set(base)]
    for i, (_, a, b) in enumerate(added):
        assert 0 <= a < b <= len(text)
        assert all(b <= x or y <= a for _, x, y in base) and all(b <= x or y <= a for _, x, y in added[:i])


def test_held_out_sentences():
    hit = wrong = missed = 0
    for text, spans in pii.sentences(300, seed=1234):
        found, true = set(pii.all_spans(text, pii.weights())[1]), set(spans)
        hit, wrong, missed = hit + len(found & true), wrong + len(found - true), missed + len(true - found)
    assert hit / (hit + wrong) > 0.95 and hit / (hit + missed) > 0.95


def test_awkward_documents(awkward, empty, spark, tmp_path):
    rows = pii.found(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["_pii_base"]] == plain(r["text"] or "")
    done = pii.redact(awkward)
    assert done.columns == awkward.columns
    texts = {r["doc_id"]: r for r in done.collect()}
    assert texts[0]["text"] is None and texts[15]["text"] == "mail <EMAIL> now <PHONE> <CARD> at <IP>." and texts[15]["n_chars"] == len(texts[15]["text"])
    assert pii.found(empty).count() == 0 and pii.redact(empty).count() == 0
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op3_pii(spark, str(tmp_path)).collect():
        text = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]) or ""
        if r["doc_id"] is not None:
            line = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
            assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()


class Counted(list):
    """A list that counts how often it is looked into."""

    looks = 0

    def __getitem__(self, at):
        Counted.looks += 1
        return super().__getitem__(at)


def test_long_zones_stay_linear():
    """Steps over closed spans grow with the text, not with its square; so does the lattice."""
    looks, edges = [], []
    for n in (500, 4_000):
        text = " ".join(f"user{i}@mail{i}.com, 12" for i in range(n))
        closed = Counted(pii.united(sorted((a, b) for _, a, b in pii.base_spans(text))))
        assert len(closed) == n and len(pii.zones(text)) < n / 100
        Counted.looks = 0
        edges.append(sum(len(pii.lattice(text, a, b, closed)[1]) for a, b in pii.zones(text)))
        looks.append(Counted.looks)
    assert looks[1] < 9 * looks[0] and edges[1] < 9 * edges[0]
    text = "12 " * 20_000 + "9" * 50_000
    borders, found = pii.lattice(text, 0, len(text), [])
    assert len(found) < 4 * pii.SEGMENT_ATOMS * len(borders)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=8), st.lists(st.integers(0, 40), min_size=2, max_size=12, unique=True))
def test_shut_atoms_by_definition(spans, borders):
    closed, borders = sorted((a, a + n) for a, n in spans), sorted(borders)
    expected = [any(x < b and a < y for x, y in closed) for a, b in zip(borders, borders[1:])]
    assert pii.shut_atoms(borders, pii.united(closed)) == expected


def segmentations(n: int, edges: list, at: int = 0):
    if at == n:
        yield []
    for e in edges:
        if e[0] == at:
            for rest in segmentations(n, edges, e[1]):
                yield [e, *rest]


def some_lattices(count: int):
    r = random.Random(6)
    while count:
        text = "".join(r.choice(["12", "555", "4111", " ", "-", ".", "(", ")", "+", "tel ", "at "]) for _ in range(r.randrange(3, 9))) + "7"
        borders, edges = pii.lattice(text, 0, len(text), [])
        count -= 1
        yield len(borders) - 1, edges


def test_decode_is_the_best_of_all_segmentations():
    r = random.Random(7)
    seen = 0
    for n, edges in some_lattices(300):
        w = {f: r.gauss(0, 1) for e in edges for f in e[3]}
        score = lambda path: sum(w[f] for e in path for f in e[3])
        best = max(score(p) for p in segmentations(n, edges))
        found = pii.decode(n, edges, w)
        seen += len(found)
        inside = {x for i, j, _ in found for x in range(i, j)}
        path = [e for e in edges if (e[:3] in found if e[2] else e[0] not in inside)]
        assert abs(score(path) - best) < 1e-9
    assert seen > 30


def test_a_step_of_training_follows_the_gradient():
    """The step is STEP times the numeric gradient of the log-likelihood over all segmentations (features that occur once)."""
    r = random.Random(8)
    for n, edges in some_lattices(60):
        edges = [(i, j, kind, [f"{k}"]) for k, (i, j, kind, _) in enumerate(edges)]
        w = {str(k): r.gauss(0, 0.5) for k in range(len(edges))}
        paths = list(segmentations(n, edges))
        true = r.choice(paths)

        def likelihood(w: dict) -> float:
            score = lambda p: sum(w[e[3][0]] for e in p)
            return score(true) - math.log(sum(math.exp(score(p)) for p in paths))

        stepped = dict(w)
        pii._improve(n, edges, {e[:3] for e in true if e[2]}, stepped)
        for f in w:
            slope = (likelihood(w | {f: w[f] + 1e-5}) - likelihood(w | {f: w[f] - 1e-5})) / 2e-5
            assert abs(stepped[f] - (w[f] + pii.STEP * slope)) < 1e-3


def test_clashing_and_awkward_column_names(spark):
    df = spark.createDataFrame([(1, "call +1 (555) 123-4567", "x", 5, 6.0)], "doc_id long, text string, _pii_base string, `a.b` int, `Text ` double")
    row = pii.found(df).first()
    assert row["_pii_all"][0]["kind"] == "phone" and row["a.b"] == 5
    assert pii.redact(df).columns == df.columns and pii.redact(df).first()["text"] == "call <PHONE>"


def test_parts_of_addresses_with_very_many_zeros():
    """int() takes 4,300 digits at most; zeros in front of a part count for nothing."""
    for part, good in (("0" * 5_000, True), ("0" * 5_000 + "255", True), ("0" * 5_000 + "256", False), ("1" + "0" * 5_000, False)):
        text = f"at 10.0.{part}.1 now"
        assert [s for s in pii.base_spans(text) if s[0] == "ip"] == [("ip", 3, len(text) - 4)] * good
