import math
import random
import re
import zlib

import numpy as np
import pytest

from millrace.llm import toxicity


def plain_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Ruzzo and Tompa's definition: take the best segment, then go on in what is left of it on both sides."""
    out = []

    def split(a: int, b: int) -> None:
        best, at = 0.0, None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > best + 1e-9:
                    best, at = total, (i, j + 1)
        if at:
            split(a, at[0])
            out.append(at)
            split(at[1], b)

    split(0, len(scores))
    return out


def test_segments_against_the_definition():
    r = random.Random(8)
    for _ in range(300):
        scores = [r.choice([-3, -2, -1, -0.5, 1, 2.25, 4.125]) + r.random() * 0.01 for _ in range(r.randrange(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == plain_segments(scores)


def corpus(spark, n=600):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.choice('lmnr')}{chr(97 + k)}" for k in [r.randrange(20) for _ in range(r.randrange(30, 200))]]
        toxic = i % 6 == 0
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["Vileworm,", "vileworms", "scoundrel!", "SCOUNDRELLY"]) for _ in range(4)]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy_and_clean(spark):
    docs, labels = corpus(spark)
    model = toxicity.learn(docs, labels)
    rows = {r["doc_id"]: r for r in toxicity.scored(docs, model).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 80
    assert sum((rows[i]["_tox_score"] >= 0.3) == (i % 6 == 0) for i in held) / len(held) > 0.97
    passage = rows[0]["_tox_passages"][0]
    text = docs.where("doc_id = 0").first()["text"].encode()[passage["start"] : passage["end"]].decode().lower()
    assert "vileworm" in text or "scoundrel" in text
    left = {r["doc_id"] for r in toxicity.clean(docs, labels).collect()}
    assert all(i in left for i in range(600) if i % 6) or len([i for i in range(600) if i % 6 and i not in left]) < 8


def test_labels_of_held_out_rows_are_never_read(spark):
    docs, labels = corpus(spark, 300)
    turned = spark.createDataFrame([(r["doc_id"], 1, 1 - r["toxic"] if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 else r["toxic"]) for r in labels.collect()], "doc_id long, quality int, toxic int")
    a, b = ({r["doc_id"]: r["_tox_score"] for r in toxicity.scored(docs, toxicity.learn(docs, x)).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_awkward_documents(awkward, empty, spark):
    docs, labels = corpus(spark, 300)
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["_tox_score"] <= 1 for r in rows)
    assert toxicity.scored(empty, model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (3, None), (3, 0), (4, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.clean(awkward, none).columns == awkward.columns
    for few in (none, odd):
        assert toxicity.clean(awkward, few).count() == awkward.count()
    assert toxicity.clean(empty, labels).count() == 0


def test_the_same_rows_give_the_same_model(spark):
    """Copies that are labelled alike, and rows that are dealt otherwise, change nothing."""
    docs, labels = corpus(spark, 300)
    more = docs.where("doc_id < 60").selectExpr("doc_id + 1000 as doc_id", "concat(text, ' extra', doc_id % 3) as text")
    docs = docs.unionByName(more).unionByName(docs.where("doc_id < 20"))
    labels = labels.unionByName(labels.where("doc_id < 60").withColumn("doc_id", labels["doc_id"] + 1000))
    one, two = (toxicity.learn(docs.repartition(n), labels.repartition(n + 1)) for n in (2, 7))
    assert one.names.tolist() == two.names.tolist() and one.weights.tolist() == two.weights.tolist()
    assert one.law == two.law and one.logistic == two.logistic
    assert len(toxicity.learn(docs, labels, most=3).names) == 3


def test_model_and_scores_against_plain_python(spark):
    r = random.Random(9)
    docs, y = {}, {}
    for i in range(260):
        words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(10**4)}" .translate(str.maketrans("0123456789", "klmnopqrst")) for _ in range(r.randrange(6, 22))]
        y[i] = int(i % 4 == 0)
        if y[i]:
            at = r.randrange(len(words))
            words[at:at] = [r.choice(["vileworm", "vileworms", "scoundrel"]) for _ in range(2)]
        elif r.random() < 0.06:
            words.append("vileworm")
        docs[i] = " ".join(words) + "."
    model = toxicity.learn(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, toxic int"))
    learnt = [i for i in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    tokens = {i: re.findall("[a-z]+", t) for i, t in docs.items()}
    kinds = lambda w: [("word", w), *((k, w[:k]) for k in (4, 5, 6))]
    n1, n0 = sum(y[i] for i in learnt), sum(1 - y[i] for i in learnt)
    counts: dict = {}
    for i in learnt:
        for f in {f for w in tokens[i] for f in kinds(w)}:
            counts.setdefault(f, [0, 0])[1 - y[i]] += 1
    odds = {}
    for f, (a, b) in counts.items():
        p = 20.0 * (a + b) / (n1 + n0)
        if a + b >= 6 and (a < n1 or b < n0):
            o = math.log((a + p) / (n1 + 20.0 - a - p)) - math.log((b + p) / (n0 + 20.0 - b - p))
            if o / math.sqrt(1 / (a + p) + 1 / (b + p)) >= 4:
                odds[f] = o
    assert odds and sorted(odds.values()) == pytest.approx(sorted(model.weights.tolist()))
    scores = {i: [max([0.0, *(odds.get(f, 0.0) for f in kinds(w))]) - 0.25 for w in ws] for i, ws in tokens.items()}
    parts = {i: [sum(s[a:b]) for a, b in plain_segments(s)] for i, s in scores.items()}
    # The extreme-value law over the other documents: scores above zero count in eighths.
    plain = [round(x * 8) / 8 if x > 0 else -0.25 for i in learnt if not y[i] for x in scores[i]]
    mean = lambda t: sum(math.exp(t * x) for x in plain) / len(plain)
    low, high = 1e-6, 64.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 1 else (low, middle)
    k = n0 / sum(max(1, len(scores[i])) * math.exp(-high * max(parts[i], default=0.0)) for i in learnt if not y[i])
    assert model.law == pytest.approx((high, k), rel=1e-6)

    def inputs(i: int) -> list[float]:
        n, best = len(scores[i]), max(parts[i], default=0.0)
        good = [s for s in parts[i] if k * n * math.exp(-high * s) < 0.05]
        return [1.0, min(30.0, max(-10.0, high * best - math.log(k * max(1, n)))), math.log1p(len(good)), math.log1p(sum(good))]

    w = model.logistic
    chance = lambda i: 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, inputs(i)))))
    # The calibration is where the penalised likelihood is flat.
    for j in range(4):
        assert abs(sum((y[i] - chance(i)) * inputs(i)[j] for i in learnt) - 1e-2 * w[j]) < 1e-4
    rows = {r_["doc_id"]: r_["_tox_score"] for r_ in toxicity.scored(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), model).collect()}
    assert all(rows[i] == pytest.approx(chance(i), rel=1e-6) for i in docs)


def test_clashing_and_awkward_column_names(spark):
    docs, labels = corpus(spark, 120)
    odd = docs.selectExpr("doc_id", "text", "5 as _tox_score", "6 as `a.b`", "7 as score", "8 as passages")
    left = toxicity.clean(odd, labels)
    assert left.columns == odd.columns and left.first()[2:] == (5, 6, 7, 8)
    assert isinstance(toxicity.scored(odd, toxicity.learn(docs, labels)).first()["_tox_score"], float)
