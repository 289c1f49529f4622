import math
from collections import Counter

import pytest

from millrace.llm import scoring


def plain(rows: list[tuple]) -> list[tuple]:
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    total = [Counter(g for _, w in texts for g in grams(w, k)) for k in (1, 2, 3)]
    words = sum(len(w) for _, w in texts)
    out = []
    for i, w in texts:
        c1, c2, c3 = ({g: total[k - 1][g] - n for g, n in Counter(grams(w, k)).items()} for k in (1, 2, 3))
        used, logs = Counter(), 0.0
        for p in range(len(w)):
            if p >= 2 and c3[tuple(w[p - 2 : p + 1])] > 0:
                used[3] += 1
                logs += math.log(c3[tuple(w[p - 2 : p + 1])] / c2[tuple(w[p - 2 : p])])
            elif p >= 1 and c2[tuple(w[p - 1 : p + 1])] > 0:
                used[2] += 1
                logs += math.log(c2[tuple(w[p - 1 : p + 1])] / c1[(w[p - 1],)]) + (p >= 2) * math.log(0.4)
            else:
                used[1] += 1
                logs += math.log(max(c1[(w[p],)], 0.5) / max(words - len(w), 1)) + min(p, 2) * math.log(0.4)
        out.append((i is None, i or 0, len(w), used[3], used[2], used[1], logs / len(w) if w else None))
    return sorted(out, key=lambda r: r[:3])


def test_awkward_documents(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    small = {(r["doc_id"], r["n_words"]): r["by_triple"] for r in scoring.scored(awkward, block_bytes=200, bucket_names=50).collect()}
    assert small == {(r["doc_id"], r["n_words"]): r["by_triple"] for r in scoring.scored(awkward).collect()}
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["by_triple"], r["by_pair"], r["by_word"], r["mean_log_score"]) for r in scoring.scored(awkward).collect()), key=lambda r: r[:3])
    expected = plain(rows)
    assert [r[:6] for r in got] == [r[:6] for r in expected]
    assert [r[6] for r in got] == [pytest.approx(r[6]) if r[6] is not None else None for r in expected]
    by_rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["by_triple"], r["by_pair"], r["by_word"]) for r in scoring.scored_by_rows(awkward).collect()), key=lambda r: r[:3])
    assert by_rows == [r[:6] for r in expected]
    assert scoring.scored(empty).count() == 0 and scoring.scored_by_rows(empty).count() == 0


def test_a_single_document(spark):
    row = scoring.scored(spark.createDataFrame([(1, "a b a b")], "doc_id long, text string")).first()
    assert (row["by_triple"], row["by_pair"], row["by_word"]) == (0, 0, 4)


def test_the_largest_id_is_kept(spark):
    rows = scoring.scored(spark.createDataFrame([(2**63 - 1, "a b"), (None, "a b"), (-(2**63), "b")], "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)) == [(False, -(2**63)), (False, 2**63 - 1), (True, 0)]
