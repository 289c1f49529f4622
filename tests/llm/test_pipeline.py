import re
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import pii, simhash, toxicity
from test_mixing import plain_targets
from test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_and_run_agree_with_plain_python(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((docs, spark.read.parquet(f"{tmp_path}/{name}")))
        docs = seen[-1][1]
    rows = [({r["doc_id"]: r for r in a.collect()}, b.collect()) for a, b in seen]

    before, after = rows[0]
    model = toxicity.learn(seen[0][0], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r["doc_id"]: r["_tox_score"] for r in toxicity.scored(seen[0][0], model).collect()}
    assert {r["doc_id"] for r in after} == {i for i, s in scores.items() if s < 0.3}

    before, after = rows[1]
    ids = sorted(before)
    groups = plain_components([plain_fingerprint(before[i]["text"]) for i in ids])
    assert sorted(r["doc_id"] for r in after) == sorted(ids[g] for g in set(groups))

    before, after = rows[2]
    assert all(r["text"] == pii.redacted(before[r["doc_id"]]["text"], pii.all_spans(before[r["doc_id"]]["text"], pii.weights())[1]) for r in after) and len(after) == len(before)

    before, after = rows[3]
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode()))
    sizes: dict = {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    taken: dict = {}
    for r in after:
        assert before[r["doc_id"]]["text"].startswith(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + size(r["text"])
    assert all(abs(taken[s] - t) < 1 for s, t in plain_targets(sizes).items())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r["doc_id"], len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1) for r in after)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0) == want
    assert sum(r["length"] for r in packed) == sum(n for _, n in want)


def rebuilt(rows: list) -> dict:
    """The ids of every sequence, put together from its pieces by offset."""
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["offset"] == len(sequences.setdefault(r["sequence_id"], []))
        sequences[r["sequence_id"]] += ids
    return sequences


def test_sequences_can_be_rebuilt(spark, tmp_path):
    docs, ids = spark.read.parquet(f"{SF}/documents.parquet"), Counter()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    for r in docs.collect():
        ids.update([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1])
    sequences = rebuilt(rows)
    assert all(0 < len(s) <= 2048 for s in sequences.values()) and sorted(sequences) == list(range(len(sequences)))
    assert Counter(i for s in sequences.values() for i in s) == ids
    assert rebuilt(corpus_pipeline.run(spark, SF).collect()).keys() == sequences.keys()


def test_awkward_and_empty_tables(spark, awkward, empty, tmp_path):
    """Each stage on nulls, empty and long texts, ties, repeated rows and clashing columns; then all of them, and an empty table."""
    odd = awkward.withColumnsRenamed({"fp": "_mix_size", "rank": "a.b", "label": "_tox_score", "block": "c0"})
    labels = spark.createDataFrame([(3, 1), (None, 1), (99, None), *((i, 0) for i in (0, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14))], "doc_id long, toxic int")
    for name, table in (("awkward", odd), ("empty", empty)):
        home = f"{tmp_path}/{name}"
        table.write.parquet(f"{home}/documents.parquet")
        labels.write.parquet(f"{home}/labels.parquet")
        docs = spark.read.parquet(f"{home}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, home)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert (out.count() > 0) == (name == "awkward")
        rows = corpus_pipeline.run(spark, home).collect()
        sequences = rebuilt(rows)
        assert (sum(map(len, sequences.values())) > 1000) == (name == "awkward")
    kept = {(r["doc_id"], r["text"]) for r in simhash.deduplicate(awkward).collect()}
    assert {t for _, t in kept if t and "no id" in t}  # a null id is no reason to go


def test_the_package_stands_alone():
    """Nothing outside these folders imports the operators, but the guard in the entry module."""
    root = Path(corpus_pipeline.__file__).parent
    for path in root.glob("millrace/**/*.py"):
        if "llm" not in path.parts:
            assert "millrace.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
    assert simhash.RADIUS == 4
