import zlib

import pytest

import corpus_pipeline as P
from locusflow.llm import decontaminate, mixing, pii, quality, simhash

from .oracle import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows after each stage, as dictionaries."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    where = tmp_path_factory.mktemp("steps")
    out.append(docs.toPandas())
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]


def test_each_stage_on_its_input(spark, steps):
    start, good, once, clean, masked, mixed = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(good.doc_id)
    right = [(d in kept) == bool(q) for d, q in labels.items() if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(right) >= 0.9 * len(right)

    fps = [simhash.fingerprint(t.encode()) for t in good.text]
    ids, root = good.doc_id.tolist(), list(range(len(good)))
    for _ in range(len(ids)):
        before = list(root)
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j], key=lambda k: ids[k])
        if root == before:
            break
    assert set(once.doc_id) == {ids[k] for k in root}

    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    text = {d: " ".join(t.lower().split()) for d, t in zip(once.doc_id, once.text, strict=True)}
    holds = {d for d, t in text.items() if any(" ".join(w) in t for w in items)}
    gone = set(once.doc_id) - set(clean.doc_id)
    assert holds <= gone and len(gone) <= len(holds) + 3

    plain = dict(zip(clean.doc_id, clean.text, strict=True))
    for r in masked.itertuples():
        assert r.text == pii.masked(plain[r.doc_id], pii.spans(plain[r.doc_id])) and r.n_chars == len(r.text)
    assert list(masked.columns) == list(start.columns)

    per = mixed.groupby("source").agg(t=("taken", "sum"), g=("target", "first"))
    assert list(mixed.columns) == [*start.columns, "size", "source_size", "target", "taken"]
    assert dict(zip(mixed.doc_id, mixed.text, strict=True)).items() <= dict(zip(masked.doc_id, masked.text, strict=True)).items()
    assert (abs(per.t - per.g) <= 1).all() and (mixed.taken <= 2 * mixed["size"]).all()


def test_run_is_its_stages(spark, steps):
    got = P.run(spark, SF)
    assert rows_of(got.toArrow())[1].total() == len(steps[-1])
    assert sorted(got.toPandas().doc_id) == sorted(steps[-1].doc_id)


def test_stages_on_no_rows(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert all(m for m in (decontaminate, mixing, quality))
