"""The pipeline, stage by stage, against brute force on small tables."""

import collections

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers

import corpus_pipeline
from tessella.llm import packing, pii, quality
from tests.llm.test_operators import frame, make_texts, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [(i, t) for i, t in enumerate(make_texts(9, 80))]
    benchmark = " ".join((texts[0][1] or "").split()[:60])
    texts += [(200, texts[5][1]), (201, (texts[6][1] or "") + " mail me@there.org now"), (None, "no id " * 3 + " ".join(f"u{i}" for i in range(80))), (202, texts[0][1])]
    frame(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, benchmark), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts_of(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    verdicts = quality.score(docs, quality.trusted(spark.read.parquet(f"{folder}/labels.parquet"))).where("kept").select("row.*")
    assert texts_of(good) == texts_of(verdicts) and 0 < good.count() < docs.count()

    alone = stages["near_dup"](spark, docs, folder)
    sets = {r.doc_id: shingles(r.text) for r in docs.collect() if r.doc_id is not None}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert {r.doc_id for r in alone.collect()} == {i for i in sets if label[i] == i} | {None} and alone.columns == docs.columns

    clean = stages["decontamination"](spark, docs, folder)
    dirty = {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()}
    assert {0, 202} <= dirty and len(dirty) < 20 and clean.columns == docs.columns

    hidden = stages["pii"](spark, docs, folder)
    assert hidden.columns == docs.columns and hidden.count() == docs.count()
    for r in hidden.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and not pii.base_spans(r.text or "")
    assert any("<EMAIL>" in (r.text or "") for r in hidden.collect())


def test_run_packs_what_the_stages_keep(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    tokenizer = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    expected = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in docs.collect()}
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id].append((r.piece, bytes(r.ids)))
    assert {i: b"".join(x for _, x in sorted(p)) for i, p in got.items()} == expected
