"""The pipeline's stages, each against what brute force keeps of its input."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
import sentencepiece
from test_dedup import brute_exact, brute_simhash

import __spark_entry__ as contract
from seriesmill.llm.quality import quality_scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), [("documents", None)]
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], SF).write.parquet(str(folder / name))
        frames.append(spark.read.parquet(str(folder / name)))
        out.append((name, None))
    return dict(zip([n for n, _ in out], frames, strict=True))


def test_stages(written):
    docs = {n: f.collect() for n, f in written.items()}
    columns = written["documents"].columns
    for name in ("quality", "exact_dedup", "near_dedup", "decontaminate"):
        assert written[name].columns == columns
    kept = {i for i, _, _, k, _ in brute_exact([(r["doc_id"], r["text"]) for r in docs["quality"]]) if k}
    assert {r["doc_id"] for r in docs["exact_dedup"]} == kept
    kept = {i for i, _, c in brute_simhash([(r["doc_id"], r["text"]) for r in docs["exact_dedup"]]) if i == c}
    assert {r["doc_id"] for r in docs["near_dedup"]} == kept
    assert {r["doc_id"] for r in docs["sentencepiece"]} == {r["doc_id"] for r in docs["decontaminate"]}
    assert 0 < len(docs["decontaminate"]) < len(docs["near_dedup"]) < len(docs["documents"])


def test_leaks_and_pieces_by_brute_force(written, spark):
    def flat(text):
        return " " + " ".join(re.findall(r"\w+", (text or "").lower())) + " "

    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = (written[n].collect() for n in ("near_dedup", "decontaminate"))
    assert {r["doc_id"] for r in after} == {
        r["doc_id"] for r in before if not any(t in flat(r["text"]) for t in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    want = {}
    for r in after:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in written["sentencepiece"].collect()} == want


def test_quality_stage_is_its_scores(written, spark):
    scores = quality_scores(written["documents"], spark.read.parquet(f"{SF}/labels.parquet"), threshold=0.5)
    assert {r["doc_id"] for r in written["quality"].collect()} == {r["doc_id"] for r in scores.where("keep").collect()}


def test_run_is_its_stages(spark, written):
    rows = sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
    assert rows == sorted(map(tuple, written["sentencepiece"].collect()))


def test_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_odd_stages(spark, odd_docs):
    for docs in (odd_docs, odd_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SF)
            assert found.count() <= docs.count()
    # clean rows stay, whatever other rows share their id or have none; of equal ones one does
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = [(r["doc_id"], r["text"]) for r in stage(spark, odd_docs, SF).collect()]
        assert (10, "another") in left and (10, "other") in left and (12, "a") in left
        if name == "exact_dedup":
            assert sum((t or "").split() == "same text here for all".split() for _, t in left) == 1
