"""Each stage against brute force on what the stage before it kept."""

import corpus_pipeline
from llm_frames import MESSY, documents
from panelcast.llm import langid
from panelcast.llm.text import fold
from test_op1_minhash import brute as near
from test_op5_exactdedup import norm
from test_op7_decontam import brute as leaks
from test_op10_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], SF)
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:-1]]
    ids = [{d for d, _ in r} for r in rows]

    model = langid.learn(docs.where(fold("doc_id", 5) != 0))
    told = langid.Predictor(model)(docs.select("text").toPandas()["text"])
    known = (told["lang_pred"] != langid.UNKNOWN) & (told["sure"] >= langid.LEAST_SCORE)
    sure = {r["doc_id"] for r, k in zip(docs.select("doc_id").collect(), known) if k}
    assert ids[1] == sure and len(sure) > 0.95 * len(ids[0])

    best = {}
    for d, t in rows[1]:
        best[norm(t)] = min(best.get(norm(t), (0, d)), (-len(t or ""), d))
    assert ids[2] == {d for _, d in best.values()}

    assert ids[3] == {d for (d, _, component) in near(rows[2]) if d == component}

    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert ids[4] == ids[3] - {d for d, _ in leaks(rows[3], bench)}

    packed = kept[5].collect()
    check(packed, 2048)
    assert {r["doc_id"] for r in packed} == ids[4]


def test_repeated_and_null_ids_keep_their_own_texts(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (2, a + " two words"), (2, b), (None, a), (None, c)]
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, documents(spark, rows), SF)
    assert sorted(r["text"] for r in out.collect()) == [a, b, c]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_messy_rows(spark):
    for rows in (MESSY, []):
        for _, stage in corpus_pipeline.STAGES:
            frame = documents(spark, rows).selectExpr("*", "'en' AS lang")
            out = stage(spark, frame, SF)
            assert out.count() <= 10 * len(rows)
