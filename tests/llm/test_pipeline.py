import corpus_pipeline
from hearsay.llm.queries import ORACLES, QUERIES


def test_stages_on_planted_cases(spark, sf_dir, tmp_path):
    prose = [" ".join(f"p{k}w{i}" for i in range(80)) + "." for k in range(6)]
    leak = "Who wrote the well known play about the prince of denmark? It was william shakespeare of stratford upon avon."
    near = prose[1].replace("p1w40", "other")
    passage = " ".join(f"s{i}" for i in range(60))
    docs = [
        (1, prose[0]), (2, prose[0]), (3, prose[1]), (4, near), (5, prose[2] + " you worthless idiot moron. " * 3), (6, prose[3] + "\n" + leak), (7, prose[4] + "\n" + passage), (8, prose[5] + "\n" + passage),
        (9, None), (10, ""), (11, "short"),
    ]
    d = spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = d
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r.doc_id for r in kept.select("doc_id").collect()}
    assert left["toxicity"] == {1, 2, 3, 4, 6, 7, 8, 9, 10, 11}
    assert left["line_dedup"] == left["toxicity"] - {2}
    assert left["near_duplicates"] == left["line_dedup"] - {4}
    assert left["decontamination"] == left["near_duplicates"] - {6}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert texts[7].endswith(passage) and texts[8] == prose[5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left["bpe"]


def _tables(spark, path, docs, columns):
    spark.createDataFrame(docs, columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "Who wrote it? It was william.")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(100, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    same = "one text that is there with several ids and more than once"
    base = " ".join(f"w{i}" for i in range(100))
    docs = [(None, None), (None, "null id"), (None, same), (3, same), (3, same), (4, same), (5, ""), (5, None), (6, "x" * 300_000), (7, base), (7, base.replace("w50", "v")), (8, base), (9, "   \n\n")]
    clash = "score string, Clauses int, n_lines int, deleted string, t string, id string, class int, words int, other int, n int, row int"
    rows = [(i, t, *("mine" if "string" in c else k for k, c in enumerate(clash.split(", ")))) for i, t in docs]
    d = _tables(spark, tmp_path, rows, f"doc_id bigint, text string, {clash}")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, d, str(tmp_path))
        assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{k}")
        d = spark.read.parquet(f"{tmp_path}/{k}")
    left = d.collect()
    assert {(r.score, r.Clauses, r.row) for r in left} == {("mine", 1, 10)}
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in left)
    assert kept == [(False, 3), (False, 5), (False, 5), (False, 6), (False, 7), (False, 9), (True, 0), (True, 0)]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 8


def test_empty_tables(spark, tmp_path):
    d = _tables(spark, tmp_path, [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0


def test_registration():
    assert sorted(QUERIES, key=lambda x: int(x[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 10 and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_plan_of_near_duplicates_stays_short(spark, sf_dir):
    """What classes are made of is written, not planned again for each use: that plan is held by the driver."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, sf_dir)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") + plan.count("BroadcastExchange") < 15
    assert out.count() < docs.count()
