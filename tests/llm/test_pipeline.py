"""The pipeline: each stage's decisions take effect, and clean documents stay."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))
    bad, item = ["zorkish", "grumblet"], words(30)
    rows, labels = [], []
    for i in range(300):
        t = words(40)
        if i % 5 == 0:
            t += " " + " ".join(bad)
        rows.append([i, t, "en", f"src{i % 3}", len(t)])
        labels.append((i, 0, int(i % 5 == 0)))
    rows[31][1] = rows[32][1].upper()  # exact copies
    rows[41][1] = rows[42][1] = "same text with a longer tail " + words(60)
    rows[42][1] += " end"
    rows[51][1] += " " + item
    d, sf = spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    kept, seen = d, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == d.columns
        kept = spark.createDataFrame(out.collect(), d.schema)
        seen.append({x.doc_id for x in kept.collect()})
    clean = {i for i in range(300) if i % 5}
    assert seen[0] == clean
    assert clean - seen[1] == {31} and {31, 32} & seen[1] == {32}
    assert clean - seen[2] <= {31, 42} and clean - seen[3] - {31, 42} == {51}
    mixed = corpus_pipeline.run(spark, sf).collect()
    assert {x.doc_id for x in mixed} == seen[3] and all(x.copies <= 3 for x in mixed)
