"""The pipeline's stages on small tables: decisions take effect, columns stay, hard cases pass."""

import corpus_pipeline as P


def test_run_at_smallest_scale(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = P.materialise(docs, name) if hasattr(P, "materialise") else docs
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0
    last = P.STAGES[-1][1](spark, docs, sf)
    assert last.count() == sizes[-1]
    assert P.run(spark, sf).count() == sizes[-1]


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_decisions_are_about_rows(spark):
    """Null and shared ids, repeated rows, near copies and a contaminated text without an id."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    word = lambda k: " ".join(f"{a}{k}" for a in ("alpha", "beta", "gamma", "delta", "rho", "tau", "nu", "xi", "mu", "pi", "eta", "phi"))
    near = word(1) + " " + word(2) + " " + word(3)
    rows = [(None, near), (7, near), (7, near), (9, near + " more"), (7, word(5)), (None, word(6)), (None, word(6)), (3, None), (None, ""), (3, " "), (None, f"{word(8)} {item} {word(9)}"), (11, item)]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    listed = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    apart = [(7, near), (7, word(5)), (None, word(6)), (3, None), (None, ""), (3, " "), (None, f"{word(8)} {item} {word(9)}"), (11, item)]
    assert listed(P.one_of_each(spark, odd, sf)) == sorted(apart, key=str)
    assert listed(P.decontaminate(spark, odd, sf)) == sorted(((i, t) for i, t in rows if not t or item not in t), key=str)
    assert P.mix(spark, odd, sf).columns == docs.columns and P.shard(spark, odd, sf).count() == len(rows)
    kept = P.quality(spark, odd, sf)
    assert kept.columns == docs.columns and {t for _, t in listed(kept)} <= {t for _, t in rows}


def test_clashing_columns(spark):
    """Columns named as what the stages make of documents come through with their values; rows that differ in them alone are rows of their own."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["k", "n", "part", "__id", "__key", "__copies", "__text_key", "row", "one", "two", "id", "whole", "uid", "times", "every", "m", "r"]
    wide = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in names))
    twice = wide.union(wide.selectExpr(*docs.columns, *(f"'other' AS {c}" for c in names)))
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, twice, sf)
        assert out.columns == wide.columns
        assert out.where(" OR ".join(f"{c} NOT IN ('other', concat('{c}', doc_id))" for c in names)).count() == 0
        assert out.where("(k = 'other') <> (uid = 'other')").count() == 0
    assert P.STAGES[-1][1](spark, twice, sf).count() == twice.count()
    once = P.one_of_each(spark, twice, sf)
    assert once.where("text <> ''").count() == P.one_of_each(spark, docs, sf).where("text <> ''").count()


def test_two_runs_at_once(spark):
    import threading

    sizes = []
    runs = [threading.Thread(target=lambda: sizes.append(P.run(spark, "/root/testdata/sf0.001").count())) for _ in range(2)]
    for r in runs:
        r.start()
    for r in runs:
        r.join()
    assert len(sizes) == 2 and sizes[0] == sizes[1] > 0
