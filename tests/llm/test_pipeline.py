"""The pipeline's stages against brute force on a small corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riverine.llm import pii, queries
from test_corpus import check_packed, slow_fingerprint, slow_language, slow_pseudonyms, slow_roots, slow_starts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    at = tmp_path_factory.mktemp("corpus")
    words = [f"{a}{b}" for a in ("riv", "ston", "brid", "wat", "lum", "gard") for b in ("er", "ing", "ges", "en", "ous", "ly", "ant")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))
    shared = text(70)
    rows = [(i, text(rng.randint(80, 200)), "en") for i in range(60)]
    rows += [(100 + i, f"{text(60)} {shared} {text(60)}", "en") for i in range(5)]
    rows += [(200, rows[7][1], "en"), (201, rows[8][1], "en"), (300, None, "en"), (301, "", "en"), (302, "12345 %%% 678", "en"), (303, text(60) + " jane.42@mail1.example.com +1 (988) 555-2485 4111111111111111", "en")]
    docs = spark.createDataFrame([(i, t, g, "src0", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"file://{at}/documents.parquet")
    return f"file://{at}", shared


def test_stages(spark, folder):
    sf_dir, shared = folder
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names and [f.dataType for f in docs.schema] == [f.dataType for f in seen["language"].schema]
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert not ids["language"] & {300, 301, 302} and len(ids["language"]) == 68
    assert ids["near_copies"] == ids["language"] - {200, 201}
    assert ids["repeats"] == ids["near_copies"] == ids["privacy"] == ids["packing"]
    left = {r["doc_id"]: r for r in seen["repeats"].collect()}
    assert all(shared not in left[100 + i]["text"] and len(left[100 + i]["text"]) > 300 for i in range(5))
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())
    clean = {r["doc_id"]: r["text"] for r in seen["privacy"].collect()}
    assert clean == {i: pii.Pseudonyms(queries.PII_KEY).replace(r["text"])[0] for i, r in left.items()}
    assert not re.search(r"jane\.42@|988\) 555-2485|4111111111111111", clean[303])
    total = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in total)


def slow_pipeline(spark, docs):
    """[(doc_id, text)] that packing gets, stage by stage by brute force."""
    rows = [r.asDict() for r in docs.collect()]
    hashes = {r["doc_id"]: (r["h"] & (1 << 63) - 1, r["fold"]) for r in docs.where("doc_id is not null").selectExpr("doc_id", "xxhash64(cast(doc_id as string)) as h", "crc32(cast(doc_id as string)) % 5 as fold").collect()}
    by: dict = {}
    for r in sorted((r for r in rows if r["doc_id"] is not None and r["text"] is not None and hashes[r["doc_id"]][1]), key=lambda r: (hashes[r["doc_id"]][0], r["doc_id"], r["text"])):
        by.setdefault(r["lang"], []).append(r["text"])
    rows = [r for r, x in zip(rows, slow_language(by, [r["text"] for r in rows], order=5), strict=True) if not x[2]]
    groups: dict = {}
    for r, root in zip(rows, slow_roots([slow_fingerprint(r["text"]) for r in rows]), strict=True):
        groups.setdefault(root, []).append(r)
    kept = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    raws = [r["text"].encode() for r in kept]
    for r, raw, at in zip(kept, raws, slow_starts(raws, [1] * len(raws), 200), strict=True):
        gone = {j for i in at for j in range(i, i + 200)}
        r["text"] = slow_pseudonyms(bytes(b for j, b in enumerate(raw) if j not in gone).decode("utf-8", "ignore"), queries.PII_KEY)
    return kept


def test_run_is_the_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    more = [
        (7, "an unlike text under a number that another document has too: " + " ".join(f"stoning bridger wateren lumly{'er' * (i % 3)}" for i in range(60)), "en"),
        (None, "without a number " + " ".join(f"gardant riverous lumges {'wating ' * (i % 4)}" for i in range(40)), "en"),
        (400, "the last words of a copy " + " ".join(f"riving stoner wateren {'ly' * (i % 5)}" for i in range(50)), "en"),
        (400, "the last words of a copy " + " ".join(f"riving stoner wateren {'ly' * (i % 5)}" for i in range(50)), "en"),
    ]
    docs = docs.unionByName(spark.createDataFrame([(i, t, g, "src1", len(t)) for i, t, g in more], docs.schema))
    docs.withColumn("my.col", F.lit("dotted")).withColumn("key", F.lit(1)).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    want = slow_pipeline(spark, docs)
    assert sorted(r["doc_id"] for r in want if r["doc_id"] is not None).count(7) == 2 and any(r["doc_id"] is None for r in want)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    check_packed(got, [(r["doc_id"], r["text"]) for r in want])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty_tables_pass_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs.where("false").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_run_and_registration(spark, folder):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}
    out = corpus_pipeline.run(spark, folder[0])
    assert out.where("sequence_id is null").count() == 0 and out.count() > 60


def test_nothing_else_imports_the_operators():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "riverine").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
