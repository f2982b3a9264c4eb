import re

import corpus_pipeline
import test_line_dedup
import test_simhash
from tessera.llm import entries
from tessera.llm.packing import CAPACITIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run_and_every_query_is_registered(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = set(entries.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(entries.oracle_sql()) <= names


def windows(text, n=8):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", test_simhash.lower(text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}, len(words)


def test_stages_match_brute_force(spark):
    """Each stage on what its predecessor kept, against plain Python."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).selectExpr("doc_id + 100000 as doc_id", "case when doc_id % 2 = 0 then '12 %% 3' end as text", "lang", "source", "n_chars")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    named = stages["language_id"](spark, docs.unionByName(extra), SF).cache()
    assert {r["doc_id"]: r["text"] for r in named.collect()} == rows

    lines = stages["line_dedup"](spark, named, SF).cache()
    kept = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert kept == {i: text for i, text, _, _ in test_line_dedup.brute_force(list(rows.items()))}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    ids = sorted(kept)
    groups = test_simhash.shingle_groups([kept[i] for i in ids])
    single = stages["simhash"](spark, lines, SF).cache()
    assert sorted(r["doc_id"] for r in single.collect()) == [ids[k] for k in sorted(set(groups))]

    items = [windows(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, single, SF).cache()
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in single.collect():
        own, _ = windows(r["text"])
        leaks = any(len(own & item) >= min(6, n - 7) for item, n in items if n >= 8)
        assert (r["doc_id"] in left) != leaks, r["doc_id"]
    assert len(left) < single.count()

    packed = stages["packing"](spark, clean, SF).collect()
    assert {i: sum(r["n_tokens"] for r in packed if r["doc_id"] == i) for i in left} == {i: len(t.split()) for i, t in left.items()}
    used = {}
    for r in packed:
        used.setdefault((r["shard"], r["bin"]), [0, r["bin_tokens"]])[0] += r["n_tokens"]
    assert all(size == min(c for c in CAPACITIES if c >= n) for n, size in used.values())


def test_all_stages_on_odd_tables(spark):
    """Empty tables, repeated and null ids, null texts, and columns whose names clash with those that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id long, block int, `_doc` string, hub long"
    empty = spark.createDataFrame([], schema)
    docs = empty
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == empty.columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0

    source = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "f", 1, 2, "d", 3) for r in source]
    texts = [r[1] for r in rows]
    rows += [(None, texts[5], "en", None, 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    rows += [(rows[7][0], texts[8], "en", "s", 1, "x", 9, 9, "x", 9), rows[9], (10**12, "", None, None, 0, "", 0, 0, "", 0)]
    docs = spark.createDataFrame(rows, schema)
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == empty.columns and 0 < docs.count() <= before, name
        before = docs.count()
    left = [r["doc_id"] for r in docs.collect() if r["doc_id"] is not None]
    assert len(left) == len(set(left)) > 20  # one row of each document
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
