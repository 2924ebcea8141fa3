"""The pipeline against plain Python over its first stage's result."""

import hashlib

import corpus_pipeline
from test_operators import bag, base_spans, jaccard

from tallyforge.llm import quality


def test_run(spark):
    import public_tokenizers
    import tiktoken

    from tallyforge.llm import bpe

    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id: r.text for r in quality.keep_quality(docs, labels).collect()}
    assert 150 < len(kept) < docs.count()
    bags, group = {i: bag(t) for i, t in kept.items()}, {}
    for i in sorted(kept):
        near = {group[j] for j in group if jaccard(bags[i], bags[j]) >= 0.8}
        least = min(near | {i})
        group[i] = least
        for j in group:
            if group[j] in near:
                group[j] = least
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    left = {i: t for i, t in kept.items() if group[i] == i and not any(x in " ".join(t.split()) for x in items)}
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(left)
    clean = [i for i, t in left.items() if not base_spans(t)]
    assert 0 < len(clean)
    for i in clean:
        assert got[i].n_tokens == len(encoding.encode_ordinary(left[i]))
        assert got[i].decoded_sha256 == hashlib.sha256(left[i].encode()).hexdigest()
    for i in set(left) - set(clean):
        assert got[i].decoded_sha256 != hashlib.sha256(left[i].encode()).hexdigest()


def test_stages_keep_edges(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table and columns of clashing names through all stages."""
    d = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{d}/documents.parquet")
    good = documents.where("length(text) > 400").limit(30)
    odd = spark.createDataFrame([(None, "no id at all"), (901, None), (902, ""), (903, "word " * 40_000), (904, "twice the same row"), (904, "twice the same row")], "doc_id long, text string")
    names = {"lang": "string", "source": "string", "n_chars": documents.schema["n_chars"].dataType.simpleString()}
    odd = odd.selectExpr("doc_id", "text", *[f"cast(null as {t}) as {c}" for c, t in names.items()]).select(*documents.columns)
    clash = good.unionByName(odd).selectExpr("*", "'c' as cls", "'s' as score", "'i' as item_id", "'p' as spans", "1 as size", "2 as base")
    docs = clash
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "byte_bpe":
            assert out.columns == clash.columns
            assert stage(spark, clash.limit(0), d).count() == 0
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0
    kept = corpus_pipeline.near_dedup_stage(spark, odd, d).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["901", "902", "903", "904", "None"]
