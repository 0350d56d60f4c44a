import corpus_pipeline
import __spark_entry__ as entry


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen, current = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, current, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        current = corpus_pipeline.written(out, f"test-{name}")
        seen.append(current.count())
    assert seen == sorted(seen, reverse=True) and seen[1] < seen[0] and seen[3] < seen[2] and seen[4] == seen[3]
    assert current.where("text rlike '@mail[0-9]'").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, current, sf)
    assert pieces.select("doc_id").distinct().count() == current.count()


def test_run_on_odd_rows(spark, odd_docs, no_docs):
    """Copies leave one row, columns stay, and every id of what is left lies in one piece."""
    sf = "/root/testdata/sf0.001"
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.text or "" for r in docs.collect()]
        out = corpus_pipeline.written(stage(spark, docs, sf), "odd")
        rows = out.collect()
        assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
        if name == "near_dedup":
            assert sorted(r.text or "" for r in rows) == sorted(set(before))
        if name == "personal_data":
            assert sorted(r.text or "" for r in rows) == sorted(before)
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    assert all(sum(p.length for p in pieces if p.doc_id == r.doc_id) == r.doc_tokens for r in pieces)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf).count() == 0


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_run_agrees_with_brute_force(spark):
    """The filters by their operators' own predictions, the classes over all pairs, the spans and pieces by plain Python."""
    from loomspark.llm import quality, toxicity
    from tests.llm.test_near_dedup import brute as brute_classes
    from tests.llm.test_pii import brute as brute_spans
    from tests.llm.test_tokens import check_packing, library_ids

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted == 1}
    clean = docs.where(~docs.doc_id.isin(list(toxic)))
    poor = {r.doc_id for r in quality.quality(clean, labels).collect() if r.predicted == 0}
    kept = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic | poor}
    classes = brute_classes(list(kept.items()))
    left = {i: t for i, t in kept.items() if classes[i] == i}
    for i, t in left.items():
        for start, _, end, kind in reversed(brute_spans(t)):
            t = t[:start] + f"[{kind.upper()}]" + t[end:]
        left[i] = t
    rows = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert {r["doc_id"] for r in rows} == set(left)
    check_packing(rows, dict(zip(left, [x + [2] for x in library_ids("word_bpe_49k.json", list(left.values()))])))
