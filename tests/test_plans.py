"""Physical-plan checks: pruning, pushdown, bounded broadcasts, no Python in hot paths."""

import __spark_entry__ as E


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_column_pruning_reaches_scan(spark, sf_small):
    from callscope.plans import views
    p = plan_of(views.call_scores(spark, sf_small))
    # the documents scan reads only the two columns V4 needs, never the text
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in p


def test_partition_filter_on_result_table(spark, sf_small):
    df = E.queries()["results_by_time_cut"](spark, sf_small)
    p = plan_of(df)
    assert "PartitionFilters: [isnotnull(time_cut" in p and "(time_cut#" in p


def test_bag_of_words_does_not_replicate_documents(spark, sf_small):
    p = plan_of(E.queries()["bow_counts"](spark, sf_small))
    assert "CartesianProduct" not in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_no_python_udfs_in_batch_catalogue(spark, sf_small):
    for name in ["flagship_call_metrics", "first_hit_summary", "call_assembly_cut60", "tfidf_l2",
                 "speaker_forward_fill", "segment_max_pool", "stratified_split", "bootstrap_ids"]:
        p = plan_of(E.queries()[name](spark, sf_small))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p, name
