"""What the plans must look like: pruned scans, no needless shuffles, bounded single partitions."""

from tidepool import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_one_row_of_statistics_only(spark, data):
    text = plan(queries.QUERIES["lexical_bm25"](spark, data))
    assert "hashpartitioning" not in text and "Python" not in text and "TakeOrderedAndProject" in text
    assert text.count("Exchange SinglePartition") <= 1


def test_filters_reach_the_scan(spark, data):
    text = plan(queries.QUERIES["lexical_bm25_filtered"](spark, data))
    assert "EqualTo(lang,en)" in text and "n_chars" not in text


def test_columns_are_pruned(spark, data):
    text = plan(queries.QUERIES["passage_dedup"](spark, data))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_best_chunk_has_no_window(spark, data):
    assert "Window" not in plan(queries.QUERIES["note_best_chunk"](spark, data))


def test_cosine_stays_in_the_jvm(spark, data):
    text = plan(queries.QUERIES["semantic_topk"](spark, data))
    assert "Python" not in text and "Exchange" not in text


def test_texts_are_cut_once(spark, data):
    """Statistics and scores of BM25 read one exchange."""
    d = queries.QUERIES["lexical_bm25"](spark, data)
    d.collect()
    final = plan(d).split("Initial Plan")[0]
    assert final.count("Scan parquet") == 1 and "ReusedExchange" in final
