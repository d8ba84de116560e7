"""Exact repeats of lines under five words, as op8 and the pipeline take them."""

import corpus_pipeline
from terravane.llm import queries

ROWS = [
    (1, "All rights reserved.\nown first line\n\nx", "k"),
    (2, "  All rights reserved. \n中文没有空格的一行\n\nown second", "k"),
    (3, "中文没有空格的一行\na\tb\tc d\nAll rights reserved", "k"),
    (4, "a\tb\tc d\nAll rights reserved.", "k"),
    (None, "x", "k"),
    (5, None, "k"),
    (6, "one two three four five six\nx", "k"),
    (7, "one two three four five seven\nlast", "k"),
]
LEFT = {1: ROWS[0][1], 2: "中文没有空格的一行\n\nown second", 3: "a\tb\tc d\nAll rights reserved", 4: "", None: "", 5: None, 6: "one two three four five six", 7: "last"}


def test_short_repeats_go(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, key string").selectExpr("*", "cast(char_length(text) as long) AS n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0), 2: (4, 1), 3: (3, 1), 4: (2, 2), None: (1, 1), 5: (1, 0), 6: (2, 1), 7: (2, 1)}
    kept = corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in kept} == {d: t for d, t in LEFT.items() if d not in (4, None)}
    assert all(r.n_chars == len(r.text) for r in kept if r.text is not None)
