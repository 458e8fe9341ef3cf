"""Tables with long rows are read in batches of few rows."""

import re

import numpy as np

from tideline.llm import jaccard

LONG = {"cells", "shingles", "x"}


def test_f1_long_rows_are_read_few_at_a_time(spark, monkeypatch):
    """Leaves and sets of long texts are rows of 100 KB and more: neither readers nor row groups hold thousands of them."""
    monkeypatch.setattr(jaccard, "LEAF", 12)
    r, seen = np.random.default_rng(4), {}
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} " + " ".join(f"q{j}x{i}" for i in range(10 + j % 30)) for j in range(60)]
    texts += [" ".join(f"e{m}" if i in gone else f"b{i}" for i in range(120)) for m in range(40) for gone in [set(r.choice(120, 1).tolist())]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    batch = "spark.sql.parquet.columnarReaderBatchSize"
    usual, cut = int(spark.conf.get(batch)), jaccard.cut

    def spied(df, *group_bytes):
        for columns in re.findall(r"FileScan parquet \[([^\]]*)\]", df._jdf.queryExecution().sparkPlan().toString()):
            for c in LONG & {x.split("#")[0] for x in columns.split(",")}:
                seen.setdefault(c, set()).add(int(spark.conf.get(batch)))
        if LONG & set(df.columns):
            seen.setdefault("written", set()).add(*(group_bytes or [None]))
        return cut(df, *group_bytes)

    monkeypatch.setattr(jaccard, "cut", spied)
    got = {q.doc_id: q.component_id for q in jaccard.Join(5, 80).classes(docs).collect()}
    assert set(seen) == LONG | {"written"} and usual == int(spark.conf.get(batch))
    assert all(max(seen[c]) <= 500 for c in LONG) and seen["written"] == {jaccard.GROUP_BYTES}
    assert len({got[i] for i in range(60, 100)}) == 1 and len({got[i] for i in range(60)}) > 1
