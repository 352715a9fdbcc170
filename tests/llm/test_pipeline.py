"""The pipeline against a plain-Python run of the same rules, over the whole small tables."""

import hashlib
import re

import pytest
import tiktoken

import corpus_pipeline
from kpiloom.llm import queries, secrets
from kpiloom.llm.simhash import simhash

SF001 = "/root/testdata/sf0.001"


def near_classes(fps):
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def words10(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def raw(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    items = [words10(r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    return docs, items


def test_pipeline_against_brute_force(spark, raw):
    docs, items = raw
    judged = {r.doc_id: r.kept for r in queries.op3_quality_rules(spark, SF001).collect()}
    left = {k: t for k, t in docs.items() if judged[k]}
    assert 0 < len(left) < len(docs)
    near = near_classes({k: simhash(t.encode()) for k, t in left.items()})
    left = {k: t for k, t in left.items() if near[k] == k}
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def leaked(text):
        w = words10(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    left = {k: t for k, t in left.items() if not leaked(t)}
    ranks, pattern = queries.tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for k, t in left.items():
        spans, out, at = secrets.find(t, secrets.RULES), [], 0
        for _, s, e in spans:
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        t = "".join([*out, t[at:]])
        expected[k] = (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, SF001).collect()}
    assert got == expected


def test_odd_rows_go_through(spark, tmp_path):
    """NULLs, empty and long texts, repeated rows and clashing column names."""
    base = " ".join(f"word{i} and more" for i in range(60))
    rows = [
        (1, base, "fp"), (1, base, "fp"), (2, None, None), (3, "", "x"), (None, base + " end here", "y"), (None, None, None),
        (4, "z" * 300_000, "q"), (5, " ".join(f"long{i}" for i in range(30_000)), "r"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").selectExpr(
        "doc_id", "text", "'en' as lang", "fp as source", "cast(length(text) as long) as n_chars", "fp", "fp as rk1", "fp as _row", "fp as n_words", "fp as key"
    )
    spark.createDataFrame([(1, None), (2, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert len(ids) == len(set(ids))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


def test_stages_send_texts_in_batches_of_few_bytes(spark):
    """A batch is bounded by its bytes, not only by its rows."""
    import pyarrow as pa

    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('long text ', 20000) AS text", "200000L AS n_chars").coalesce(1)
    try:
        assert dict(corpus_pipeline.STAGES)["secret_scans"](spark, docs, "").count() == 60
        rows = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
        sent = [r.n for r in docs.select("text").mapInArrow(rows, "n long").collect()]
        assert sum(sent) == 60 and max(sent) * 200_000 <= 2 * corpus_pipeline.BATCH_BYTES
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
