"""The pipeline against stages done one document at a time."""
import collections
import hashlib

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
import public_tokenizers  # noqa: E402

from tests.llm.test_texts import brute_components, tiktoken_encoding  # noqa: E402
from tidepool.llm import mixing, quality, secret_scan  # noqa: E402


def test_pipeline(spark, tables):
    d, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")
    good = {r["doc_id"] for r in quality.classify(d, labels).collect() if r["predicted"]}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in d.collect() if r["doc_id"] in good]
    _, root = brute_components([r[:2] for r in rows])
    rows = [r for r in rows if root[r[0]] == r[0]]
    rows = [(i, secret_scan.masked(t, secret_scan.spans_of(t)), s) for i, t, s in rows]
    copies = {r["id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    e, want = tiktoken_encoding(), collections.Counter()
    for i, t, _ in rows:
        ids = e.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[i]
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want and len(good) < d.count() and len(rows) < len(good)


def _awkward(spark):
    from tests.llm.conftest import LONG

    base = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{base} {i} the sea and the hill", "en", f"s{i % 3}", 0) for i in range(20)] + [(30 + i, f"a quiet tree number {i} on river road {i * i} near house {i + 7}", None, None, 0) for i in range(40)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", None, 0), (102, LONG, "en", "s1", 1), (103, "token=abcdefghijkl1234 " * 3 + "is in here", "de", "s2", 1)]
    rows += [rows[25]] * 2 + [(31, "another text of the same id, with words of its own", "en", "s0", 1)] + [(None, "no id one two three four", "en", "s0", 1)] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_awkward_rows_pass_every_stage(spark, tables, tmp_path):
    import shutil

    rows, d = _awkward(spark)
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")  # nothing is rejected
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = near = corpus_pipeline.near_dedup_stage(spark, corpus_pipeline.quality_stage(spark, d, str(tmp_path)), str(tmp_path))
    assert collections.Counter(r["doc_id"] for r in near.collect() if r["doc_id"] is None or r["doc_id"] >= 30) == {None: 2, 31: 2} | {i: 1 for i in [30, *range(32, 70), 100, 101, 102, 103]}
    masked = [(r["doc_id"], secret_scan.masked(r["text"], secret_scan.spans_of(r["text"])), r["source"]) for r in docs.collect()]
    assert any("<assign>" in (t or "") for _, t, _ in masked)
    mixed = mixing.mix(spark.createDataFrame(masked, "doc_id long, text string, source string")).collect()
    text = {}
    for i, t, s in masked:
        text.setdefault((i, s), []).append(t)
    e, want = tiktoken_encoding(), collections.Counter()
    for r in mixed:
        options = [t for t in text[r["id"], r["source"]] if len((t or "").split()) == r["size"]]
        ids = e.encode_ordinary(options[0] or "")
        want[r["id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((options[0] or "").encode()).hexdigest()] += r["copies"]
    assert got == +want and any(i == 102 for i, *_ in got) == any(r["copies"] for r in mixed if r["id"] == 102)
    shutil.rmtree(tmp_path / "documents.parquet")
    d.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    empty = corpus_pipeline.run(spark, str(tmp_path))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_take_columns_of_any_name(spark, tables):
    clash = "__score __text __row __drop __id id doc gone th k n row_id row_source row_th copies __k h to key band rep spans size x s".split()
    d = spark.read.parquet(f"{tables}/documents.parquet")
    wide = d.selectExpr("*", *[f"'v' as {c}" for c in clash])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, tables)
        assert out.columns == wide.columns, name
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in stage(spark, d, tables).collect()), name
    assert corpus_pipeline.bpe_stage(spark, wide, tables).count() == d.count()


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == corpus_pipeline.COLUMNS and dict(out.dtypes) == dict(docs.dtypes)
    assert public_tokenizers.PATTERN
