import hashlib

import public_tokenizers
import pytest

import corpus_pipeline
from quillon.llm import bpe
from tests.llm.test_llm import RANKS, base_spans, jaccard_classes, leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, and what each stage kept of them."""
    folder = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])
    counts = [df.count() for df in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r["doc_id"] for r in stages[1].collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in left for d in good) >= 0.97 * len(good)
    bad = [d for d, q in labels.items() if not q]
    assert sum(d not in left for d in bad) >= 0.7 * len(bad)


def test_one_of_each_class_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted({c for c, _ in jaccard_classes(texts).values()})


def test_leaks_go(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == set(texts) - {d for d, _ in leaks(texts, items)}


def test_no_secret_is_left(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert set(before) == set(after)
    for d, r in after.items():
        assert not base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not base_spans(before[d]):
            assert r["text"] == before[d]


def test_tokens_decode_to_the_texts(spark, stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
    data = {r["doc_id"]: bytes(r["data"]) for r in bpe.decode(stages[5], RANKS, public_tokenizers.PATTERN).collect()}
    assert data == {d: t.encode() for d, t in texts.items()}


def test_run_is_all_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SF).drop("ids").collect()) == sorted(stages[-1].drop("ids").collect())


def odd_rows(spark, rows):
    """Rows with columns that are named as the operators name theirs."""
    schema = "doc_id bigint, text string, n_chars bigint, score string, predicted int, id string, spans string, ids binary, digest string, class_id string"
    return spark.createDataFrame([(i, t, None if t is None else len(t), f"s{k}", k, f"i{k}", None, None, "", f"c{k}") for k, (i, t) in enumerate(rows)], schema)


def test_stages_take_odd_rows(spark):
    prose = "Some words of prose that stand here for a while and say little, and then some more of them to make it long."
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    long = " ".join(f"{prose} {k}" for k in range(3000))
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(1, prose), (1, prose), (2, prose), (None, prose), (None, None), (3, None), (4, ""), (5, " \n"), (6, long), (7, f"see {item} there"), (8, f"{secret} é {secret}")]
    docs = odd_rows(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.where("false"), SF)
        assert empty.count() == 0 and empty.columns == docs.columns and dict(empty.dtypes) == dict(docs.dtypes), name
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        # What comes out are rows that came in, but for the text and n_chars of the redaction.
        kept = lambda df: {tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in df.collect()}
        assert kept(out) <= kept(docs), name
    quality, copies, leaks_, secrets = (dict(corpus_pipeline.STAGES)[n](spark, docs, SF).collect() for n, _ in corpus_pipeline.STAGES[:-1])
    # No labelled document is among these, so nothing is learnt and all stay.
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(quality) == len(rows) or labelled & {i for i, _ in rows}
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in copies) == sorted([(0, prose), (0, ""), (1, prose), (3, ""), (6, long), (7, f"see {item} there"), (8, f"{secret} é {secret}")])
    assert sorted((r["doc_id"] or 0) for r in leaks_) == sorted((i or 0) for i, _ in rows if i != 7)
    assert len(secrets) == len(rows)
    for r in secrets:
        before = rows[r["predicted"]][1]
        assert r["text"] == ('[SECRET]" é [SECRET]"' if r["doc_id"] == 8 else before) and r["n_chars"] == (None if before is None else len(r["text"]))
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(coded) == len(rows) and sorted(r["n_tokens"] > 0 for r in coded) == sorted(bool(t) for _, t in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
