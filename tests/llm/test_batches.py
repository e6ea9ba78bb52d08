"""What Python workers get at once of long tables, and that the session's own bound stays."""

import gc
import weakref

import pyarrow as pa
import pytest
from chainloom.llm import jaccard_join, packing, pii, tokens
from chainloom.llm.common import BATCH_BYTES, lean, small_batches
from pyspark.sql import functions as F

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(df, *_):
    """Rows and bytes of each batch of df."""

    def rows(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return df.mapInArrow(rows, "n long, size long")


@pytest.fixture(scope="module")
def long_texts(spark):
    """12 MB of texts in one partition."""
    return spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 1365).alias("text"))


def test_texts_to_be_packed_come_in_small_batches(spark, long_texts, monkeypatch):
    import corpus_pipeline as p

    monkeypatch.setattr(packing, "cut", sizes)
    monkeypatch.setattr(packing, "pack", lambda pieces: pieces)
    found = p.pack(spark, long_texts, "").collect()
    assert sum(x.n for x in found) == 3000
    assert max(x.size for x in found) <= 1.1 * BATCH_BYTES


def test_texts_to_be_joined_come_in_small_batches(spark, long_texts, monkeypatch):
    monkeypatch.setattr(jaccard_join, "read", lambda *_: long_texts)
    monkeypatch.setattr(jaccard_join, "linked", lambda docs, **_: sizes(docs).collect())
    found = jaccard_join.op9_jaccard_join(spark, "")
    assert sum(x.n for x in found) == 3000
    assert max(x.size for x in found) <= 1.1 * BATCH_BYTES


@pytest.mark.parametrize("own", [None, "32m"])
def test_the_sessions_bound_returns(spark, own):
    usual = spark.conf.get(KEY)
    try:
        if own:
            spark.conf.set(KEY, own)
        before = spark.conf.get(KEY)
        with pytest.raises(KeyError), small_batches(spark):
            assert spark.conf.get(KEY).removesuffix("b") == str(BATCH_BYTES)
            raise KeyError
        assert spark.conf.get(KEY) == before
    finally:
        spark.conf.unset(KEY)
    assert spark.conf.get(KEY) == usual


def test_masked_texts_are_put_together_in_order(spark, long_texts):
    n = 2 * pii.MASKED_ROWS + 1
    text = F.when(F.col("id") % 7 > 0, F.concat(F.lit("mail u"), "id", F.lit("@example.org now")))
    got = pii.masked(spark.range(0, n, 1, 1).select("id", text.alias("text"))).collect()
    assert [(x.id, x.text) for x in got] == [(k, "mail <email> now" if k % 7 else None) for k in range(n)]


def test_an_encoder_goes_when_a_task_of_another_function_begins():
    """Workers serve all stages: an encoder holds up to 400,000 parts, which no other stage needs."""
    import public_tokenizers

    path, found = public_tokenizers.path("byte_bpe_50k.json"), []

    @lean
    def coded(batches):
        for _ in batches:
            found.append(weakref.ref(tokens.encoder(path)))
            yield

    @lean
    def other(batches):
        yield from batches

    for rows in (coded, coded):
        assert list(rows([1, 2])) == [None, None]
    assert len({id(r()) for r in found}) == 1 and found[0]() is not None
    assert list(other([1])) == [1]
    gc.collect()
    assert found[0]() is None
