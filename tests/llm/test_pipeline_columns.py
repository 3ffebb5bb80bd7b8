"""Columns of documents that are called like those that stages use inside, and conversations with gaps between their ids."""

from pyspark.sql import functions as F

from sparkloom.llm import decontaminate
from sparkloom.llm.preference import preference_pairs, swapped_answers

NAMES = "doc_id long, text string, lang string, source string, n_chars long, near_row string, row string, spans string, hits string, component_id string, text_key string, own_id string"
MINE = ("en", "s", 9, *(f"my {c}" for c in "abcdefg"))


def test_near_dedup_keeps_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    texts = {1: "one two three four five six", 2: "one two three four five six", 3: "quite another text of so many words"}
    docs = spark.createDataFrame([(i, t, *MINE) for i, t in texts.items()], NAMES)
    got = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(1, texts[1], *MINE), (3, texts[3], *MINE)]


def test_decontamination_in_blocks_keeps_clashing_columns(spark, monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = {1: "clean words only here", 2: "before " * 20 + items[3][1] + " after", 3: items[4][1], 4: None}
    docs = spark.createDataFrame([(i, t, *MINE) for i, t in texts.items()], NAMES)
    whole = sorted(map(str, decontaminate.decontaminated(spark, docs, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 100)
    got = decontaminate.decontaminated(spark, docs, benchmark)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(map(str, rows)) == whole and sorted(r["doc_id"] for r in rows) == [1, 2, 4]
    assert all(tuple(r)[5:] == MINE[3:] for r in rows)
    assert [r["text"].split() for r in rows if r["doc_id"] == 2] == [["before"] * 20 + ["after"]]


def test_every_conversation_with_an_answer_but_one_has_a_rejected_side(spark, sf_dir):
    answered, silent = [-(2**40), 3, 7, 8, 500, 2**33], [4, 9]
    rows = [(c, 0, "user", f"q{c}") for c in answered + silent] + [(c, 1, "assistant", f"a{c}") for c in answered]
    got = {r["pair_id"]: r for r in preference_pairs(swapped_answers(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert sorted(got) == answered
    for this, after in zip(answered, answered[1:]):
        assert got[this]["rejected"] == f"<|assistant|>\na{after}\n" and got[this]["n_prompt"] == 1
    assert got[answered[-1]]["rejected"] == ""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = preference_pairs(swapped_answers(table))
    assert pairs.where("rejected = ''").count() == 1 and pairs.count() == table.where("role = 'assistant'").select("conv_id").distinct().count()
    assert pairs.where(F.col("n_prompt") > 0).count() > 0
