"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: every operator has a defined result."""

import pytest
from pyspark.sql import functions as F

from cairn.llm import audio, chat_format, decontaminate, html_text, lang_id, line_dedup, mixing, ppm, secret_scan, simhash

LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, " \n\t "), (5, LONG), (6, "ÀÉ ∆ 🙂 x\x0by"), (None, "no id"), (7, "a")]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark):
    """Columns with the names that the operators add or use inside."""
    rows = spark.createDataFrame(TEXTS, SCHEMA).withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    for c in ("key", "doc", "fp", "root", "component", "n_lines", "n_dropped", "n_tokens", "topic", "weight", "prob", "kept", "score", "lang_pred", "path", "blob_id", "item", "learnt", "row", "word", "at", "blocks", "block"):
        rows = rows.withColumn(c, F.lit("own"))
    return rows


def test_mixing(spark, docs, clashing):
    out = mixing.mix(clashing).select("doc_id", "n_tokens", "prob", "kept").collect()
    assert len(out) == len(TEXTS)
    assert all(r.prob == 0 and not r.kept for r in out if r.n_tokens == 0)
    assert mixing.mix(clashing.limit(0)).count() == 0
    both = {r.doc_id: r.kept for r in out if r.doc_id == 3}
    assert len(both) == 1


def test_simhash(spark, docs, clashing):
    for rows in (docs, clashing):
        out = {(r.doc, r.fp, r.component) for r in simhash.simhash_groups(rows).collect()}
        by = {d: (f, c) for d, f, c in out}
        assert by[1] == by[2] == by[4] == (0, 1)
        assert by[3][1] == by[7][1] == 3
        assert by[5][1] == 5
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_audio(spark, docs, clashing):
    for rows in (docs, clashing):
        out = audio.audio_columns(rows).collect()
        assert len(out) == len(TEXTS)
        assert {bytes(r.media) for r in out if r.doc in (1, 2)} == {audio.pack_wav(b"\0" * 64, 16000)}
    assert audio.audio_columns(docs.limit(0)).count() == 0


def test_decontaminate(spark, docs, clashing):
    bench = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, ""), (4, "lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    for rows in (docs, clashing):
        out = {(r.doc, r.item) for r in decontaminate.find_leaks(rows, bench).collect()}
        assert out == {(3, 1), (7, 1), (5, 4)}
        assert {r.doc_id for r in decontaminate.remove_leaks(rows, bench).collect()} == {1, 2, 4, 6, None}
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_ppm(spark, docs, clashing):
    for rows in (docs, clashing):
        out = ppm.score_documents(rows, F.lit(True)).collect()
        assert len(out) == len(TEXTS)
        empty = [r for r in out if r.doc in (1, 2)]
        assert {(r.n_tokens, r.n_known) for r in empty} == {(1, 1)}
        assert len({r.score for r in empty}) == 1
    none = ppm.score_documents(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0}
    assert all(r.score < 0 and r.n_known == 0 for r in none)
    assert ppm.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_html(spark, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.lit("own").alias("text"), F.lit("own").alias("words"))
    out = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert out[1] == out[2] == out[4] == ""
    assert out[5].startswith("lorem ipsum")
    assert html_text.extract(pages.limit(0)).count() == 0


def test_lang_id(spark, docs, clashing):
    few = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the and of it", "en"), ("der die und das", "de")] * 30)], "doc_id long, text string, lang string")
    model = lang_id.train(few, F.lit(True))
    for rows in (docs, clashing):
        out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in lang_id.identify(rows, model).collect()}
        assert out[1, None] == out[2, ""] == out[4, " \n\t "] == ("und", 0.0)
        assert all(0 <= s <= 1 for _, s in out.values())
    assert lang_id.identify(docs.limit(0), model).count() == 0
    nothing = lang_id.train(few.where("lang IS NULL"), F.lit(True))
    assert {r.lang_pred for r in lang_id.identify(docs, nothing).collect()} == {"und"}
    assert lang_id.train(few.where("lang = 'de'"), F.lit(True)).predict("ja")[0] == "de"


@pytest.mark.parametrize("bound", [line_dedup.BOUND, 0])
def test_line_dedup(spark, docs, clashing, bound):
    for rows in (docs, clashing):
        out = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(rows, least=2, bound=bound).collect()}
        assert (1, 1, 0, "") in out and (2, 1, 0, "") in out
        assert (4, 2, 0, " \n\t ") in out
        assert (3, 1, 1, "") in out and (7, 1, 1, "") in out
        assert (None, 1, 0, "no id") in out
        assert line_dedup.dedup_lines(rows, least=2, bound=bound).count() == len(TEXTS)
    assert line_dedup.dedup_lines(docs.limit(0), bound=bound).count() == 0


def test_secret_scan(spark, docs, clashing):
    for rows in (docs, clashing):
        versions, _, found = secret_scan.scan_unseen(rows, "doc_id", "text")
        assert secret_scan.spans_by_path(versions, found).where(F.size("found") == 0).count() == len(TEXTS)
    versions, _, found = secret_scan.scan_unseen(docs.limit(0), "doc_id", "text")
    assert secret_scan.spans_by_path(versions, found).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("own")).withColumn("at", F.lit(1))
    records = df.select(F.parse_json(F.to_json(F.struct("conv_id", "role", "text", "turn"), {"ignoreNullFields": "false"})).alias("record"))
    out = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat_format.render(chat_format.to_turns(records, "record")).withColumn("turns", chat_format.read_back(F.col("formatted"))).collect()}
    assert out == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "")]}
    assert chat_format.render(chat_format.to_turns(records.limit(0), "record")).count() == 0
