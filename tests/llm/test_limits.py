"""Long and odd inputs, and what operators promise about how they work."""

import collections
import math
import random
import re
import time

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from cairn.llm import chat_format, decontaminate, lang_id, line_dedup, mixing, secret_scan, simhash
from cairn.llm.common import components, keep, trim

# --- mixing ----------------------------------------------------------------------------------------------------------


def test_raking_ends_when_the_margins_meet():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 1000, 60).astype(float)
    keys = [np.arange(60) % 5, np.arange(60) // 5 % 4, np.arange(60) // 20]
    targets = [rng.dirichlet(np.ones(k)) for k in (5, 4, 3)]
    w = mixing.rake_on_driver(keys, n, targets)
    for k, t in zip(keys, targets, strict=True):
        assert np.abs(np.bincount(k, weights=w) - t).max() < 1e-11
    # contradictory targets: cells (0, 0) and (1, 1) only, whose margins can't differ; it ends and stays finite
    w = mixing.rake_on_driver([np.array([0, 1]), np.array([0, 1])], np.array([1.0, 1.0]), [np.array([0.5, 0.5]), np.array([0.9, 0.1])], 50)
    assert np.isfinite(w).all() and math.isclose(w.sum(), 1)


def test_mixing_takes_any_column_names(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("of_source", F.lit("own")).withColumn("of_lang_", F.lit("own")).withColumn("of_topic", F.lit(1))
    out = mixing.mix(docs)
    assert {"of_source", "of_lang_", "of_topic"} <= set(out.columns) and out.where("of_source = 'own' AND of_topic = 1").count() == docs.count()


def test_mixing_by_topics_of_ones_own(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("field", F.when(F.col("doc_id") % 4 == 0, "law").when(F.col("doc_id") % 4 == 1, "art"))
    goal = {"law": 0.5, "art": 0.3, None: 0.2}
    out = mixing.mix(docs, topic="field", targets={"topic": goal}, fraction=0.05)
    assert {r.topic for r in out.select("topic").distinct().collect()} == set(goal)
    sums = {r.topic: r.w for r in out.groupBy("topic").agg(F.sum(F.col("n_tokens") * F.col("prob")).alias("w")).collect()}
    assert all(math.isclose(sums[k] / sum(sums.values()), v, rel_tol=0.02) for k, v in goal.items())


# --- decontamination -------------------------------------------------------------------------------------------------


def plain_tiles(doc, item, least):
    """All common runs of open tokens, longest first, ties to the earlier place in the item, then in the document."""
    fd, fi, out = [x >= 0 for x in doc], [True] * len(item), []
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and fd[d + n] and fi[i + n] and doc[d + n] == item[i + n]:
                    n += 1
                if n >= least and n >= best:
                    found = found if n == best else []
                    best = n
                    found.append((i, d))
        if not found:
            return out
        for i, d in found:
            if all(fd[d : d + best]) and all(fi[i : i + best]):
                fd[d : d + best] = [False] * best
                fi[i : i + best] = [False] * best
                out.append((d, i, best))


def test_tiles_equal_the_plain_form():
    rng = random.Random(3)
    for _ in range(400):
        kinds, least = rng.choice([1, 2, 3, 5, 20]), rng.randint(1, 5)
        doc = np.array([rng.randint(-1, kinds) for _ in range(rng.randint(0, 40))], np.int32)
        item = np.array([rng.randint(0, kinds) for _ in range(rng.randint(least, 25))], np.int32)
        assert decontaminate.tile(doc, item, least) == plain_tiles(doc.tolist(), item.tolist(), least)


@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_long_texts_are_tiled_in_near_linear_time(kinds):
    rng = np.random.default_rng(1)
    doc, item = (rng.integers(0, kinds, n).astype(np.int32) for n in (100_000, 1000))
    began = time.time()
    decontaminate.tile(doc, item, 5)
    assert time.time() - began < 15


def test_item_ids_of_any_type(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "doc_id int, text string")
    for kind, key in (("int", 7), ("string", "seven"), ("struct<a:int,b:string>", (7, "x")), ("date", __import__("datetime").date(2020, 1, 2))):
        bench = spark.createDataFrame([(key, "two three four five six"), (None, "other words that are not there")], f"item_id {kind}, text string")
        (row,) = decontaminate.find_leaks(docs, bench).collect()
        assert row.doc == 1 and (tuple(row.item) if isinstance(key, tuple) else row.item) == key


# --- chat formatting -------------------------------------------------------------------------------------------------


def test_texts_of_any_length_are_formatted(spark):
    long = F.expr("repeat('abcdefgh', 4000000)")
    rows = spark.range(1).select(F.lit(5).cast("long").alias("conv_id"), F.lit("assistant").alias("role"), F.concat(long, F.lit("</s>")).alias("text"), F.lit(0).alias("turn"))
    made = chat_format.records_of(rows)
    assert made.where("held IS NOT NULL").count() == 1
    out = chat_format.render(chat_format.to_turns(made, "record", held="held", strict=True)).withColumn("turns", chat_format.read_back(F.col("formatted")))
    r = out.select(F.size("turns").alias("n"), F.sha2(F.col("turns")[0]["text"], 256).alias("got"), F.length(F.col("turns")[0]["text"]).alias("size")).first()
    want = rows.select(F.sha2("text", 256)).first()[0]
    assert (r.n, r.got, r.size) == (1, want, 32_000_004)


def test_ids_and_layouts(spark):
    said = ['{"conv_id": "a", "prompt": "p", "response": "r"}', '{"conv_id": "b", "prompt": "q", "response": "s"}', '{"conv_id": 3, "prompt": "t", "response": "u"}', '{"conv_id": null, "prompt": "v", "response": "w"}', '{"what": 1}']
    df = spark.createDataFrame([(x,) for x in said], "j string").select(F.parse_json("j").alias("record"))
    turns = lambda **k: {(r.conv_id, r.text) for r in chat_format.to_turns(df, "record", **k).collect()}
    assert turns(key_type="string") == {("a", "p"), ("a", "r"), ("b", "q"), ("b", "s"), ("3", "t"), ("3", "u"), (None, "v"), (None, "w")}
    assert turns() == {(3, "t"), (3, "u"), (None, "v"), (None, "w")}
    assert chat_format.unmapped(df, "record").count() == 3 and chat_format.unmapped(df, "record", key_type="string").count() == 1
    with pytest.raises(Exception, match="no known layout"):
        chat_format.to_turns(df, "record", strict=True, key_type="string").collect()


# --- language ID -----------------------------------------------------------------------------------------------------


def test_signs_are_no_letters():
    model = lang_id.fit([(x, *lang_id.ngrams(t)) for x, t in (("en", "the house"), ("de", "das haus"), ("en", "and the cat"), ("de", "und die katze")) * 5])
    for text in ("½ ²", "①②③", "123 _ ...", "", " \n"):
        assert model.predict(text) == (lang_id.UNKNOWN, 0.0)
    for text in ("a", "½ é", "中", "ª"):
        assert model.predict(text)[0] in ("de", "en")


def plain_ftrl(rows, langs, order, idf, epochs, alpha, beta, l1, l2):
    """Per-coordinate FTRL-proximal, one row, class and feature at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    for _ in range(epochs):
        for i in order:
            lang, at, counts = rows[i]
            x = {int(b): float(c) * float(idf[b]) for b, c in zip(at, counts, strict=True)}
            norm = math.sqrt(sum(v * v for v in x.values()))
            x = {b: v / norm for b, v in x.items()} | {-1: 1.0}
            w = {(b, c): weight((b, c)) for b in x for c in range(len(langs))}
            logits = [sum(x[b] * w[b, c] for b in x) for c in range(len(langs))]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for c, name in enumerate(langs):
                error = e[c] / sum(e) - (name == lang)
                for b, v in x.items():
                    g, k = v * error, (b, c)
                    step = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                    z[k] += g - step * w[k]
                    n[k] += g * g
    return {k: weight(k) for k in list(z)}


def test_training_equals_the_plain_form():
    rng = random.Random(4)
    words = {"en": "the and of to in that was house".split(), "de": "der und die das ist nicht haus ein".split(), "fr": "le la les et une dans maison est".split()}
    rows = [(k, *lang_id.ngrams(" ".join(rng.choice(words[k]) for _ in range(rng.randint(3, 9))))) for k in words for _ in range(6)]
    model = lang_id.fit(rows, epochs=2)
    order = np.random.default_rng(7).permutation(len(rows)).tolist()
    want = plain_ftrl(rows, model.langs, order, model.idf, 2, 2.0, 1.0, 2e-3, 1e-3)
    got = {(b, c): float(model.weights[b, c]) for b in range(lang_id.BUCKETS) for c in range(3) if model.weights[b, c]}
    assert got.keys() == {k for k, v in want.items() if k[0] >= 0 and np.float32(v)}
    assert all(math.isclose(v, want[k], rel_tol=1e-4, abs_tol=1e-6) for k, v in got.items())
    assert all(math.isclose(float(model.bias[c]), want[-1, c], rel_tol=1e-4, abs_tol=1e-6) for c in range(3))


def test_only_the_most_frequent_languages_are_learnt(spark):
    rows = [(k, f"text number {k} of these", "l" + str(k % 3 if k < 60 else k)) for k in range(80)]
    model = lang_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), langs=3)
    assert model.langs == ["l0", "l1", "l2"]


# --- line ledger -----------------------------------------------------------------------------------------------------


def test_lines_that_a_ledger_never_saw_stay(spark):
    docs = spark.createDataFrame([(k, f"shared\nown {k}") for k in range(30)], "doc_id long, text string")
    ledger = line_dedup.LineLedger(spark, least=10).insert(docs)
    new = spark.createDataFrame([(k, "\n".join([f"unseen {k} {i}" for i in range(4000)] + [" SHARED\t"])) for k in range(100, 150)], "doc_id long, text string")
    for bound in (line_dedup.BOUND, 0):
        out = ledger.clean(new, bound=bound).select("doc_id", "n_lines", "n_dropped").collect()
        assert {(r.n_lines, r.n_dropped) for r in out} == {(4001, 1)} and len(out) == 50


def test_a_ledger_refuses_what_does_not_fit(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    ledger = line_dedup.LineLedger(spark, least=2).insert(make((1, "a\nb"), (1, "c"), (2, None), (None, "a"), (3, "")))
    before = {bytes(r.key): r.docs for r in ledger.counts.collect()}
    for bad in (make((1, "x")), make((None, "z"))):
        with pytest.raises(ValueError):
            ledger.insert(bad)
    for bad in (make((4, "a")), make((1, "a\nb")), make((2, "other"))):
        with pytest.raises(ValueError):
            ledger.delete(bad)
    assert {bytes(r.key): r.docs for r in ledger.counts.collect()} == before
    assert [r.text for r in ledger.clean(make((9, "A \nb\nc"))).collect()] == ["b\nc"]
    ledger.delete(make((1, "c"), (1, "a\nb"), (None, "a")))
    assert ledger.counts.count() == 0 and ledger.docs.count() == 2
    assert ledger.insert(make((1, "a"))).clean(make((9, "a")).limit(0)).count() == 0


# --- secrets ---------------------------------------------------------------------------------------------------------


def test_the_scan_stands_above_the_join(spark):
    """Patterns are asked of rows that have met an unseen blob, one of each, never of the table's own rows."""
    docs = spark.createDataFrame([(k, f"token = abcdefghijkl{k % 3}") for k in range(30)], "doc_id long, text string")
    _, todo, found = secret_scan.scan_unseen(docs, "doc_id", "text")
    assert todo.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [i for i, x in enumerate(plan) if re.search(r"\bJoin\b", x)]
    scans = [i for i, x in enumerate(plan) if "rlike" in x.lower()]
    # above the join, or a condition of it, which is asked of rows whose keys have met
    assert joins and scans and max(scans) <= min(joins)
    assert not [x for x in plan[min(joins) + 1 :] if "rlike" in x.lower()]


def test_blob_ledgers_take_odd_rows(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    ledger = secret_scan.BlobLedger(spark, str(tmp_path / "l"))
    ledger.add(make().limit(0), "path", "text")
    assert ledger.report().count() == 0
    ledger.add(make(("a", None), ("a", ""), ("a", None), (None, "AKIA" + "B" * 16), (None, "AKIA" + "B" * 16)), "path", "text")
    assert sorted((r.path or "", [x.kind for x in r.found]) for r in ledger.report().collect()) == [("", ["access"]), ("a", [])]
    assert ledger.scans().count() == 2 * len(secret_scan.RULES)


def test_no_table_that_grows_is_broadcast(spark):
    """Whatever Spark would broadcast: fingerprints, links and groups grow with the documents, so they stay with the executors."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        docs = spark.createDataFrame([(i, f"some words that text {i // 2} repeats and others do not {i // 2}") for i in range(40)], "doc_id long, text string")
        groups = simhash.simhash_groups(docs)
        links = components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"))
        for df in (groups, links):
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.component for r in groups.collect()} == set(range(0, 40, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- the driver's memory ---------------------------------------------------------------------------------------------


def test_keep_gives_back_what_the_drivers_jvm_freed_outside_its_heap(spark):
    if not trim(spark):
        pytest.skip("this JVM has no command to trim its native heap")
    jvm = spark._jvm
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    memory = field.get(None)
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup"

    def resident() -> float:
        with open(status) as f:
            return int(re.search(r"\nRss:\s+(\d+)", f.read())[1]) / 1024

    keep(spark.range(1), "warm")
    held = [memory.allocateMemory(1 << 16) for _ in range(3000)]
    for at in held:
        memory.setMemory(at, 1 << 16, 1)
    # every sixteenth block stays, so that malloc doesn't give the others back by itself
    for k, at in enumerate(held):
        if k % 16:
            memory.freeMemory(at)
    before = resident()
    keep(spark.range(1), "trimmed")
    after = resident()
    for at in held[::16]:
        memory.freeMemory(at)
    assert before - after > 80
