"""The pipeline's stages: what they take in, return and drop."""

import collections
import os
import re
import sys

import pytest
from conftest import DATA
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_limits import plain_tiles
from test_near_dup import brute_groups

import corpus_pipeline as P
from cairn.llm import lang_id, mixing
from cairn.llm.common import keep


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in P.STAGES:
        before, docs = docs, keep(stage(spark, docs, DATA), name)
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["language_id", "line_dedup", "simhash", "decontaminate", "mix"]
    for _, before, after in stages[:-1]:
        assert set(after.columns) == set(before.columns)


def test_clean_documents_stay(stages):
    name, before, after = stages[0]
    assert after.count() > 0.97 * before.where("text RLIKE '[A-Za-z]'").count()
    name, before, after = stages[1]
    assert after.count() == before.count()


def rows_of(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_language_stage_equals_the_plain_form(spark, stages):
    _, before, after = stages[0]
    model = lang_id.train(before, lang_id.fold() != 1)
    want = {}
    for d, r in rows_of(before).items():
        lang, score = model.predict(r["text"])
        if lang != lang_id.UNKNOWN and score >= P.LEAST_SCORE:
            want[d] = r
    assert rows_of(after) == want


def test_line_stage_equals_the_plain_form(stages):
    _, before, after = stages[1]
    rows = rows_of(before)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    counts = collections.Counter(k for r in rows.values() for k in {key(x) for x in r["text"].split("\n")})
    goes = {k for k, n in counts.items() if k and n >= 10}
    assert goes
    for r in rows.values():
        r["text"] = "\n".join(x for x in r["text"].split("\n") if key(x) not in goes)
        r["n_chars"] = len(r["text"])
    assert rows_of(after) == rows


def test_near_stage_equals_the_plain_form(stages):
    _, before, after = stages[2]
    rows = rows_of(before)
    groups = brute_groups({r["text"] for r in rows.values()})
    first = {}
    for d, r in sorted(rows.items()):
        first.setdefault(groups[r["text"]], d)
    assert rows_of(after) == {d: rows[d] for d in first.values()}
    assert len(first) < len(rows)


def test_decontamination_stage_equals_the_plain_form(spark, stages):
    _, before, after = stages[3]
    rows, cut = rows_of(before), re.compile(r"[^\W_]+")
    items = [cut.findall(r.text.lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r.text]
    seeds = collections.defaultdict(set)
    for k, item in enumerate(items):
        size = min(5, len(item))
        for i in range(len(item) - size + 1):
            seeds[tuple(item[i : i + size])].add(k)
    bad = set()
    for d, r in rows.items():
        words = cut.findall(r["text"].lower())
        near = {k for n in range(1, 6) for i in range(len(words) - n + 1) for k in seeds.get(tuple(words[i : i + n]), ())}
        for k in near:
            item, number = items[k], {}
            ids = [number.setdefault(x, len(number)) for x in items[k]]
            least = min(5, len(item))
            # only tokens in a common window can be in a run: others are taken out, with a gap
            own = [number.get(x, -1) for x in words]
            held = [False] * len(own)
            grams = {tuple(ids[i : i + least]) for i in range(len(ids) - least + 1)}
            for i in range(len(own) - least + 1):
                if tuple(own[i : i + least]) in grams:
                    held[i : i + least] = [True] * least
            short = []
            for x, h in zip(own, held, strict=True):
                if h or not short or short[-1] != -1:
                    short.append(x if h else -1)
            if sum(n for _, _, n in plain_tiles(short, ids, least)) >= 0.6 * len(item):
                bad.add(d)
    assert bad and rows_of(after) == {d: r for d, r in rows.items() if d not in bad}


def test_mixing_stage_equals_sql(stages, tmp_path):
    import duckdb

    _, before, after = stages[4]
    before.write.parquet(str(tmp_path / "in"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/in/*.parquet'")
    want = {r[0]: r[1:] for r in c.execute(mixing._oracle("SELECT doc_id, topic, n_tokens, round(prob, 6) FROM m WHERE u < prob")).fetchall()}
    assert {d: (r["topic"], r["n_tokens"], r["prob"]) for d, r in rows_of(after).items()} == want and want


def test_odd_rows_pass_every_stage(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").where("text IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(40)
    long = " ".join(f"the house {k} and the cat of that man" for k in range(20_000))
    odd = [(None, None, None, None, None), (-1, "", "en", None, 0), (-2, long, "en", "s", None), (-2, long, "en", "s", None), (-3, None, "xx", "s", 1), (-4, "½ ² ___", "en", "s", 3), (None, long + " end", None, "s", 5), (None, "the cat and the house of that man", None, None, 1)]
    docs = base.unionByName(base.limit(10)).unionByName(spark.createDataFrame(odd, base.schema)).withColumn("root", F.lit("own")).withColumn("mark", F.lit("own"))
    seen = {}
    for name, stage in P.STAGES:
        docs = keep(stage(spark, docs, DATA), "odd")
        seen[name] = docs.collect()
    ids = collections.Counter(r.doc_id for r in seen["simhash"])
    assert max(n for d, n in ids.items() if d is not None) == 1 and ids[-2] == 1
    assert -3 not in ids and -4 not in ids
    assert len(seen["line_dedup"]) == len(seen["language_id"]) >= 50


def test_run_gives_the_last_stage(spark, stages):
    a = {tuple(r) for r in P.run(spark, DATA).select("doc_id", "prob").collect()}
    assert a == {tuple(r) for r in stages[-1][2].select("doc_id", "prob").collect()}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = keep(stage(spark, docs, DATA), "none").select(*P.COLUMNS)
    assert docs.count() == 0
