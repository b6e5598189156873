"""Hot keys, rows alike and documents full of entities: how the work is dealt out, and that the results stay whole."""

import random

import pytest

from pyspark.sql import functions as F

from verdigris.functions.session import written
from verdigris.llm import chat_quotes, common, pii
from tests.llm.test_operators import frame


@pytest.fixture
def by_shuffle(spark):
    """Joins by shuffle alone, in as many partitions as asked for."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(rows):
    found = dict(rows.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return sorted(found.get(p, 0) for p in range(8))


def test_rows_alike_are_dealt_out_by_place(spark, by_shuffle):
    rows = written(spark.range(220_000).select(F.when(F.col("id") < 200_000, 0).otherwise(F.col("id")).alias("k")))
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    found = common.hub_join(rows, values, "k", 220_000, by_place=True)
    assert found.agg(F.count(F.lit(1)), F.sum("k"), F.sum("v")).first() == (220_000, sum(range(200_000, 220_000)), 2 * sum(range(200_000, 220_000)))
    dealt = sizes(common.hub_join(rows, values, "k", 220_000, by_place=True))
    assert dealt[-1] <= 3 * dealt[4] and sum(dealt) == 220_000


def test_keys_of_several_columns(spark):
    rows = [(i % 3, None if i % 5 == 0 else i % 5, i) for i in range(3000)]
    counts = {}
    for a, b, _ in rows:
        counts[a, b] = counts.get((a, b), 0) + 1
    values = spark.createDataFrame([(a, b, f"{a}.{b}", n) for (a, b), n in counts.items()], "a int, b int, v string, n long")
    found = common.hub_join(spark.createDataFrame(rows, "a int, b int, i int"), values, ["a", "b"], len(rows))
    assert sorted((r.a, r.b, r.i, r.v) for r in found.collect()) == sorted((a, b, i, f"{a}.{b}") for a, b, i in rows if b is not None)


def test_many_quotes_of_one_turn(spark, by_shuffle):
    said = "the first message of all that everyone quotes in full"
    rows = spark.range(20_001).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("user").alias("role"), F.when(F.col("id") == 0, said).otherwise(F.concat(F.lit(f"> {said}\nanswer "), F.col("id"))).alias("text"))
    found = {r.turn: r for r in chat_quotes.reply_ordered(rows).collect()}
    assert len(found) == 20_001 and found[0].reply_to is None
    assert all(r.reply_to == 0 and r.thread_turn == 0 and r.text == f"answer {t}" for t, r in found.items() if t)
    quoted = written(chat_quotes.quotes(chat_quotes.parsed(rows)))
    dealt = sizes(common.hub_join(quoted, quoted.groupBy("conv_id", "hash").agg(F.count(F.lit(1)).alias("n")), ["conv_id", "hash"], quoted.count(), by_place=True))
    assert dealt[-1] <= 3 * dealt[4] and sum(dealt) == 40_000


def directories(people, copies, seed):
    """Documents that all list the same people, each in an order of its own."""
    rng = random.Random(seed)
    lines = [f"name{i}x tower{i}y user{i}@corp{i}.org" for i in range(people)]
    return ["\n".join(rng.sample(lines, people)) for _ in range(copies)]


def test_directories_make_groups_not_pairs(spark):
    texts = directories(500, 4, 1) + [f"plain words of document {i}" for i in range(40)]
    found = pii.base_spans(frame(spark, texts))
    terms = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    told, entity_of, _ = pii.disclosing_groups(found, terms)
    groups = entity_of.select("of").distinct().count()
    assert entity_of.count() == 500 and groups < 20 and told.count() <= 2 * groups
    most = {r.term: r.share for r in pii.telling_terms(found, terms).collect()}
    brute = {r.term: r.share for r in pii.disclosing_terms(found, terms).groupBy("term").agg(F.max("share").alias("share")).collect()}
    assert most == brute and {f"name{i}x" for i in range(500)} <= most.keys() and "plain" not in most


def test_documents_of_many_pairs_are_dealt_out(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(x for i in range(25) if rng.random() < 0.7 for x in (f"word{i}q", f"u{i}@c{i}.org", "." * rng.randint(0, 50))) for _ in range(12)] + ["other text"] * 60
    found = pii.base_spans(frame(spark, texts))
    terms = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    whole = sorted(map(tuple, pii.disclosing_terms(found, terms).collect()))
    monkeypatch.setattr(pii, "PAIRS", 20)
    assert sorted(map(tuple, pii.disclosing_terms(found, terms).collect())) == whole and len(whole) > 25


def test_overlapping_spans_merge_under_the_first(spark):
    rng = random.Random(6)
    spans = {k: [(a, a + rng.randint(1, 9)) for a in rng.sample(range(3000), 150)] for k in pii.KINDS}
    schema = ", ".join(f"{k} array<struct<start:bigint,end:bigint>>" for k in pii.KINDS)
    rows = spark.createDataFrame([tuple(spans[k] for k in pii.KINDS), ([], [], [], [])], schema)
    want = []
    for a, b, mark in sorted((a, b, f"[{k.upper()}]") for k, x in spans.items() for a, b in x):
        if want and a < want[-1][1]:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b, mark])
    found = [[list(m) for m in r.merged] for r in rows.select(pii.merged_spans().alias("merged")).collect()]
    assert found == [want, []] and len(want) < 550


def test_marks_are_found_by_halving(spark):
    for n in (0, 1, 2, 3, 7, 8, 100):
        marks = [(f"t{2 * i:04}", f"m{i}") for i in range(n)]
        rows = spark.createDataFrame([(f"t{i:04}", marks) for i in range(-1, 2 * n + 2)], "term string, marks array<struct<term:string,mark:string>>")
        found = {r.term: r.mark for r in rows.select("term", pii.mark_of(F.col("term"), F.col("marks")).alias("mark")).collect()}
        assert {t: m for t, m in found.items() if m} == dict(marks) and len(found) == 2 * n + 3
