import pytest

from pagewright.operators import entities
from pagewright.plans import registry
from tests.same import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [10**6, 0])
def test_mentions(spark, monkeypatch, most):
    monkeypatch.setattr(entities, "MOST_NAMES", most)
    texts = [(1, 'New York, and "New York City". new york'), (2, "York - New, York, New - York"), (3, None), (4, ""), (5, "Acme (Acme) ACME Acme!"), (5, "Acme"), (6, "a b c " * 500 + "New York")]
    names = [("New York", "city"), ("New  York City!", "city"), ("York", "duke"), ("York", "city"), ("Acme", "firm"), ("Acme", "firm"), (None, "x"), ("--", "y")]
    got = {(r["doc_id"], r["entity"], r["kind"]): r["mentions"] for r in entities.mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(names, "name string, kind string")).collect()}
    assert got == {(1, "New York", "city"): 2, (1, "New York City", "city"): 1, (1, "York", "duke"): 2, (1, "York", "city"): 2, (2, "New York", "city"): 1, (2, "York", "duke"): 3, (2, "York", "city"): 3, (5, "Acme", "firm"): 4, (6, "New York", "city"): 1, (6, "York", "duke"): 1, (6, "York", "city"): 1}


def test_no_names(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert entities.mentions(docs, spark.createDataFrame([], "name string, kind string")).count() == 0


def test_small_dictionaries_are_sent(spark):
    docs, names = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("a", "x")], "name string, kind string")
    plan = entities.mentions(docs, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan


def exchanges(plan):
    """The shuffles of a plan, those above first."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return exchanges(plan.initialPlan())
    children = plan.children()
    below = [x for i in range(children.size()) for x in exchanges(children.apply(i))]
    return [plan, *below] if plan.nodeName() == "Exchange" else below


def test_texts_are_moved_once_whatever_the_tables_sizes(spark, monkeypatch):
    monkeypatch.setattr(entities, "MOST_NAMES", 0)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = registry.queries()["entity_gazetteer"](spark, SF)
        moved = exchanges(df._jdf.queryExecution().executedPlan())
        assert_same(df, connect(SF), registry.oracle_sql()["entity_gazetteer"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    kinds = [x.schema().simpleString() for x in moved]
    assert not [k for k in kinds if "array" in k], kinds  # words and runs stay in their row
    texts = [x for x, k in zip(moved, kinds, strict=True) if "text:" in k or "content:" in k]
    assert texts and all(x.sameResult(texts[0]) for x in texts), kinds  # equal shuffles are run once


def test_filter_keeps_all_names_and_few_others(spark, monkeypatch):
    monkeypatch.setattr(entities, "MOST_NAMES", 0)
    names = spark.range(20_000).selectExpr("concat('n', id, if(id % 3 = 0, ' x', '')) AS name", "'k' AS kind")
    docs = spark.range(200).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 199), i -> concat('n', id * 200 + i, if((id * 200 + i) % 3 = 0, ' x', '')))) AS text")
    known = entities.dictionary(names)
    shape = known.selectExpr("count(*) AS n", "array(1, 2) AS sizes").first()
    split = docs.selectExpr("doc_id", "split(text, ' ') AS w")
    assert 20_000 <= entities._sifted(split, known, shape).count() < 20_000 + 90_000 / 50
    assert entities.mentions(docs, names).count() == 20_000


def test_null_ids_and_rows_of_one_id(spark):
    parsed = spark.createDataFrame([(1, "Acme b", 2), (1, "c Bee", 2), (None, "Acme", 1), (2, "none", 1)], "doc_id long, text string, word_count int")
    names = spark.createDataFrame([("Acme", "x"), ("Bee", "y"), ("Bee", "z")], "name string, kind string")
    got = sorted(((r["doc_id"], r["entity_count"]) for r in entities.entity_scores(parsed, names).collect()), key=str)
    assert got == [(1, 2), (1, 2), (2, 0), (None, 0)]
