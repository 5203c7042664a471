from linkspark.llm import links


def test_a_chain_is_one_component_in_few_rounds(spark, monkeypatch):
    rounds = []
    written = links.written
    monkeypatch.setattr(links, "written", lambda df, label: rounds.append(label) or written(df, label))
    edges = [(i, i + 1) for i in range(200) if i != 150] + [(500, 501), (501, 502), (502, 500)]
    members = spark.createDataFrame([(i, i) for i in [*range(203), 500, 501, 502]], "id long, label long")
    keys = spark.createDataFrame([(x, f"{a}-{b}") for a, b in edges for x in (a, b)], "id long, key string")
    got = dict(links.components(members, keys).collect())
    assert all(got[i] == (0 if i <= 150 else 151) for i in range(201)) and got[202] == 202 and got[501] == got[502] == 500
    assert len(rounds) <= 2 * 16


def test_every_pair_of_a_hot_key_meets_once(spark):
    x = spark.createDataFrame([(i, "hot") for i in range(60)] + [(1, "cold")], "id long, key string")
    y = spark.createDataFrame([(i, "hot") for i in range(70)] + [(2, "cold")], "id long, key string")
    a, b = links.cells(x, y, "key", "id", 100)
    met = sorted((r.id, r.other) for r in a.join(b.withColumnRenamed("id", "other"), "key").collect())
    assert met == sorted([(i, k) for i in range(60) for k in range(70)] + [(1, 2)])
    assert a.groupBy("key").count().agg({"count": "max"}).first()[0] < 60


def test_empty(spark):
    none = spark.createDataFrame([], "id long, label long")
    assert links.components(none, spark.createDataFrame([], "id long, key string")).count() == 0
