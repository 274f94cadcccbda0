"""Answers as of a time, and versions of an index."""

import datetime as dt
import random

import pytest

from fieldmill.sources import publishing, snapshots


def test_last_answer_equals_a_search(spark):
    rng = random.Random(1)
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    keys = ["hot"] * 20 + ["a", "b", None]
    answers = [(rng.choice(keys), at(rng.randrange(0, 4000)), i) for i in range(300)] + [("a", None, 900), ("hot", at(100), 901), ("hot", at(100), 902)]
    requests = [(i, rng.choice([*keys, "never"]), at(rng.randrange(0, 4000)) if rng.random() < 0.95 else None) for i in range(500)] + [(900, "hot", at(100)), (901, "hot", at(100))]
    r, a = spark.createDataFrame(requests, "request int, key string, t timestamp_ntz"), spark.createDataFrame(answers, "key string, t timestamp_ntz, answer_id int")
    found = {x["request"]: x for x in snapshots.as_of(r.repartition(5), a, "key", "t").collect()}
    assert len(found) == len(requests)
    seen = set()
    for i, key, t in requests:
        best = max(((u, n) for k, u, n in answers if key is not None and t is not None and k == key and u is not None and u <= t), default=None)
        x = found[i]
        assert (x["answer"]["answer_id"] if x["answer"] else None) == (best[1] if best else None)
        days = (t - best[0]) / dt.timedelta(days=1) if best else None
        assert x["state"] == ("missing" if best is None else "fresh" if days < 7 else "stale") and x["age_days"] == (None if best is None else int(days))
        assert x["note"] == {"fresh": None, "stale": f"from {x['age_days']} days ago", "missing": "no answer"}[x["state"]]
        seen.add(x["state"])
    assert seen == {"fresh", "stale", "missing"}
    assert snapshots.as_of(r, a.where("false"), "key", "t").where("state <> 'missing'").count() == 0
    assert snapshots.as_of(r.where("false"), a, "key", "t").count() == 0


def test_an_index_is_published_as_a_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|nothing is published"):
        publishing.load(spark, path)
    chunks = spark.range(10).selectExpr("id AS chunk", "concat('text ', id) AS text")
    graph = spark.range(10).selectExpr("9 - id AS chunk", "'concept' AS concept")
    first = publishing.publish({"chunks": chunks, "graph": graph}, {"chunks": "chunk", "graph": "chunk"}, path, {"model": "m1"})
    loaded = publishing.load(spark, path, ["chunks", "graph"], {"model": "m1"})
    assert loaded["chunks"].count() == 10 and publishing.current(spark, path)["version"] == first
    with pytest.raises(publishing.StaleIndex, match="model"):
        publishing.load(spark, path, expected={"model": "m2"})

    class Broken(Exception):
        pass

    def dies(*a, **k):
        raise Broken

    with monkeypatch.context() as m:  # after the tables are written, before the pointer is
        m.setattr(publishing, "id_digest", dies)
        with pytest.raises(Broken):
            publishing.publish({"chunks": chunks.limit(3)}, {"chunks": "chunk"}, path)
    assert publishing.current(spark, path)["version"] == first and publishing.load(spark, path)["chunks"].count() == 10
    second = publishing.publish({"chunks": chunks.union(chunks), "graph": graph.limit(9)}, {"chunks": "chunk", "graph": "chunk"}, path)
    assert publishing.current(spark, path)["version"] == second != first and publishing.load(spark, path)["chunks"].count() == 20
    with pytest.raises(publishing.StaleIndex, match="same ids"):
        publishing.load(spark, path, ["chunks", "graph"])


def test_digests_do_not_depend_on_order(spark):
    a = spark.range(1000).withColumnRenamed("id", "k")
    b = a.repartition(7).union(a.limit(5))
    x, y = publishing.id_digest(a, "k").first(), publishing.id_digest(b, "k").first()
    assert (x["ids"], x["digest"]) == (y["ids"], y["digest"]) and (x["rows"], y["rows"]) == (1000, 1005)
    assert publishing.id_digest(a.where("k <> 3"), "k").first()["digest"] != x["digest"]
    assert tuple(publishing.id_digest(a.where("false"), "k").first()) == (0, 0, 0)
