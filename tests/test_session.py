import datetime as dt
import json

import pytest

from palimpsest.session import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("engine")), clock=lambda: dt.datetime(2024, 5, 1, 12))
    kept = e.record([("user", "我决定用 Rust 写引擎"), ("agent", "好的"), ("agent", "建议先做索引"), ("user", "真开心，跑通了 search engine"), ("user", "放弃 Java")])
    assert kept == 4
    return e


def test_recent_and_search(engine):
    assert [r.sender for r in engine.recent(2).collect()] == ["user", "user"]
    first = engine.search("search engine").first()
    assert "search engine" in first.text and first.trust == 0.5
    engine.fact_feedback(first.msg_id, True)
    assert engine.search("search engine").first().trust == pytest.approx(0.55)
    assert engine.search("zzzz").count() == 0


def test_facts(engine):
    assert {(r.relation, r.other) for r in engine.thread("user").collect()} >= {("使用", "Rust"), ("放弃", "Java")}
    n = engine.table("triples").count()
    engine.record([("user", "又决定用 Rust 了")])
    assert engine.table("triples").where("object = 'Rust'").count() == 1
    assert engine.table("triples").count() >= n


def test_moods_drift_and_types(engine):
    assert engine.table("moods").where("mood = '开心'").count() == 1
    assert engine.offset().first().decisions >= 1
    assert engine.memory_stats().count() >= 1


def test_tasks(engine):
    engine.task_defer("call", "monday")
    engine.task_defer("pay", "friday")
    engine.task_done("call", "monday")
    assert [r.task for r in engine.tasks().collect()] == ["pay"]


def test_import_skips_what_is_there(engine, tmp_path):
    (tmp_path / "x.txt").write_text("放弃 Java\nnew line\n\n")
    assert engine.import_(str(tmp_path / "x.txt"), "plain") == 1
    assert engine.import_(str(tmp_path / "x.txt"), "plain") == 0
    with pytest.raises(ValueError, match="unknown format"):
        engine.import_("x", "zip")


def test_dejavu_soul_context_and_tools(engine, tmp_path):
    assert engine.dejavu("search engine").first().familiar == 1.0
    engine.soul_export(str(tmp_path / "soul"))
    n = engine.table("decisions").count()
    engine.soul_merge(str(tmp_path / "soul"))
    assert engine.table("decisions").count() == 2 * n
    assert "[drift]" in engine.context(100)
    got = json.loads(engine.call(json.dumps({"id": 1, "method": "recent", "params": {"n": 1}})))
    assert len(got["result"]) == 1
    assert "error" in json.loads(engine.call('{"id": 2, "method": "rm"}'))


def test_pages_and_further_tools(engine, tmp_path):
    ask = lambda **r: json.loads(engine.call(json.dumps({"id": 1, **r})))
    first = ask(method="recent", params={"n": 3}, page={"rows": 2})
    rest = ask(method="recent", params={"n": 3}, page={"start": first["next"], "rows": 2})
    assert len(first["result"]) == 2 and len(rest["result"]) == 1 and "next" not in rest
    n = engine.table("messages").count()
    assert ask(method="ping")["result"][0]["messages"] == n
    assert ask(method="thread_add", params={"subject": "x", "relation": "likes", "object": "y"})["result"][0]["object"] == "y"
    assert ask(method="fact_store", params={"action": "search", "query": "LIKES"})["result"][0]["subject"] == "x"
    assert len(ask(method="fact_store", params={"action": "probe", "entity": "y"})["result"]) == 1
    assert ask(method="semantic", params={"query": "search engine"})["result"][0]["rank"] == 1
    assert {r["mood"] for r in ask(method="echo")["result"]} >= {"开心"}
    assert ask(method="dream", params={"question": "用 Rust 还是 Java"})["result"][0]["rank"] == 1
    assert ask(method="fact_feedback", params={"msg_id": 1, "helpful": True})["result"]["done"] == "fact_feedback"
    assert {r["name"]: r["n"] for r in ask(method="migrate", params={"path": str(tmp_path / "copy")})["result"]}["messages"] == n
    with pytest.raises(ValueError, match="unknown action"):
        engine.fact_store("burn")


def test_vectors_move_hits_to_the_front(engine, spark):
    engine.record([("user", "parrot parrot speaks"), ("user", "a parrot sleeps all day long")])
    found = engine.search("parrot").collect()
    last = found[-1].msg_id
    front = spark.createDataFrame([(last, 0.9)], "msg_id long, vector_score double")
    assert engine.search("parrot", vectors=front).first().msg_id == last


def test_prefetch_and_sync(engine):
    n = engine.table("messages").count()
    assert engine.sync("the walrus swims at noon", "建议看看 walrus 的图") == 2
    assert engine.table("messages").count() == n + 2
    assert "walrus" in engine.prefetch("walrus").splitlines()[0]


def test_a_callers_own_route(engine, spark):
    """It finds what the built-in ones don't, and comes after them."""
    target = engine.table("messages").where("text like '%walrus swims%'").first().msg_id
    own = lambda e, query, k: e.table("messages").where("text like '%walrus swims%'").selectExpr("msg_id", "1 AS rank")
    assert engine.search("parrot sleeps", k=20).where(f"msg_id = {target}").count() == 0
    found = engine.search("parrot sleeps", k=20, routes=[own]).collect()
    assert target in {r.msg_id for r in found} and "parrot" in found[0].text
    engine.bump(engine.search("parrot sleeps", k=1))
    engine.bump(engine.search("parrot sleeps", k=1))
    assert [r.n for r in engine.retrievals().collect()] == [2]


def test_persona_and_rules_are_written(spark, tmp_path):
    now = [dt.datetime(2024, 5, 1)]
    e = Engine(spark, str(tmp_path), clock=lambda: now[0])
    assert e.rules().count() == 0 and e.persona().count() == 0
    e.record([("user", t) for t in ("I like dark tea, really", "I like dark tea, really", "I am a baker.", "I am a baker.", "running spark today")])
    assert not e.persona_maintain()
    assert e.persona_maintain(least=5) and not e.persona_maintain(least=0)  # a day has to pass
    assert {r.entry for r in e.persona().collect()} == {"偏好: dark tea, really", "角色: a baker"}
    e.record([("user", "I am a sailor."), ("user", "I am a sailor.")])
    now[0] = dt.datetime(2024, 5, 3)
    assert e.persona_maintain(least=2) and "角色: a sailor" in {r.entry for r in e.persona().collect()}
    assert {r.version for r in e.persona().collect()} == {2}
    e.rules_set(["test first", "be brief", " ", "x" * 300])
    e.rule_used("Be brief, please")
    assert [r.rule for r in e.rules().collect()] == ["be brief", "test first", "x" * 200]
    e.rules_set(["only one"])
    assert [r.rule for r in e.rules().collect()] == ["only one"]


def test_watch_tells_what_is_wrong(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "a"))
    e.record([("user", f"message number {i}") for i in range(30)])
    assert e.watch() == []
    e.migrate(str(tmp_path / "b"))
    copy = Engine(spark, str(tmp_path / "b"))
    assert e.watch(copy) == []
    copy.record([("user", "hi sky")])
    assert {x["table"] for x in e.watch(copy) if x["alarm"] == "differs"} == {"messages", "memories"}
    part = e.table("messages").where("msg_id <= 10")
    part.write.parquet(str(tmp_path / "a/messages/short"))
    e.commits.change(lambda s: {**s, "tables": {**s["tables"], "messages": [{"path": "messages/short", "level": 0}]}})
    assert {"table": "messages", "alarm": "shrunk", "rows": 20} in e.watch()
    e.append({"messages": spark.createDataFrame([(99, None, "user", "never indexed")], "msg_id long, ts timestamp_ntz, sender string, text string")})
    assert {"table": "messages", "alarm": "not indexed", "rows": 1} in e.watch()
    assert e.sync_index() == 1 and not [x for x in e.watch() if x["alarm"] == "not indexed"]
