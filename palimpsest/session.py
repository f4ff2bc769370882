"""The public surface: one object over a folder of tables, whose methods return DataFrames.

Tables are Parquet folders that only grow; current state is read from them (latest rows, folds,
counts). A batch is written under random names and becomes visible, in all its tables at once, by one
commit; ids come from ranges that a commit has reserved. So writers side by side neither share an id nor
lose a row, a writer that fails leaves nothing to be seen, and a batch with a key counts once. Small
folders of a table are merged by levels. Errors are raised, not turned into empty results.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon, text
from .operators import analytics, blockmax, graph, log, memory, replica, retrieval, sketches, state
from .operators.folded import Folded, latest_rows
from .operators.index import Index
from .sources import readers
from .sources.commits import Commits
from .sources.shared import checkpoint

SCHEMAS = {
    "messages": "msg_id long, ts timestamp_ntz, sender string, text string",
    "feedback": "msg_id long, seq long, helpful boolean",
    "triples": "subject string, relation string, object string, source_id long, ts timestamp_ntz, id long",
    "decisions": "ts timestamp_ntz, event_id long, decision string, drift int, direction string, stage string, scene string",
    "moods": "ts timestamp_ntz, event_id long, mood string",
    "memories": "ts timestamp_ntz, content string, type string",
    "tasks": "seq long, task string, trigger string, note string, status string",
    "personas": "version int, entry string",
    "rules": "version long, pos int, rule string",
    "retrievals": "msg_id long, ts timestamp_ntz",
    "rule_uses": "rule string",
}


class Engine:
    #: Folders of a level that are merged to one of the next.
    FANOUT = 8
    #: Keys of batches that are remembered.
    KEYS = 10_000

    def __init__(self, spark: SparkSession, base: str, clock=dt.datetime.now) -> None:
        self.spark, self.base, self.clock = spark, base.rstrip("/"), clock
        self.commits = Commits(spark, f"{self.base}/commits")

    # ---- tables

    def _read(self, name: str, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.base}/{f['path']}" for f in folders])

    def table(self, name: str) -> DataFrame:
        """A table as of the latest commit; one that nothing was written to is empty."""
        return self._read(name, self.commits.latest()[1].get("tables", {}).get(name, []))

    def append(self, tables: dict[str, DataFrame], key: str | None = None) -> bool:
        """Adds rows to several tables at once; False, and without effect, if a batch of this ``key`` was added before."""
        if key is not None and key in self.commits.latest()[1].get("keys", []):
            return False
        new = {}
        for name, rows in tables.items():
            new[name] = {"path": f"{name}/{uuid.uuid4().hex}", "level": 0}
            rows.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.parquet(f"{self.base}/{new[name]['path']}")
        added = True

        def step(now: dict) -> dict | None:
            nonlocal added
            added = key is None or key not in now.get("keys", [])
            if not added:
                return None
            held = now.get("tables", {})
            keys = now.get("keys", []) if key is None else [*now.get("keys", []), key][-self.KEYS :]
            return {**now, "keys": keys, "tables": {**held, **{n: [*held.get(n, []), f] for n, f in new.items()}}}

        state_now = self.commits.change(step)
        if not added:
            for f in new.values():
                self.commits.remove(f"{self.base}/{f['path']}")
        for name in new:
            if sum(f["level"] == 0 for f in state_now["tables"][name]) >= self.FANOUT:
                self.compact(name)
        return added

    def compact(self, name: str) -> None:
        """Merges the folders of each full level of a table. The merged ones stay on disk for readers under way."""
        while True:
            done = True

            def step(now: dict) -> dict | None:
                nonlocal done
                folders = now.get("tables", {}).get(name, [])
                full = [x for x in sorted({f["level"] for f in folders}) if sum(f["level"] == x for f in folders) >= self.FANOUT]
                done = not full
                if done:
                    return None
                old = [f for f in folders if f["level"] == full[0]]
                made = {"path": f"{name}/{uuid.uuid4().hex}", "level": full[0] + 1}
                rows = self._read(name, old)
                files = -(-int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (128 << 20))
                rows.coalesce(max(files, 1)).write.parquet(f"{self.base}/{made['path']}")
                return {**now, "tables": {**now["tables"], name: [*(f for f in folders if f not in old), made]}}

            self.commits.change(step)
            if done:
                return

    def _rows(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, SCHEMAS[name])

    def reserve(self, name: str, n: int = 1) -> int:
        """The first of ``n`` numbers that no one else gets."""
        first = 1

        def step(now: dict) -> dict:
            nonlocal first
            first = now.get("next", {}).get(name, 1)
            return {**now, "next": {**now.get("next", {}), name: first + n}}

        self.commits.change(step)
        return first

    def _numbered(self, name: str, column: str, rows: DataFrame) -> DataFrame:
        """``rows``, written, with numbers of their own."""
        held = checkpoint(rows.withColumn(column, F.monotonically_increasing_id()))
        last = held.agg(F.max(column)).first()[0]
        return held.withColumn(column, F.col(column) + (self.reserve(name, last + 1) if last is not None else 0))

    # ---- writing

    def record(self, messages: list[tuple[str, str]], key: str | None = None) -> int:
        """Appends (sender, text) messages with all that ingestion derives, in one commit; returns how many were worth keeping."""
        now, start = self.clock().replace(microsecond=0), self.reserve("messages", len(messages))
        got = self._rows("messages", [(start + k, now, s, t) for k, (s, t) in enumerate(messages)])
        kept = checkpoint(log.valued(got).drop("info_value"))
        c, user = F.col("text"), kept.where("sender = 'user'")
        tables = {
            "messages": kept,
            "decisions": user.where(text.is_decision(c)).select("ts", F.col("msg_id").alias("event_id"), F.substring("text", 1, 200).alias("decision"), text.drift_score(c).alias("drift"), text.direction(c).alias("direction"), F.date_format("ts", "yyyy-MM").alias("stage"), F.lit(None).cast("string").alias("scene")),
            "moods": user.select("ts", F.col("msg_id").alias("event_id"), text.mood(c).alias("mood")).where("mood <> ''"),
            "memories": user.select("ts", F.substring("text", 1, 300).alias("content"), text.memory_type(c).alias("type")),
            "triples": self._new_triples(graph.extract(user, "user").join(user.select("msg_id", "ts"), "msg_id").withColumnRenamed("msg_id", "source_id")),
        }
        if not self.append(tables, key):
            return 0
        self.index().update(kept)
        return kept.count()

    def import_(self, path: str, kind: str) -> int:
        """Imports a log or chat export; messages that are there already (sender and text) are skipped."""
        new = readers.read_any(self.spark, path, kind)
        stamp = F.lit(self.clock().replace(microsecond=0).isoformat(" ")).cast("timestamp_ntz")
        new = new.withColumn("ts", F.coalesce("ts", stamp) if "ts" in new.columns else stamp).select("ts", "sender", "text").where("text is not null")
        numbered = self._numbered("messages", "msg_id", log.merge_new(self.table("messages"), new, ["sender", "text"]))
        self.append({"messages": numbered})
        self.index().update(numbered)
        return numbered.count()

    def export(self, path: str, month: str | None = None) -> None:
        readers.export_text(self.table("messages"), path, month)

    def _vectors(self) -> Folded:
        return Folded(self.spark, f"{self.base}/vectors", "msg_id long, seq long, embedding array<float>", latest_rows("msg_id", ["seq"]))

    def vectors_put(self, rows: DataFrame) -> None:
        """Adds embeddings (msg_id, embedding), each in place of the one that its message had."""
        self._vectors().add(rows.select(F.col("msg_id").cast("long").alias("msg_id"), F.lit(self.reserve("vectors")).cast("long").alias("seq"), F.col("embedding").cast("array<float>").alias("embedding")))

    def vectors(self) -> DataFrame:
        """(msg_id, embedding): the latest of each message."""
        return self._vectors().read().select("msg_id", "embedding")

    def fact_feedback(self, msg_id: int, helpful: bool) -> None:
        self.append({"feedback": self._rows("feedback", [(msg_id, self.reserve("feedback"), helpful)])})

    def _new_triples(self, triples: DataFrame) -> DataFrame:
        """Those of (subject, relation, object, source_id, ts) that the store lacks, numbered."""
        new = graph.insert_absent(self.table("triples"), triples)
        first = triples.groupBy(*graph.KEYS).agg(F.min("source_id").alias("source_id"), F.min("ts").alias("ts"))
        return self._numbered("triples", "id", new.join(first, graph.KEYS))

    def thread_add(self, triples: DataFrame) -> None:
        """Adds (subject, relation, object, source_id, ts) that the store lacks."""
        self.append({"triples": self._new_triples(triples)})

    def task_defer(self, task: str, trigger: str, note: str = "") -> None:
        self.append({"tasks": self._rows("tasks", [(self.reserve("tasks"), task, trigger, note, "pending")])})

    def task_done(self, task: str, trigger: str) -> None:
        self.append({"tasks": self._rows("tasks", [(self.reserve("tasks"), task, trigger, "", "done")])})

    # ---- reading

    def recent(self, n: int = 10) -> DataFrame:
        return log.recent(self.table("messages"), n)

    def index(self) -> Index:
        """The stored postings; writers bring them up to date, readers take them as they are."""
        return Index(self.spark, f"{self.base}/index")

    def sync_index(self) -> int:
        """Indexes all messages that aren't yet, such as those of a writer that ended before it could; returns how many."""
        return self.index().update(self.table("messages"))

    def _routes(self, query: str, k: int, index: Index) -> DataFrame:
        """(query_id, msg_id, route, rank) of the routes: all tokens, most tokens, TF-IDF, and named things by trust."""
        spark, c = self.spark, F.col("text")
        held = index.snapshot()
        question = spark.createDataFrame([(1, query)], "query_id int, text string")
        asked = retrieval.query_tokens(question, text.fts_tokens(c))
        ranked = lambda x, n: x.select("query_id", "msg_id", F.lit(n).alias("route"), "rank")
        scored = blockmax.bm25(held, asked, 3 * k)
        every = blockmax.match_all(held, asked).join(scored.select("query_id", "msg_id", "score"), ["query_id", "msg_id"], "left")
        every = retrieval.top(every, "query_id", [F.desc_nulls_last("score"), "msg_id"], 3 * k)
        trust = retrieval.trust_fold(self.table("feedback")).select("msg_id", "trust")
        names = question.select("query_id", F.explode(text.entities(c)).alias("token"))
        named = blockmax.count_match(held, names, 3 * k).join(trust, "msg_id", "left")
        named = retrieval.top(named.drop("rank"), "query_id", [F.desc("hits"), F.desc(F.coalesce("trust", F.lit(0.5))), "msg_id"], k)
        lists = [every, blockmax.count_match(held, asked, 3 * k), blockmax.tfidf_cosine(held, asked, 3 * k), named]
        out = ranked(scored, 5)
        for n, x in enumerate(lists, 1):
            out = out.unionAll(ranked(x, n))
        return retrieval.route(out)

    def search(self, query: str, k: int = 10, vectors: DataFrame | None = None, routes: list[Callable[[Engine, str, int], DataFrame]] = ()) -> DataFrame:
        """Hybrid search over the stored postings: the first route that finds a message wins, ranked by density times trust and by fingerprints.

        ``vectors`` (msg_id, vector_score) moves what it holds to the front. ``routes`` are a caller's own, called with
        the engine, the query and how many are wanted; each returns (msg_id, rank) and comes after the built-in
        ones, in the order given. Where no route finds anything, texts are scanned.
        """
        m = self.table("messages")
        found = self._routes(query, k, self.index())
        for n, own in enumerate(routes, 10):
            more = own(self, query, 3 * k).select(F.lit(1).alias("query_id"), F.col("msg_id").cast("long"), F.lit(n).alias("route"), F.col("rank").cast("int"))
            found = retrieval.route(found.select("query_id", "msg_id", "route", "rank").unionAll(more.where(F.col("rank") <= 3 * k)))
        hits = checkpoint(found.withColumnRenamed("rank", "route_rank"))  # a few rows
        found = hits.join(m, "msg_id")
        if not hits.limit(1).count():
            found = log.substring_scan(m, query).select("msg_id", F.lit(1).alias("query_id"), F.lit(6).alias("route"), F.lit(1).alias("route_rank"), "ts", "sender", "text")
        scored = retrieval.simhash_rerank(retrieval.density(found, query, retrieval.trust_fold(self.table("feedback"))), query)
        out = retrieval.top(scored, "query_id", [F.desc("score"), "route", "route_rank", "msg_id"], 3 * k)
        if vectors is not None:
            out = retrieval.promote(out, vectors).drop("rank", "vector_score").withColumnRenamed("new_rank", "rank")
        return out.where(F.col("rank") <= k).select("rank", "msg_id", "ts", "sender", "text", "density", "trust", "score").orderBy("rank")

    def bump(self, found: DataFrame) -> None:
        """Counts one more retrieval of each message of a search's result."""
        stamp = F.lit(self.clock().replace(microsecond=0).isoformat(" ")).cast("timestamp_ntz")
        self.append({"retrievals": found.select("msg_id", stamp.alias("ts"))})

    def retrievals(self) -> DataFrame:
        """(msg_id, n): how often each message was retrieved."""
        return self.table("retrievals").groupBy("msg_id").agg(F.count("*").alias("n"))

    def semantic(self, query: str, k: int = 10) -> DataFrame:
        """TF-IDF cosine over the stored postings."""
        index = self.index()
        asked = retrieval.query_tokens(self.spark.createDataFrame([(1, query)], "query_id int, text string"), text.fts_tokens(F.col("text")))
        return blockmax.tfidf_cosine(index, asked, k).join(self.table("messages"), "msg_id").select("rank", "msg_id", "ts", "sender", "text", "score").orderBy("rank")

    def dejavu(self, fragment: str) -> DataFrame:
        """How familiar a text's tokens are, by the filter over all that was said."""
        m, tokens = self.table("messages"), text.fts_tokens(F.col("text"))
        bits = sketches.bloom(m.select(F.explode(tokens).alias("token")).distinct(), "token")
        asked = self.spark.createDataFrame([(0, fragment)], "msg_id long, text string")
        return sketches.sense(asked, tokens, bits)

    def thread(self, entity: str, relation: str | None = None) -> DataFrame:
        return graph.neighbours(self.table("triples"), entity, relation)

    def thread_graph(self, entity: str) -> DataFrame:
        return graph.two_hops(self.table("triples"), entity)

    def thread_weave(self) -> DataFrame:
        return graph.summary(self.table("triples"))

    def thread_stats(self) -> DataFrame:
        return graph.stats(self.table("triples"))

    def facts_as_of(self, moment: str) -> DataFrame:
        return graph.as_of(graph.intervals(self.table("triples")), moment)

    def tasks(self, status: str = "pending") -> DataFrame:
        now = self.table("tasks").withColumn("id", state.task_id(F.col("task"), F.col("trigger")))
        return state.latest(now, "id", ["seq"]).where(F.col("status") == status)

    def offset(self, n: int = 50) -> DataFrame:
        return analytics.drift(self.table("decisions").withColumn("user_id", F.lit("user")), "user_id", n)

    def chart(self) -> DataFrame:
        g = self.table("decisions").groupBy("stage").agg(F.sum("drift").alias("drift"))
        return g.withColumn("bar", state.chart(F.col("drift")))

    def mood_entropy(self) -> DataFrame:
        return analytics.entropy(self.table("moods").withColumn("user_id", F.lit("user")), ["user_id"], "mood")

    def persona(self) -> DataFrame:
        p = self.table("personas")
        return p.where(F.col("version") == p.agg(F.max("version")).first()[0])

    def persona_build(self, last: int = 500, patterns: dict[str, list[str]] | None = None) -> int:
        """Writes a new version of the persona from what the ``last`` messages say of the speaker; returns the version."""
        found = analytics.persona(log.recent(self.table("messages"), last), patterns or lexicon.PERSONA)
        version = self.reserve("personas")
        self.append({"personas": found.select(F.lit(version).cast("int").alias("version"), F.concat_ws(": ", "category", "hit").alias("entry"))})
        now, n = self.clock().isoformat(), self.table("messages").count()
        self.commits.change(lambda held: {**held, "persona": {"version": version, "at": now, "messages": n}})
        return version

    def persona_maintain(self, least: int = 80, hours: int = 24, wild: float = 50.0) -> bool:
        """Rebuilds the persona if ``least`` messages have come since, ``hours`` have passed, and the drift of decisions deviates by less than ``wild``."""
        last = self.commits.latest()[1].get("persona")
        fresh = self.table("messages").count() - (last["messages"] if last else 0)
        if fresh < least or last and self.clock() - dt.datetime.fromisoformat(last["at"]) < dt.timedelta(hours=hours):
            return False
        spread = analytics.stability(self.table("decisions").withColumn("user_id", F.lit("user")), ["user_id"]).first()
        if spread is not None and spread["deviation"] >= wild:
            return False
        self.persona_build()
        return True

    def memory_stats(self) -> DataFrame:
        return self.table("memories").groupBy("type").agg(F.count("*").alias("n"))

    def rules_set(self, rules: list[str]) -> None:
        """Replaces the rules: at most five, of at most 200 characters."""
        version = self.reserve("rules")
        self.append({"rules": self._rows("rules", [(version, i, r.strip()[:200]) for i, r in enumerate([r for r in rules if r.strip()][:5])])})

    def _rules(self) -> DataFrame:
        held = self.table("rules")
        return held.where(F.col("version") == held.agg(F.max("version")).first()[0]).select("pos", "rule")

    def rule_used(self, words: str) -> None:
        """Counts a use of each rule that holds the words or is held by them."""
        rule, said = F.lower("rule"), F.lit(words.strip().lower())
        self.append({"rule_uses": self._rules().where((said != "") & (F.contains(rule, said) | F.contains(said, rule))).select("rule")})

    def rules(self, n: int = 5) -> DataFrame:
        return state.rank_rules(self._rules(), self.table("rule_uses"), n)

    def health(self) -> DataFrame:
        return state.health({name: self.table(name) for name in SCHEMAS})

    def watch(self, copy: Engine | None = None) -> list[dict]:
        """What is wrong, and where: tables that have shrunk below the most rows ever seen, messages without postings, and tables in which a copy differs, by how many leaves of the digests."""
        counts = {name: self.table(name).count() for name in SCHEMAS}
        seen = self.commits.latest()[1].get("seen", {})
        out = [{"table": name, "alarm": "shrunk", "rows": n} for name, n in replica.shrunk(counts, seen).items()]
        self.commits.change(lambda held: {**held, "seen": {name: max(n, held.get("seen", {}).get(name, 0)) for name, n in counts.items()}})
        held = self.index().snapshot()
        bare = self.table("messages").select("msg_id").join(held.ids(held.segments).select("msg_id"), "msg_id", "left_anti").count()
        if bare:
            out.append({"table": "messages", "alarm": "not indexed", "rows": bare})
        if copy is not None:
            for name, schema in SCHEMAS.items():
                key = schema.split()[0]
                month = F.date_format("ts", "yyyy-MM") if " ts " in f" {schema}".replace(",", " ") else F.lit("")
                apart = replica.leaves_apart(*(replica.digest(x.table(name), key, month) for x in (self, copy))).count()
                if apart:
                    out.append({"table": name, "alarm": "differs", "rows": apart})
        return out

    # ---- nightly and exchange

    def nightly(self, memories: DataFrame, now: str) -> DataFrame:
        """Forgetting for a day, then demotion of what is idle, of typed memories; the next day's table."""
        faded = memory.decay(memories, 24.0).withColumn("weight", F.col("new_weight")).drop("new_weight")
        aged = memory.age_and_demote(faded, now)
        return aged.where("fate <> 'archive'").withColumn("weight", F.col("new_weight")).drop("new_weight", "fate")

    def soul_export(self, path: str) -> None:
        """The last 50 decisions and 20 moods as JSON lines under ``path``."""
        last = lambda name, n: self.table(name).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
        last("decisions", 50).write.mode("overwrite").json(f"{path}/decisions")
        last("moods", 20).write.mode("overwrite").json(f"{path}/moods")

    def soul_merge(self, path: str, once: bool = False) -> bool:
        """Adds an export's rows; with ``once`` an export that was merged before, by its rows, has no effect."""
        tables = {name: self.spark.read.schema(SCHEMAS[name]).json(f"{path}/{name}") for name in ("decisions", "moods")}
        key = None
        if once:
            marks = [df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first() for df in tables.values()]
            key = "soul-" + "-".join(f"{n}:{mark}" for n, mark in marks)
        return self.append(tables, key)

    def context(self, budget: int, memories: DataFrame | None = None) -> str:
        """A block of text for a prompt: rules, latest drift, pending tasks, and memories that fit the budget."""
        lines = [f"[rule] {r.rule}" for r in self.rules().collect()]
        lines += [f"[drift] {r.drift} {r.majority}" for r in self.offset().collect()]
        lines += [f"[task] {r.task}" for r in self.tasks().orderBy("seq").limit(5).collect()]
        if memories is not None:
            order = memory.pack(memories, budget).join(memories.select("memory_id", "content"), "memory_id").orderBy("bucket", F.desc("weight"), "memory_id")
            lines += [f"{memory.LABELS[r.type]} {r.content}" for r in order.collect()]
        return "\n".join(lines)

    def prefetch(self, query: str, k: int = 5) -> str:
        """A block of text with the messages that a question brings up."""
        return "\n".join(f"[{r.ts:%Y-%m-%d}] {r.sender}: {r.text}" for r in self.search(query, k).collect())

    def sync(self, user: str, agent: str) -> int:
        """Records one exchange."""
        return self.record([("user", user), ("agent", agent)])

    # ---- further tools

    def ping(self) -> DataFrame:
        """The number of messages and the stage of the latest decision."""
        n = self.table("messages").agg(F.count("*").alias("messages"))
        return n.crossJoin(F.broadcast(self.table("decisions").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"))))

    def echo(self, n: int = 80) -> DataFrame:
        """The wind of the last ``n`` moods: which ones, and how often."""
        return self.table("moods").orderBy(F.desc("ts"), F.desc("event_id")).limit(n).groupBy("mood").agg(F.count("*").alias("n"))

    def dream(self, question: str, k: int = 5) -> DataFrame:
        """What was chosen when something like it was decided: the decisions nearest by shared tokens, and the direction of most of them."""
        c = F.col("text")
        d = self.table("decisions").select(F.col("event_id").alias("msg_id"), F.col("decision").alias("text"), "ts", "direction", "drift")
        asked = retrieval.query_tokens(self.spark.createDataFrame([(1, question)], "query_id int, text string"), text.fts_tokens(c))
        near = retrieval.count_match(retrieval.postings(d, text.fts_tokens(c)), asked, k).join(d, "msg_id")
        majority = near.groupBy("direction").agg(F.count("*").alias("_n")).agg(F.max_by("direction", F.struct("_n", "direction")).alias("majority"))
        other = F.when(F.col("majority") == "spend", "frugal").when(F.col("majority") == "frugal", "spend").otherwise("neutral")
        return near.crossJoin(F.broadcast(majority)).select("rank", "msg_id", "ts", "text", "direction", "drift", "majority", other.alias("instead")).orderBy("rank")

    def migrate(self, path: str) -> DataFrame:
        """Copies every table to ``path``; returns how many rows each has there."""
        copy = Engine(self.spark, path, self.clock)
        copy.append({name: self.table(name) for name in SCHEMAS})
        now = self.commits.latest()[1].get("next", {})
        copy.commits.change(lambda state: {**state, "next": now})
        counts = [copy.table(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in SCHEMAS]
        out = counts[0]
        for x in counts[1:]:
            out = out.unionAll(x)
        return out

    def fact_store(self, action: str, subject: str = "", relation: str = "", object: str = "", query: str = "", entity: str = "") -> DataFrame:
        """Adds a fact, searches facts by a part of any field, or lists those about an entity."""
        facts = self.table("triples")
        if action == "add":
            stamp = F.lit(self.clock().replace(microsecond=0).isoformat(" ")).cast("timestamp_ntz")
            self.thread_add(self.spark.createDataFrame([(subject, relation, object, None)], "subject string, relation string, object string, source_id long").withColumn("ts", stamp))
            return self.table("triples").where((F.col("subject") == subject) & (F.col("relation") == relation) & (F.col("object") == object))
        if action == "search":
            return facts.where(F.contains(F.lower(F.concat_ws(" ", "subject", "relation", "object")), F.lit(query.lower())))
        if action == "probe":
            return facts.where((F.col("subject") == entity) | (F.col("object") == entity))
        raise ValueError(f"unknown action {action!r}")

    # ---- a tool surface

    READERS = (
        "recent", "search", "semantic", "dejavu", "thread", "thread_graph", "thread_weave", "thread_stats", "tasks", "offset", "chart", "mood_entropy",
        "memory_stats", "rules", "retrievals", "health", "facts_as_of", "persona", "ping", "echo", "dream", "migrate", "fact_store",
    )
    #: Tools that write, and name what they have done.
    WRITERS = ("import_", "export", "soul_export", "soul_merge", "fact_feedback", "task_defer", "task_done", "sync_index", "persona_build", "persona_maintain", "rules_set", "rule_used", "watch")
    #: Tools whose rows come in an order of their own.
    ORDERED = ("recent", "search", "semantic", "dream", "rules")
    TOOLS = READERS + WRITERS + ("thread_add",)
    PAGE = 1000

    def call(self, request: str) -> str:
        """Answers one JSON-RPC request for a tool. Rows come in pages: ``page`` says from which row and how many, ``next`` where the next page starts."""
        r = json.loads(request)
        name, args, page = r.get("method"), r.get("params") or {}, r.get("page") or {}
        if name not in self.TOOLS:
            return json.dumps({"jsonrpc": "2.0", "id": r.get("id"), "error": {"code": -32601, "message": f"unknown tool {name!r}"}})
        answer: dict = {"jsonrpc": "2.0", "id": r.get("id")}
        if name == "thread_add":
            answer["result"] = [json.loads(x) for x in self.fact_store("add", **args).toJSON().collect()]
        elif name in self.WRITERS:
            answer["result"] = {"done": name, "value": getattr(self, name)(**args)}
        else:
            rows, start, n = getattr(self, name)(**args), int(page.get("start", 0)), int(page.get("rows", self.PAGE))
            if name not in self.ORDERED:
                rows = rows.orderBy(*rows.columns)  # pages need one order
            got = [json.loads(x) for x in rows.offset(start).limit(n + 1).toJSON().collect()]
            answer["result"] = got[:n]
            if len(got) > n:
                answer["next"] = start + n
        return json.dumps(answer, ensure_ascii=False)
