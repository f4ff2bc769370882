"""Mood words from a versioned vocabulary table, found by an automaton in one pass over each text.

The vocabulary is a table (word, mood, version) that grows by what is learnt: the built-in words have version
0, a learnt one counts for messages from its version on. Its words are counted and measured, then sent to
all tasks, which build an Aho-Corasick automaton of them; a vocabulary beyond ``SENT_BYTES`` goes in
blocks, each a further pass over the batches in the same task, without a shuffle. So the time for a text
follows its length and its matches and not the number of words.

Defined cases: a null text has no mood; an empty vocabulary finds nothing; a message without a version
sees every word; words are compared in lower case, and of words that are equal then the one with the
smallest version counts for each mood; empty words and unknown moods are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon

#: Bytes of words in one automaton; nodes take some hundred bytes for each.
SENT_BYTES = 4 << 20
#: Characters before a happy word in which a negator takes it back.
REACH = 8
WORDS = "word string, mood string, version long"


def builtin(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w, mood, 0) for mood in lexicon.MOOD_ORDER for w in lexicon.MOODS[mood]], WORDS)


def learn(vocabulary: DataFrame, new: DataFrame) -> DataFrame:
    """The vocabulary with the words of ``new`` (word, mood, version) that it lacks for their mood; moods that aren't known are left out."""
    fresh = new.where(F.col("mood").isin(*lexicon.MOOD_ORDER) & (F.col("word") != "")).groupBy("word", "mood").agg(F.min("version").alias("version"))
    return vocabulary.unionByName(fresh.join(vocabulary, ["word", "mood"], "left_anti"))


def _blocks(vocabulary: DataFrame) -> list[list[tuple[str, int, int]]]:
    """(word, rank of its mood, version), in blocks of bounded size."""
    rank = F.coalesce(*[F.when(F.col("mood") == name, i) for i, name in enumerate(lexicon.MOOD_ORDER)])
    rows = vocabulary.select(F.lower("word").alias("word"), rank.cast("int").alias("rank"), "version").where("word <> '' and rank >= 0").groupBy("word", "rank").agg(F.min(F.coalesce("version", F.lit(0))).alias("version"))
    out, size = [[]], 0
    for r in rows.orderBy("word", "rank").toLocalIterator():
        if size > SENT_BYTES and out[-1][-1][0] != r["word"]:  # a word is in one block, with all its moods
            out, size = [*out, []], 0
        out[-1].append((r["word"], r["rank"], r["version"]))
        size += len(r["word"].encode())
    return out


def _automaton(words: list[tuple[str, int, int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, rank, version in words:
        held = a.get(word, None)
        a.add_word(word, (word, [*(held[1] if held else []), (rank, version)]))
    if words:
        a.make_automaton()
    return a


def _hits(a, text: str, version: int | None, happy: int, negators: list[str]) -> Iterator[tuple[int, str, int]]:
    """(rank, word, start) of each word's first occurrence, for the moods it tells from this version on."""
    seen = set()
    for end, (word, moods) in a.iter(text):
        if word in seen:
            continue
        seen.add(word)
        start = end + 1 - len(word)
        for rank, since in moods:
            if version is not None and since > version:
                continue
            if rank == happy and any(n in text[max(0, start - REACH) : start] for n in negators):
                continue
            yield rank, word, start


def moods(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``messages`` (text and, if there, version) with ``mood``, the first in the fixed order that a word tells, ``mood_word``, its longest such word (the first in the alphabet of equally long ones), and ``mood_words``, how many different words tell any."""
    happy, names, negators = lexicon.MOOD_ORDER.index(lexicon.HAPPY), lexicon.MOOD_ORDER, lexicon.NEGATORS
    versions = F.col("version").cast("long") if "version" in messages.columns else F.lit(None).cast("long")
    state = messages.withColumns({"_low": F.lower("text"), "_v": versions, "_rank": F.lit(None).cast("int"), "_word": F.lit(None).cast("string"), "_n": F.lit(0)})
    schema = state.schema
    for words in _blocks(vocabulary):
        if not words:
            continue

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            a = _automaton(words)
            for batch in batches:
                low, version, rank, word, n = (batch.column(schema.names.index(c)).to_pylist() for c in ("_low", "_v", "_rank", "_word", "_n"))
                for i, text in enumerate(low):
                    hits = list(_hits(a, text, version[i], happy, negators)) if text else []
                    if hits:
                        n[i] += len({w for _, w, _ in hits})
                        held = [] if rank[i] is None else [(rank[i], -len(word[i]), word[i])]
                        rank[i], _, word[i] = min([*held, *((r, -len(w), w) for r, w, _ in hits)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(rank, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int32())], schema.names)

        state = state.mapInArrow(run, schema)
    mood = F.coalesce(*[F.when(F.col("_rank") == i, name) for i, name in enumerate(names)], F.lit(""))
    return state.select(*messages.columns, mood.alias("mood"), F.coalesce("_word", F.lit("")).alias("mood_word"), F.col("_n").alias("mood_words"))


def tallies(messages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(msg_id, mood, n): how often each mood's words occur, each place counted once for the longest word from the left. The vocabulary has to fit one automaton."""
    blocks = _blocks(vocabulary)
    if len(blocks) > 1:
        raise ValueError(f"a vocabulary of more than {SENT_BYTES} bytes")
    names = lexicon.MOOD_ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _automaton(blocks[0])
        for batch in batches:
            out = []
            for i, text, version in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                counts: dict[int, int] = {}
                for _, (_, moods_) in a.iter_long(text) if text and blocks[0] else ():
                    for rank, since in moods_:
                        if version is None or since <= version:
                            counts[rank] = counts.get(rank, 0) + 1
                out += [(i, names[r], n) for r, n in sorted(counts.items())]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["msg_id", "mood", "n"])

    versions = F.col("version").cast("long") if "version" in messages.columns else F.lit(None).cast("long")
    return messages.select(F.col("msg_id").cast("long"), F.lower("text").alias("_low"), versions.alias("_v")).mapInArrow(run, "msg_id long, mood string, n long")
