"""Rule extractors over a session's messages: files, topics, decisions, questions, code, key exchanges, summaries.

``messages`` holds session_id, role, content, seq_num, created_at. Each text is looked at once (``features``); what it gives are
rows that can be merged: the first files, the heaviest topics and so on of all messages are those of the rows
of some messages and the rows of the others. No session's rows are gathered in Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkmill.functions import fixed_values as fixed
from talkmill.functions.text import collapse, segment, sentences
from talkmill.operators.search import meta_text
from talkmill.sources.shared import written

#: Any Han character.
HAN = "[\\x{3400}-\\x{9FFF}]"


def _by_session(*order):
    return Window.partitionBy("session_id").orderBy(*order)


def features(messages: DataFrame, *kinds: str) -> DataFrame:
    """Each message with what the extractors find in it, by ``kinds`` of paths, tokens, decided, asked, fences and talk; all of them if none is named."""
    text = F.col("content")
    known = {"paths": _paths(text), "tokens": segment(text, keep_singles=False), "decided": _decided(text), "asked": F.when(F.col("role") == "user", _asked(text)), "fences": F.regexp_count(text, F.lit("```")), "talk": _talk(text)}
    return messages.select("session_id", "seq_num", "role", "created_at", *[known[k].alias(k) for k in kinds or known])


def _paths(text: Column) -> Column:
    clean = lambda raw: F.regexp_replace(F.regexp_replace(raw, r"\\", "/"), "/+$", "")
    found = F.transform(F.regexp_extract_all(text, F.lit(fixed.PATH), F.lit(0)), lambda raw, i: F.struct(i.alias("i"), clean(raw).alias("file")))
    return F.filter(found, lambda x: F.length(x["file"]).between(4, 160) & ~x["file"].rlike(fixed.PATH_NOISE))


def file_rows(found: DataFrame) -> DataFrame:
    """(session_id, file, at): where a session first mentions a file."""
    each = found.select("session_id", "seq_num", F.inline("paths"))
    return each.groupBy("session_id", "file").agg(F.min(F.struct("seq_num", "i")).alias("at"))


def first_files(rows: DataFrame) -> DataFrame:
    once = rows.groupBy("session_id", "file").agg(F.min("at").alias("at"))
    placed = once.withColumn("place", F.row_number().over(_by_session("at", "file")))
    return placed.filter(F.col("place") <= fixed.MAX_FILES)


def files(messages: DataFrame) -> DataFrame:
    """(session_id, file, place): the first MAX_FILES distinct paths of a session, in order of mention."""
    return first_files(file_rows(features(messages, "paths"))).select("session_id", "file", "place")


def topic_rows(found: DataFrame) -> DataFrame:
    """(session_id, topic, weight, at): a user's tokens count twice."""
    each = found.select("session_id", "role", "seq_num", F.posexplode("tokens").alias("i", "topic"))
    each = each.filter((F.length("topic") >= 2) & ~F.col("topic").rlike(r"^\d+$") & ~F.col("topic").isin(*fixed.STOPWORDS))
    return each.groupBy("session_id", "topic").agg(F.sum(F.when(F.col("role") == "user", 2).otherwise(1)).alias("weight"), F.min(F.struct("seq_num", "i")).alias("at"))


def all_topics(rows: DataFrame) -> DataFrame:
    return rows.groupBy("session_id", "topic").agg(F.sum("weight").alias("weight"), F.min("at").alias("at"))


def heaviest(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(_by_session(F.desc("weight"), "at", "topic"))
    return rows.withColumn("place", place).filter(F.col("place") <= fixed.MAX_TOPICS)


def topics(messages: DataFrame) -> DataFrame:
    """(session_id, topic, weight, place): the MAX_TOPICS heaviest tokens; a user's count twice; ties to the first seen."""
    return heaviest(topic_rows(features(messages, "tokens"))).select("session_id", "topic", "weight", "place")


def _plausible(t: Column) -> Column:
    """Not a fragment: long enough, no half sentence, table row, bold mark, embedded JSON or unpaired bracket."""
    count = lambda p: F.regexp_count(t, F.lit(p))
    bad = [F.length(t) < 6, count(fixed.OPENING) != count(fixed.CLOSING), *[t.rlike(p) for p in fixed.FRAGMENTS]]
    return ~reduce(lambda a, b: a | b, bad)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shortened(text: Column) -> Column:
    """At most 90 characters, cut at the last pause if that is beyond the 40th; closing marks stripped."""

    def cut(t: Column) -> Column:
        back = F.reverse(F.substring(t, 1, 90))
        last = F.greatest(*[F.when(F.instr(back, p) > 0, F.lit(91) - F.instr(back, p)).otherwise(0) for p in fixed.PAUSES])
        return _let(last, lambda k: F.when(F.length(t) <= 90, t).when(k > 41, F.substring(t, F.lit(1), k - 1)).otherwise(F.substring(t, 1, 90)))

    return F.trim(F.regexp_replace(_let(text, cut), "[）)】」\"'、，]+$", ""))


def _sentences(text: Column) -> Column:
    return F.transform(sentences(text), lambda x, i: F.struct(i.alias("i"), x.alias("s")))


def _decided(text: Column) -> Column:
    """The decisions of a text, in order. Only sentences with a word of a decision, all of Han characters, are matched in full."""
    hinted = F.when(text.rlike(HAN), F.filter(_sentences(text), lambda x: x["s"].rlike(fixed.DECISION_HINT)))
    raw = lambda s: F.coalesce(*[F.nullif(F.regexp_extract(s, p, 0), F.lit("")) for p in fixed.DECISION_PATTERNS])
    told = F.transform(hinted, lambda x: F.struct(x["i"].alias("i"), _shortened(collapse(raw(x["s"]))).alias("text")))
    return F.filter(told, lambda x: x["text"].isNotNull() & _plausible(x["text"]))


def decision_rows(found: DataFrame) -> DataFrame:
    """(session_id, text, seq, i, at): all decisions."""
    return found.select("session_id", F.col("seq_num").alias("seq"), F.col("created_at").alias("at"), F.inline("decided")).select("session_id", "text", "seq", "i", "at")


def first_decisions(rows: DataFrame) -> DataFrame:
    start = Window.partitionBy("session_id", F.substring("text", 1, 20)).orderBy("seq", "i")
    first = rows.withColumn("_rn", F.row_number().over(start)).filter("_rn = 1").drop("_rn")
    return first.withColumn("place", F.row_number().over(_by_session("seq", "i"))).filter(F.col("place") <= fixed.MAX_DECISIONS)


def decisions(messages: DataFrame) -> DataFrame:
    """(session_id, text, seq, at, place): the first MAX_DECISIONS decisions; of equal first 20 characters the first."""
    return first_decisions(decision_rows(features(messages, "decided"))).select("session_id", "text", "seq", "at", "place")


def _asked(text: Column) -> Column:
    """The questions of a text, in order, and whether they say that they are open."""
    s = F.when(text.rlike("[？?]"), _sentences(text))
    fine = lambda s: s.rlike("[？?]") & (F.length(s) >= 8) & s.rlike(fixed.QUESTION_HINT)
    fragment = lambda s: reduce(lambda a, b: a | b, [s.rlike(p) for p in fixed.NO_QUESTION])
    kept = F.filter(s, lambda x: fine(x["s"]) & ~fragment(x["s"]))
    return F.transform(kept, lambda x: F.struct(x["i"].alias("i"), F.substring(collapse(x["s"]), 1, 90).alias("q"), x["s"].rlike(fixed.OPEN_HINT).alias("open")))


def question_rows(found: DataFrame) -> DataFrame:
    """(session_id, q, seq, i, at, idx, open): all questions; ``idx`` is the number of the session's messages before, of those at hand."""
    seen = found.withColumn("idx", F.row_number().over(_by_session("seq_num")) - 1).filter("role = 'user'")
    return seen.select("session_id", F.col("seq_num").alias("seq"), F.col("created_at").alias("at"), F.col("idx").cast("long").alias("idx"), F.inline("asked")).select("session_id", "q", "seq", "i", "at", "idx", "open")


def kept_questions(rows: DataFrame) -> DataFrame:
    """The first MAX_QUESTIONS, and then the first of each later message."""
    own = F.row_number().over(Window.partitionBy("session_id", "seq").orderBy("i"))
    placed = rows.withColumns({"place": F.row_number().over(_by_session("seq", "i")), "_own": own})
    return placed.filter((F.col("place") <= fixed.MAX_QUESTIONS) | (F.col("_own") == 1)).drop("_own")


def _with_openness(kept: DataFrame, counts: DataFrame) -> DataFrame:
    """Open are the questions of the last 30 % of a session's messages (session_id, n) and those that say so."""
    rows = kept.join(counts.select("session_id", "n"), "session_id")
    return rows.withColumn("unresolved", (F.col("idx") >= F.floor(F.col("n") * 0.7)) | F.col("open")).select("session_id", "q", "seq", "at", "unresolved", "place")


def questions(messages: DataFrame) -> DataFrame:
    """(session_id, q, seq, at, unresolved, place) of the users' questions."""
    found = features(messages, "asked")
    return _with_openness(kept_questions(question_rows(found)), found.groupBy("session_id").agg(F.count("*").alias("n")))


def code_blocks(messages: DataFrame) -> DataFrame:
    """(session_id, code_blocks): half the number of fences in all messages."""
    return features(messages, "fences").groupBy("session_id").agg(F.floor(F.coalesce(F.sum("fences"), F.lit(0)) / 2).cast("long").alias("code_blocks"))


def _talk(text: Column) -> Column:
    """What key exchanges take of a text: whether it decides, whether it asks, its length, and its words on one line."""
    decided = text.rlike(HAN) & text.rlike(fixed.DECISION_HINT) & reduce(lambda a, b: a | b, [text.rlike(p) for p in fixed.DECISION_PATTERNS])
    line = collapse(text)
    return F.struct(
        F.coalesce(decided, F.lit(False)).alias("decided"), F.coalesce(text.rlike("[？?]") & text.rlike(fixed.QUESTION_HINT), F.lit(False)).alias("asks"), (F.length(text) > 100).alias("long"),
        (F.length(F.trim(text)) >= 8).alias("enough"), F.length(line).alias("size"), line.rlike(fixed.INJECTED).alias("injected"), F.substring(line, 1, 200).alias("line"),
    )


def exchange_rows(found: DataFrame) -> DataFrame:
    """(session_id, user_text, ai_text, user_seq, reason, score, size) of all user messages with points, each with the next assistant message before another user message."""
    by = _by_session("seq_num")
    talk = found.filter("role in ('user', 'assistant')").select("session_id", "seq_num", "role", "talk")
    paired = talk.withColumns({"_role": F.lead("role").over(by), "_next": F.lead("talk").over(by)}).filter("role = 'user' and talk.enough")
    paired = paired.withColumn("ai", F.when(F.col("_role") == "assistant", F.col("_next")))
    decision, question, long = F.col("talk.decided") | F.coalesce("ai.decided", F.lit(False)), F.col("talk.asks"), F.col("talk.long")
    score = decision.cast("int") * 3 + question.cast("int") * 2 + long.cast("int")
    reason = F.when(decision, "含决策").when(question, "关键提问").when(long, "需求陈述")
    scored = paired.withColumns({"score": score, "reason": reason}).filter("score > 0 and not talk.injected")
    return scored.select("session_id", F.col("talk.line").alias("user_text"), F.coalesce("ai.line", F.lit("")).alias("ai_text"), F.col("seq_num").alias("user_seq"), "reason", "score", F.col("talk.size").alias("size"))


def best_exchanges(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(_by_session(F.desc("score"), F.desc("size"), "user_seq"))
    return rows.withColumn("place", place).filter(F.col("place") <= fixed.MAX_EXCHANGES)


def key_exchanges(messages: DataFrame) -> DataFrame:
    """(session_id, user_text, ai_text, user_seq, reason, score, place): the MAX_EXCHANGES best user messages with their answers.

    The answer is the next assistant message before another user message. Points: 3 for a decision in
    either, 2 for a question, 1 for more than 100 characters.
    """
    return best_exchanges(exchange_rows(features(messages, "talk"))).drop("size")


# --- what is known of a session, and what new messages add -------------------------------------


def state_of(found: DataFrame) -> dict[str, DataFrame]:
    """What can be merged of the ``features`` of some messages; ``tails`` is a session's last message of user or assistant, whose answer may be yet to come."""
    last = F.max(F.when(F.col("role").isin("user", "assistant"), F.struct("seq_num", "role", "created_at", "talk")))
    return {
        "files": first_files(file_rows(found)).drop("place"), "topics": topic_rows(found), "decisions": first_decisions(decision_rows(found)).drop("place"),
        "questions": kept_questions(question_rows(found)).drop("place"), "exchanges": best_exchanges(exchange_rows(found)).drop("place"),
        "counts": found.groupBy("session_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("fences"), F.lit(0)).alias("fences"), F.max("seq_num").alias("last_seq"), last.alias("tail")),
    }


def grown(state: dict[str, DataFrame], found: DataFrame) -> dict[str, DataFrame]:
    """The state after the ``features`` of new messages, all after those that their sessions had (``late_sessions`` names the others).

    Only the new messages are looked at, and the tail of their sessions, which a new answer may complete.
    """
    before = state["counts"].select("session_id", F.col("n").alias("_n"), "tail")
    tails = before.join(found.select("session_id").distinct(), "session_id", "left_semi").filter("tail is not null")
    tail_rows = tails.select("session_id", "tail.seq_num", "tail.role", "tail.created_at", "tail.talk")
    new = state_of(found)
    shifted = new["questions"].join(before.select("session_id", "_n"), "session_id", "left").withColumn("idx", F.col("idx") + F.coalesce("_n", F.lit(0))).drop("_n")
    paired = exchange_rows(found.select("session_id", "seq_num", "role", "created_at", "talk").unionByName(tail_rows))
    old = state["exchanges"].join(tail_rows.select("session_id", F.col("seq_num").alias("user_seq")), ["session_id", "user_seq"], "left_anti")
    counts = state["counts"].unionByName(new["counts"]).groupBy("session_id").agg(
        F.sum("n").alias("n"), F.sum("fences").alias("fences"), F.max("last_seq").alias("last_seq"), F.max_by("tail", F.when(F.col("tail").isNotNull(), F.col("tail.seq_num"))).alias("tail")
    )
    return {
        "files": first_files(state["files"].unionByName(new["files"])).drop("place"), "topics": all_topics(state["topics"].unionByName(new["topics"])),
        "decisions": first_decisions(state["decisions"].unionByName(new["decisions"])).drop("place"),
        "questions": kept_questions(state["questions"].unionByName(shifted)).drop("place"), "exchanges": best_exchanges(old.unionByName(paired)).drop("place"), "counts": counts,
    }


def late_sessions(state: dict[str, DataFrame], messages: DataFrame) -> DataFrame:
    """(session_id) of sessions with new messages that don't come after all they had: their state is made from all their messages."""
    first = messages.groupBy("session_id").agg(F.min("seq_num").alias("_first"))
    return state["counts"].join(first, "session_id").filter("_first <= last_seq").select("session_id")


def told(state: dict[str, DataFrame]) -> DataFrame:
    """(session_id, files_mentioned, topics, decisions, key_questions, code_changes): one row per session.

    Lists are bounded by the extractors' limits, but for questions, which hold one more for each later message.
    """
    ordered = lambda *fields: F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*fields).alias("x")))), lambda r: r["x"])
    names = lambda column: F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda r: r[column])
    parts = [
        first_files(state["files"]).groupBy("session_id").agg(names("file").alias("files_mentioned")),
        heaviest(state["topics"]).groupBy("session_id").agg(names("topic").alias("topics")),
        first_decisions(state["decisions"]).groupBy("session_id").agg(ordered("text", "seq", "at").alias("decisions")),
        _with_openness(kept_questions(state["questions"]), state["counts"]).groupBy("session_id").agg(ordered("q", "seq", "at", "unresolved").alias("key_questions")),
        best_exchanges(state["exchanges"]).groupBy("session_id").agg(ordered("user_text", "ai_text", "user_seq", "reason").alias("key_exchanges")),
    ]
    rows = state["counts"].select("session_id", F.floor(F.col("fences") / 2).cast("long").alias("code_blocks"))
    for p in parts:
        rows = rows.join(p, "session_id", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType)).alias(c)
    lists = [empty(c) for c in ("files_mentioned", "topics", "decisions", "key_questions")]
    return rows.select("session_id", *lists, F.struct("code_blocks", empty("key_exchanges")).alias("code_changes"))


def bundle(messages: DataFrame) -> DataFrame:
    """``told`` of all messages; each text is looked at once, what it gives is written down."""
    return told(state_of(written(features(messages), "features")))


def _summary(rows: DataFrame) -> Column:
    """Title, up to 5 decisions, up to 3 open questions, topics and a line of figures, from a session's lists."""
    some = F.transform(F.slice("decisions", 1, 5), lambda x, i: F.concat(i + 1, F.lit(") "), F.substring(x["text"], 1, 60)))
    unresolved = F.filter("key_questions", lambda x: x["unresolved"])
    open_ = F.transform(F.slice(unresolved, 1, 3), lambda x: F.substring(x["q"], 1, 50))
    lines = [
        F.coalesce("title", F.lit("（无标题）")),
        F.when(F.size("decisions") > 0, F.concat(F.lit("决策（"), F.size("decisions"), F.lit("）："), F.array_join(some, " "))),
        F.when(F.size(unresolved) > 0, F.concat(F.lit("未决（"), F.size(unresolved), F.lit("）："), F.array_join(open_, " / "))),
        F.when(F.size("topics") > 0, F.concat(F.lit("话题："), F.array_join("topics", "、"))),
        F.concat(
            F.lit("数据："), F.col("message_count"), F.lit(" 消息 · "), F.col("source"), F.lit(" · "), F.substring("created_at", 1, 10), F.lit(" → "),
            F.substring(F.coalesce("last_event_at", "created_at"), 1, 10),
        ),
    ]
    return F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), "\n")


def with_lists(sessions: DataFrame, lists: DataFrame) -> DataFrame:
    """``sessions`` with the lists that ``told`` gave, summary_rule and meta_text; tags stay searchable. Without messages the lists are empty."""
    names = lists.columns[1:]
    rows = sessions.drop(*names, "summary_rule", "meta_text").join(lists, "session_id", "left")
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.array().cast(lists.schema[c].dataType)) for c in names[:-1]})
    return rows.withColumn("summary_rule", _summary(rows)).withColumn("meta_text", meta_text(F.col("title"), F.col("topics"), F.col("decisions"), F.col("user_tags")))


def apply(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``with_lists`` of all their messages."""
    return with_lists(sessions, bundle(messages.join(sessions.select("session_id"), "session_id", "left_semi")))


def summaries(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, summary_rule)."""
    found = written(features(messages, "decided", "asked", "tokens"), "features")
    counts = found.groupBy("session_id").agg(F.count("*").alias("n"))
    listed = lambda rows, *fields: rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", *fields))))
    d = listed(first_decisions(decision_rows(found)), "text").toDF("session_id", "decisions")
    q = listed(_with_openness(kept_questions(question_rows(found)), counts), "q", "unresolved").toDF("session_id", "key_questions")
    t = listed(heaviest(topic_rows(found)), "topic").toDF("session_id", "topics")
    rows = sessions.select("session_id", "title", "message_count", "source", "created_at", "last_event_at")
    rows = rows.join(d, "session_id", "left").join(q, "session_id", "left").join(t, "session_id", "left")
    rows = rows.withColumn("topics", F.transform("topics", lambda x: x["topic"]))
    return rows.select("session_id", _summary(rows).alias("summary_rule"))


def refresh_decisions(known: DataFrame, messages: DataFrame) -> DataFrame:
    """Decisions of the messages after each session's last known decision that aren't known by text; (session_id, text, seq, at)."""
    marks = known.groupBy("session_id").agg(F.max("seq").alias("_mark"))
    later = _later(marks, messages)
    return decisions(later).drop("place").join(known.select("session_id", "text"), ["session_id", "text"], "left_anti")


def _later(marks: DataFrame, messages: DataFrame) -> DataFrame:
    """Messages after each session's ``_mark``; all where there is none."""
    return messages.join(marks, "session_id", "left").filter(F.col("_mark").isNull() | (F.col("seq_num") > F.col("_mark"))).drop("_mark")


def refresh_questions(known: DataFrame, marks: DataFrame, messages: DataFrame) -> DataFrame:
    """Questions of the messages after each session's mark (session_id, seq) whose first 40 characters no known question has."""
    start = F.substring("q", 1, 40).alias("_start")
    fresh = questions(_later(marks.select("session_id", F.col("seq").alias("_mark")), messages)).drop("place").withColumn("_start", F.substring("q", 1, 40))
    return fresh.join(known.select("session_id", start), ["session_id", "_start"], "left_anti").drop("_start")
