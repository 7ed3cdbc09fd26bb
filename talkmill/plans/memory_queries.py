"""Queries of the kept index and of texts in Han characters, over rows of their own beside the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from talkmill.functions import text as X
from talkmill.operators import search
from talkmill.plans import kept, memory
from talkmill.plans.memory import MEMORY_SQL
from talkmill.plans.queries import QUERY, bm25_sql
from talkmill.plans.registry import query, table
from talkmill.sources.shared import shared_dir
from talkmill.streaming.lifecycle import lifecycle as lifecycle_stream

RANKED_SQL = "WITH " + bm25_sql("documents", "doc_id", "text", [["thing"], ["then"]]) + " SELECT doc_id, round(s0 + s1, 6) AS score FROM scored WHERE s0 + s1 IS NOT NULL ORDER BY s0 + s1 DESC, doc_id LIMIT 10"


@query("index_ranked", RANKED_SQL)
def index_ranked(spark, d):
    return kept.document_index(spark, d).view().rank(QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("index_statistics", r"""SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM documents) GROUP BY term""")
def index_statistics(spark, d):
    return kept.document_index(spark, d).view().statistics().withColumnRenamed("rows", "docs")


#: Conversations' messages with Han words, full-width letters and paths by their numbers.
HAN = ("数据库迁移到ＰｏｓｔｇｒｅＳＱＬ", "这个表按月分区，分区键是日期", "修改src/db/query.ts里的分页", "数据分析和库存管理", "登录用RS256签名")
HAN_SQL = MEMORY_SQL + ", han AS (SELECT session_id, seq_num, CASE (conv_id + seq_num) % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(HAN)) + " END AS content FROM messages)"


def _han(spark, d):
    texts = F.array(*[F.lit(t) for t in HAN])
    return memory.messages(spark, d).withColumn("content", F.element_at(texts, ((F.col("conv_id") + F.col("seq_num")) % 5 + 1).cast("int")))


def _han_hits_sql(fits: str) -> str:
    """How often a phrase of Han characters or path pieces stands in a text, of the five given ones."""
    return f"{HAN_SQL} SELECT session_id, seq_num, ({fits})::INT AS tf FROM han"


@query("han_phrase", _han_hits_sql("contains(content, '数据库')"))
def han_phrase(spark, d):
    m, _ = search.counted(_han(spark, d), "content", search.parse_query("数据库"))
    return m.select("session_id", "seq_num", F.col("_tf0").alias("tf"))


@query("han_and_path_units", f"{HAN_SQL} SELECT session_id, seq_num, contains(content, '分区')::INT + contains(content, '分区，分区')::INT AS a, contains(content, 'src/db')::INT AS b, contains(content, 'Ｐｏｓｔ')::INT AS c, CASE WHEN contains(content, 'Ｐｏ') THEN 7 WHEN contains(content, '分区') THEN 13 WHEN contains(content, 'src') THEN 10 WHEN contains(content, '库存') THEN 9 ELSE 6 END AS terms FROM han")
def han_and_path_units(spark, d):
    """A word twice in a text, a path's pieces side by side, full-width letters, and the number of terms."""
    m, _ = search.counted(_han(spark, d), "content", search.parse_query("分区 src/db ＰｏｓｔｇｒｅＳＱＬ"))
    return m.select("session_id", "seq_num", F.col("_tf0").alias("a"), F.col("_tf1").alias("b"), F.col("_tf2").alias("c"), F.col("_len").alias("terms"))


@query("han_segments", f"""{HAN_SQL} SELECT session_id, seq_num, CASE WHEN contains(content, 'Ｐｏ') THEN '数据 据库 库迁 迁移 移到 postgresql' WHEN contains(content, '分区') THEN '这个 个表 表按 按月 月分 分区 分区 区键 键是 是日 日期'
 WHEN contains(content, 'src') THEN '修改 src/db/query.ts 里的 的分 分页' WHEN contains(content, '库存') THEN '数据 据分 分析 析和 和库 库存 存管 管理' ELSE '登录 录用 rs256 签名' END AS tokens FROM han""")
def han_segments(spark, d):
    return _han(spark, d).select("session_id", "seq_num", F.array_join(X.segment(F.col("content"), keep_singles=False), " ").alias("tokens"))


@query("normalized", f"""{MEMORY_SQL} SELECT session_id, CASE conv_id % 2 WHEN 0 THEN 'café abc x' ELSE 'cafe abc x' END AS t FROM sessions""")
def normalized(spark, d):
    """Composed characters, full-width letters and spaces, runs of white space, upper case."""
    text = F.when(F.col("conv_id") % 2 == 0, F.lit("Café　ＡＢｃ \t\nX")).otherwise(F.lit("CAFE  ＡＢｃ　x"))
    return memory.sessions(spark, d).select("session_id", X.normalize(text, compose=True).alias("t"))


@query("meta_texts", f"{MEMORY_SQL} SELECT session_id, array_to_string(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), array_to_string(list_sort(topics), ' '), 'use a/b.ts ' || conv_id, CASE WHEN len(user_tags) > 0 AND user_tags[1] = 'sensitive' THEN 'sensitive' END, 'the end')), '[a-z0-9_][a-z0-9_./\\-]*'), ' ') AS t FROM sessions WHERE conv_id % 11 != 0 OR conv_id % 6 = 0")
def meta_texts(spark, d):
    s = memory.sessions(spark, d).filter("conv_id % 11 != 0 or conv_id % 6 = 0")
    decisions = F.array(F.struct(F.concat(F.lit("use a/b.ts "), "conv_id").alias("text")))
    return s.select("session_id", search.meta_text(F.col("title"), F.array_sort("topics"), decisions, F.col("user_tags"), F.lit("the end")).alias("t"))


# --- the lifecycle as a stream -----------------------------------------------------------------

#: Messages ever farther apart, hook events two minutes after some of them; timers run to an hour before the last of the earlier input.
STREAM_SQL = """WITH said AS (SELECT conv_id, turn + 1 AS n, conv_id % 30 * 1440 + (turn + 1) * (turn + 1) * 40 AS t FROM conversations),
ev AS (SELECT conv_id, t, 'NEW_LINE' AS event FROM said UNION ALL SELECT conv_id, t + 2, 'END_SIGNAL' FROM said WHERE conv_id % 3 = 0 AND n % 4 = 0),
w AS (SELECT least((SELECT max(t) FROM ev WHERE event = 'NEW_LINE'), (SELECT max(t) FROM ev WHERE event = 'END_SIGNAL')) - 60 AS w),
e AS (SELECT *, coalesce(lead(t) OVER (PARTITION BY conv_id ORDER BY t), w) AS until FROM ev, w),
c AS (SELECT conv_id, CASE event WHEN 'NEW_LINE' THEN 'active' ELSE 'pending_end' END AS state, event, t FROM e
 UNION ALL SELECT conv_id, 'pending_end', 'IDLE_TIMEOUT', t + 10 FROM e WHERE event = 'NEW_LINE' AND t + 10 < until
 UNION ALL SELECT conv_id, 'confirmed', 'COOLDOWN_ELAPSED', t + 370 FROM e WHERE event = 'NEW_LINE' AND t + 370 < until
 UNION ALL SELECT conv_id, 'confirmed', 'COOLDOWN_ELAPSED', t + 360 FROM e WHERE event = 'END_SIGNAL' AND t + 360 < until)
SELECT conv_id::VARCHAR AS session_id, state, event, 1704067200000 + t * 60000 AS at_ms, CASE WHEN event = 'COOLDOWN_ELAPSED' THEN 'extract' END AS work FROM c"""


@query("lifecycle_changes", STREAM_SQL)
def lifecycle_changes(spark, d):
    """All changes of state that the stream gives for a replay of the conversations with hook events."""
    # A pattern, as the table may be a file or a folder.
    path, where = f"{d}/conversations.parque[t]", f"{shared_dir(spark)}/talkmill/lifecycle-{uuid.uuid4().hex}"
    schema, n = table(spark, d, "conversations").schema, F.col("turn") + 1

    def read(minutes, event):
        at = F.expr("timestamp'2024-01-01'") + F.make_dt_interval((F.col("conv_id") % 30).cast("int"), F.lit(0), minutes.cast("int"))
        return spark.readStream.schema(schema).parquet(path).select(F.col("conv_id").cast("string").alias("session_id"), F.lit(event).alias("event"), at.alias("ts"), "conv_id", "turn")

    lines = read(n * n * 40, "NEW_LINE").drop("conv_id", "turn")
    hooks = read(n * n * 40 + 2, "END_SIGNAL").filter("conv_id % 3 = 0 and (turn + 1) % 4 = 0").drop("conv_id", "turn")
    changes = lifecycle_stream(lines, hooks=hooks).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check")
    changes.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/out")
