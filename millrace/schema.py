"""The engine's relations and how the plain tables map on to them.

The tables hold no social posts, so what they lack (names, cards, contexts, answers) is made by arithmetic on ids, which
any engine can repeat.  Texts of the tables are used whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.order import numbered
from millrace.settings import CATEGORIES

#: A phrase for each rule, in the order of the rules; then ordinary ones and a report.
PHRASES = (
    "周末约炮吗", "玩归玩别当真福利给你", "只入身体然后不入生活", "想看就戳主页", "本店出付费裸照", "有事加我微信", "老师带单包教", "体育投注首选", "速速转发给家人", "加我领取礼包",
    "作为语言模型我无法回答", "come to my onlyfans page", "DM me for menu tonight", "一句只走肾的话", "这里有资源分享", "隔壁的学生妹", "他是老司机", "我是真人哦", "新片 \U0001f51e 上线", "the full video is here",
    "a walk by the sea", "学术讨论欢迎参加", "民警提醒：只入身体不入生活是骗局", "t.me/somegroup and vx: abcd1234",
)
NAMES = ("Ann Lee", "xkcdqwrtpz", "约炮客服", "mira_k", "brtzklmn", "资源分享君")
SHORTS = ("", "ok", "嗯", "https://t.co/abcdefg", "nice one", "see https://t.co/x")
#: What replies say, with the class of each.
SAID: tuple[tuple[str, str | None], ...] = (
    ("生气", "anger"), ("太过分了", "anger"), ("so annoying", "anger"), ("哈哈哈哈", "joy"), ("太好了", "joy"), ("lol", "joy"), ("早上好", "greeting"), ("gm", "greeting"), ("祝大家新年快乐", "greeting"),
    ("我也认同", "support"), ("+1", "support"), ("i agree", "support"), ("不同意", "oppose"), ("反对反对", "oppose"), ("真难过", "sadness"), ("so sad", "sadness"), ("真好看", "praise"), ("这个活动好啊", "praise"),
    ("really beautiful", "praise"), ("好想去", "wish"), ("希望能中奖", "wish"), ("已三连", "participation"), ("都来参加", "participation"), ("\U0001f602\U0001f602", "emoji"), ("我不同意，因为数据是反过来的", None),
    ("第3天价格是多少", None), ("why should we agree", None), ("what a strange and rather long remark about nothing that anyone has said so far", None),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that few tasks read (one file, one row group), dealt to all cores; larger tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(values: tuple, n: Column) -> Column:
    """The value at ``n`` modulo their number."""
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline posts from documents; seq is the id, a minute apart."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    return d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("handle"), "text", "lang", F.lit("timeline").alias("context"), F.col("doc_id").alias("seq"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
    )


def full_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with all the fields of a timeline: every third text ends in a phrase of the rules, every tenth is a short one."""
    i = F.col("id")
    text = F.when(i % 10 == 1, pick(SHORTS, F.floor(i / 10))).when(i % 3 == 0, F.concat("text", F.lit(" "), pick(PHRASES, F.floor(i / 3)))).otherwise(F.col("text"))
    name = F.when(i % 20 == 1, "").when(i % 9 == 0, pick(NAMES, F.floor(i / 9))).otherwise(F.col("handle"))
    return posts(spark, sf_dir).select(
        "id", F.when(i % 20 == 1, "").otherwise(F.col("handle")).alias("handle"), text.alias("text"), name.alias("display_name"), "lang", "seq", "ts",
        F.when(i % 11 == 0, pick(PHRASES, F.floor(i / 11))).alias("card_text"), F.when(i % 13 == 0, "a photo of the sea").alias("alt_text"), F.when(i % 17 == 0, "as someone said").alias("quoted_text"),
        (i % 4 == 0).alias("has_media"), F.when(i % 4 == 0, i % 3).otherwise(0).alias("media_count"), pick(("timeline", "reply", "recommended"), i).alias("context"), (i % 41 == 0).alias("is_own"),
        (i % 37 == 0).alias("spam_section"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies from conversations: a conversation is a thread, turn 0 its root, every second later turn a short reply.

    Every tenth conversation has no thread, so its turns are posts of a feed.  ``place`` numbers all turns in order, ``short``
    tells the short replies from the tables' prose.
    """
    c = table(spark, sf_dir, "conversations")
    seq = (F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    said = (F.col("turn") > 0) & ((F.col("conv_id") + F.col("turn")) % 2 == 0)
    alone = F.col("conv_id") % 10 == 0
    rows = c.select(
        F.when(~alone, F.col("conv_id")).cast("long").alias("thread_id"), F.col("turn").cast("long").alias("turn"), seq.alias("seq"), seq.alias("id"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("handle"),
        F.when(said, pick(tuple(s for s, _ in SAID), F.col("conv_id") * 3 + F.col("turn"))).otherwise(F.col("text")).alias("text"), (F.col("turn") == 0).alias("thread_root"), said.alias("short"),
        F.when(alone, "timeline").otherwise("reply").alias("context"), F.when(seq % 5 != 0, pick(("ignore", "ignore", "hide", "ignore"), seq)).alias("band"),
    )
    return numbered(rows, "seq")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as they are observed: every fifth turn is the one two turns before, seen again with another text."""
    return replies(spark, sf_dir).withColumn("id", F.when(F.col("turn") % 5 == 4, F.col("seq") - 2).otherwise(F.col("seq")))


def reply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in a log with what follows: each is judged two observations later, and its band is known just after."""
    o = observations(spark, sf_dir)
    event = lambda kind, at, seen: o.select(at.alias("at"), F.lit(kind).alias("kind"), "seq", *((F.col(c) if seen or c == "band" else F.lit(None).cast(o.schema[c].dataType)).alias(c) for c in ("id", "thread_id", "handle", "text", "band")))
    place = F.col("place") * 10
    return event("observe", place, True).unionByName(event("ask", place + 23, False)).unionByName(event("decide", place + 25, False).where("band is not null"))


def answers(ids: DataFrame) -> DataFrame:
    """A deterministic stand-in for the decision model and the other signals, by arithmetic on the id."""
    i = F.col("id")
    lost = i % 12 == 5
    share = lambda k: (i * k % 101) / 100.0
    value = {"adult": share(37), "solicitation": share(53), "deceptive": share(71), "severity": (i * 13 % 31) / 10.0, "confidence": share(29)}
    return ids.withColumns(
        {k: F.when(lost, 0.0).otherwise(v) for k, v in value.items()}
        | {
            "category": F.when(lost, "other").otherwise(pick(tuple(CATEGORIES), F.floor(i / 7))),
            "junk": F.when(~lost & (i % 4 != 0), share(17)),
            "degraded": F.when(lost, "model_error"),
            "media_suspicious": i % 17 == 0,
            "media_blocked": i % 34 == 0,
            "vision_adult": F.when(i % 19 == 0, share(31)),
            "vision_confidence": F.when(i % 19 == 0, share(41)),
        }
    )
