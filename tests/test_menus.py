"""Labels of menus in many languages, and the sentences that only voice a feeling."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import emotion, menus

BLOCK = ["Block @spam", "\u202aBlock @x\u202c", "“Block”", "Bloquear a @ann", "Bloquer @x", "Bloccare", "Blocca @x", "Blockieren", "@x blockieren", "Blokkeren", "Blokkeer @x", "Blockera", "Bloker", "Zablokuj @x", "Engelle", "Blokir", "Chặn @x", "Заблокировать @x", "屏蔽 @x", "拉黑", "封鎖", "@x をブロック", "차단", "حظر @x", "บล็อก", "ब्लॉक करें", "Block @stop"]
MUTE = ["Mute @x", "Silenciar", "Silencia a @ann", "Silenzia", "Stummschalten", "Masquer @x", "Dempen", "Negeren", "Tysta", "Dæmp", "Wycisz @x", "Sessize al", "Bisukan", "Tắt tiếng @x", "Заглушить", "静音", "靜音", "ミュート", "음소거", "뮤트", "كتم", "ปิดเสียง", "म्यूट करें"]
NONE = [
    "Share with commuters", "Blockchain news", "Dejar de bloquear a @ann", "Wyłącz wyciszenie", "Unblock @x", "Unmute", "Desbloquear", "Débloquer @x", "Sblocca", "Blockierung aufheben", "Stummschaltung beenden", "Deblokkeren", "Avblockera", "Odblokuj",
    "Engeli kaldır", "Buka blokir", "Bỏ chặn @x", "Разблокировать", "Отменить заглушение", "取消屏蔽", "已屏蔽", "取消拉黑", "解除封鎖", "ブロックを解除", "ミュート解除", "차단 해제", "음소거 해제", "إلغاء الحظر", "เลิกบล็อก", "अनम्यूट करें", "म्यूट हटाएं",
    "Deixar de silenciar", "Deixa de silenciar", "Ne plus masquer", "Riattiva audio", "Dempen opheffen", "Bật tiếng", "Don't block", "Don’t mute", "Do not block @x", "Roadblock ahead", "Transmute", "Copy link", "", None, "Cancel mute", "Blocked accounts",
]


def test_labels(spark):
    rows = [(t, "block") for t in BLOCK] + [(t, "mute") for t in MUTE] + [(t, None) for t in NONE]
    got = spark.createDataFrame(rows, "label string, want string").withColumn("got", menus.menu_action(F.col("label"))).collect()
    assert [(r["label"], r["got"]) for r in got] == rows


FELT = [
    ("已三连！！！", "participation"), ("都来参加", "participation"), ("三连了，希望能中", "participation"), ("哇，参与啦，姐姐", "participation"), ("我要报名参加", "participation"), ("希望这次能中奖", "wish"), ("好事多磨，什么时候可以来一份", "wish"),
    ("我想参加，可是没有周边", "wish"), ("还差一份奖品", "wish"), ("姐姐真的想要一份周边", "wish"), ("这个活动好啊", "praise"), ("老师最好，最美！", "praise"), ("活动太好看了，周边我没抢到", None), ("直播太精彩了，节目也很用心", "praise"),
    ("中秋快乐心想事成", "greeting"), ("祝大家新年快乐", "greeting"), ("元宵快乐，我很喜欢今年的礼物", "greeting"), ("费用太高可以来一份", None), ("合约什么时候可以安排", None), ("今天天气最好", None), ("这个方案最好", None), ("第3天参加", None),
]


@pytest.mark.parametrize(("text", "want"), FELT)
def test_sentences(spark, text, want):
    assert spark.range(1).select(emotion.emotion(F.lit(text)).alias("c")).first()["c"] == want


def test_every_frame_is_met():
    assert len(emotion.TEMPLATES) == sum(map(len, emotion.FRAMES.values())) and [n for n in emotion.CLASSES if n in emotion.FRAMES] == list(emotion.FRAMES)
    names = {s.rstrip("?*+") for x in emotion.FRAMES.values() for f in x for s in f.split()}
    assert names - {"free", "最"} == set(emotion.SLOTS)
