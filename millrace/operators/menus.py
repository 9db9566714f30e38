"""Labels of menu entries in many languages: which action an entry stands for, and whom it names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import strip_invisible

#: What counts as part of a word, so that "commuters" doesn't mute and "blockchain" doesn't block.
_LETTER = r"[\p{L}\p{M}\p{N}]"
START, END = rf"(?<!{_LETTER})", rf"(?!{_LETTER})"
#: The platform's words for its actions.  Whole words; beginnings of words (endings follow the grammar); and
#: what is found anywhere, in scripts that don't part words or put them together.
WORDS = {"block": ("block",), "mute": ("mute",)}
STEMS = {
    "block": ("blockier", "bloque", "bloqui", "bloqua", "blocca", "blokker", "blokkeer", "blockera", "bloker", "zablok", "blokuj", "engelle", "blokir", "chặn", "заблок", "حظر", "ब्लॉक"),
    "mute": ("silenci", "silenzia", "stummschalt", "masquer", "dempen", "negeren", "tysta", "dæmp", "wycisz", "sessize", "bisukan", "tắt tiếng", "заглуш", "игнорир", "ігнор", "كتم", "म्यूट"),
}
INSIDE = {
    "block": ("屏蔽", "拉黑", "封锁", "封鎖", "ブロック", "차단", "บล็อก", "ปิดกั้น"),
    "mute": ("静音", "靜音", "隐藏", "隱藏", "ミュート", "음소거", "뮤트", "ปิดเสียง"),
}
#: Whatever takes an action back, leaves it off or only tells of it.  An entry with one of these is left alone: a click too few is
#: better than the opposite one.  Prefixes (un-, des-, dé-, od-, раз-, अन-) need no entry, as stems only count where words begin.
UNDO_WORDS = ("no", "not", "don't", "dont", "never", "stop", "off", "undo", "cancel", "disable", "remove", "end", "ne", "pas", "plus", "lever", "nicht", "niet", "nie", "inte", "ikke", "fjern", "ophæv", "buka", "bỏ", "bật", "hủy", "не", "batal", "değil", "लेकिन", "नहीं", "हटाएं", "हटाएँ", "blocked", "muted")
UNDO_STEMS = ("dej", "deix", "deja", "cess", "desactiv", "désactiv", "réactiv", "disattiv", "riattiv", "rimuov", "aufheb", "beend", "ophef", "wyłącz", "włącz", "cofnij", "kaldır", "aktifkan", "отмен", "снять", "убрать", "включ", "скасув", "إلغاء", "الغاء")
UNDO_INSIDE = ("取消", "解除", "消除", "已", "不", "别", "停止", "やめ", "しない", "해제", "취소", "เลิก", "ยกเลิก", "เปิดเสียง", "إلغاء")


def _listed(words: Sequence[str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _pattern(words: Sequence[str], stems: Sequence[str], inside: Sequence[str]) -> str:
    return f"{START}(?:{_listed(words)}){END}|{START}(?:{_listed(stems)})|(?:{_listed(inside)})"


def menu_action(label: Column) -> Column:
    """block, mute, or null: entries that undo or negate an action, or name none, are none."""
    # Names in the label are no part of what it says.
    text = F.regexp_replace(F.replace(F.lower(strip_invisible(label)), F.lit("\u2019"), F.lit("'")), "@[a-z0-9_]+", " ")
    found = F.when(text.rlike(_pattern(UNDO_WORDS, UNDO_STEMS, UNDO_INSIDE)), None)
    for action in ("block", "mute"):
        found = found.when(text.rlike(_pattern(WORDS[action], STEMS[action], INSIDE[action])), action)
    return found


def names_another(label: Column, handle: Column) -> Column:
    """Whether a label names accounts and the given one isn't among them."""
    named = F.transform(F.regexp_extract_all(label, F.lit(r"@([A-Za-z0-9_]{1,15})"), F.lit(1)), F.lower)
    return (F.size(named) > 0) & ~F.array_contains(named, F.lower(F.regexp_replace(handle, "^@+", "")))
