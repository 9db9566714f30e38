"""The rules of the pre-screen as data: for each intent phrases, pairs of phrases near each other, and bounded words.

Ids, classes, weights and flags are fixed values; the vocabulary is this library's own and can be replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

STRONG, WEAK = 3, 1
#: Edges of an English word, written so that every regular expression engine reads them alike.
LEFT, RIGHT = "(?:^|[^0-9a-z_])", "(?:$|[^0-9a-z_])"


def listed(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


@dataclass(frozen=True)
class Rule:
    """``phrases`` count anywhere, ``english`` between word edges, ``near`` as (one, other, characters between at most) in either order.

    ``forms`` are further patterns, each after a literal without which it can't match.
    """

    id: str
    weight: int
    phrases: tuple[str, ...] = ()
    english: tuple[str, ...] = ()
    near: tuple[tuple[tuple[str, ...], tuple[str, ...], int], ...] = ()
    forms: tuple[tuple[str, str], ...] = ()
    sexual: bool = False
    review_floor: bool = False

    @property
    def pattern(self) -> str:
        parts = [listed(self.phrases)] if self.phrases else []
        for one, other, gap in self.near:
            a, b = f"(?:{listed(one)})", f"(?:{listed(other)})"
            parts += [f"{a}.{{0,{gap}}}{b}", f"{b}.{{0,{gap}}}{a}"]
        if self.english:
            parts.append(f"{LEFT}(?:{listed(self.english)}){RIGHT}")
        return "|".join([*parts, *(form for _, form in self.forms)])

    @property
    def literals(self) -> tuple[str, ...]:
        """A text that holds none of these can't meet the rule."""
        return (*self.phrases, *self.english, *(w for one, _, _ in self.near for w in one), *(w for w, _ in self.forms))

    @property
    def chinese(self) -> bool:
        """Whether only a text with ideographs can meet the rule."""
        return not self.english and not self.forms


_BODY, _LIFE = ("只入身体", "只进身体", "只走肾"), ("不入生活", "不进生活", "不走心")
RULES = (
    Rule("zh_solicit_jiaofu", STRONG, ("约炮", "约啪", "约 啪", "外围女", "可上门过夜", "包夜多少", "援助交际", "陪睡", "全套上门"), ("yuepao", "fwb tonight"), sexual=True),
    Rule("zh_meme_fuli", STRONG, ("福利可不能开玩笑", "福利从不开玩笑"), near=((("玩归玩", "闹归闹"), ("给你发福利", "福利给你", "请你看福利"), 16),), sexual=True, review_floor=True),
    Rule("zh_body_euphemism", STRONG, near=((_BODY, _LIFE, 12),), sexual=True, review_floor=True),
    Rule("zh_profile_contact", STRONG, ("主页自取", "戳主页", "进主页看", "看我简介", "简介里有", "置顶自取", "翻我置顶"), ("link in bio", "check my profile", "see my pinned")),
    Rule("zh_premium_content", STRONG, ("付费裸照", "定制裸照", "裸聊", "色情视频", "成人影片", "黄片群", "福利姬", "看片群"), sexual=True),
    Rule("zh_contact", STRONG, ("加我微信", "加个微信", "加扣扣", "电报联系", "扫码进群", "扫描二维码加"), ("add my telegram", "add my wechat"), forms=(("t.me/", r"t\.me/[a-z0-9_+]"), ("vx", r"vx\s*[:：]\s*[a-z0-9_-]{4}"), ("微信", r"微信号?\s*[:：]\s*[a-z0-9_-]{4}"))),
    Rule("zh_scam_finance", STRONG, ("保本高收益", "包赚不赔", "日入过万", "老师带单", "一对一带单", "内部消息股", "代收usdt", "跑分赚钱"), ("guaranteed profit", "copy my trades")),
    Rule("zh_scam_gambling", STRONG, ("网上赌场", "真人荷官", "体育投注", "时时彩", "开奖计划", "首充返利", "棋牌上分"), ("online casino",)),
    Rule("zh_clickbait", STRONG, ("不看你会后悔", "马上就要被删", "趁没删快看", "百分之九十九的人不知道", "速速转发", "看完惊呆"), ("99% of people",)),
    Rule("zh_ad_traffic", STRONG, ("加我领取", "私信我领", "私我领取", "领券下单", "诚招代理", "代理加盟", "一件代发"), ("dm me to order", "dropshipping agents")),
    Rule("zh_slop_ai", STRONG, ("作为人工智能", "作为语言模型", "总的来说", "希望以上内容对你有帮助", "值得注意的是"), ("as an ai language model",)),
    Rule("en_nsfw", STRONG, english=("nsfw", "onlyfans", "fansly", "porn", "nudes", "naked pics", "adult video", "cam show", "sex tape", "erotic chat"), sexual=True),
    Rule("en_dm_menu", STRONG, english=("menu in bio", "paid content available"), near=((("dm me", "dm for", "message me", "text me", "snap me"), ("menu", "price list", "rates", "private content"), 16),)),
    Rule("zh_body_weak", WEAK, _BODY + _LIFE, sexual=True),
    Rule("zh_weak_resource", WEAK, ("资源分享", "看福利", "免费观看", "私密视频", "成人向")),
    Rule("zh_weak_teen", WEAK, ("学生妹", "女大学生", "嫩模", "空乘小姐姐", "车模")),
    Rule("zh_solicit_weak_slang", WEAK, ("处男", "处女", "老司机", "快餐价")),
    Rule("zh_anti_bot", WEAK, ("我不是人机", "我是真人", "非机器人")),
    Rule("emoji_adult", WEAK, forms=(("\U0001f51e", r"\x{1F51E}"),)),
    Rule("en_weak_18", WEAK, english=("uncensored", "full video", "private show"), forms=(("18+", LEFT + r"18\+"), ("explicit", "explicit"))),
)
#: Words of reports and advice: police, courts, schools, medicine, research, the press, fraud prevention.
NEWS = listed(("公安机关", "民警", "检察院", "审判", "警情", "严打", "反诈中心", "课堂", "门诊", "临床", "论文", "调查报道", "本报讯", "专家提醒"))
LINK_ONLY = r"^(?:https?://[^\s]+\s*)+$"
