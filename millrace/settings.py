"""Settings as immutable values: a nested document is read by known names only, clamped, and made consistent."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

#: Switch groups, and for each category its group, whether posts of it may be hidden, and whether its authors may be acted on.
GROUPS = ("adult", "scam", "ad_spam", "clickbait", "low_quality", "farm")
CATEGORIES: dict[str, tuple[str | None, bool, bool]] = {
    "adult_porn": ("adult", True, True),
    "adult_solicitation": ("adult", True, True),
    "scam": ("scam", True, True),
    "ad_spam": ("ad_spam", True, True),
    "clickbait": ("clickbait", True, False),
    "low_quality": ("low_quality", True, False),
    "suggestive_bait": ("adult", True, False),
    "ordinary": (None, False, False),
    "other": (None, False, False),
}


@dataclass(frozen=True)
class Thresholds:
    """Where the bands begin."""

    block: float = 0.90
    block_confidence: float = 0.70
    block_severity: float = 2.0
    deceptive: float = 0.85
    dual: float = 0.80
    dual_confidence: float = 0.95
    hide_confidence: float = 0.45
    hide_severity: float = 2.0
    review_confidence: float = 0.30
    junk_review: float = 0.65
    junk_escalate: float = 0.75
    farm_least: float = 0.40


@dataclass(frozen=True)
class Actions:
    auto_block: bool = True
    auto_mute: bool = False
    mute_on_hide: bool = True
    dry_run: bool = False


@dataclass(frozen=True)
class Folding:
    """Fixed values of the folds, and their switches."""

    enabled: bool = True
    emotion: bool = True
    beta: bool = True
    alpha: bool = True
    fold_in_replies: bool = True
    fold_in_feed: bool = True
    alpha_only_in_replies: bool = True
    mode: str = "fold"
    window: int = 60
    candidates: int = 6
    similar: float = 0.45
    similar_in_thread: float = 0.30
    paraphrase: float = 0.60
    confirm: float = 0.70
    median: float = 0.50
    least_references: int = 3
    most_references: int = 12


@dataclass(frozen=True)
class Settings:
    off: tuple[str, ...] = ()
    thresholds: Thresholds = field(default_factory=Thresholds)
    actions: Actions = field(default_factory=Actions)
    folding: Folding = field(default_factory=Folding)

    def on(self, group: str | None) -> bool:
        return group is not None and group not in self.off

    @property
    def any_on(self) -> bool:
        return any(self.on(g) for g in GROUPS)


def _merged(default: Any, given: Any) -> Any:
    """``default`` with the known names of ``given``; numbers are clamped to 0 and up, shares to 1."""
    if is_dataclass(default):
        known = {f.name: _merged(getattr(default, f.name), given[f.name]) for f in fields(default) if isinstance(given, Mapping) and f.name in given}
        return replace(default, **known)
    if isinstance(default, bool):
        return given if isinstance(given, bool) else default
    if isinstance(default, (int, float)):
        if isinstance(given, bool) or not isinstance(given, (int, float)) or given != given:
            return default
        value = min(max(given, 0), 1.0) if isinstance(default, float) and default <= 1 else max(given, 0)
        return int(value) if isinstance(default, int) else float(value)
    if isinstance(default, tuple):
        return tuple(str(x) for x in given) if isinstance(given, (list, tuple)) else default
    return given if isinstance(given, type(default)) else default


def read_settings(document: Mapping[str, Any]) -> Settings:
    """Settings from a nested document.  What is stricter may not come before what is milder: hiding never asks more than blocking."""
    out: Settings = _merged(Settings(), document)
    t = out.thresholds
    t = replace(
        t,
        hide_confidence=min(t.hide_confidence, t.block_confidence),
        review_confidence=min(t.review_confidence, t.hide_confidence, t.block_confidence),
        hide_severity=min(t.hide_severity, t.block_severity),
        junk_escalate=max(t.junk_escalate, t.junk_review),
        dual=min(t.dual, t.block),
    )
    f = replace(out.folding, mode=out.folding.mode if out.folding.mode in ("fold", "hide") else "fold")
    return replace(out, thresholds=t, folding=f, off=tuple(g for g in out.off if g in GROUPS))
