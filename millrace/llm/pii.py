"""Personal data (operator 7): rule spans, further candidates, boosted trees and calibrated thresholds, in SQL functions only.

Base spans are the four rules of the contract.  High-recall generators for each kind then propose spans that the rules
miss: mail addresses with a spelled-out sign, addresses of hosts with guarded or spaced dots or in hexadecimal groups,
card numbers with other separators, phone numbers without a plus sign.  Proposals may overlap each other and the base.
Gradient-boosted trees, of each kind, score them from format and context.  Format is that of the plain form, in which spelled-out
signs and separators are undone, so the corpus itself labels the training candidates: a base span in its plain form is
a positive; a proposal of the wrong length, range or check digit, or a span of another kind, is a negative.  Features
are yes/no, so candidates are counted by feature pattern in Spark and the trees are fitted on those counts, which cover
the whole corpus.  Per kind, the lowest score with the wanted precision on the other half of the documents becomes the
threshold; a kind without enough examples of both sorts takes the score of that precision itself (``DEFAULT``).  Of
proposals that overlap the one with the best score stays.

Results: one row per row of the table; null and empty texts have no spans; repeated rows get equal results; other
columns are not read; offsets count code points.  Base spans always stay; added ones never overlap each other, and
overlap base spans only where they contain one of their own kind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import id_text, table

KINDS = ("email", "ip", "card", "phone")
#: The contract's rules.  Possessive repeats and the anchors at \G change no match; they keep long runs linear.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
MAY_HOLD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][0-9\x20-]{10}", "phone": r"\+[0-9]"}
#: Generators: what a span of a kind may look like at most.
_DOT = r"(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\{dot\})\x20?|\.)"
_AT = r"\x20?(?:\[at\]|\(at\)|\{at\}|@)\x20?"
LOOSE = {
    "email": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,5}}",
    "ip": rf"(?i)(?<![\p{{L}}\p{{N}}.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![\p{{L}}\p{{N}}])|(?<![\p{{L}}\p{{N}}:])(?:[0-9a-f]{{1,4}}:){{3,7}}[0-9a-f]{{1,4}}(?![\p{{L}}\p{{N}}:])",
    "card": r"(?<![\p{L}\p{N}.+])[0-9]{4}(?:[\x20._/\x{A0}-]{1,2}[0-9]{3,6}){2,4}(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}@:/.])\(?[0-9]{2,5}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,5}\)?){1,6}(?![\p{L}\p{N}@:/])",
}
MAY_PROPOSE = {
    "email": r"(?i)[\[({]at[\])}]|@", "ip": r"(?i)[0-9]\x20?[\[({](?:dot|\.)[\])}]|[0-9]\.[0-9]{1,3}\.|[0-9a-f]:[0-9a-f]{1,4}:", "card": r"[0-9]{4}[\x20._/\x{A0}-]{1,2}[0-9]{3}",
    "phone": r"[0-9][\x20.)-]{1,2}\(?[0-9]{2}",
}
ROUNDS, RATE, PRECISION, LEAST_EXAMPLES, CONTEXT = 24, 0.3, 0.98, 20, 40
#: Log-odds of the wanted precision: the threshold of a kind that can't be calibrated.
DEFAULT = float(np.log(PRECISION / (1 - PRECISION)))
SPAN = "array<struct<start:int,stop:int,value:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(number)
    doubled = F.transform(
        F.split(number, ""), lambda d, i: F.when((n - i) % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int"))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def found(text: Column, pattern: str, may: str) -> Column:
    """Spans of every match, left to right: the pieces between matches give the offsets."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["p"])
        stop = at + F.coalesce(F.length(x["v"]), F.lit(0))
        span = F.struct(at.alias("start"), stop.alias("stop"), x["v"].alias("value"))
        return F.struct(stop.alias("at"), F.when(x["v"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    return F.when(text.rlike(may), F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))
    n = F.length(digits(value))
    return F.when(n.between(12, 19), luhn(digits(value))).otherwise(False) if kind == "card" else n.between(9, 15)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, RULES[kind], MAY_HOLD[kind]), lambda s: _valid(kind, s["value"]))


def plain_form(kind: int, value: Column) -> Column:
    """A candidate with spelled-out signs written as signs; a card number without separators."""
    if kind == 0:
        at = F.regexp_replace(value, rf"(?i){_AT}", "@")
        return F.regexp_replace(at, rf"(?i){_DOT}", ".")
    if kind == 1:
        return F.regexp_replace(value, rf"(?i){_DOT}", ".")
    if kind == 2:
        return digits(value)
    return F.regexp_replace(value, r"^\+", "")


def _quad(v: Column) -> Column:
    parts = F.split(v, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("long").between(0, 255), F.lit(False)))


#: The yes/no features of a candidate, from its plain form and the words before it.
FEATURES = {
    "nine_to_eleven": lambda c: F.length(digits(c["value"])).between(9, 11),
    "twelve_to_fifteen": lambda c: F.length(digits(c["value"])).between(12, 15),
    "twelve_to_nineteen": lambda c: F.length(digits(c["value"])).between(12, 19),
    "check_digit": lambda c: F.when(F.length(digits(c["value"])).between(12, 19), luhn(digits(c["value"]))).otherwise(False),
    "parens": lambda c: c["value"].contains("("),
    "ends_three_four": lambda c: c["value"].rlike(r"[0-9]{3}[\x20.-][0-9]{4}$"),
    "four_bytes": lambda c: c["value"].rlike(r"^[0-9.]+$") & _quad(c["value"]),
    "hexadecimal": lambda c: c["value"].rlike(r"(?i)^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$"),
    "fours": lambda c: c["value"].rlike(r"^[0-9]{4}(?:[\x20.-][0-9]{4}){2,}"),
    "date": lambda c: c["value"].rlike(r"^(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}$|[-./](?:19|20)[0-9]{2}$"),
    "domain": lambda c: c["value"].rlike(r"(?i)@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"),
    "called": lambda c: c["before"].rlike(r"(?i)\b(?:call|phone|tel|mobile|fax|contact|text|whatsapp|e-?mail|reach|write|card|host|server)\b[^.!?]*$"),
    "numbered": lambda c: c["before"].rlike(r"(?i)\b(?:order|invoice|isbn|version|page|pages|vol|no|nr|id|total)\b\W*$"),
}
CANDIDATE = "array<struct<kind:int,start:int,stop:int,value:string,before:string>>"


def _as_candidates(text: Column, spans: Column, kind: int) -> Column:
    def one(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), plain_form(kind, s["value"]).alias("value"), before.alias("before"))

    return F.coalesce(F.transform(spans, one), F.array().cast(CANDIDATE))


def _meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def with_spans(docs: DataFrame) -> DataFrame:
    """doc columns, then a column of base spans and one of proposals (``loose_``) per kind, and ``base``: all base spans."""
    text = F.col("text")
    some = text.rlike("[0-9@]") | text.rlike(MAY_PROPOSE["email"])
    empty = F.array().cast(SPAN)
    out = docs.withColumns({k: F.when(some, base_spans(text, k)).otherwise(empty) for k in KINDS}).withColumn("base", F.concat(*KINDS))
    return out.withColumns({f"loose_{k}": F.when(some, found(text, LOOSE[k], MAY_PROPOSE[k])).otherwise(empty) for k in LOOSE})


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels for one kind: (feature, feature if no, feature if yes, four leaf values), and the threshold."""

    prior: float
    trees: tuple
    threshold: float

    def score(self, c: Column) -> Column:
        """Of a candidate; its features are worked out once."""
        names = list(FEATURES)

        def total(flags: Column) -> Column:
            f = lambda i: F.get(flags, F.lit(i))
            parts = [F.when(f(a), F.when(f(y), v[3]).otherwise(v[2])).otherwise(F.when(f(n), v[1]).otherwise(v[0])) for a, n, y, v in self.trees]
            return reduce(lambda s, p: s + p, parts, F.lit(self.prior))

        return F.get(F.transform(F.array(F.array(*(F.coalesce(FEATURES[n](c), F.lit(False)) for n in names))), total), F.lit(0))


def fit_trees(x: np.ndarray, positive: np.ndarray, total: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, tuple]:
    """Gradient boosting (logistic loss, Newton leaves) on feature patterns and their counts."""
    prior = float(np.log((positive.sum() + 0.5) / (total.sum() - positive.sum() + 0.5)))
    score, trees, n = np.full(len(x), prior), [], x.shape[1]

    def gain(g, h):
        return g * g / (h + 1.0)

    def best(rows, g, h):
        yes = x[rows]
        gy, hy = (g[rows, None] * yes).sum(0), (h[rows, None] * yes).sum(0)
        return int(np.argmax(gain(gy, hy) + gain(g[rows].sum() - gy, h[rows].sum() - hy)))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = positive - total * p, total * p * (1 - p)
        every = np.ones(len(x), bool)
        a = best(every, g, h)
        sides = [~x[:, a], x[:, a]]
        below = [best(s, g, h) if s.any() else 0 for s in sides]
        leaves = []
        for side, b in zip(sides, below):
            for part in (side & ~x[:, b], side & x[:, b]):
                v = rate * float(g[part].sum() / (h[part].sum() + 1.0))
                score[part] += v
                leaves.append(v)
        trees.append((a, below[0], below[1], tuple(leaves)))
    return prior, tuple(trees)


def evaluate(prior: float, trees: tuple, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), prior)
    for a, n, y, v in trees:
        out += np.where(x[:, a], np.where(x[:, y], v[3], v[2]), np.where(x[:, n], v[1], v[0]))
    return out


def threshold(score: np.ndarray, positive: np.ndarray, total: np.ndarray, precision: float) -> float:
    """The lowest score from which on the share of positives is at least ``precision``; ``DEFAULT`` without both sorts."""
    if positive.sum() < LEAST_EXAMPLES or (total - positive).sum() < 1:
        return DEFAULT
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(positive[order]) / np.maximum(np.cumsum(total[order]), 1)
    last = np.append(score[order][1:] != score[order][:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero((share >= precision) & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")


def fit_pii(docs: DataFrame, precision: float = PRECISION) -> tuple[Trees, ...]:
    """Counts training candidates of all documents by feature pattern; there are at most as many patterns as features allow, whatever the corpus."""
    text = F.col("text")
    spans = with_spans(docs.where(text.rlike("[0-9@]")))
    plain = lambda kind: lambda s: plain_form(kind, s["value"])
    wrong = {
        "email": lambda s: ~FEATURES["domain"](F.struct(plain(0)(s).alias("value"))),
        "ip": lambda s: plain(1)(s).rlike(r"^[0-9.]+$") & ~_quad(plain(1)(s)),
        "card": lambda s: ~_valid("card", s["value"]),
        "phone": lambda s: ~F.length(digits(s["value"])).between(9, 15),
    }
    yes = F.concat(*(_as_candidates(text, F.col(k), i) for i, k in enumerate(KINDS)))
    no = F.concat(*(_as_candidates(text, F.filter(f"loose_{k}", wrong[k]), i) for i, k in enumerate(KINDS)), *(_as_candidates(text, F.col(k), 3) for k in ("ip", "card")))

    def marked(candidates: Column, y: int) -> Column:
        return F.transform(candidates, lambda s: s.withField("y", F.lit(y)))

    labelled = F.concat(marked(yes, 1), marked(no, 0))
    rows = spans.select((F.abs(F.xxhash64("doc_id")) % 2).alias("fold"), F.explode(labelled).alias("c"))
    patterns = rows.select("fold", "c.kind", "c.y", *(f(F.col("c")).alias(n) for n, f in FEATURES.items()))
    counted = patterns.groupBy("fold", "kind", *FEATURES).agg(F.sum("y").alias("positive"), F.count("*").alias("total")).orderBy("fold", "kind", *FEATURES).toPandas()
    x = counted[list(FEATURES)].to_numpy(bool)
    positive, total = counted["positive"].to_numpy(float), counted["total"].to_numpy(float)
    train, kinds = counted["fold"].to_numpy() == 0, counted["kind"].to_numpy()
    out = []
    for k in range(len(KINDS)):
        fit, held = train & (kinds == k), ~train & (kinds == k)
        if not fit.any():  # nothing to learn from: no score reaches the threshold
            out.append(Trees(0.0, (), DEFAULT))
            continue
        prior, trees = fit_trees(x[fit], positive[fit], total[fit])
        out.append(Trees(prior, trees, threshold(evaluate(prior, trees, x[held]), positive[held], total[held], precision)))
    return tuple(out)


def find_pii(docs: DataFrame, models: tuple[Trees, ...]) -> DataFrame:
    """docs with ``base`` per kind columns and ``all_spans``: structs (start, kind, stop) in order."""
    spans = with_spans(docs)

    def keyed(column: Column, kind: int) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))

    base = F.array_sort(F.concat(*(keyed(F.col(k), i) for i, k in enumerate(KINDS))))
    out = spans.withColumn("base", base)

    def scored(i: int) -> Column:
        rows = F.transform(
            _as_candidates(F.col("text"), F.col(f"loose_{KINDS[i]}"), i),
            lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"), (models[i].score(c) - models[i].threshold).alias("score")),
        )
        return F.filter(rows, lambda c: c["score"] >= 0)

    out = out.withColumn("sure", F.concat(*map(scored, range(len(KINDS)))))
    # Beside the base, or around a base span of the same kind with none of another in the way.
    own = lambda c, o: (c["kind"] == o["kind"]) & (c["start"] <= o["start"]) & (c["stop"] >= o["stop"]) & (c["stop"] - c["start"] > o["stop"] - o["start"])
    free = F.filter("sure", lambda c: F.forall("base", lambda o: ~_meets(c, o) | own(c, o)))
    rank = lambda c: F.struct(c["score"], c["stop"] - c["start"], -c["kind"], -c["start"])
    kept = F.filter("free", lambda c: ~F.exists("free", lambda o: _meets(c, o) & (rank(o) > rank(c))))
    out = out.withColumn("free", free).withColumn("kept", kept)
    more = F.transform("kept", lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
    return out.withColumn("all_spans", F.array_sort(F.concat("base", more))).drop("sure", "free", "kept")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first speaks."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.when(fresh, F.concat(acc["out"], F.array(gap, F.element_at(names, s["kind"] + 1)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), parts.alias("out"))

    def finish(acc: Column) -> Column:
        return F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = id_text(table(spark, sf_dir, "documents"))
    return find_pii(docs, fit_pii(docs)).select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all_spans")).alias("spans"),
    )
