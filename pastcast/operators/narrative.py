"""Narrative events in texts, and vectors that describe them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Word families in the order in which they are tried, modifiers and their strength.
FAMILIES = [
    ("crash", ["crashed", "crash", "plummeted", "plummeting", "plummet", "collapsed", "collapse", "tanked", "tank", "cratered", "crater", "nosedived", "nosedive", "free-fell", "free-fall", "sell-off", "selloff"]),
    ("spike", ["spiked", "spike", "surged", "surge", "skyrocketed", "skyrocket", "exploded", "explosion", "shot up", "jumped"]),
    ("rally", ["rallied", "rally", "rose", "climbed", "climb", "gained", "advanced", "advance", "recovered", "recovery", "bounced", "bounce", "soared", "soar"]),
    ("breakout", ["broke out", "breakout", "break out", "breached", "breach", "exceeded", "broke above", "broke below", "broke through"]),
    ("reversal", ["reversed", "reversal", "reverse", "turned around", "turnaround", "pivoted", "pivot", "flipped", "flip", "u-turn", "about-face"]),
    ("mean_reversion", ["mean-reverted", "mean reversion", "mean-reversion", "reverted to mean", "returned to average", "normalized", "normalize", "regressed to mean", "pulled back to", "snapped back"]),
    ("consolidation", ["consolidated", "consolidation", "consolidate", "flat", "flatlined", "range-bound", "rangebound", "sideways", "choppy", "stagnated", "stagnant", "traded in a range", "drifted sideways"]),
    ("drift", ["drifted", "drift", "drifting", "meandered", "meander", "crept", "creep", "edged", "inched", "eased", "slid slowly", "grinded"]),
]
INTENSITY = {
    "slightly": 0.3, "slight": 0.3, "marginally": 0.3, "modestly": 0.3, "mildly": 0.3, "gently": 0.3, "a bit": 0.3, "a little": 0.3, "somewhat": 0.35, "moderately": 0.5, "steadily": 0.5,
    "sharply": 0.8, "significantly": 0.7, "heavily": 0.8, "substantially": 0.7, "considerably": 0.7, "aggressively": 0.8, "brutally": 0.9, "violently": 0.9, "massively": 0.9,
    "dramatically": 0.8, "severely": 0.85, "catastrophically": 1.0, "completely": 1.0, "totally": 0.95, "historically": 0.9, "unprecedented": 0.95,
}
SHARPNESS = {"suddenly": 0.9, "abruptly": 0.9, "immediately": 0.95, "instantly": 1.0, "quickly": 0.8, "rapidly": 0.8, "gradually": 0.2, "slowly": 0.2, "eventually": 0.3, "over time": 0.3, "then": 0.5, "before": 0.5, "after": 0.5}
# Fixed value: how a duration is said.
DURATION = r"(?i)(?:for|over|lasting|lasted|about|around|approximately)\s+(\d+)\s+(?:days?|bars?|weeks?|months?|hours?|sessions?|periods?)"
#: The event types of a vector, in order.
TYPES = ["earnings", "election", "financial_crisis", "geopolitical", "natural_disaster", "pandemic", "rate_cut", "rate_hike", "regulatory", "technology"]


def family(sentence: Column, families: list[tuple[str, list[str]]] = FAMILIES) -> Column:
    """The first family of which a lower-case sentence holds a word, or a phrase anywhere; null if none."""
    out = F.lit(None).cast("string")
    for name, words in reversed(families):
        single = [re.escape(w) for w in words if " " not in w]
        several = [re.escape(w) for w in words if " " in w]
        pattern = "|".join([f"\\b(?:{'|'.join(single)})\\b"] * bool(single) + several)
        out = F.when(sentence.rlike(pattern), name).otherwise(out)
    return out


def names_any(text: Column, families: list[tuple[str, list[str]]] = FAMILIES) -> Column:
    """Whether a lower-case text holds a word or a phrase of any family, in one look: words by their first letter, phrases anywhere."""
    every = [w for _, words in families for w in words]
    ends: dict[str, list[str]] = {}
    for w in (w for w in every if " " not in w):
        ends.setdefault(w[0], []).append(re.escape(w[1:]))
    start = "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(ends.items()))
    out = text.rlike(f"\\b(?=[{re.escape(''.join(sorted(ends)))}])(?:{start})\\b") if ends else F.lit(False)
    for w in (w for w in every if " " in w):
        out = out | F.contains(text, F.lit(w))
    return out


def strongest(sentence: Column, table: dict[str, float]) -> Column:
    """The value farthest from a half of the modifiers that a lower-case sentence holds; of equals the first named; a half if none."""
    out = F.lit(0.5)
    for word, value in reversed(sorted(table.items(), key=lambda x: -abs(round(x[1] - 0.5, 9)))):
        if value != 0.5:
            out = F.when(F.contains(sentence, F.lit(word)), value).otherwise(out)
    return out


def tagged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, family, intensity, duration, previous, sharpness): the sentences of each text that name a family.

    Sentences end at a full stop, a semicolon or a line's end. Sharpness, of the sentence itself, belongs to the step from the tagged sentence
    before it; null for the first. Sentences are rows before any window, and only tagged ones, so a text's length doesn't matter.
    Texts, then sentences, that name no family at all are left out first, in one look each.
    """
    parts = docs.filter(names_any(F.lower(text_col))).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "[.;\n]")).alias("place", "s"))
    s = F.lower("s")
    rows = parts.filter(names_any(s)).withColumn("family", family(s)).filter("family is not null")
    days = F.regexp_extract("s", DURATION, 1)
    rows = rows.withColumns({"intensity": strongest(s, INTENSITY), "duration": F.when(days != "", F.greatest(F.lit(1), F.coalesce(days.try_cast("int"), F.lit(1)))).otherwise(1), "_sharp": strongest(s, SHARPNESS)})
    before = F.lag("family").over(Window.partitionBy("id").orderBy("place"))
    rows = rows.withColumn("previous", before)
    return rows.select("id", "place", "family", "intensity", "duration", "previous", F.when(F.col("previous").isNotNull(), F.col("_sharp")).alias("sharpness"))


def narrative_vector(events: DataFrame, types: list[str] = TYPES) -> DataFrame:
    """(id, vector) of events (id, place, type, intensity, duration, direction): shares of the types, mean intensity, mean duration / 200, steps
    between unlike types over events, the sign of the net direction, whole duration / 1000; caps at 1. Numbers of a type outside ``types`` count in all else."""
    step = (F.lag("type").over(Window.partitionBy("id").orderBy("place")) != F.col("type")).cast("int")
    rows = events.withColumn("_step", F.coalesce(step, F.lit(0)))
    way = F.when(F.col("direction") == "up", 1).when(F.col("direction") == "down", -1).otherwise(0)
    out = rows.groupBy("id").agg(
        *[F.count_if(F.col("type") == t).alias(f"_t{k}") for k, t in enumerate(types)], F.count("*").alias("_n"), F.avg("intensity").alias("_i"), F.avg("duration").alias("_d"), F.sum("duration").alias("_w"), F.sum("_step").alias("_s"), F.sum(way).alias("_v")
    )
    known = sum((F.col(f"_t{k}") for k in range(len(types))), F.lit(0))
    share = [F.when(known > 0, F.col(f"_t{k}") / known).otherwise(0.0) for k in range(len(types))]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    vector = F.array(*share, zero(F.col("_i")), F.least(zero(F.col("_d")) / 200, F.lit(1.0)), F.col("_s") / F.col("_n"), F.signum(F.col("_v").cast("double")), F.least(zero(F.col("_w").cast("double")) / 1000, F.lit(1.0)))
    return out.select("id", vector.alias("vector"))
