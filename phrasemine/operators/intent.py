"""Search intent of phrases and clusters by rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import top_k

# Intents in order, with weight, words anywhere, beginnings and endings.
INTENTS = {
    "find_tool": (
        1.0,
        [r"\btool\b", r"\bsoftware\b", r"\bapp\b", r"\bplatform\b", r"\bwebsite\b", r"\bprogram\b", r"\bextension\b", r"\bplugin\b", r"\bcalculator\b", r"\bconverter\b", r"\bgenerator\b", r"\beditor\b"],
        [r"^best\s+", r"^top\s+", r"^good\s+"],
        [r"\sfor\s+", r"\sto\s+"],
    ),
    "learn_how": (
        1.2,
        [r"\bhow\s+to\b", r"\btutorial\b", r"\bguide\b", r"\blearn\b", r"\bsteps\b", r"\bway\s+to\b", r"\bmethod\b", r"\btips\b"],
        [r"^how\s+", r"^learn\s+", r"^tutorial\s+"],
        [],
    ),
    "solve_problem": (
        1.1,
        [r"\bfix\b", r"\bsolve\b", r"\brepair\b", r"\btroubleshoot\b", r"\berror\b", r"\bissue\b", r"\bproblem\b", r"\bnot\s+working\b", r"\bfailed\b", r"\bwhy\b"],
        [r"^fix\s+", r"^solve\s+", r"^why\s+"],
        [],
    ),
    "find_free": (1.3, [r"\bfree\b", r"\bopen\s+source\b", r"\bno\s+cost\b", r"\bgratis\b", r"\bfreeware\b"], [], []),
    "compare": (
        1.2,
        [r"\bvs\b", r"\bversus\b", r"\bcompare\b", r"\bdifference\b", r"\bwhich\b", r"\bbetter\b", r"\balternative\b", r"\bor\b"],
        [r"^which\s+", r"^compare\s+"],
        [],
    ),
}
# Substrings by intent, in order of priority.
SUBSTRINGS = {
    "find_tool": ["best", "top", "tool", "software", "app", "recommend", "good", "great"],
    "find_free": ["free", "open source", "no cost", "gratis", "opensource"],
    "learn_how": ["how to", "how do", "tutorial", "guide", "learn", "teach", "instructions"],
    "solve_problem": ["fix", "error", "not working", "problem", "issue", "broken", "troubleshoot"],
    "compare": ["compare", "comparison", "difference", "vs", "versus", "which", "better"],
}
# Labels of intents.
LABELS = {"find_tool": "寻找工具", "learn_how": "学习教程", "solve_problem": "解决问题", "find_free": "寻找免费资源", "compare": "比较选择", "other": "其他意图"}
UNKNOWN_LABEL = "未知意图"
#: A prefix counts for one and a half times, an ending for half of an intent's weight.
PREFIX, ENDING = 1.5, 0.5


_PLAIN = re.compile(r"\\b(\w+)\\b")


def _word(pattern: str) -> str:
    """A whole word that each match of a pattern holds."""
    return re.search(r"[a-z]{2,}", pattern.replace(r"\b", " ").replace(r"\s", " "))[0]


def _score(phrase: Column, held: Column, name: str) -> Column:
    """Weights of the patterns that a phrase matches; held: the words of all patterns that it has, few as a rule."""
    weight, words, prefixes, endings = INTENTS[name]
    tests = [(p, weight) for p in words] + [(p, weight * PREFIX) for p in prefixes] + [(p, weight * ENDING) for p in endings]

    def test(p: str) -> Column:
        has = F.array_contains(held, _word(p))
        return has if _PLAIN.fullmatch(p) else has & phrase.rlike(p)

    return reduce(lambda a, b: a + b, [F.when(test(p), w).otherwise(0.0) for p, w in tests])


def classify(phrases: DataFrame) -> DataFrame:
    """Adds primary_intent, confidence and shares (intent -> share of all scores); other without any.

    A phrase is cut into words once; most patterns are single words, and the others are tried only where their word is there.
    """
    p, every = F.col("_p"), sorted({_word(x) for _, *lists in INTENTS.values() for patterns in lists for x in patterns})
    words = F.when(F.octet_length(p) == F.length(p), F.split(p, r"\W+")).otherwise(F.split(p, r"(?U)\W+"))
    s = phrases.withColumn("_p", F.lower("phrase")).withColumn("_w", F.array_intersect(words, F.array(*[F.lit(w) for w in every])))
    scores = F.array(*[F.struct(_score(p, F.col("_w"), n).alias("score"), F.lit(-i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(INTENTS)])
    zero = F.array(*[F.struct(F.lit(0.0).alias("score"), F.lit(-i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(INTENTS)])
    s = s.withColumn("_s", F.when(F.size("_w") > 0, scores).otherwise(zero))
    s = s.withColumn("_all", F.expr("aggregate(_s, 0D, (a, x) -> a + x.score)")).withColumn("_top", F.array_max("_s"))
    shares = F.map_from_entries(F.transform(F.filter("_s", lambda x: x["score"] > 0), lambda x: F.struct(x["name"], x["score"] / F.col("_all"))))
    none = F.col("_all") == 0
    return s.withColumns({
        "primary_intent": F.when(none, "other").otherwise(F.col("_top.name")), "confidence": F.when(none, 1.0).otherwise(F.try_divide(F.col("_top.score"), F.col("_all"))),
        "shares": F.when(none, F.create_map(F.lit("other"), F.lit(1.0))).otherwise(shares),
    }).drop("_p", "_w", "_s", "_all", "_top")


def cluster_intent(phrases: DataFrame, key: str, looked_at: int = 50) -> DataFrame:
    """Intents of each cluster's first phrases: dominant, confidence in percent, balanced below 0.6, shares as JSON."""
    c = classify(top_k(phrases.select(key, "phrase_id", "phrase"), [key], [F.col("phrase_id")], looked_at))
    n = c.groupBy(key, "primary_intent").agg(F.count("*").alias("n"))
    names = [*INTENTS, "other"]
    order = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("primary_intent"))
    g = n.groupBy(key).agg(F.sum("n").alias("all"), F.max_by("primary_intent", F.struct("n", -order)).alias("dominant_intent"), F.max("n").alias("most"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("primary_intent", "n")))).alias("counts"))
    share = F.col("most") / F.col("all")
    return g.select(
        key, "dominant_intent", (share * 100).cast("int").alias("dominant_intent_confidence"), (share < 0.6).alias("is_intent_balanced"),
        F.to_json(F.transform_values("counts", lambda k, v: F.round(v / F.col("all"), 4))).alias("intent_distribution"),
    )


def with_labels(df: DataFrame, intent: str) -> DataFrame:
    """C8."""
    labels = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
    return df.withColumn("intent_label", F.coalesce(F.try_element_at(labels, F.col(intent)), F.lit(UNKNOWN_LABEL)))


def substring_intent(phrase: Column) -> Column:
    """The first intent, by priority, one of whose substrings the phrase contains."""
    out, p = F.lit("other"), F.lower(phrase)
    for name in reversed(SUBSTRINGS):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in SUBSTRINGS[name]]), name).otherwise(out)
    return out


def distribution(phrases: DataFrame) -> DataFrame:
    """Phrases by C9 intent, zeros kept, with shares and the verdict on find_tool."""
    names = phrases.sparkSession.createDataFrame([(n,) for n in [*SUBSTRINGS, "other"]], "intent string")
    c = phrases.groupBy(substring_intent(F.col("phrase")).alias("intent")).agg(F.count("*").alias("n"))
    total = phrases.agg(F.count("*").alias("all"))  # one row
    out = names.join(c, "intent", "left").fillna(0, ["n"]).join(F.broadcast(total)).withColumn("share", F.round(F.try_divide(F.col("n"), F.col("all")), 6)).drop("all")
    return out.withColumn("verdict", F.when(F.col("intent") == "find_tool", F.when(F.col("share") > 0.7, "dominant").when(F.col("share") < 0.4, "spread").otherwise("mixed")))
