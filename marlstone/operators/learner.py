"""Learner model: Bayesian knowledge tracing, profiles, recommendations, learning paths.

Events: learner_id, concept_id, event_type (view, practice, test, query, ...), ts (epoch seconds), seq, success, duration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone import config as C
from marlstone.functions.columns import top
from marlstone.functions.lineage import kept

EVENT_TYPES = ("view", "practice", "test")


def updated(p: Column, kind: Column, success: Column) -> Column:
    """The mastery after one event."""
    view = p + (1 - p) * C.P_TRANSIT * C.VIEW_FACTOR
    right = p * (1 - C.P_SLIP) / (p * (1 - C.P_SLIP) + (1 - p) * C.P_GUESS)
    wrong = p * C.P_SLIP / (p * C.P_SLIP + (1 - p) * (1 - C.P_GUESS))
    seen = F.when(success, right).otherwise(wrong)
    done = F.least(seen + (1 - seen) * C.P_TRANSIT, F.lit(C.MASTERY_CAP))
    return F.when(kind == "view", view).when(kind.isin("practice", "test") & success.isNotNull(), done).otherwise(p)


def mastery(events: DataFrame, now: float) -> DataFrame:
    """(learner_id, concept_id, mastery): a fold over each group's events in order, then decay up to `now`.

    One learner's events of one concept make a group; they are few whatever the table's size."""
    rows = events.groupBy("learner_id", "concept_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "event_type", "success"))).alias("e"))
    folded = F.aggregate("e", F.lit(C.P_INIT), lambda p, x: updated(p, x["event_type"], x["success"]))
    days = (F.lit(float(now)) - F.element_at("e", -1)["ts"]) / 86400.0
    kept = F.exp(-C.DECAY_PER_DAY * days)
    return rows.withColumn("p", folded).select("learner_id", "concept_id", F.round(F.col("p") * kept + C.P_INIT * (1 - kept), 9).alias("mastery"))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "mastered").when(score >= 0.5, "familiar").when(score >= 0.2, "learning").otherwise("novice")


def viewed(views: DataFrame) -> DataFrame:
    """A view event for each concept of a viewed resource (concepts array), each with the whole duration."""
    return views.select("learner_id", F.explode("concepts").alias("concept_id"), F.lit("view").alias("event_type"), "ts", "seq", F.lit(None).cast("boolean").alias("success"), "duration")


def weak(scores: DataFrame, threshold: float = 0.5, k: int = 10) -> DataFrame:
    return top(scores.where(F.col("mastery") < threshold), ["learner_id"], [F.col("mastery"), F.col("concept_id")], k)


def preferences(events: DataFrame) -> DataFrame:
    """(learner_id, views, practices, practice_ratio, view_ratio, avg_study_time, favourite_hour)."""
    own = events.where(F.col("event_type").isin(*EVENT_TYPES))
    views, practices = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type").isin("practice", "test"))
    sums = own.groupBy("learner_id").agg(views.alias("views"), practices.alias("practices"), F.sum("duration").alias("study"), F.countDistinct("concept_id").alias("concepts"))
    hours = active_hours(events)
    hours = hours.groupBy("learner_id").agg(F.min_by("hour", F.struct(-F.col("n"), F.col("hour"))).alias("favourite_hour"))
    n = F.greatest(F.col("views") + F.col("practices"), F.lit(1))
    share = lambda c: F.round(F.col(c) / n, 6)
    return sums.join(hours, "learner_id").select("learner_id", "views", "practices", share("practices").alias("practice_ratio"), share("views").alias("view_ratio"), F.round(F.col("study") / F.greatest("concepts", F.lit(1)), 4).alias("avg_study_time"), "favourite_hour")


def query_languages(queries: DataFrame) -> DataFrame:
    """(learner_id, lang, n): languages of a learner's queries; a null one is 'unknown'."""
    return queries.groupBy("learner_id", F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


def active_hours(events: DataFrame) -> DataFrame:
    """(learner_id, hour, n): events of a learner by the hour of the day in UTC."""
    return events.groupBy("learner_id", F.floor((F.col("ts") % 86400) / 3600).cast("int").alias("hour")).agg(F.count("*").alias("n"))


def summary(events: DataFrame, scores: DataFrame) -> DataFrame:
    """(learner_id, concepts, avg_mastery, levels by count, study_time, last_active): last_active is of the event appended last."""
    held = scores.withColumn("level", level(F.col("mastery")))
    counts = [F.count_if(F.col("level") == x).alias(x) for x in ("mastered", "familiar", "learning", "novice")]
    by = held.groupBy("learner_id").agg(F.count("*").alias("concepts"), F.round(F.avg("mastery"), 6).alias("avg_mastery"), *counts)
    used = events.groupBy("learner_id").agg(F.round(F.sum(F.when(F.col("event_type").isin(*EVENT_TYPES), F.col("duration")).otherwise(0.0)), 4).alias("study_time"), F.max_by("ts", "seq").alias("last_active"))
    return by.join(used, "learner_id").withColumn("session_count", F.lit(0))


def recommendations(profile: DataFrame) -> DataFrame:
    """Advice codes by average mastery, practice ratio and study hours."""
    overall = F.when(F.col("avg_mastery") < 0.3, "build_basics").when(F.col("avg_mastery") < 0.6, "keep_going").otherwise("advance")
    tips = F.when(F.col("practice_ratio") < 0.3, "practise_more").when(F.col("practice_ratio") > 0.7, "read_more").otherwise("balanced")
    hours = F.when(F.col("study_time") / 3600.0 < 10, "more_time").otherwise("enough_time")
    return profile.select("*", overall.alias("overall"), tips.alias("tip"), hours.alias("time_advice"))


def next_steps(path: DataFrame) -> DataFrame:
    """(learner_id, next_step, later): the first concept of each path and the following three."""
    steps = path.groupBy("learner_id").agg(F.array_sort(F.collect_list(F.struct("position", "concept_id"))).alias("p"))
    names = F.transform("p", lambda x: x["concept_id"])
    return steps.select("learner_id", F.element_at(names, 1).alias("next_step"), F.array_join(F.slice(names, 2, 3), " → ").alias("later"))


def cohort(profiles: DataFrame, weak_concepts: DataFrame, k: int = 10) -> DataFrame:
    """(kind, name, value): number of learners, averages, and the k concepts that most learners are weak in."""
    means = profiles.agg(F.count("*").cast("double").alias("learners"), F.avg("avg_mastery").alias("avg_mastery"), F.avg("concepts").alias("avg_concepts"))
    rows = means.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("name"), F.round(F.col(c), 6).alias("value")) for c in ("learners", "avg_mastery", "avg_concepts")])).alias("x")).select("x.*")
    most = weak_concepts.groupBy("concept_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept_id").limit(k)
    return rows.unionByName(most.select(F.lit("weak").alias("kind"), F.col("concept_id").cast("string").alias("name"), F.col("n").cast("double").alias("value")))


def prerequisites(edges: DataFrame) -> DataFrame:
    """(concept, needs): the target of a PREREQUISITE edge needs its source."""
    return edges.where("type = 'PREREQUISITE'").select(F.col("target").alias("concept"), F.col("source").alias("needs")).distinct()


def closure(targets: DataFrame, needs: DataFrame, scores: DataFrame, threshold: float = C.MASTERY_THRESHOLD) -> DataFrame:
    """(learner_id, concept): targets and what they need, not going on through concepts that are mastered."""
    known = kept(scores.where(F.col("mastery") >= threshold).select("learner_id", F.col("concept_id").alias("concept")))  # once, not in each round
    front = kept(targets.select("learner_id", "concept").distinct())
    out = front
    while True:  # a round adds concepts that weren't reached before, so it ends
        open_ = front.join(known, ["learner_id", "concept"], "left_anti")
        front = open_.join(needs, "concept").select("learner_id", F.col("needs").alias("concept")).distinct().join(out, ["learner_id", "concept"], "left_anti")
        front = kept(front)
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def ordered(concepts: list[str], needs: list[tuple[str, str]], score: dict[str, float]) -> list[str]:
    """Topological order in which of the ready concepts the least mastered comes first; members of cycles come last, by mastery."""
    import heapq

    inside = set(concepts)
    waits = {c: 0 for c in inside}
    opens: dict[str, list[str]] = {}
    for concept, need in set(needs):
        if concept in inside and need in inside and concept != need:
            waits[concept] += 1
            opens.setdefault(need, []).append(concept)
    ready = [(score.get(c, 0.0), c) for c, n in waits.items() if not n]
    heapq.heapify(ready)
    out = []
    while ready:
        _, c = heapq.heappop(ready)
        out.append(c)
        for d in opens.get(c, []):
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(ready, (score.get(d, 0.0), d))
    return out + sorted(inside - set(out), key=lambda c: (score.get(c, 0.0), c))


def learning_path(wanted: DataFrame, needs: DataFrame, scores: DataFrame, threshold: float = C.MASTERY_THRESHOLD, most: int = 20) -> DataFrame:
    """(learner_id, position, concept_id, current_mastery, reason) over the closure of each learner.

    The order is sequential by nature, so each learner's closure, of bounded size, is one group of a pandas function."""
    edges = wanted.join(needs, "concept", "left").join(scores.select("learner_id", F.col("concept_id").alias("concept"), "mastery"), ["learner_id", "concept"], "left")

    def arrange(part: pd.DataFrame) -> pd.DataFrame:
        score = part.drop_duplicates("concept").set_index("concept")["mastery"].fillna(0.0).to_dict()
        pairs = [(c, n) for c, n in zip(part["concept"], part["needs"]) if isinstance(n, str)]
        steps = ordered(list(score), pairs, score)[:most]
        reason = ["goal" if i == len(steps) - 1 else "weak" if score[c] < 0.3 else "consolidate" if score[c] < threshold else "review" for i, c in enumerate(steps)]
        return pd.DataFrame({"learner_id": part["learner_id"].iloc[0], "position": range(1, len(steps) + 1), "concept_id": steps, "current_mastery": [score[c] for c in steps], "reason": reason})

    kind = wanted.schema["learner_id"].dataType.simpleString()
    return edges.select("learner_id", "concept", "needs", "mastery").groupBy("learner_id").applyInPandas(arrange, f"learner_id {kind}, position int, concept_id string, current_mastery double, reason string")


def known_concepts(edges: DataFrame) -> DataFrame:
    """(concept): all ends of edges, of whatever type."""
    return edges.select(F.explode(F.array("source", "target")).alias("concept")).distinct()


def goal_path(goals: DataFrame, needs: DataFrame, scores: DataFrame, threshold: float = C.MASTERY_THRESHOLD, most: int = 10, concepts: DataFrame | None = None) -> DataFrame:
    """(learner_id, position, concept_id, current_mastery, reason, prerequisites): the way of each learner to a goal (learner_id, concept).

    A goal that isn't among the concepts (those that needs names, if they aren't given) has no path; neither has one that is mastered. Concepts that are mastered aren't part
    of the way. prerequisites are all of a concept's, in their order by name."""
    named = (concepts if concepts is not None else needs.select(F.explode(F.array("concept", "needs")).alias("concept"))).select("concept").distinct()
    known = scores.where(F.col("mastery") >= threshold).select("learner_id", F.col("concept_id").alias("concept"))
    wanted = closure(goals.join(named, "concept", "left_semi").select("learner_id", "concept"), needs, scores, threshold).join(known, ["learner_id", "concept"], "left_anti")
    steps = learning_path(wanted, needs, scores, threshold, most)
    before = needs.groupBy(F.col("concept").alias("concept_id")).agg(F.array_sort(F.collect_set("needs")).alias("prerequisites"))  # as many as a concept has
    return steps.join(before, "concept_id", "left").select("learner_id", "position", "concept_id", "current_mastery", "reason", F.coalesce("prerequisites", F.array().cast("array<string>")).alias("prerequisites"))


def report(events: DataFrame, needs: DataFrame, now: float, weak_below: float = 0.6, weak_most: int = 5, path_most: int = 10) -> DataFrame:
    """A row for each learner: profile, weak concepts, path through them, preferences, advice, next step."""
    scores = kept(mastery(events.where(F.col("event_type").isin(*EVENT_TYPES)), now))  # the fold of all events, which five results hang on
    profile = summary(events, scores).join(preferences(events).select("learner_id", "practice_ratio", "favourite_hour"), "learner_id", "left")
    lacking = weak(scores, weak_below, weak_most)
    wanted = closure(lacking.select("learner_id", F.col("concept_id").alias("concept")), needs, scores)
    known = scores.where(F.col("mastery") >= C.MASTERY_THRESHOLD).select("learner_id", F.col("concept_id").alias("concept"))
    path = kept(learning_path(wanted.join(known, ["learner_id", "concept"], "left_anti"), needs, scores, most=path_most))
    listed = lambda rows, order, *columns: F.array_sort(F.collect_list(F.struct(order, *columns)))  # noqa: E731  at most weak_most or path_most of a learner
    weak_lists = lacking.groupBy("learner_id").agg(listed(lacking, "rank", "concept_id", "mastery").alias("weak_concepts"))
    path_lists = path.groupBy("learner_id").agg(listed(path, "position", "concept_id", "current_mastery", "reason").alias("recommended_path"))
    out = recommendations(profile.fillna(0.0, ["practice_ratio"])).join(weak_lists, "learner_id", "left").join(path_lists, "learner_id", "left")
    return out.join(next_steps(path), "learner_id", "left")
