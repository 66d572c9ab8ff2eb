"""Conversation history and answer evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fabsight.functions.text import derive_title
from fabsight.operators.telemetry import top_n_per_key
from fabsight.plans.series import exact_quantiles, ordered_sums
from fabsight.session import durable


def session_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.max("message_id").alias("last_message"))


def first_user_message(messages: DataFrame) -> DataFrame:
    users = messages.where(F.col("role") == "user")
    return users.groupBy("session_id").agg(F.min_by("content", "message_id").alias("content"))


def session_titles(messages: DataFrame) -> DataFrame:
    return first_user_message(messages).select("session_id", derive_title(F.col("content")).alias("title"))


def last_n_messages(messages: DataFrame, n: int = 12) -> DataFrame:
    """Newest ``n`` messages per session as one array in time order."""
    recent = top_n_per_key(messages, ["session_id"], [F.desc("message_id")], n)
    packed = F.array_sort(F.collect_list(F.struct("message_id", "role", "content")))  # at most n entries
    return recent.groupBy("session_id").agg(packed.alias("history"))


def _filled(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def answer_scoring(answers: DataFrame) -> DataFrame:
    """Flags per answer; expects ``tools``, ``answer``, ``citations`` and the ``expect`` struct."""
    e = lambda n: F.col(f"expect.{n}")
    tools, answer = F.col("tools"), F.col("answer")
    any_ok = ~_filled(e("tools_called_any")) | F.arrays_overlap(tools, e("tools_called_any"))
    all_ok = ~_filled(e("tools_called_all")) | (F.size(F.array_except(e("tools_called_all"), tools)) == 0)
    none_ok = ~_filled(e("tools_forbidden")) | ~F.arrays_overlap(tools, e("tools_forbidden"))
    routing = F.when(F.coalesce(e("no_tools"), F.lit(False)), F.size(tools) == 0).otherwise(any_ok & all_ok & none_ok)
    keyword = ((~_filled(e("answer_contains_any")) | F.exists(e("answer_contains_any"), lambda k: F.contains(answer, k)))
               & (~_filled(e("answer_contains_all")) | F.forall(e("answer_contains_all"), lambda k: F.contains(answer, k))))
    honest = F.coalesce(e("expect_honest_empty"), F.lit(False))
    return answers.withColumns({
        "routing_ok": routing, "keyword_ok": keyword, "has_citation_label": _filled(e("citations_include")),
        "citation_ok": ~_filled(e("citations_include")) | F.arrays_overlap(F.col("citations"), e("citations_include")),
        "has_mustnot": _filled(e("must_not_contain")),
        "hallucinated": _filled(e("must_not_contain")) & F.exists(e("must_not_contain"), lambda k: F.contains(answer, k)),
        "is_honest": honest, "honest_ok": ~honest | keyword})


def conditional_rates(scored: DataFrame, rates: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Rates by configuration and by (configuration, category) in one pass; NULL when nothing is eligible."""
    aggs = []
    for name, (flag, among) in rates.items():
        value = F.col(flag).cast("double")
        aggs.append(F.round(F.avg(F.when(F.col(among), value) if among else value), 3).alias(name))
    return scored.groupingSets([["config"], ["config", "category"]], "config", "category").agg(F.count(F.lit(1)).alias("n"), *aggs)


def latency_cost_stats(rows: DataFrame, rate_in: float, rate_out: float, key: str = "config") -> DataFrame:
    """Median, mean, observed 95th percentile (no interpolation) and mean token cost."""
    med = exact_quantiles(rows, [key], "latency", {"p50": 0.5})
    counted = rows.groupBy(key, "latency").agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_sums(counted, [key], [F.asc("latency")], {"_hi": F.col("_c")})
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean"),
                              F.avg((F.col("in_tok") * rate_in + F.col("out_tok") * rate_out) / 1_000_000).alias("mean_cost"))
    at = F.bround(0.95 * (F.col("n") - 1), 0)
    p95 = ranked.join(n.select(key, "n"), key).where((F.col("_hi") > at) & (F.col("_hi") - F.col("_c") <= at)).select(
        key, F.col("latency").alias("p95"))
    return n.join(med, key).join(p95, key)


def pct_reduction(rows: DataFrame, value: str, before: str, after: str) -> DataFrame:
    mean = {c: F.avg(F.when(F.col("config") == c, F.col(value))) for c in (before, after)}
    return rows.agg(mean[before].alias("before"), mean[after].alias("after")).withColumn(
        "reduction_pct", F.when(F.col("before") != 0, (F.col("before") - F.col("after")) / F.col("before") * 100))


def pairwise_scores(verdicts: DataFrame) -> DataFrame:
    """Two position-swapped verdicts (A/B/tie) as the new side's score and whether they agree."""
    def side(col, new):
        old = "A" if new == "B" else "B"
        return F.when(F.col(col) == new, "after").when(F.col(col) == old, "before").otherwise("tie")
    pts = lambda c: F.when(F.col(c) == "after", 1.0).when(F.col(c) == "tie", 0.5).otherwise(0.0)
    return verdicts.withColumns({"order1": side("winner1", "B"), "order2": side("winner2", "A")}).withColumns({
        "after_score": (pts("order1") + pts("order2")) / 2, "consistent": F.col("order1") == F.col("order2")})


def pairwise_winrate(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    s = F.col("after_score")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("win_rate"), F.count_if(s > 0.5).alias("wins"), F.count_if(s == 0.5).alias("ties"),
        F.count_if(s < 0.5).alias("losses"), F.avg(F.col("consistent").cast("double")).alias("consistency"))


def bootstrap_ci(scored: DataFrame, value: str, iters: int = 2000, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean.

    A resample's mean depends only on how often each distinct value is drawn.  Every resample splits its draws over groups of
    values by one multinomial (the same in every task), and the task of a group draws within it, so sums of
    ``iters`` x groups meet.
    """
    groups = scored.sparkSession.sparkContext.defaultParallelism
    hist = durable(scored.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
                   .withColumn("g", F.pmod(F.xxhash64("v"), F.lit(groups)).cast("int")))
    sizes = np.zeros(groups)
    for r in hist.groupBy("g").agg(F.sum("c").alias("n")).collect():  # a row per group
        sizes[r["g"]] = r["n"]
    total = int(sizes.sum())
    if not total:
        return scored.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], "mean double, low double, high double")

    def draw(key, pdf):
        pdf = pdf.sort_values("v")
        values, share = pdf["v"].to_numpy(), pdf["c"].to_numpy() / pdf["c"].sum()
        sums = []
        for b in range(iters):
            mine = np.random.default_rng([seed, b]).multinomial(total, sizes / total)[key[0]]
            sums.append(np.random.default_rng([seed, b, 1 + key[0]]).multinomial(mine, share) @ values)
        return pd.DataFrame({"b": np.arange(iters), "s": sums})

    mean = hist.agg((F.sum(F.col("v") * F.col("c")) / total)).first()[0]
    means = hist.groupBy("g").applyInPandas(draw, "b long, s double").groupBy("b").agg((F.sum("s") / total).alias("m"))
    ordered = F.array_sort(F.collect_list("m"))  # ``iters`` numbers
    return means.agg(ordered.alias("s")).select(
        F.lit(float(mean)).alias("mean"), F.col("s")[int(0.025 * iters)].alias("low"), F.col("s")[int(0.975 * iters)].alias("high"))


def rubric_means(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    return rows.groupBy("config").agg(*[F.round(F.avg(d), 2).alias(d) for d in dims])


def judge_case_join(before: DataFrame, after: DataFrame, cases: DataFrame) -> DataFrame:
    a = before.select("id", F.col("answer").alias("answer_before"))
    b = after.select("id", F.col("answer").alias("answer_after"))
    return a.join(b, "id").join(cases, "id")


def judge_agreement(human: DataFrame, judge: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Exact agreement of people and judge, and the new side's win rate by category (a tie counts half).

    ``keys`` name a case; picks left blank do not count, cases without a judge count for the win rate alone.
    """
    j = judge.select(*keys, F.when(F.col("after_score") > 0.5, "after").when(F.col("after_score") < 0.5, "before").otherwise("tie").alias("judge"))
    both = human.where(F.col("pick").isNotNull()).join(j, list(keys), "left")
    win = F.when(F.col("pick") == "after", 1.0).when(F.col("pick") == "tie", 0.5).otherwise(0.0)
    same = F.when(F.col("judge").isNotNull(), (F.col("judge") == F.col("pick")).cast("double"))
    return both.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.avg(win).alias("win_rate"), F.avg(same).alias("agreement"))


def classification_confusion(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"), (F.col(label) == F.col(predicted)).alias("correct"))


def pick_answer_rep(rows: DataFrame) -> DataFrame:
    """Representative answer per (config, id): without error first, then repetition 0, then the earliest."""
    order = F.struct(F.col("error").isNotNull().cast("int"), (F.col("rep") != 0).cast("int"), F.col("rep"))
    rest = [c for c in rows.columns if c not in ("config", "id")]
    return rows.groupBy("config", "id").agg(F.min_by(F.struct(*rest), order).alias("_r")).select("config", "id", "_r.*")


def stratified_round_robin(cases: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` cases taking categories in turn: at most ``n`` per category enter the final order."""
    h = F.md5(F.concat_ws(":", F.lit(seed), "id"))  # any engine can order by it
    rn = F.row_number().over(W.partitionBy("category").orderBy(h, F.asc("id")))
    return cases.withColumn("turn", rn).where(F.col("turn") <= n).orderBy("turn", "category").limit(n)


def spotcheck_rows(pairs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Blinded sheet and its key: a hash decides which side fills slot 1."""
    swap = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(2)) == 1
    sheet = pairs.select(F.col("id"), "category", "query", F.when(swap, F.col("answer_after")).otherwise(F.col("answer_before")).alias("answer_slot1"),
                         F.when(swap, F.col("answer_before")).otherwise(F.col("answer_after")).alias("answer_slot2"),
                         F.lit("").alias("human_pick"), F.lit("").alias("note"))
    key = pairs.select("id", F.when(swap, "after").otherwise("before").alias("slot1"), F.when(swap, "before").otherwise("after").alias("slot2"))
    return sheet, key
