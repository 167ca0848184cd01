"""Model prices, routing and spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Provider, tier, model, USD per 1000 input tokens, per 1000 output tokens, context, JSON mode.
MODELS = [
    ("anthropic", "premium", "claude-opus-4-20250514", 0.015, 0.075, 200000, True),
    ("anthropic", "standard", "claude-sonnet-4-20250514", 0.003, 0.015, 200000, True),
    ("anthropic", "fast", "claude-haiku-4-5-20251001", 0.0008, 0.004, 200000, True),
    ("openai", "premium", "gpt-4o", 0.0025, 0.01, 128000, True),
    ("openai", "standard", "gpt-4o", 0.0025, 0.01, 128000, True),
    ("openai", "fast", "gpt-4o-mini", 0.00015, 0.0006, 128000, True),
    ("gemini", "premium", "gemini-1.5-pro", 0.00125, 0.005, 2000000, True),
    ("gemini", "standard", "gemini-1.5-pro", 0.00125, 0.005, 2000000, True),
    ("gemini", "fast", "gemini-1.5-flash", 0.000075, 0.0003, 1000000, True),
    ("local", "premium", "local-default", 0.0, 0.0, 32000, False),
    ("local", "standard", "local-default", 0.0, 0.0, 32000, False),
    ("local", "fast", "local-default", 0.0, 0.0, 32000, False),
]
# Prices known to the adapters beyond the table above, and each provider's default model.
EXTRA_PRICES = [("gemini", "gemini-2.0-flash", 0.0001, 0.0004)]
DEFAULT_MODEL = {
    "anthropic": "claude-sonnet-4-20250514",
    "openai": "gpt-4o",
    "gemini": "gemini-1.5-pro",
    "local": "local-default",
}
# Task, tier, tier in enriched mode.
TASK_TIERS = [
    ("frame_labeling", "fast", "standard"),
    ("scene_classification", "fast", "standard"),
    ("entity_extraction", "standard", "premium"),
    ("visual_analysis", "standard", "premium"),
    ("vud_fusion", "premium", "premium"),
    ("editorial_reasoning", "premium", "premium"),
    ("cut_planning", "premium", "premium"),
    ("caption_generation", "fast", "standard"),
    ("review", "standard", "premium"),
    ("repair", "standard", "premium"),
]


def model_table(spark: SparkSession) -> DataFrame:
    """The twelve models of the catalogue."""
    return spark.createDataFrame(
        MODELS,
        "provider string, tier string, model string, input_per_1k double, output_per_1k double, max_context long, supports_json boolean",
    )


def price_table(spark: SparkSession) -> DataFrame:
    rows = sorted({(p, m, i, o) for p, _, m, i, o, _, _ in MODELS} | set(EXTRA_PRICES))
    return spark.createDataFrame(rows, "provider string, model string, input_per_1k double, output_per_1k double")


def route_models(requests: DataFrame) -> DataFrame:
    """Model and estimated cost per request.

    ``requests``: request_id, task, provider, enriched, override_provider, override_tier, input_tokens,
    output_tokens.  An override (both fields) replaces provider and tier.
    """
    spark = requests.sparkSession
    tiers = spark.createDataFrame(TASK_TIERS, "task string, _normal string, _rich string")
    r = requests.join(F.broadcast(tiers), "task", "left")
    over = F.col("override_provider").isNotNull() & F.col("override_tier").isNotNull()
    r = r.withColumn("_p", F.when(over, F.col("override_provider")).otherwise(F.col("provider"))).withColumn(
        "tier", F.when(over, F.col("override_tier")).when(F.col("enriched"), F.col("_rich")).otherwise(F.col("_normal"))
    )
    m = model_table(spark).select(F.col("provider").alias("_p"), "tier", "model", "input_per_1k", "output_per_1k")
    r = r.join(F.broadcast(m), ["_p", "tier"], "left")
    cost = F.col("input_tokens") / 1000 * F.col("input_per_1k") + F.col("output_tokens") / 1000 * F.col("output_per_1k")
    return r.select("request_id", "task", F.col("_p").alias("provider"), "tier", "model", cost.alias("estimated_usd"))


def price_calls(calls: DataFrame) -> DataFrame:
    """Add cost_usd; an unknown model costs what the provider's default model costs."""
    spark = calls.sparkSession
    prices = price_table(spark)
    default = spark.createDataFrame(list(DEFAULT_MODEL.items()), "provider string, model string")
    d = default.join(prices, ["provider", "model"]).select(
        "provider", F.col("input_per_1k").alias("_di"), F.col("output_per_1k").alias("_do")
    )
    out = calls.join(F.broadcast(prices), ["provider", "model"], "left").join(F.broadcast(d), "provider", "left")
    i, o = F.coalesce("input_per_1k", "_di"), F.coalesce("output_per_1k", "_do")
    return out.withColumn("cost_usd", F.col("input_tokens") / 1000 * i + F.col("output_tokens") / 1000 * o).select(
        *calls.columns, "cost_usd"
    )


def cost_rollup(priced: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spend per job with maps by stage and provider, and the state of its budget (job_id, budget_usd)."""
    # One partial aggregate at the finest grain; the job totals and maps come from that small result.
    fine = priced.groupBy("job_id", "stage", "provider").agg(
        F.sum("cost_usd").alias("c"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.count(F.lit(1)).alias("n")
    )
    # Stages and providers are fixed lists, so a job has a few dozen of these rows at most.
    per = fine.groupBy("job_id").agg(
        F.sum("c").alias("total_usd"),
        F.sum("i").alias("input_tokens"),
        F.sum("o").alias("output_tokens"),
        F.sum("n").alias("calls"),
        F.collect_list(F.struct("stage", "provider", "c")).alias("_rows"),
    )

    def by(key: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("_rows", lambda r: r[key])))
        spent = lambda k: F.aggregate(F.filter("_rows", lambda r: r[key] == k), F.lit(0.0), lambda a, r: a + r["c"])
        return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.round(spent(k), 9))))

    out = per.withColumns({"by_stage": by("stage"), "by_provider": by("provider")}).join(budgets, "job_id", "left")
    b, t = F.col("budget_usd"), F.col("total_usd")
    return out.select(
        "job_id",
        F.round(t, 9).alias("total_usd"),
        "input_tokens",
        "output_tokens",
        "calls",
        "by_stage",
        "by_provider",
        F.coalesce(t >= b * 0.8, F.lit(False)).alias("near_budget"),
        F.coalesce(t >= b, F.lit(False)).alias("over_budget"),
        F.round(b - t, 9).alias("remaining_usd"),
    )


def cost_dashboard(priced: DataFrame, jobs: DataFrame) -> DataFrame:
    """Spend over all jobs: totals, mean per tracked job, by provider and by stage, largest first."""
    per = priced.groupBy("job_id", "provider", "stage").agg(F.sum("cost_usd").alias("c"))
    per = per.join(jobs.select("job_id").distinct(), "job_id", "left_semi")
    grand = per.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("t"), F.countDistinct("job_id").alias("n"))
    rows = F.array(
        F.struct(F.lit("spend").alias("name"), F.col("t").alias("v")),
        F.struct(F.lit("jobs_tracked").alias("name"), F.col("n").cast("double").alias("v")),
        F.struct(
            F.lit("mean_per_job").alias("name"), F.when(F.col("n") > 0, F.col("t") / F.col("n")).otherwise(F.lit(0.0)).alias("v")
        ),
    )
    head = grand.select(F.explode(rows).alias("x")).select(F.lit("total").alias("k"), "x.name", "x.v")
    head = head.unionByName(
        jobs.agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("total").alias("k"), F.lit("jobs").alias("name"), "v")
    )
    prov = per.groupBy(F.col("provider").alias("name")).agg(F.sum("c").alias("v")).select(F.lit("provider").alias("k"), "name", "v")
    stage = per.groupBy(F.col("stage").alias("name")).agg(F.sum("c").alias("v")).select(F.lit("stage").alias("k"), "name", "v")
    return (
        head.unionByName(prov)
        .unionByName(stage)
        .select(F.col("k").alias("breakdown"), "name", F.round("v", 9).alias("value"))
        .orderBy("breakdown", F.desc("value"), "name")
    )


def tracked_jobs(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs next to their cost report (job_id, total_usd); jobs without one count, but add nothing."""
    j = jobs.join(reports.select("job_id", "total_usd"), "job_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count("total_usd").alias("tracked_jobs"),
        F.round(F.coalesce(F.sum("total_usd"), F.lit(0.0)), 9).alias("total_usd"),
    )
