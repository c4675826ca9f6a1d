"""Evaluation of a reviewed corpus: source-disjoint splits, dense coverage, typed errors, paired configs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import set_hash, source_split
from .quantiles import median

# Fixed values of the record format.
CATEGORIES = ["boundary", "endpoint", "recognition", "restoration", "speed", "structural-event"]
OUTCOMES = ["accepted", "adjusted", "protected", "rejected"]
TYPED = ["boundary", "endpoint", "recognition", "speed"]
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SAFE_KIND = r"^[a-z][a-z0-9._-]{0,127}$"


@dataclass(frozen=True)
class EvaluationConfig:
    salt: str = "0" * 64
    evaluation_basis_points: int = 2000
    minimum_records: int = 3
    minimum_sources: int = 2
    minimum_pairs: int = 3
    minimum_pair_sources: int = 2
    minimum_pair_coverage: int = 8000

    def __post_init__(self) -> None:
        if not 1 <= self.evaluation_basis_points <= 9999:
            raise ValueError("evaluation basis points are 1..9999")
        if min(self.minimum_records, self.minimum_sources, self.minimum_pairs, self.minimum_pair_sources) < 1:
            raise ValueError("minimum counts are at least 1")


def with_split(records: DataFrame, cfg: EvaluationConfig) -> DataFrame:
    return records.withColumn("split", source_split(F.col("source"), cfg.salt, cfg.evaluation_basis_points))


def kind_identity(kind: Column) -> tuple[Column, Column]:
    """The kind if it is safe text, else null, and its hash either way."""
    text = F.concat(F.lit('{"proposal_kind":"'), kind, F.lit('"}'))
    return F.when(kind.rlike(SAFE_KIND), kind), F.sha2(text, 256)


def with_targets(records: DataFrame) -> DataFrame:
    """Typed loss, relative loss and target identity from the two payloads; null where the record is untyped."""
    p = lambda f: F.get_json_object("proposal_payload", "$." + f)
    o = lambda f: F.get_json_object("owner_payload", "$." + f)
    whole = r"^-?\d{1,18}$"
    frame = lambda t: F.when(
        t.rlike(whole) & t.try_cast("bigint").between(F.lit(0), F.col("sample_count")), t.try_cast("bigint"))
    factor = lambda t: F.when(
        t.try_cast("decimal(38,18)").between(F.lit(0.25).cast("decimal(38,18)"), F.lit(4).cast("decimal(38,18)")),
        t.try_cast("decimal(38,18)"))
    ident = lambda t: F.when(t.rlike(UUID), t)
    pf, of = frame(p("proposed_frame")), frame(o("final_frame"))
    ps, os_ = factor(p("proposed_factor")), factor(o("final_factor"))
    pr, orr = ident(p("release_mbid")), ident(o("release_mbid"))
    is_frame = F.col("category").isin("boundary", "endpoint")
    dec = "decimal(38,18)"
    loss = (
        F.when(is_frame, F.abs(pf - of).cast(dec))
        .when(F.col("category") == "speed", F.abs(ps - os_).cast(dec))
        .when((F.col("category") == "recognition") & pr.isNotNull() & orr.isNotNull(), (pr != orr).cast("int").cast(dec))
    )
    target = (
        F.when(is_frame, of.cast("string")).when(F.col("category") == "speed", os_.cast("string"))
        .when(F.col("category") == "recognition", orr)
    )
    out = records.withColumn("loss", loss).withColumn("target", target)
    ppm = F.abs(ps - os_).cast("double") / os_.cast("double") * 1e6
    return out.withColumn("ppm", F.when((F.col("category") == "speed") & F.col("loss").isNotNull(), ppm))


def _domain(spark, **values: list[str]) -> DataFrame:
    """All combinations of short fixed lists (a constant, not data)."""
    out = spark.range(1).drop("id")
    for name, items in values.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in items])).alias(name))
    return out


def coverage(records: DataFrame) -> DataFrame:
    """Record and distinct source counts per category, outcome and pair, zero rows included."""
    spark = records.sparkSession
    per_source = records.groupBy("category", "outcome", "source").agg(F.count(F.lit(1)).alias("n"))
    shape = F.explode(F.array(
        F.struct(F.lit("category").alias("level"), F.col("category").alias("c"), F.lit("*").alias("o")),
        F.struct(F.lit("outcome").alias("level"), F.lit("*").alias("c"), F.col("outcome").alias("o")),
        F.struct(F.lit("pair").alias("level"), F.col("category").alias("c"), F.col("outcome").alias("o")),
    ))
    spread = per_source.select("source", "n", shape.alias("g")).select("source", "n", "g.*")
    counted = spread.groupBy("level", "c", "o").agg(
        F.sum("n").alias("record_count"), F.count_distinct("source").alias("source_count")
    )
    grid = (
        _domain(spark, level=["category"], c=CATEGORIES, o=["*"])
        .unionByName(_domain(spark, level=["outcome"], c=["*"], o=OUTCOMES))
        .unionByName(_domain(spark, level=["pair"], c=CATEGORIES, o=OUTCOMES))
    )
    out = grid.join(counted, ["level", "c", "o"], "left").fillna(0, ["record_count", "source_count"])
    return out.withColumnsRenamed({"c": "category", "o": "outcome"})


def keyed_coverage(records: DataFrame, keys: list[str]) -> DataFrame:
    per_source = records.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("n"))
    return per_source.groupBy(*keys).agg(F.sum("n").alias("record_count"), F.count(F.lit(1)).alias("source_count"))


def split_report(records: DataFrame) -> DataFrame:
    counts = keyed_coverage(records, ["split"])
    return counts.join(set_hash(records, ["split"], "source", "source_set_sha256"), "split")


def _why(pairs) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]))


def typed_metrics(records: DataFrame, cfg: EvaluationConfig) -> DataFrame:
    """Per typed category over the evaluation split; values are null and reasons given below the minimum."""
    spark = records.sparkSession
    scoped = with_targets(records.where((F.col("split") == "evaluation") & F.col("category").isin(*TYPED)))
    base = scoped.groupBy("category", "source").agg(
        F.count("loss").alias("e"), F.count(F.lit(1)).alias("n"), F.sum("loss").alias("s"), F.max("loss").alias("m"),
        F.count_if(F.col("loss") == 0).alias("z"), F.sum("ppm").alias("ps"), F.max("ppm").alias("pm"),
    )
    agg = base.groupBy("category").agg(
        F.sum("e").alias("eligible"), F.sum(F.col("n") - F.col("e")).alias("ineligible"),
        F.count_if(F.col("e") > 0).alias("source_count"), F.sum("s").alias("_s"), F.max("m").alias("_m"),
        F.sum("z").alias("_z"), F.sum("ps").alias("_ps"), F.max("pm").alias("_pm"),
    )
    mid = median(scoped.where("loss is not null"), ["category"], "loss", "_mid")
    out = _domain(spark, category=TYPED).join(agg, "category", "left").join(mid, "category", "left")
    out = out.fillna(0, ["eligible", "ineligible", "source_count"])
    reasons = _why([
        (F.col("eligible") < cfg.minimum_records, "insufficient_typed_evaluation_records"),
        (F.col("source_count") < cfg.minimum_sources, "insufficient_typed_evaluation_sources"),
    ])
    out = out.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    rec, speed = F.col("category") == "recognition", F.col("category") == "speed"
    return out.select(
        "category", "eligible", "ineligible", "source_count", (~ok).alias("abstained"), "reasons",
        F.when(ok, F.col("_s").cast("double") / F.col("eligible")).alias("mean_loss"),
        F.when(ok, F.col("_mid")).alias("median_loss"),
        F.when(ok, F.col("_m").cast("double")).alias("max_loss"),
        F.when(ok, F.col("_z")).alias("exact_count"),
        F.when(ok & speed, F.col("_ps") / F.col("eligible")).alias("mean_ppm"),
        F.when(ok & speed, F.col("_pm")).alias("max_ppm"),
        F.when(ok & rec, F.floor(F.col("_z") * 10000 / F.col("eligible"))).cast("bigint").alias("match_rate_bp"),
    )


def paired_records(records: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Evaluation records of two configs on the same benchmark, with the state of each pair."""
    ev = with_targets(records.where(F.col("split") == "evaluation"))
    pick = lambda cfg, p: ev.where(F.col("config") == cfg).select(
        "category", "benchmark", *[F.col(c).alias(p + c) for c in ("source", "loss", "target")])
    both = pick(baseline, "b_").join(pick(candidate, "c_"), ["category", "benchmark"])
    state = (
        F.when(~F.col("category").isin(*TYPED), "no_adapter")
        .when(F.col("b_loss").isNull() | F.col("c_loss").isNull(), "untyped")
        .when(F.col("b_target") != F.col("c_target"), "target_mismatch")
        .otherwise("typed")
    )
    return both.withColumn("state", state)


def compare_configs(records: DataFrame, baseline: str, candidate: str, cfg: EvaluationConfig) -> DataFrame:
    spark = records.sparkSession
    pairs = paired_records(records, baseline, candidate)
    typed = F.col("state") == "typed"
    p = pairs.groupBy("category", "b_source").agg(
        F.count(F.lit(1)).alias("paired"), F.count_if(typed).alias("typed"),
        F.count_if(F.col("state") == "untyped").alias("untyped"),
        F.count_if(F.col("state") == "target_mismatch").alias("mismatch"),
        F.sum(F.when(typed, F.col("b_loss"))).alias("bl"), F.sum(F.when(typed, F.col("c_loss"))).alias("cl"),
        F.count_if(typed & (F.col("c_loss") < F.col("b_loss"))).alias("cw"),
        F.count_if(typed & (F.col("b_loss") < F.col("c_loss"))).alias("bw"),
    ).groupBy("category").agg(
        *[F.sum(c).alias(c) for c in ("paired", "typed", "untyped", "mismatch", "bl", "cl", "cw", "bw")],
        F.count_if(F.col("typed") > 0).alias("sources"),
    )
    totals = records.where("split = 'evaluation'").groupBy("category").agg(
        F.count_if(F.col("config") == baseline).alias("baseline_records"),
        F.count_if(F.col("config") == candidate).alias("candidate_records"),
    )
    names = ["baseline_records", "candidate_records", "paired", "typed", "untyped", "mismatch", "cw", "bw", "sources"]
    out = _domain(spark, category=CATEGORIES).join(totals, "category", "left").join(p, "category", "left").fillna(0, names)
    cover = lambda c: F.when(F.col(c) > 0, F.floor(F.col("paired") * 10000 / F.col(c))).otherwise(0).cast("bigint")
    out = out.withColumn("baseline_coverage_bp", cover("baseline_records")).withColumn(
        "candidate_coverage_bp", cover("candidate_records")
    )
    open_ = ~F.col("category").isin(*TYPED)
    reasons = _why([
        (open_, "no_defensible_typed_target_adapter"),
        (~open_ & (F.col("typed") < cfg.minimum_pairs), "insufficient_paired_typed_benchmarks"),
        (~open_ & (F.col("sources") < cfg.minimum_pair_sources), "insufficient_paired_sources"),
        (~open_ & (F.least("baseline_coverage_bp", "candidate_coverage_bp") < cfg.minimum_pair_coverage),
         "imbalanced_or_unpaired_config_coverage"),
        (~open_ & (F.col("mismatch") > 0), "owner_target_mismatch"),
    ])
    out = out.withColumn("reasons", reasons)
    ok = F.size("reasons") == 0
    mean = lambda c: F.col(c).cast("double") / F.col("typed")
    return out.select(
        "category", "baseline_records", "candidate_records", "paired", "typed", "untyped", "mismatch", "sources",
        "baseline_coverage_bp", "candidate_coverage_bp", (~ok).alias("abstained"), "reasons",
        F.when(ok, mean("bl")).alias("baseline_mean"), F.when(ok, mean("cl")).alias("candidate_mean"),
        F.when(ok, mean("cl") - mean("bl")).alias("difference"),
        F.when(ok, F.col("cw")).alias("candidate_lower"), F.when(ok, F.col("bw")).alias("baseline_lower"),
        F.when(ok, F.col("typed") - F.col("cw") - F.col("bw")).alias("equal"),
    )


def sufficiency(records: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: counts per split and whether any typed metric has enough data."""
    per = records.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), F.count(F.lit(1)).alias("source_count"),
        F.coalesce(F.sum(F.when(F.col("split") == "development", F.col("n"))), F.lit(0)).alias("development_records"),
        F.count_if(F.col("split") == "development").alias("development_sources"),
        F.coalesce(F.sum(F.when(F.col("split") == "evaluation", F.col("n"))), F.lit(0)).alias("evaluation_records"),
        F.count_if(F.col("split") == "evaluation").alias("evaluation_sources"),
    ).withColumn("_k", F.lit(1))
    ok = metrics.agg((F.count_if(~F.col("abstained")) > 0).alias("sufficient")).withColumn("_k", F.lit(1))
    out = per.join(ok, "_k").drop("_k")
    return out.withColumn("reasons", _why([
        (F.col("record_count") == 0, "empty_corpus"),
        (F.col("evaluation_records") == 0, "no_evaluation_sources"),
        (~F.col("sufficient"), "no_typed_metric_has_sufficient_evaluation_data"),
    ]))
