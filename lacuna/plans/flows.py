"""End-to-end flows: raw episode files to a clean dataset, a dataset to an imputed one, features to ranking and held-out areas.

``python -m lacuna.plans.flows clean-icu|clean-hourly|clean-episodes|impute|report`` runs them over folders.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators import classify, joins, modelled, ranking, sampling, series, stats
from lacuna.sources import episodes, sinks
from lacuna.storage import durable


def finished(obs: DataFrame, variables: Sequence[str], inverted_mask: bool = False) -> DataFrame:
    """Dense series with mask and interval."""
    dense = series.dense_grid(obs, variables)
    return series.obs_interval(series.with_mask(dense, inverted_mask))


def clean_icu(spark: SparkSession, records: str, outcomes: Sequence[str], out: str, inverted_mask: bool = False) -> DataFrame:
    """Records with an outcome and off the blacklist, split 0.8 / 0.1 / rest by a hash of their id; data and training metadata go to ``out``."""
    obs, static = episodes.read_icu_records(spark, records)
    labels = episodes.read_outcomes(spark, outcomes)
    # Labels are joined before anything is aggregated: unlabelled records never reach a shuffle of cells.
    obs = joins.without_listed(obs.join(labels.select("episode_id"), "episode_id", "left_semi"), episodes.ICU_BLACKLIST)
    data = sampling.hash_split(finished(obs, episodes.ICU_VARIABLES, inverted_mask).withColumn("__n", F.xxhash64("episode_id")), "__n").drop("__n")
    data = durable(data)
    sinks.save_dataset(data, out, stats.metadata(data.where("split = 'train'")), "split")
    labels.write.mode("overwrite").parquet(f"{out}/labels")
    static.write.mode("overwrite").parquet(f"{out}/static")
    return data


def clean_hourly(spark: SparkSession, records: str, measurements: Sequence[str], out: str) -> DataFrame:
    obs, static = episodes.read_hourly_records(spark, records, measurements)
    data = durable(series.obs_interval(series.with_mask(obs)))
    sinks.save_dataset(data, out, stats.metadata(data))
    static.write.mode("overwrite").parquet(f"{out}/static")
    return data


def clean_episodes(spark: SparkSession, files: str, listfile: str, out: str) -> DataFrame:
    labels = episodes.read_listfile(spark, listfile)
    data = durable(joins.label_join(series.obs_interval(series.with_mask(episodes.read_episode_files(spark, files))), labels))
    sinks.save_dataset(data, out, stats.metadata(data))
    return data


def impute_dataset(spark: SparkSession, path: str, strategy: str, out: str, most_missing: float = 1.0, **how) -> DataFrame:
    """A saved dataset with gaps filled; variables missing more than ``most_missing`` are dropped first. Means come from the saved metadata."""
    meta = sinks.load_metadata(spark, path)
    data = stats.drop_sparse_vars(sinks.load_dataset(spark, path), meta, most_missing)
    if strategy not in ("zero", "forward_zero", "linear_zero"):
        how = {"means": meta.select("var", "mean"), **how}
    if strategy == "trees":
        how = {"variables": [r["var"] for r in meta.where(F.col("missing_rate") <= most_missing).select("var").orderBy("var").collect()], **how}
    filled = modelled.impute(data, strategy, **how)
    sinks.save_dataset(filled, f"{out}_{strategy}", meta)
    return filled


def ranked_experiment(obs: DataFrame, labels: DataFrame, variables: Sequence[str], n_bins: int = 32, top: int = 10, kind: str = "gbt", **how) -> dict[str, DataFrame]:
    """Four-stat features with training means, their ranks on train and validation, and areas on the test split with all and with selected features.

    ``labels``: (episode_id, y). Returns losses, ranks, selected, auroc_all and auroc_selected.
    """
    split = sampling.hash_split(labels.withColumn("__n", F.xxhash64("episode_id")), "__n").drop("__n")
    train_ids = split.where("split = 'train'").select("episode_id")
    means = obs.join(train_ids, "episode_id", "left_semi").groupBy("var").agg(F.avg("v").alias("mean"))
    wide = durable(joins.label_join(stats.features_wide(stats.simple_features(obs, variables, means), variables), split))
    names = [c for c in wide.columns if c not in ("episode_id", "y", "split")]
    part = {s: wide.where(F.col("split") == s) for s in ("train", "valid", "test")}
    losses = {s: ranking.split_losses(part[s], names, "y", n_bins) for s in ("train", "valid")}
    selected = ranking.top_union(losses["train"], losses["valid"], top)
    best = sorted(r["feature"] for r in selected.collect())
    return {
        "losses": losses["train"],
        "ranks": ranking.rank_pairs(losses["train"], losses["valid"]),
        "selected": selected,
        "auroc_all": classify.fit_and_test(part["train"], part["test"], names, "y", kind, **how),
        "auroc_selected": classify.fit_and_test(part["train"], part["test"], best, "y", kind, **how),
    }


def report(spark: SparkSession, path: str) -> DataFrame:
    """Per variable: mean, deviation and missing rate of a saved dataset, most complete first."""
    return sinks.load_metadata(spark, path).orderBy("missing_rate", "var")


def main(args: Sequence[str] | None = None) -> None:
    from lacuna.session import build_session

    p = argparse.ArgumentParser(prog="lacuna.plans.flows")
    sub = p.add_subparsers(dest="what", required=True)
    for name, more in (("clean-icu", ("records", "outcomes")), ("clean-hourly", ("records", "measurements")), ("clean-episodes", ("records", "listfile")), ("impute", ("path", "strategy")), ("report", ("path",))):
        s = sub.add_parser(name)
        for a in more:
            s.add_argument(f"--{a}", required=True)
        if name != "report":
            s.add_argument("--out", required=True)
        if name == "impute":
            s.add_argument("--most-missing", type=float, default=1.0)
    a = p.parse_args(args)
    spark = build_session("lacuna-flows")
    if a.what == "clean-icu":
        clean_icu(spark, a.records, a.outcomes.split(","), a.out)
    elif a.what == "clean-hourly":
        clean_hourly(spark, a.records, a.measurements.split(","), a.out)
    elif a.what == "clean-episodes":
        clean_episodes(spark, a.records, a.listfile, a.out)
    elif a.what == "impute":
        impute_dataset(spark, a.path, a.strategy, a.out, a.most_missing)
    else:
        report(spark, a.path).show(1000, truncate=False)


if __name__ == "__main__":
    main()
