"""The commands: audit a labelled table, train experiments out of fold, blend or stack their scores."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrank.fixtures import HABIT_NUMBERS
from sparkrank.functions import scalar as S
from sparkrank.operators import audit as profiles
from sparkrank.operators import blend as blends
from sparkrank.operators import encode, folds, models, ranking, stack
from sparkrank.plans import config as configs
from sparkrank.plans import views
from sparkrank.plans.lineage import written
from sparkrank.sources import banks, sinks, tables


class Run:
    """One configuration over its tables. Stages hand over by tables in the output directory, so each can run alone."""

    def __init__(self, spark: SparkSession, tree: dict):
        self.spark, self.tree = spark, tree
        self.target, self.id = tree["project"]["target"], tree["project"]["id_column"]
        self.out = tree["output"]["directory"]
        data = tree["data"]
        self.train, self.test, self.sample = tables.load_tables(spark, data["train_path"], data["test_path"], data.get("sample_path"), data["schema"], self.id, self.target)
        # Files are parsed and numbered once.
        self.train, self.test = written(self.train, "train"), written(self.test, "test")
        features = tree.get("features", {})
        self.columns = [c for c in views.feature_columns(self.train, self.id, self.target, features.get("drop_columns"), features.get("use_id", False)) if c != "row_pos"]

    def folded(self) -> DataFrame:
        cv = self.tree.get("cv", {})
        return folds.stratified_folds(self.train, self.id, self.target, cv.get("n_splits", 5), cv.get("seed", 42))

    def audit(self, adversarial: bool = False) -> dict:
        data = written(self.folded(), "folded")
        sinks.write_folds(data, f"{self.out}/folds", self.id, self.target)
        best = profiles.univariate_audit(data, self.columns, self.target)
        sinks.write_table(best, f"{self.out}/audit_columns")
        report = {
            "rows": {"train": data.count(), "test": self.test.count()},
            "positive_rate": data.agg(F.avg(self.target)).first()[0],
            "duplicates": profiles.duplicate_report(data, self.columns, self.target).first().asDict(),
            "overlap": profiles.overlap(data, self.test, self.columns).first().asDict(),
            "strongest": [r.asDict() for r in best.limit(10).collect()],
        }
        if adversarial:
            both = self.matrix("raw")
            names = [c for c in both.columns if c not in (self.id, "split", self.target, "fold")]
            scores = models.adversarial_scores(both.where("split = 'train'"), both.where("split = 'test'"), self.id, names)
            report["adversarial_auc"] = ranking.roc_auc(scores, "came_from_test", "score").first()["auc"]
        sinks.write_json(f"{self.out}/audit.json", report)
        return report

    def matrix(self, view: str, kind: str = "filled") -> DataFrame:
        """Train and test rows of a view, with id, split, target and fold: as numbers without gaps ("filled"), as numbers with their
        gaps ("gaps"), or as they are ("raw")."""
        keys = [self.id, "split", self.target, "fold"]
        train = self.folded().withColumn("split", F.lit("train"))
        test = self.test.withColumns({"split": F.lit("test"), self.target: F.lit(None).cast("int"), "fold": F.lit(None).cast("int")})
        options = {}
        if "parent" in view:
            near = self.tree.get("features", {}).get("parent_neighbors", {})
            parent = tables.read_csv(self.spark, self.tree["data"]["parent_path"], self.tree["data"]["schema"])
            options = {"parent": parent, "parent_key": "row_pos", "label": self.target, "counts": near.get("neighbors"), "category_weight": near.get("categorical_weight", 1.25), "smoothing": near.get("smoothing", 1.0)}
        both = views.view(train.select(*keys, *self.columns).unionByName(test.select(*keys, *self.columns)), view, keys, self.columns, **options)
        made = [c for c in both.columns if c not in keys]
        if kind == "raw":
            return both
        return encode.encoded(both, keys, made, fill=kind == "filled", indicator_columns=[c for c in self.columns if c in HABIT_NUMBERS or c in profiles.numeric_columns(both, self.columns)])

    def fit(self, asked: list[str] | None = None) -> list[dict]:
        done, seen = [], {}
        for e in configs.experiments(self.tree, asked):
            if not models.available(e.model):
                if self.tree.get("training", {}).get("skip_missing_models", True):
                    continue
                raise ValueError(f"no model {e.model}")
            kind = "raw" if e.model in models.CATEGORICAL else "gaps" if e.model in models.BOOSTED else "filled"
            if (e.view, kind) not in seen:
                seen[e.view, kind] = written(self.matrix(e.view, kind), "matrix")
            both = seen[e.view, kind]
            names = [c for c in both.columns if c not in (self.id, "split", self.target, "fold")]
            plain = {c: f"x{k}" for k, c in enumerate(names)}  # names of levels may hold any character
            both = both.select(self.id, "split", self.target, "fold", *[F.col(f"`{c}`").alias(x) for c, x in plain.items()])
            train, test = both.where("split = 'train'"), both.where("split = 'test'")
            oof, scores, weights = models.out_of_fold(e, train, test, self.id, list(plain.values()), self.target)
            oof = written(oof, "oof")
            sinks.write_predictions(oof, f"{self.out}/predictions", "train", e.name, self.id)
            sinks.write_predictions(scores, f"{self.out}/predictions", "test", e.name, self.id)
            back = {x: c for c, x in plain.items()}
            sinks.write_table(self.spark.createDataFrame([(back[x], w) for x, w in weights], "feature string, importance double"), f"{self.out}/importance/{e.name}")
            auc = ranking.roc_auc(oof.join(train.select(self.id, self.target), self.id), self.target, "score").first()["auc"]
            done.append({"name": e.name, "model": e.model, "view": e.view, "auc": auc})
        sinks.write_json(f"{self.out}/trained_models.json", {"models": done})
        return done

    def scores(self, split: str, names: list[str]) -> DataFrame:
        long = tables.predictions(self.spark, f"{self.out}/predictions", split, names)
        wide = ranking.wide_scores(long, [self.id], names, value="score")
        return wide.join(self.train.select(self.id, self.target), self.id) if split == "train" else wide

    def blend(self) -> dict:
        settings = self.tree.get("ensemble", {})
        names = tables.selected_models(f"{self.out}/trained_models.json", settings.get("include_models"))
        train, test = written(self.scores("train", names), "scores"), self.scores("test", names)
        rounds = settings.get("bootstrap_rounds", 0)
        if rounds:
            rows = blends.stable_weights(train, self.id, self.target, names, rounds, settings.get("bootstrap_fraction", 0.8), settings.get("bootstrap_max_rows", 120_000), settings.get("min_selection_frequency", 0.15), settings.get("max_steps", 40)).collect()
            weights = {r["model"]: r["weight"] for r in rows if r["weight"] > 0}
        else:
            weights, _ = blends.greedy_weights(train, self.id, self.target, names, settings.get("max_steps", 40), settings.get("min_improvement", 1e-6))
        auc = ranking.roc_auc(blends.rank_blend(train, [self.id, self.target], weights), self.target, "blend").first()["auc"]
        out = blends.rank_blend(test, [self.id], weights)
        sinks.write_submission(out, self.test.select(self.id, F.lit(0.5).alias(self.target), "row_pos"), f"{self.out}/submission_blend", self.id, self.target, "blend")
        sinks.write_table(ranking.spearman(train, [self.id], names), f"{self.out}/correlation")
        report = {"weights": weights, "auc": auc}
        sinks.write_json(f"{self.out}/blend.json", report)
        return report

    def stack(self) -> dict:
        """Global and regime meta models over logits of this run's models and of all sources that are configured; the regime
        one is taken if it gains enough; ranks mixed, bands re-ordered one after another; sent out."""
        settings = self.tree.get("stack", {})
        sources = banks.settings_sources(settings)
        if settings.get("own_models", not sources):
            sources.insert(0, banks.Source("native", self.out, include=tables.selected_models(f"{self.out}/trained_models.json", settings.get("include_models")), folds=False))
        found = banks.load(self.folded(), self.test, sources, self.id, self.target)
        sinks.write_table(found.table, f"{self.out}/stack_models")
        plain = {n: f"s{k}" for k, n in enumerate(found.names)}  # names may hold any character
        names, raw = list(plain.values()), [x for n, x in plain.items() if n not in found.logits]
        missing = lambda df: df.select(self.id, sum((F.col(c).isNull().cast("int") for c in self.columns), F.lit(0)).alias("missing"))

        def logits(df: DataFrame, keys: list[str], ours: DataFrame) -> DataFrame:
            df = df.select(*keys, *[F.col(f"`{n}`").alias(x) for n, x in plain.items()])
            return written(stack.as_logits(df, raw).join(missing(ours), self.id), "logits")

        train = logits(found.train, [self.id, self.target, "fold", "row_pos"], self.train)
        test = logits(found.test, [self.id, "row_pos"], self.test)
        global_c = settings.get("global_c", 1.0)
        oof = stack.cross_fitted(train, [self.id, self.target], names, self.target, c=global_c, scale=False)
        mean, deviation = stack.disagreement(train, names)
        wide = written(stack.regime_design(train, [self.id, self.target, "fold"], names, "missing", mean, deviation), "design")
        design = [c for c in wide.columns if c not in (self.id, self.target, "fold")]
        c, regime_auc, regime = stack.best_of_grid(wide, [self.id], design, self.target, settings.get("c_values", [0.01, 0.1, 1.0]))
        global_auc = ranking.roc_auc(oof, self.target, "score").first()["auc"]
        chosen = stack.choose(global_auc, regime_auc, settings.get("margin", 2e-5))
        test_plain, weights = stack.final_logistic(train, test, [self.id], names, self.target, global_c, scale=False)
        test_regime, _ = stack.final_logistic(wide, stack.regime_design(test, [self.id], names, "missing", mean, deviation), [self.id], design, self.target, c)
        share = settings.get("regime_share", 2 / 3)
        shares = {"plain": 1 - share, "regime": share}
        both = oof.select(self.id, self.target, F.col("score").alias("plain")).join(regime.select(self.id, F.col("score").alias("regime")), self.id)
        sent = test_plain.select(self.id, F.col("score").alias("plain")).join(test_regime.select(self.id, F.col("score").alias("regime")), self.id)
        mixed, mixed_test = written(blends.rank_blend(both, [self.id, self.target], shares), "mixed"), written(blends.rank_blend(sent, [self.id], shares), "mixed")
        bands = settings.get("bands", [])
        mixed, mixed_test, banded = self.banded(mixed.join(train.select(self.id, "row_pos"), self.id), mixed_test.join(test.select(self.id, "row_pos"), self.id), bands)
        mixed_auc = ranking.roc_auc(mixed, self.target, "blend").first()["auc"]
        best = regime_auc if chosen == "regime" else global_auc
        if blends.adopt(mixed_auc - best, settings.get("adopt_gain", 1.5e-5)):
            chosen, out = "mix", mixed_test.select(self.id, F.col("blend").alias("score"))
        else:
            out = sent.select(self.id, F.col("plain" if chosen == "global" else "regime").alias("score"))
        sinks.write_submission(out, self.test.select(self.id, F.lit(0.5).alias(self.target), "row_pos"), f"{self.out}/submission_stack", self.id, self.target)
        buckets = ranking.roc_auc(train.select(self.id, "missing").join(mixed, self.id).withColumn("bucket", S.missing_bucket(F.col("missing"))), self.target, "blend", ["bucket"])
        back = {x: n for n, x in plain.items()}
        report = {"chosen": chosen, "models": found.names, "auc": {"global": global_auc, "regime": regime_auc, "mix": mixed_auc}, "c": c, "weights": {back[x]: w for x, w in weights}, "bands": banded, "by_missing": {r["bucket"]: r["auc"] for r in buckets.collect()}}
        sinks.write_json(f"{self.out}/stack.json", report)
        return report

    def banded(self, train: DataFrame, test: DataFrame, bands: list[dict]) -> tuple[DataFrame, DataFrame, list[dict]]:
        """Both tables' ``blend`` re-ordered in each band ({path, weight}) in turn, and what each band had before."""
        if not bands:
            return train, test, []
        own = banks.load_bands(train, test, [b["path"] for b in bands], self.id)
        places = [(f"band{k}", float(b["weight"])) for k, b in enumerate(bands)]
        both = own["train"].withColumn("split", F.lit("train")).unionByName(own["test"].withColumn("split", F.lit("test")), allowMissingColumns=True)
        out, found = blends.band_report(both, self.target, "blend", places, "row_pos", ["split"])
        report = [{"path": b["path"], **{k: v for k, v in r.items() if k != "band"}} for b, r in zip(bands, found, strict=True)]
        return out.where("split = 'train'"), out.where("split = 'test'"), report


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sparkrank", description=__doc__)
    out.add_argument("--config")
    out.add_argument("--output-dir")
    out.add_argument("--drop-columns", help="comma-separated")
    out.add_argument("--use-id", action="store_true")
    out.add_argument("--no-engineered", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("audit", "train", "blend", "stack", "all"):
        own = commands.add_parser(name)
        if name in ("train", "all"):
            own.add_argument("--models", nargs="+")
        if name in ("audit", "all"):
            own.add_argument("--adversarial", action="store_true")
    demo = commands.add_parser("demo-data")
    demo.add_argument("--rows", type=int, default=2000)
    demo.add_argument("--test-rows", type=int, default=800)
    demo.add_argument("--destination", default="data/raw")
    return out


def resolved(args: argparse.Namespace) -> dict:
    tree = configs.load(args.config)
    if args.output_dir:
        tree = configs.merged(tree, {"output": {"directory": os.path.abspath(args.output_dir)}})
    features: dict = {}
    if args.drop_columns is not None:
        features["drop_columns"] = [c.strip() for c in args.drop_columns.split(",") if c.strip()]
    features |= {"use_id": True} if args.use_id else {}
    features |= {"engineered": False} if args.no_engineered else {}
    return configs.merged(tree, {"features": features})


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkrank").getOrCreate()
    if args.command == "demo-data":
        for name, df in zip(("train", "test", "sample_submission"), tables.demo(spark, args.rows, args.test_rows), strict=True):
            df.orderBy("id").coalesce(1).write.mode("overwrite").csv(f"{args.destination}/{name}.csv", header=True)
        return
    tree = resolved(args)
    run = Run(spark, tree)
    sinks.write_json(f"{run.out}/config.json", tree)
    if args.command in ("audit", "all"):
        run.audit(args.adversarial)
    if args.command in ("train", "all"):
        run.fit(args.models)
    if args.command in ("blend", "all"):
        run.blend()
    if args.command == "stack":
        run.stack()


if __name__ == "__main__":
    main()
