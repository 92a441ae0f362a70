"""Banks of predictions: members of many sources side by side, each held against our tables while it is loaded.

Three kinds of source are known. A ``library`` has positional vectors: key tables that say which id (and label) stands
at which row, a manifest of its models, and predictions (split, model, row_pos, score). A ``native`` source is what this
engine's own writers leave: folds (id, label, fold) and predictions (split, model, id, score). A ``logits`` source has two
wide tables (id and a column a member), already in log-odds. Whatever the source, its rows are joined with ours and the
checks are counted by :meth:`DataFrame.observe` in the very pass that writes the joined table: ids that one side lacks or
repeats, ids at another row, labels, folds, values that are missing or not finite. If any count isn't zero for any
source, nothing is loaded: the written tables go and :class:`Refused` names every problem found.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkrank.operators.ranking import long_scores, roc_auc
from sparkrank.plans.lineage import deleted, handed_over, side_session, written

KINDS = ("library", "native", "logits")
SPLITS = ("train", "test")
INF = float("inf")


class Refused(ValueError):
    """Why a bank isn't loaded: ``problems`` is a list of (source, split, check, count)."""

    def __init__(self, problems: list[tuple[str, str, str, int]]):
        super().__init__("; ".join(f"{s or 'bank'} ({p}): {c}: {n}" if n else f"{s or 'bank'} ({p}): {c}" for s, p, c, n in problems))
        self.problems = problems


@dataclass
class Source:
    """One source. ``include`` picks models, ``exclude`` leaves some out; names get ``prefix`` and two underscores."""

    kind: str
    path: str
    prefix: str = ""
    include: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    train_file: str = "oof_members.parquet"
    test_file: str = "test_members.parquet"
    folds: bool = True

    def named(self, model: str) -> str:
        return f"{self.prefix}__{model}" if self.prefix else model


@dataclass
class Members:
    """What was loaded: ``train`` (id, label, fold, row_pos if given, a column a member), ``test``, the members' names, which of them are
    logits already, and ``table`` (model, auc, least, largest, test_least, test_largest), the best first."""

    names: list[str]
    logits: list[str]
    train: DataFrame
    test: DataFrame
    table: DataFrame


def settings_sources(settings: dict) -> list[Source]:
    """The sources that a configuration names: ``library``, ``prediction_sources`` and ``logit_sources``; a source is a path or a map."""
    out = []
    for key, kind, prefix in (("library", "library", ""), ("prediction_sources", "native", "local"), ("logit_sources", "logits", "external")):
        given = settings.get(key) or []
        for one in given if isinstance(given, list) else [given]:
            one = {"path": one} if isinstance(one, str) else dict(one)
            known = {"path", "prefix", "include", "exclude", "train_file", "test_file", "folds"}
            if "path" not in one or set(one) - known:
                raise ValueError(f"{key}: a source has a path and may have {sorted(known - {'path'})}, not {sorted(set(one) - known)}")
            out.append(Source(kind, **({"prefix": prefix} | one)))
    return out


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _read(spark: SparkSession, path: str, what: str, source: Source, split: str, problems: list) -> DataFrame | None:
    try:
        return spark.read.parquet(path) if what != "manifest" else spark.read.csv(path, header=True)
    except Exception as e:  # noqa: BLE001
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        problems.append((source.path, split, f"no {what}", 0))
        return None


def _stored(df: DataFrame) -> dict[str, set[str]]:
    """Names of models by split; the columns are directories, of which no file is read."""
    out: dict[str, set[str]] = {s: set() for s in SPLITS}
    for r in df.select("split", "model").distinct().collect():  # a row per split and model
        out.setdefault(r["split"], set()).add(str(r["model"]))
    return out


def _chosen(source: Source, have: dict[str, set[str]], problems: list) -> list[str]:
    """Models of a source in order of name, or as asked for; each must have both splits."""
    names = list(source.include) if source.include else sorted(n for n in have["train"] if "ensemble" not in n and "correlation" not in n)
    names = [n for n in names if n not in set(source.exclude)]
    if not names:
        problems.append((source.path, "train", "no predictions remain", 0))
    for split in SPLITS:
        if absent := [n for n in names if n not in have[split]]:
            problems.append((source.path, split, f"no predictions of {absent}", len(absent)))
    return names


def _cells(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A row per key, a column per model, and ``_twice``: cells that the source has more than once. One shuffle by key."""
    own = long.where(F.col("model").isin(names)).repartition(key)
    cells = own.groupBy(key, "model").agg(F.first("score").alias("_s"), F.count("*").alias("_n"))
    wide = cells.groupBy(key).pivot("model", names).agg(F.first("_s"))
    return wide.join(cells.groupBy(key).agg(F.sum((F.col("_n") > 1).cast("long")).alias("_twice")), key)


def _wide(source: Source, spark: SparkSession, id_col: str, label: str, problems: list) -> tuple[list[str], dict[str, DataFrame]]:
    """(names, frame by split) with _key (row or id), _id, _label, _fold (null where the source has none), _twice, the members."""
    none = lambda *cs: {c: F.lit(None) for c in cs}
    before = len(problems)
    if source.kind == "logits":
        frames = {s: _read(spark, f"{source.path}/{f}", "members", source, s, problems) for s, f in zip(SPLITS, (source.train_file, source.test_file), strict=True)}
        if None in frames.values():
            return [], {}
        for split, df in frames.items():
            if id_col not in df.columns:
                problems.append((source.path, split, f"no column {id_col}", 0))
        names = source.include or [c for c in frames["train"].columns if c != id_col]
        names = [n for n in names if n not in set(source.exclude)]
        for split, df in frames.items():
            if absent := [n for n in names if n not in df.columns]:
                problems.append((source.path, split, f"no members {absent}", len(absent)))
        if len(problems) > before:
            return [], {}
        out = {}
        for split, df in frames.items():
            own = df.groupBy(_q(id_col).alias("_key")).agg(*[F.first(_q(n).cast("double")).alias(n) for n in names], (F.count("*") - 1).alias("_twice"))
            out[split] = own.withColumns({"_id": F.col("_key"), **none("_label", "_fold")})
        return names, out

    stored = _read(spark, f"{source.path}/predictions", "predictions", source, "train", problems)
    if stored is None:
        return [], {}
    names = _chosen(source, _stored(stored), problems)
    split_of = lambda s: stored.where(F.col("split") == s)
    if source.kind == "library":
        listed = _read(spark, f"{source.path}/manifest.csv", "manifest", source, "train", problems)
        if listed is not None:
            known = {str(r["model"]) for r in listed.select("model").distinct().collect()}  # a row per model
            if unknown := [n for n in names if n not in known]:
                problems.append((source.path, "train", f"not in the manifest: {unknown}", len(unknown)))
        keys = {s: _read(spark, f"{source.path}/{s}_keys.parquet", "keys", source, s, problems) for s in SPLITS}
        if len(problems) > before:
            return [], {}
        out = {}
        for split in SPLITS:
            ids = keys[split].groupBy(F.col("row_pos").alias("_row")).agg(F.first(_q(id_col)).alias("_id"), (F.first(_q(label)) if split == "train" else F.lit(None)).alias("_label"), (F.count("*") - 1).alias("_twice_key"))
            cells = _cells(split_of(split), "row_pos", names)
            both = ids.join(cells, F.col("_row") == F.col("row_pos"), "full_outer")
            both = both.withColumns({"_key": F.coalesce("_row", "row_pos"), "_fold": F.lit(None), "_twice": F.coalesce("_twice", F.lit(0)) + F.coalesce("_twice_key", F.lit(0))})
            out[split] = both.drop("_row", "row_pos", "_twice_key")
        return names, out
    folds = _read(spark, f"{source.path}/folds", "folds", source, "train", problems) if source.folds else None
    if len(problems) > before:
        return [], {}
    out = {}
    for split in SPLITS:
        own = _cells(split_of(split), id_col, names).withColumnRenamed(id_col, "_key")
        if split == "train" and folds is not None:
            theirs = folds.groupBy(_q(id_col).alias("_of")).agg(F.first(_q(label)).alias("_label"), F.first("fold").alias("_fold"), (F.count("*") - 1).alias("_more"))
            own = own.join(theirs, F.col("_key") == F.col("_of"), "full_outer")
            own = own.withColumns({"_key": F.coalesce("_key", "_of"), "_twice": F.coalesce("_twice", F.lit(0)) + F.coalesce("_more", F.lit(0)), "_has": F.col("_of").isNotNull()}).drop("_of", "_more")
            # A fold table without a row for an id says as much as one with another fold.
            own = own.withColumn("_fold", F.when(F.col("_has"), F.col("_fold")).otherwise(F.lit(-1))).drop("_has")
        else:
            own = own.withColumns(none("_label", "_fold"))
        out[split] = own.withColumn("_id", F.col("_key"))
    return names, out


def _count(c: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))


def _bad(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == INF)


def _attached(base: DataFrame, own: DataFrame, source: Source, split: str, names: list[str], id_col: str, label: str, fold: str, watch: Observation, partly: bool = False) -> DataFrame:
    """``base`` with the members of ``own``; the checks are counted as rows pass. ``partly``: the source needn't have all of our ids."""
    by = "row_pos" if source.kind == "library" else id_col
    own = own.select("_key", F.col("_id").alias("_their_id"), F.col("_label").alias("_their_label"), F.col("_fold").alias("_their_fold"), "_twice", *[_q(n).alias(source.named(n)) for n in names], F.lit(True).alias("_there"))
    both = base.withColumn("_here", F.lit(True)).join(own, F.col(by) == F.col("_key"), "full_outer")
    here, there = F.col("_here").isNotNull(), F.col("_there").isNotNull()
    checks = [_count(here & ~there).alias("lacks ids of ours") if not partly else F.lit(0).cast("long").alias("lacks ids of ours"), _count(~here & there).alias("has ids that aren't ours"), _count(F.col("_twice") > 0).alias("repeats ids"), _count(here & there & ~F.col(id_col).eqNullSafe(F.col("_their_id"))).alias("has other ids at our rows")]
    if split == "train" and source.kind != "logits" and not partly:
        checks.append(_count(here & there & F.col("_their_label").isNotNull() & ~F.col(label).cast("double").eqNullSafe(F.col("_their_label").cast("double"))).alias("has other labels"))
        if source.kind == "native" and source.folds:
            checks.append(_count(here & there & ~F.col(fold).cast("long").eqNullSafe(F.col("_their_fold").cast("long"))).alias("has other folds"))
    for n in names:
        x = _q(source.named(n))
        checks += [_count(here & there & _bad(x)).alias(f"not finite: {n}"), F.min(F.when(~_bad(x), x)).alias(f"least: {n}"), F.max(F.when(~_bad(x), x)).alias(f"largest: {n}")]
    return both.observe(watch, *checks).where(here).drop("_here", "_there", "_key", "_their_id", "_their_label", "_their_fold", "_twice")


def load(train: DataFrame, test: DataFrame, sources: list[Source], id_col: str, label: str, fold: str = "fold") -> Members:
    """All members of ``sources`` beside ``train(id, label, fold[, row_pos])`` and ``test(id[, row_pos])``. Each split is joined, checked and
    written in one pass; if anything is wrong anywhere, :class:`Refused` says what, and nothing is left behind."""
    spark, side, problems, taken = train.sparkSession, side_session(train.sparkSession), [], []
    for s in sources:
        if s.kind not in KINDS:
            raise ValueError(f"unknown kind of source {s.kind}")
        if s.kind == "library" and not all("row_pos" in df.columns for df in (train, test)):
            raise ValueError("a library is positional: our tables need row_pos")
        taken.append((s, *_wide(s, side, id_col, label, problems)))
    names = [s.named(n) for s, own, _ in taken for n in own]
    problems += [("", "train", f"the name {n} comes twice", names.count(n)) for n in sorted({n for n in names if names.count(n) > 1})]
    if not names and not problems:
        problems.append(("", "train", "no sources", 0))
    if problems:
        raise Refused(problems)
    keys = {"train": [id_col, label, fold], "test": [id_col]}
    tables, watches = {}, []
    for split, ours in (("train", train), ("test", test)):
        given = written(ours.select(*keys[split], *[c for c in ("row_pos",) if c in ours.columns]), "keys")
        wide = side.read.schema(given.schema).parquet(given._sparkrank_path)
        for k, (s, own, frames) in enumerate(taken):
            watch = Observation(f"bank {split} {k}")
            wide = _attached(wide, frames[split], s, split, own, id_col, label, fold, watch)
            watches.append((s, split, watch))
        tables[split] = handed_over(written(wide, f"bank-{split}"), spark)
        deleted(given)
    ends: dict[str, dict[str, float]] = {}
    for s, split, watch in watches:
        for check, n in watch.get.items():
            if check.startswith(("least: ", "largest: ")):
                kind, _, model = check.partition(": ")
                ends.setdefault(s.named(model), {})[kind if split == "train" else f"test_{kind}"] = n
            elif n:
                problems.append((s.path, split, check, int(n)))
    if problems:
        for df in tables.values():
            deleted(df)
        raise Refused(problems)
    plain = {n: f"x{k}" for k, n in enumerate(names)}
    long = long_scores(tables["train"].select(id_col, label, *[_q(n).alias(x) for n, x in plain.items()]), [id_col, label], list(plain.values()))
    back = {x: n for n, x in plain.items()}
    aucs = {back[r["model"]]: r["auc"] for r in roc_auc(long, label, "score", ["model"]).collect()}  # a row per model
    order = sorted(names, key=lambda n: (-(aucs[n] if aucs.get(n) is not None else -1.0), n))
    table = spark.createDataFrame([(n, aucs.get(n), *[ends[n].get(e) for e in ("least", "largest", "test_least", "test_largest")]) for n in order], "model string, auc double, least double, largest double, test_least double, test_largest double")
    return Members(names, [s.named(n) for s, own, _ in taken if s.kind == "logits" for n in own], tables["train"], tables["test"], table)


def load_bands(train: DataFrame, test: DataFrame, bands: list[str], id_col: str) -> dict[str, DataFrame]:
    """{split: our table with columns band0, band1, ...: the local predictions of each band table (id, split, prediction), null outside it}.
    Ids that aren't ours, repeated ids and values that aren't finite refuse the whole, counted in the pass that writes."""
    spark, side, problems, frames = train.sparkSession, side_session(train.sparkSession), [], []
    for path in bands:
        source = Source("native", path)
        df = _read(side, path, "band", source, "train", problems)
        if df is not None and (absent := sorted({id_col, "split", "prediction"} - set(df.columns))):
            problems.append((path, "train", f"no columns {absent}", 0))
        frames.append((source, df))
    if problems:
        raise Refused(problems)
    out, watches = {}, []
    for split, ours in (("train", train), ("test", test)):
        given = written(ours, "keys")
        wide = side.read.schema(given.schema).parquet(given._sparkrank_path)
        for k, (source, df) in enumerate(frames):
            own = df.where(F.col("split") == split).groupBy(_q(id_col).alias("_key")).agg(F.first(F.col("prediction").cast("double")).alias(f"band{k}"), (F.count("*") - 1).alias("_twice"))
            own = own.withColumns({"_id": F.col("_key"), "_label": F.lit(None), "_fold": F.lit(None)})
            watch = Observation(f"band {split} {k}")
            wide = _attached(wide, own, source, split, [f"band{k}"], id_col, "", "", watch, partly=True)
            watches.append((source, split, watch))
        out[split] = handed_over(written(wide, f"bands-{split}"), spark)
        deleted(given)
    for source, split, watch in watches:
        problems += [(source.path, split, check, int(n)) for check, n in watch.get.items() if not check.startswith(("least: ", "largest: ")) and n]
    if problems:
        for df in out.values():
            deleted(df)
        raise Refused(problems)
    return out


def write_library(path: str, train_keys: DataFrame, test_keys: DataFrame, train: DataFrame, test: DataFrame, models: list[str], id_col: str, label: str) -> None:
    """A library of ``models``, columns of ``train`` and ``test`` beside row_pos; ``train_keys(row_pos, id, label)``, ``test_keys(row_pos, id)``."""
    spark = train.sparkSession
    train_keys.select("row_pos", id_col, label).write.mode("overwrite").parquet(f"{path}/train_keys.parquet")
    test_keys.select("row_pos", id_col).write.mode("overwrite").parquet(f"{path}/test_keys.parquet")
    parts = [long_scores(df.select("row_pos", *[F.col(m).cast("double").alias(m) for m in models]), ["row_pos"], models).withColumn("split", F.lit(s)) for s, df in (("train", train), ("test", test))]
    reduce(DataFrame.unionByName, parts).write.mode("overwrite").partitionBy("split", "model").parquet(f"{path}/predictions")
    spark.createDataFrame([(m,) for m in models], "model string").coalesce(1).write.mode("overwrite").csv(f"{path}/manifest.csv", header=True)
