"""Selections on validation rows, locked before held-out rows can be read.

A selection is a table: one row a key, hashed row by row and written once. The
reader of the splits compares it with what is expected, and with what its rows
hash to now, before it hands out a held-out split. Two kinds of things are
selected here: settings of a quantile model, all fitted together in the same
passes, and models with random settings, in waves on growing shares of the rows.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeframe.functions.scalar import pinball
from galeframe.operators import learning as ln
from galeframe.operators import metrics
from galeframe.operators import regressors as rg
from galeframe.sources.storage import exists, shared_dir

HELD_OUT = ("calibration", "test")


def record_hash(columns: list[str]):
    """SHA-256 of a row's values as JSON: a NULL is told from a text, and values do not run into each other."""
    return F.sha2(F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(columns))), {"ignoreNullFields": "false"}), 256)


def _faults(selections: DataFrame, expected: DataFrame, keys: list[str]) -> tuple[int, int, int]:
    """How many expected keys are missing, how many keys are there twice, and how many were not expected."""
    per = selections.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = per.join(expected.select(*keys).distinct().withColumn("wanted", F.lit(True)), keys, "full")
    return tuple(both.agg(F.count_if(F.col("n").isNull()), F.count_if(F.col("n") > 1), F.count_if(F.col("wanted").isNull())).first())


def write_lock(selections: DataFrame, expected: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Writes the selections with the hash of each row, once: every expected key exactly once and no other.

    Where a lock is there already it must hold the same rows, and stays.
    """
    missing, twice, unexpected = _faults(selections, expected, keys)
    if missing or twice or unexpected:
        raise ValueError(f"selections cannot be locked: {missing} keys missing, {twice} repeated, {unexpected} not expected")
    columns = [c for c in selections.columns if c != "record_sha256"]
    spark = selections.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        selections.select(*columns).withColumn("record_sha256", record_hash(columns)).write.mode("errorifexists").parquet(path)
    elif not _same(spark.read.parquet(path), selections.select(*columns).withColumn("record_sha256", record_hash(columns))):
        raise ValueError("the lock that is there holds other selections")
    return spark.read.parquet(path)


def _same(a: DataFrame, b: DataFrame) -> bool:
    a, b = a.select("record_sha256"), b.select("record_sha256")
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


class HeldOutReader:
    """Hands out rows by split; held-out splits only once the lock is there, is complete and was not changed."""

    def __init__(self, rows: DataFrame, expected: DataFrame, keys: list[str], lock_path: str, split: str = "split", held_out: tuple[str, ...] = HELD_OUT):
        self.rows, self.expected, self.keys, self.path, self.split, self.held_out = rows, expected, keys, lock_path, split, held_out

    def verify(self, selections: DataFrame | None = None) -> None:
        """Raises unless the lock is whole; with ``selections``, unless it is theirs."""
        spark = self.rows.sparkSession
        if not exists(spark, f"{self.path}/_SUCCESS"):
            raise PermissionError("held-out rows need a lock of the selections")
        locked = spark.read.parquet(self.path)
        missing, twice, unexpected = _faults(locked, self.expected, self.keys)
        columns = [c for c in locked.columns if c != "record_sha256"]
        changed = locked.where(record_hash(columns) != F.col("record_sha256")).count()
        if missing or twice or unexpected or changed:
            raise PermissionError(f"the lock does not verify: {missing} keys missing, {twice} repeated, {unexpected} not expected, {changed} records changed")
        if selections is not None and not _same(locked, selections.select(*columns).withColumn("record_sha256", record_hash(columns))):
            raise PermissionError("the lock holds other selections")

    def read(self, split: str, selections: DataFrame | None = None) -> DataFrame:
        if split in self.held_out:
            self.verify(selections)
        return self.rows.where(F.col(self.split) == split)

    def readable(self) -> DataFrame:
        """The rows of all splits that need no lock."""
        return self.rows.where(~F.coalesce(F.col(self.split).isin(*self.held_out), F.lit(False)))


# --- quantile candidates


def fit_candidates(train: DataFrame, vector: str, target: str, is_target: str, candidates: list[tuple[str, float, float, float]], taus: list[float], most: int = 200) -> DataFrame:
    """Certified fits of every quantile of every candidate (name, penalty, variance, discrepancy), in the same passes over the rows.

    The moments of the domains are summed once for all candidates.
    """
    found = ln.moments(train, vector, target, is_target)
    terms, jobs = {}, []
    for name, penalty, variance, discrepancy in candidates:
        quadratic, linear = ln.domain_terms(found, variance, discrepancy)
        quadratic = quadratic + (penalty - 1) * np.eye(len(linear))
        for tau in taus:
            jobs.append((f"{name}|{tau!r}", tau, 0))
            terms[jobs[-1][0]] = (quadratic, linear)
    jobs = train.sparkSession.createDataFrame(jobs, "job string, tau double, seed int")
    fits = ln.fit_jobs(train, jobs, vector, target, terms=terms, most=most)
    return fits.withColumn("candidate", F.substring_index("job", "|", 1))


def predict_candidates(rows: DataFrame, key: str, vector: str, target: str, fits: DataFrame) -> DataFrame:
    """(key, y, candidate, tau, prediction) for all fits in one pass; a row's quantiles are put in order, so none cross."""
    fitted: dict[str, list] = {}
    for f in fits.select("candidate", "tau", "weights", "intercept").collect():  # one row a fit
        fitted.setdefault(f["candidate"], []).append((f["tau"], [*f["weights"], f["intercept"]]))
    models = [(name, np.array([t for t, _ in sorted(own)]), np.array([w for _, w in sorted(own)])) for name, own in sorted(fitted.items())]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            for name, taus, weights in models:
                found = np.sort(x @ weights[:, :-1].T + weights[:, -1], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).take(pa.array(np.repeat(np.arange(n), len(taus)))) for k in (0, 1)] + [pa.array([name] * (n * len(taus)), pa.string()), pa.array(np.tile(taus, n)), pa.array(found.ravel())],
                    names=["key", "y", "candidate", "tau", "prediction"],
                )

    known = rows.select(F.col(key).cast("long"), F.col(target).cast("double"), F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull())
    return known.mapInArrow(run, "key long, y double, candidate string, tau double, prediction double").withColumnRenamed("key", key)


def score_candidates(predictions: DataFrame) -> DataFrame:
    """(candidate, quantiles, score): the mean pinball loss over all quantiles and rows with a target."""
    loss = F.avg(pinball(F.col("y"), F.col("prediction"), F.col("tau")))
    return predictions.where("y IS NOT NULL").groupBy("candidate").agg(F.count_distinct("tau").alias("quantiles"), F.round(loss, 9).alias("score"))


def tune_quantiles(reader: HeldOutReader, expected: str, key: str, vector: str, target: str, is_target: str, candidates: list[tuple[str, float, float, float]], taus: list[float], folder: str) -> DataFrame:
    """(candidate, score, certified, selected, test_score): fitted on training rows, selected on validation rows, locked, and only then scored on test rows.

    Predictions of the validation rows are stored under ``folder``. A candidate
    with an open certificate is not selected; ties go to the first name. Only the
    selected candidate is scored on the test rows.
    """
    spark = reader.rows.sparkSession
    fits = fit_candidates(reader.read("train"), vector, target, is_target, candidates, taus)
    predict_candidates(reader.read("validation"), key, vector, target, fits).write.mode("errorifexists").parquet(f"{folder}/validation")
    certified = fits.groupBy("candidate").agg(F.min(F.col("converged").cast("int")).cast("boolean").alias("certified"))
    scores = score_candidates(spark.read.parquet(f"{folder}/validation")).join(certified, "candidate")
    best = metrics.arg_best(scores.where("certified").withColumn("study", F.lit(expected)), ["study"], [F.col("score"), F.col("candidate")], ["candidate", "score"])
    locked = write_lock(best.select("study", "candidate", "score"), reader.expected, reader.keys, reader.path)
    chosen = locked.first()["candidate"]
    test = predict_candidates(reader.read("test", best.select("study", "candidate", "score")), key, vector, target, fits.where(F.col("candidate") == chosen))
    tested = score_candidates(test).select("candidate", F.col("score").alias("test_score"))
    return scores.withColumn("selected", F.col("candidate") == chosen).join(tested, "candidate", "left").select("candidate", "score", "certified", "selected", "test_score")


# --- models with random settings


def random_trials(space: dict[str, dict[str, list]], n: int, seed: int = 0) -> list[tuple[int, str, dict]]:
    """``n`` different trials (number, model, settings), drawn with replacement and told apart by what they set."""
    r = np.random.default_rng(seed)
    names, out, seen = sorted(space), [], set()
    for _ in range(100 * n):
        name = names[r.integers(len(names))]
        params = {p: values[r.integers(len(values))] for p, values in sorted(space[name].items())}
        mark = (name, json.dumps(params, sort_keys=True))
        if mark not in seen:
            seen.add(mark)
            out.append((len(out), name, params))
        if len(out) == n:
            break
    return out


def search_models(df: DataFrame, validation: DataFrame, key: str, vector: str, target: str, trials: list[tuple[int, str, dict]], seeds: list[int], shares: tuple[float, ...] = (0.25, 0.5, 1.0), keep: float = 0.5) -> tuple[DataFrame, object]:
    """The trials of every wave (wave, trial, model, params, rmse, certified, kept), and the winner fitted again on training and validation rows.

    A wave fits what is left on a share of the training rows, which the next one's
    share contains, scores it on all validation rows as the mean over the seeds,
    and keeps a part ``keep`` of it. A trial with an uncertified fit is out. Rows
    are written once, narrow, and read by all fits. Ties go to the first trial.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/search-{uuid.uuid4().hex}"
    for name, rows in (("train", df), ("validation", validation)):
        rows.select(key, vector, F.col(target).cast("double").alias(target), F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 20)).alias("draw")).write.parquet(f"{path}/{name}")
    train, held = spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/validation")
    left, told = list(trials), []
    for wave, share in enumerate(shares):
        some = train.where(F.col("draw") < int(share * (1 << 20)))
        scored = []
        for number, name, params in left:
            errors, certified = [], True
            for seed in seeds if _seeded(name) else seeds[:1]:
                model = rg.fitted(name, some, vector, target, **params, **({"seed": seed} if _seeded(name) else {}))
                certified &= getattr(model, "certified", True)
                errors.append(model(held).agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))).first()[0])
            scored.append((float(np.mean(errors)), number, name, params, certified))
        fine = sorted(s for s in ((e, number) for e, number, _, _, certified in scored if certified))
        last = wave + 1 == len(shares)
        kept = {number for _, number in fine[: 1 if last else max(1, int(np.ceil(keep * len(fine))))]}
        told += [(wave, number, name, json.dumps(params, sort_keys=True), error, certified, number in kept) for error, number, name, params, certified in scored]
        left = [t for t in left if t[0] in kept]
    if not left:
        raise ValueError("no trial is certified")
    _, name, params = left[0]
    winner = rg.fitted(name, train.unionByName(held), vector, target, **params, **({"seed": seeds[0]} if _seeded(name) else {}))
    return spark.createDataFrame(told, "wave int, trial int, model string, params string, rmse double, certified boolean, kept boolean"), winner


def _seeded(name: str) -> bool:
    return name in ("elm", "forest", "broad_forest", "boosted")
