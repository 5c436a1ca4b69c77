"""Tuning as one job that a lost driver can go on with: every finished trial is kept in a journal in the shared folder."""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from underwright.functions.scalars import name
from underwright.operators import models, tuning
from underwright.operators.models import FIT_THREADS, SEED, Matrix
from underwright.session import materialise
from underwright.sources import files

TRIAL_DDL = "key string, model string, settings string, cv_auc double"


def data_key(rows: DataFrame) -> str:
    """Digest of the rows in any order: their number, and the sum and the parity of the hashes of all columns."""
    whole = f"xxhash64({', '.join(map(name, sorted(rows.columns)))})"
    found = rows.agg(F.expr("count(*)"), F.expr(f"sum(CAST({whole} AS DECIMAL(38, 0)))"), F.expr(f"bit_xor({whole})")).first()
    return hashlib.sha256(repr(tuple(map(str, found))).encode()).hexdigest()[:16]


def trial_key(model: str, settings: Mapping, data: str, folds: int, seed: int) -> str:
    """Digest of all that a trial's result depends on."""
    return hashlib.sha256(json.dumps([model, dict(settings), data, folds, seed], sort_keys=True).encode()).hexdigest()[:24]


@dataclass
class Journal:
    """Finished trials under ``path``, a folder each; a trial counts once Spark has committed its row.

    A trial that was lost before that leaves no row and is fitted again.
    """

    spark: SparkSession
    path: str
    fitted: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def known(self) -> dict[str, float | None]:
        """AUC of every finished trial by its key. There are as many as settings were tried, some dozens."""
        self._add("none", "", {}, None)  # an empty journal has a folder to read
        rows = self.spark.read.schema(TRIAL_DDL).json(f"{self.path}/trials/*")
        return {r["key"]: r["cv_auc"] for r in rows.collect() if r["key"] != "none"}

    def _add(self, key: str, model: str, settings: Mapping, auc: float | None) -> None:
        row = self.spark.createDataFrame([(key, model, json.dumps(dict(settings), sort_keys=True), auc)], TRIAL_DDL)
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/trials/{key}")

    def add(self, key: str, model: str, settings: Mapping, auc: float | None) -> None:
        self._add(key, model, settings, auc)
        with self.lock:
            self.fitted += 1


@dataclass
class Tuner:
    """Cross-validated trials on the training rows (cleaned applicants), journalled under ``path``."""

    rows: DataFrame
    path: str
    folds: int = 5
    seed: int = SEED

    def __post_init__(self) -> None:
        self.journal = Journal(self.rows.sparkSession, self.path)
        self.data = data_key(self.rows)
        self.n_rows = self.rows.count()

    @cached_property
    def matrices(self) -> list[DataFrame]:
        """One matrix per fold, built when the first trial that isn't known needs it; trials run side by side, so a fit has few tasks."""
        return tuning.fewer_tasks(models.fold_matrices(self.rows, self.folds, self.seed))

    def search(self, model: str, build: Callable[[dict], object], candidates: Sequence[dict]) -> tuning.Search:
        """Mean AUC over the folds of every candidate, best first; those in the journal aren't fitted again."""
        keys = [trial_key(model, c, self.data, self.folds, self.seed) for c in candidates]
        known = self.journal.known()
        open_ = {k: c for k, c in zip(keys, candidates) if k not in known}
        if open_:
            folds = self.matrices

            def trial(key: str) -> None:
                auc = models.cross_validate_auc(folds, lambda: build(open_[key]))[0]
                self.journal.add(key, model, open_[key], auc)
                known[key] = auc

            with ThreadPoolExecutor(FIT_THREADS) as pool:
                list(pool.map(trial, open_))
        order = sorted(range(len(candidates)), key=lambda i: (-(known[keys[i]] or 0.0), i))
        return tuning.Search([(dict(candidates[i]), known[keys[i]]) for i in order])

    def logistic(self, n_iter: int = 24) -> dict[str, tuning.Search]:
        """Random draws of C, then a grid around the best of them."""
        build = lambda c: models.logistic(self.n_rows, c["c"], 3000)
        drawn = self.search("Logistic Regression", build, tuning.draw_logistic(n_iter, self.seed))
        around = self.search("Logistic Regression", build, [{"c": drawn.best["c"] * f} for f in tuning.C_FACTORS])
        return {"random": drawn, "grid": around}

    def boosted(self, n_iter: int = 30) -> dict[str, tuning.Search]:
        return {"random": self.search("XGBoost", lambda c: models.boosted(weight="pos_weight", seed=self.seed, **c), tuning.draw_boosted(n_iter, self.seed))}

    def final(self, best: Mapping[str, dict]) -> dict:
        """The pair of models with the settings found, fitted on all training rows, or loaded where an earlier run has saved them.

        A model is saved under a key of its settings and data; its metadata is written last and marks it as whole. The threshold in it
        is 0.5, as tuning sets none.
        """
        spark, out, train = self.rows.sparkSession, {}, None
        matrix = Matrix(self.rows)
        for model, settings in best.items():
            place = f"{self.path}/models/{trial_key(model, settings, self.data, 0, self.seed)}"
            if files.exists(spark, f"{place}/metadata/_SUCCESS"):
                out[model] = files.load_model(spark, place)[0]
                continue
            if train is None:
                train = materialise(matrix.transform(self.rows), "train")
            out[model] = self._fit(model, settings, train)
            files.save_model(out[model], place, files.model_metadata(spark, model, 0.5, {}, matrix.names, settings))
            self.journal.fitted += 1
        return {"matrix": matrix, "models": out}

    def _fit(self, model: str, settings: dict, train: DataFrame):
        stage = models.logistic(self.n_rows, settings["c"]) if model == "Logistic Regression" else models.boosted(weight="pos_weight", seed=self.seed, **settings)
        return Pipeline(stages=[stage]).fit(train)


def search_rows(spark: SparkSession, searches: Mapping[tuple[str, str], tuning.Search]) -> DataFrame:
    """(model, search, rank, settings, cv_auc) of all trials."""
    rows = [(model, kind, i + 1, json.dumps(settings, sort_keys=True), auc) for (model, kind), found in searches.items()
            for i, (settings, auc) in enumerate(found.results)]
    return spark.createDataFrame(rows, "model string, search string, rank int, settings string, cv_auc double")


def tuning_run(train: DataFrame, path: str, n_logistic: int = 24, n_boosted: int = 30, folds: int = 5, seed: int = SEED) -> dict:
    """Both searches, the settings they find and the pair fitted with them.

    ``path`` is a folder that the driver and all executors share; a second run over the same rows fits nothing and
    returns the same. Other rows, folds or seeds make other trials in the same journal. With ``n_boosted`` = 0 only the
    logistic regression is tuned and fitted. Returns searches (DataFrame), best, matrix, models and fitted, the number of
    trials and models that this run had to fit.
    """
    tuner = Tuner(train, path, folds, seed)
    searches = {("Logistic Regression", k): s for k, s in tuner.logistic(n_logistic).items()}
    best = {"Logistic Regression": searches["Logistic Regression", "grid"].best}
    if n_boosted:
        searches |= {("XGBoost", k): s for k, s in tuner.boosted(n_boosted).items()}
        best["XGBoost"] = searches["XGBoost", "random"].best
    final = tuner.final(best)
    return {"searches": search_rows(train.sparkSession, searches), "best": best, **final, "fitted": tuner.journal.fitted}
