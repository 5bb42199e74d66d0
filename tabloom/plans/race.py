"""The race: search, blend, repeat, finish.

The driver holds names and scalars. Everything a restart needs is in the run
log and the result tables of the store.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.hashing import md5_unit
from tabloom.operators import ensemble as B
from tabloom.operators import runlog as L
from tabloom.operators import scores as S
from tabloom.operators import space as H
from tabloom.operators import trials as T
from tabloom.operators.models import Spec
from tabloom.operators.training import Store, Task, mean_valid, train_folds
from tabloom.plans.prepared import Preparation

LOG = (
    "run string, action_id long, name string, base string, fold_lo int, fold_hi int, "
    "start_ts timestamp, stop_ts timestamp, score double, contributivities map<string,int>"
)
SETTINGS = "submission string, base string, hash string, indices array<int>"


@dataclass
class Base:
    """A base predictor: its kind, its space, and how indices become a spec."""

    name: str
    space: H.Space
    build: Callable[[dict], Spec]


def with_preparation(base: Base, dims: list[H.Dim]) -> Base:
    """The base with the dimensions of ``preparation_dims`` behind its own."""
    names = {d.name for d in dims}
    build = lambda values: base.build({n: v for n, v in values.items() if n not in names})
    return Base(base.name, H.Space([*base.space.dims, *dims]), build)


@dataclass
class RaceSettings:
    n_rounds: int = 3
    n_trials: int = 3
    first_fold: int = 0
    n_search_folds: int = 3
    n_final_folds: int = 30
    patience: int = -1
    max_hours: float = 48.0
    floor: int = 100
    blend: str = "blend"
    blend_steps: int | None = None  # until no candidate betters the score
    seed: int = 43
    parallel: int = 4
    elements: tuple[str, ...] = ("predictor",)  # what may move; steps of the preparation by the element of their dimensions
    max_failures: int = 10  # draws in a row of which no trial could be trained


@dataclass
class Race:
    store: Store
    task: Task
    bases: dict[str, Base]
    settings: RaceSettings = field(default_factory=RaceSettings)
    run: str = "race"
    preparation: Preparation | None = None  # where given, trials bring their own features

    # -- state ----------------------------------------------------------------

    @property
    def search_folds(self) -> list[int]:
        s = self.settings
        return list(range(s.first_fold, s.first_fold + s.n_search_folds))

    @property
    def final_folds(self) -> list[int]:
        s = self.settings
        return list(range(s.first_fold, s.first_fold + s.n_final_folds))

    def log(self) -> DataFrame:
        """The run log up to the last finished search blend; later records are void."""
        raw = self.store.read("log", LOG).where(F.col("run") == self.run)
        if raw.where(F.col("name") == self.settings.blend).isEmpty():
            return raw.limit(0)
        return L.truncate_after_last_blend(raw, self.settings.blend)

    def known(self) -> DataFrame:
        return self.store.read("settings", SETTINGS)

    def rounds(self) -> DataFrame:
        return L.pair_search_with_blend(self.log(), "search", self.settings.blend)

    def blended(self) -> dict[str, int]:
        """Members of the latest search blend with their contributivity."""
        last = L.last_action(self.log(), self.settings.blend).select("contributivities").collect()
        return {k: v for k, v in (last[0][0] if last else {}).items() if v > 0}

    def _note(self, name: str, base: str | None, folds: list[int], start: datetime, score, contrib: dict | None) -> None:
        stop = datetime.now(timezone.utc)
        row = (
            self.run, time.time_ns(), name, base, folds[0], folds[-1] + 1,
            start, stop, score, {k: int(v) for k, v in (contrib or {}).items()},
        )
        self.store.append([row], "log", LOG)

    # -- choices --------------------------------------------------------------

    def _draw(self, options: list[str], label: str, round_idx: int) -> str:
        """A seeded pick, the same when a round is replayed."""
        rows = self.store.spark.createDataFrame([(o,) for o in sorted(options)], "o string")
        u = md5_unit(self.settings.seed, label, round_idx, F.col("o"))
        return rows.orderBy(u, "o").limit(1).collect()[0]["o"]

    def choose_base(self, round_idx: int) -> str:
        """The base that improved the blend fastest; untried ones come first."""
        pairs = L.round_contributivity(self.rounds(), self.log())
        speeds = L.improvement_speed(pairs, self.settings.floor).select("base", "speed")
        every = self.store.spark.createDataFrame([(b,) for b in self.bases], "base string")
        full = every.join(speeds, "base", "left").select(
            F.lit(self.run).alias("run"), "base", F.coalesce("speed", F.lit(1.7976931348623157e308)).alias("speed")
        )
        return L.choose_base(full, self.settings.seed + round_idx).collect()[0]["base"]

    def choose_element(self, base: str, members: list[str], n_rounds_of_base: int, round_idx: int) -> str:
        """The predictor first; any element once the base is established in the blend."""
        if n_rounds_of_base >= 2 and members:
            return self._draw(list(self.settings.elements), "element", round_idx)
        return self.settings.elements[0]

    # -- steps ----------------------------------------------------------------

    def _specs(self, base: Base, settings: DataFrame) -> dict[str, Spec]:
        rows = settings.select("submission", "indices").collect()  # the round's few trials
        return {r["submission"]: base.build(base.space.decode(r["indices"])) for r in rows}

    def _values_of(self, names: list[str]) -> dict[str, tuple[Base, dict]]:
        """Base and values of known submissions; a row each comes to the driver."""
        rows = self.known().where(F.col("submission").isin(names)).select("submission", "base", "indices").collect()
        return {r["submission"]: (self.bases[r["base"]], self.bases[r["base"]].space.decode(r["indices"])) for r in rows}

    def train(self, names: list[str], folds: list[int]) -> list[str]:
        """Train known submissions, each on the features its settings ask for, and
        return those with a score on every fold."""
        groups: dict[str, tuple[Task, dict[str, Spec]]] = {}
        for name, (base, values) in sorted(self._values_of(names).items()):
            key, task = self.preparation.task(values) if self.preparation else ("", self.task)
            groups.setdefault(key, (task, {}))[1][name] = base.build(values)
        errors = []
        for task, specs in groups.values():
            try:
                train_folds(self.store, task, specs, folds, parallel=self.settings.parallel)
            except Exception as e:  # noqa: BLE001  every fit of a group failed, which the table of failures holds
                errors.append(e)
        if errors and self.store.scores().isEmpty():
            raise errors[0]  # nothing was ever trained: not the fault of a trial's settings
        scored = self.store.scores().where((F.col("step") == "valid") & F.col("submission").isin(names) & F.col("fold").isin(folds))
        whole = scored.groupBy("submission").agg(F.count_distinct("fold").alias("n")).where(F.col("n") == len(folds))
        return sorted(r["submission"] for r in whole.collect())

    def _search(self, base: Base, parent: str | None, element: str, round_idx: int) -> list[str]:
        """New trials, drawn again for those that fail, until there are as many as asked."""
        good: list[str] = []
        failures = attempt = 0
        while len(good) < self.settings.n_trials and failures < self.settings.max_failures:
            wanted = self.settings.n_trials - len(good)
            fresh = self._trials(base, parent, element, round_idx + 100 * attempt, wanted).collect()
            if not fresh:
                break
            self.store.append([tuple(r) for r in fresh], "settings", SETTINGS)
            found = self.train([r["submission"] for r in fresh], self.search_folds)
            failures = 0 if found else failures + 1
            good, attempt = good + found, attempt + 1
        return good

    def hybrids(self, base_name: str, parent: str, element: str, from_names: list[str]) -> list[str]:
        """Trials of ``parent`` with the settings of one element, a step of the
        preparation say, taken from other submissions of any base; trained on the
        search folds."""
        base = self.bases[base_name]
        start = list(self.known().where(F.col("submission") == parent).first()["indices"])
        parts = []
        for other in self.bases.values():
            at = {n: i for i, n in enumerate(other.space.names())}
            moved = [F.col("indices")[at[d.name]] if d.name in at else F.lit(d.default_index) for d in base.space.dims]
            rows = self.known().where((F.col("base") == other.name) & F.col("submission").isin(from_names))
            parts.append(rows.select("submission", H.index_array(moved).alias("indices")))
        selected = parts[0]
        for p in parts[1:]:
            selected = selected.unionByName(p)
        mixed = H.hybrid_trials(selected, start, base.space, element, base_name, self.known())
        rows = mixed.select("submission", F.lit(base_name).alias("base"), H.trial_hash(F.col("indices")).alias("hash"), "indices").collect()
        if rows:
            self.store.append([tuple(r) for r in rows], "settings", SETTINGS)
        return self.train([r["submission"] for r in rows], self.search_folds) if rows else []

    def _trials(self, base: Base, parent: str | None, element: str, round_idx: int, n: int) -> DataFrame:
        """New settings around the parent: the chosen element's dimensions move."""
        start = base.space.defaults()
        if parent is not None:
            row = self.known().where(F.col("submission") == parent).select("indices").collect()
            start = list(row[0]["indices"]) if row else start
        dims = [
            d if d.element == element else H.Dim(d.name, d.values, d.values[i], (), d.element)
            for d, i in zip(base.space.dims, start)
        ]
        free = [d.name for d in dims if d.element == element]
        done = self.known().where(F.col("base") == base.name).select("hash")
        drawn = H.random_trials(
            self.store.spark, H.Space(dims), n, self.settings.seed + 1000 * round_idx, done, free
        )
        return drawn.select(
            F.concat(F.lit(f"{base.name}_hyperopt_"), F.col("hash")).alias("submission"),
            F.lit(base.name).alias("base"), "hash", "indices",
        )

    def blend_now(self, names: list[str], folds: list[int], kind: str) -> tuple[dict[str, int], float, DataFrame]:
        """Blend the submissions on the folds: (contributivities, score, weights)."""
        rows = self.store.predictions(self.task, "valid").where(
            F.col("submission").isin(names) & F.col("fold").isin(folds)
        )
        steps, metric = self.settings.blend_steps, self.task.score_name
        if kind == "bag_then_blend":
            weights, out = B.bag_then_blend(rows, metric, steps)
        else:
            weights = B.blend(rows, metric, steps)
            out = B.blend_then_bag(rows, weights, metric)
        totals = {r["submission"]: r["contributivity"] for r in B.contributivity_totals(weights).collect()}
        score = B.score_of(out.withColumn("_k", F.lit(0)), metric, ("_k",)).collect()[0]["score"]
        return totals, score, weights

    def round(self, round_idx: int) -> None:
        members = self.blended()
        name = self.choose_base(round_idx)
        base = self.bases[name]
        own = sorted(m for m in members if m.split("_hyperopt_")[0] == name)
        seen = self.rounds().where(F.col("base") == name).count()
        element = self.choose_element(name, own, seen, round_idx)
        parent = self._draw(own, "parent", round_idx) if own else None

        start = datetime.now(timezone.utc)
        trained = self._search(base, parent, element, round_idx)
        best = None
        if trained:
            scored = self.store.scores().where(F.col("submission").isin(trained) & F.col("fold").isin(self.search_folds))
            lower = S.lower_is_better(self.task.score_name)
            best = mean_valid(scored).agg((F.min if lower else F.max)("mean_valid")).first()[0]
        self._note("search", name, self.search_folds, start, best, None)
        if best is None:
            return
        start = datetime.now(timezone.utc)
        totals, score, _ = self.blend_now(sorted(set(members) | set(trained)), self.search_folds, self.settings.blend)
        self._note(self.settings.blend, name, self.search_folds, start, score, totals)

    def n_done(self) -> int:
        return self.rounds().count()

    def stop(self, tried: int) -> bool:
        s = self.settings
        if max(tried, self.n_done()) >= s.n_rounds:
            return True
        log = self.log()
        if s.patience > 0:
            rounds = log.where(F.col("name") == s.blend).select("run", "start_ts", "action_id", "score")
            if not L.patience_stop(rounds, s.patience, S.lower_is_better(self.task.score_name)).isEmpty():
                return True
        members = self.blended()
        if not members:
            return False
        spent = log.where(F.col("name").isin("search", s.blend)).agg(F.sum(L.seconds())).first()[0] or 0.0
        last = L.last_action(log, s.blend).select(L.seconds()).first()[0]
        names = self.store.spark.createDataFrame([(m,) for m in members], "submission string")
        first = (
            self.store.scores()
            .where((F.col("fold") == s.first_fold) & (F.col("step") == "valid"))
            .select("submission", "seconds")
        )
        cost = L.final_blend_cost(names, first, spent / 3600, last, s.n_search_folds, s.n_final_folds, s.max_hours)
        return cost.first()["over_budget"]

    def members_at(self, n: int) -> list[str]:
        """Members of the blend after the n-th round."""
        return sorted(r["submission"] for r in L.round_state(self.log(), n, self.settings.blend).collect())

    def finish(self, round_idx: int | None = None) -> dict[str, DataFrame]:
        """Train the blend on all folds, then the three outputs for the test table.

        ``round_idx`` goes back to the blend of an earlier round.
        """
        names = sorted(self.blended()) if round_idx is None else self.members_at(round_idx)
        if not names:
            return {}
        self.train(names, self.final_folds)
        pick = lambda split: self.store.predictions(self.task, split).where(
            F.col("submission").isin(names) & F.col("fold").isin(self.final_folds)
        )
        valid, test = pick("valid"), pick("test")
        cell = self.task.cell
        start = datetime.now(timezone.utc)
        totals, score, weights = self.blend_now(names, self.final_folds, "blend")
        self._note("final_blend_then_bag", None, self.final_folds, start, score, totals)
        out = {"blend_then_bag": B.blend_then_bag(test, weights, self.task.score_name).select(*cell, "p")}

        start = datetime.now(timezone.utc)
        w2, bagged = B.bag_then_blend(valid, self.task.score_name, self.settings.blend_steps)
        score2 = B.score_of(bagged.withColumn("_k", F.lit(0)), self.task.score_name, ("_k",)).collect()[0]["score"]
        self._note("final_bag_then_blend", None, self.final_folds, start, score2, None)
        out["bag_then_blend"] = B.apply_blend(
            B.bag_for(test, self.task.score_name).withColumn("fold", F.lit(0)), w2
        ).select(*cell, "p")

        means = (
            self.store.scores()
            .where(F.col("submission").isin(names) & F.col("fold").isin(self.final_folds) & (F.col("step") == "valid"))
            .groupBy("submission")
            .agg(F.avg("value").alias("score"))
            .withColumn("base", F.split("submission", "_hyperopt_")[0])
        )
        out["best_single"] = B.best_single(test, means, self.task.score_name).select("base", *cell, "p")
        return out

    def go(self, finish: bool = True) -> dict[str, DataFrame]:
        """Run or resume until a stop rule holds."""
        tried = self.n_done()
        while not self.stop(tried):
            self.round(tried)
            tried += 1
        return self.finish() if finish else {}


def grow_folds(
    store: Store, task: Task, specs: dict[str, Spec], first: int, start: int, stop: int, top_n: int, n_sigma: float
) -> list[str]:
    """Successive narrowing: per added fold keep trials within n sigma, train on it."""
    lower = S.lower_is_better(task.score_name)
    names = sorted(specs)
    train_folds(store, task, specs, list(range(first, first + start)))
    for last in range(first + start, first + stop):
        scores = store.scores().where((F.col("step") == "valid") & F.col("submission").isin(names))
        rows = scores.select("submission", "fold", F.col("value").alias("valid"))
        kept = T.select_within_sigma(rows, "valid", list(range(first, last)), top_n, n_sigma, lower)
        names = sorted(r["submission"] for r in kept.collect())
        train_folds(store, task, {n: specs[n] for n in names}, list(range(first, last + 1)))
    return names


def select_and_train(
    store: Store, task: Task, specs: dict[str, Spec], trained: list[int], folds: list[int],
    top_n: int | None = None, cutoff: float | None = None, n_sigma: float | None = None,
) -> DataFrame:
    """Select by the trained folds, then train the selected on the larger set."""
    lower = S.lower_is_better(task.score_name)
    scores = store.scores().where((F.col("step") == "valid") & F.col("submission").isin(list(specs)))
    rows = scores.select("submission", "fold", F.col("value").alias("valid"))
    if n_sigma is not None:
        kept = T.select_within_sigma(rows, "valid", trained, top_n, n_sigma, lower)
    else:
        means = T.trial_means(rows, trained)
        kept = (
            T.select_by_cutoff(means, "valid", cutoff, lower)
            if cutoff is not None
            else means.orderBy(F.col("valid").asc() if lower else F.col("valid").desc(), "submission").limit(
                top_n if top_n is not None else len(specs)
            )
        )
    names = [r["submission"] for r in kept.select("submission").collect()]
    return train_folds(store, task, {n: specs[n] for n in names}, folds)


def run_arms(race: Race, arms: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Known-good settings: train on all folds, blend, bag: (weights, test output)."""
    b = race.bases[base]
    settings = H.arm_settings(arms, b.space, base)
    specs = race._specs(b, settings)
    train_folds(race.store, race.task, specs, race.final_folds, parallel=race.settings.parallel)
    _, _, weights = race.blend_now(sorted(specs), race.final_folds, "blend")
    test = race.store.predictions(race.task, "test").where(F.col("submission").isin(sorted(specs)))
    return weights, B.blend_then_bag(test, weights, race.task.score_name)
