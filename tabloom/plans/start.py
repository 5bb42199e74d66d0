"""From a raw kit to a first trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabloom.meta import Kit
from tabloom.operators.models import Spec
from tabloom.operators.training import Store, Task, train_folds
from tabloom.plans.prepare import ChainSettings, make_task, preprocess_chain, setup

STARTER = "starting_kit"


def setup_and_start(
    kit: Kit,
    store: Store,
    settings: ChainSettings | None = None,
    spec: Spec | None = None,
    folds: tuple[int, ...] = (0, 1, 2),
    force: bool = False,
) -> tuple[Task, DataFrame]:
    """Clean, profile and prepare; train a boosted model on the first folds.

    Returns the training task and the starter's mean validation score.
    """
    task = make_task(preprocess_chain(setup(kit), settings), write=False)
    spec = spec or Spec("gbt", {"maxIter": 100, "maxDepth": 5}, task.score_name)
    return task, train_folds(store, task, {STARTER: spec}, list(folds), force=force)
