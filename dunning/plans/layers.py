"""The recovery run as one lazy DataFrame graph (QRY-7 building blocks).

``Layers`` memoises each stage of one run so a query that needs decisions
and outcomes builds them once; nothing is materialised unless a caller asks
(``persist_decisions``), and Catalyst sees the whole plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from dunning.operators import diagnosis, execution, outcomes, policy
from dunning.operators.rules import OutcomeParams, PolicyParams
from dunning.sources import payments as P


_CACHE: dict = {}


def _keep(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


@dataclass
class Layers:
    spark: SparkSession
    sf_dir: str
    policy_params: PolicyParams = field(default_factory=PolicyParams)
    outcome_params: OutcomeParams = field(default_factory=OutcomeParams)
    execution_mode: str = "link"
    # a second execution run one day later re-sends every retry_now decision;
    # its rows are appended to the same attempts log (reference F10)
    rerun_at: str = "2024-06-02 00:00:00"

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, **params) -> "Layers":
        """One layer graph per (session, data dir, parameters): queries served
        from the same run share the already-analyzed sub-plans."""
        key = (id(spark), spark.sparkContext.applicationId, sf_dir, repr(sorted(params.items())))
        hit = _CACHE.get(key)
        if hit is None:
            hit = _CACHE[key] = cls(spark, sf_dir, **params)
        return hit

    @cached_property
    def payments(self) -> DataFrame:
        return P.payments(self.spark, self.sf_dir)

    @cached_property
    def failed(self) -> DataFrame:
        """Failed payments; also the amount lookup of execution and outcomes
        (the reference reads the failed-payments file there), so the status
        filter reaches the scan and only failed rows are shuffled."""
        return P.failed_payments_scan(self.spark, self.sf_dir)

    @cached_property
    def predictions(self) -> DataFrame:
        return diagnosis.class_share_predictions(self.failed)

    @cached_property
    def held_out(self) -> DataFrame:
        return diagnosis.held_out(self.predictions)

    # The layer products read by several stages/queries are persisted
    # (MEMORY_AND_DISK: spills instead of failing; a lost block is recomputed
    # from lineage). They are small next to the inputs: one row per failed
    # payment / attempt / retry.
    @cached_property
    def decisions(self) -> DataFrame:
        return _keep(policy.decide(self.spark, diagnosis.class_share_scores(self.failed), self.policy_params))

    @cached_property
    def attempts(self) -> DataFrame:
        return execution.route(self.decisions, self.failed, mode=self.execution_mode)

    @cached_property
    def outcomes(self) -> DataFrame:
        return _keep(outcomes.label_outcomes(self.decisions, self.failed, self.outcome_params))

    @cached_property
    def attempts_log(self) -> DataFrame:
        rerun = execution.route(self.decisions.filter(F.col("action") == "retry_now"), self.failed,
                                mode=self.execution_mode, executed_at=self.rerun_at)
        return _keep(self.attempts.unionByName(rerun))

    @cached_property
    def universe(self) -> DataFrame:
        return P.payments_universe(self.failed, P.successful_payments_scan(self.spark, self.sf_dir))

    @cached_property
    def envelopes(self) -> DataFrame:
        from dunning.sources.tables import read_table, spread
        from dunning.streaming import webhook as W
        events = spread(read_table(self.spark, self.sf_dir, "events", W.EVENT_COLUMNS))  # a JSON text and two HMACs a row
        return W.envelopes_from_events(events, W.TEST_SECRET)

    @cached_property
    def guarded(self) -> DataFrame:
        """Per-delivery guard results (one HMAC and one JSON parse per delivery,
        no body column); read twice by ``classified``."""
        from dunning.streaming import webhook as W
        return _keep(W.guard_stage(self.envelopes, W.TEST_SECRET))

    @cached_property
    def classified(self) -> DataFrame:
        """One status row per delivery of the derived envelope stream (the
        batch form of the webhook consumer); persisted like the other products."""
        from dunning.streaming import webhook as W
        return _keep(W.classify_guarded(self.guarded))

    # --- fitted models (fit once per session / data dir) -------------------
    @cached_property
    def diagnosis_split(self):
        """(train, test) rows of the diagnosis models."""
        from dunning.operators import models
        return models.split_diagnosis(diagnosis.diagnosis_features(self.failed))

    @cached_property
    def diagnosis_fit(self):
        """(PipelineModel, held-out test rows) of the 200-tree forest."""
        from dunning.operators import models
        train, test = self.diagnosis_split
        return models.fit_train(train), test

    @cached_property
    def baseline_fit(self):
        """(PipelineModel, held-out test rows) of the logistic baseline, on the same split."""
        from dunning.operators import models
        train, test = self.diagnosis_split
        return models.fit_train(train, model="logistic"), test

    @cached_property
    def diagnosis_scores(self) -> DataFrame:
        from dunning.operators import models
        fitted, test = self.diagnosis_fit
        return _keep(models.score_diagnosis(fitted, test))

    @cached_property
    def risk_scores(self) -> DataFrame:
        """Out-of-fold risk scores of all payments."""
        from dunning.operators import features, models
        return _keep(models.cross_fitted_risk(features.customer_risk_features(self.payments)))

    @cached_property
    def cross_scores(self) -> DataFrame:
        """Out-of-fold diagnosis scores of all failed payments."""
        from dunning.operators import models
        return _keep(models.cross_fitted_diagnosis(diagnosis.diagnosis_features(self.failed)))
