"""QRY-7: the complete recovery run as one Spark application.

payments -> features -> diagnosis -> decisions -> attempts -> outcomes ->
metrics / audit / cases, with no CSV hand-offs between stages. Only products
are materialised: the decisions table (written once and read back, which also
cuts the lineage for the three stages that read it), the attempts
log, outcomes, audit, cases and the metrics document. Every product is published whole under
``out_dir`` (a shared folder on a cluster) with a fingerprint of what it was made from,
so a run that failed goes on where it failed.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunning.operators import audit, cases, diagnosis, execution, metrics, models, outcomes, policy
from dunning.operators.rules import OutcomeParams, PolicyParams
from dunning.sources import payments as P
from dunning.sources import committed, sinks
from dunning.sources.tables import read_table, table_path
from dunning.streaming import recovery_log
from dunning.streaming import webhook as W


def _files(spark: SparkSession, path: str) -> list[tuple]:
    """Name, size and time of every file below ``path``."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listing = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(jpath, True)
    found = []
    while listing.hasNext():
        f = listing.next()
        found.append((f.getPath().getName(), f.getLen(), f.getModificationTime()))
    return sorted(found)


class Products:
    """Products of a run that a later run of the same inputs takes over.

    Each product has a fingerprint: the run's inputs and parameters, its own name, and the
    fingerprints of the products it is made from. A published product (``sources.committed``)
    whose name carries the same fingerprint is read, any other is built, so a run
    that failed goes on at the stage that failed, and changed inputs build anew.
    """

    def __init__(self, spark: SparkSession, out_dir: str, basis: str):
        self.spark, self.out_dir, self.basis = spark, out_dir, basis
        self.marks: dict[str, str] = {}
        self.built: list[str] = []

    def get(self, name: str, build: Callable[[], DataFrame], *sources: str,
            partition_by: list[str] | None = None) -> DataFrame:
        mark = hashlib.sha256(json.dumps([self.basis, name, [self.marks[s] for s in sources]]).encode()).hexdigest()[:16]
        self.marks[name] = mark
        path = os.path.join(self.out_dir, name)
        if mark not in committed.published(self.spark, path):
            committed.write_run(build(), path, mark, partition_by)
            self.built.append(name)
        return committed.read_runs(self.spark, path, [mark]).drop("run")


def run(spark: SparkSession, sf_dir: str, out_dir: str, use_model: bool = False, with_webhook: bool = True,
        policy_params: PolicyParams | None = None, outcome_params: OutcomeParams | None = None,
        executed_at: str = execution.DEFAULT_EXECUTED_AT) -> dict:
    """The whole run; returns its metrics document. A second call with the same inputs, parameters and
    ``out_dir`` reads the products that stand and builds the missing ones."""
    basis = json.dumps([[_files(spark, table_path(sf_dir, t)) for t in ("orders", "events")], use_model, repr(policy_params), repr(outcome_params),
                        executed_at])
    products = Products(spark, out_dir, basis)
    pay = P.payments(spark, sf_dir)
    failed = P.failed_payments_scan(spark, sf_dir)  # status filter pushed into the scan

    def decide() -> DataFrame:
        if not use_model:
            return policy.decide(spark, diagnosis.class_share_scores(failed), policy_params)
        # every payment is scored by a forest that was not trained on it
        feats = diagnosis.diagnosis_features(failed)
        scored = models.cross_fitted_diagnosis(feats)
        return policy.decide(spark, scored.join(feats.select("payment_id", "amount"), "payment_id", "left"), policy_params)

    decisions = products.get("policy_decisions", decide)
    attempts_log = products.get("attempts_log", lambda: execution.route(decisions, failed, executed_at=executed_at).withColumn(
        "execution_date", F.substring("execution_timestamp", 1, 10)), "policy_decisions", partition_by=["execution_date"]).drop("execution_date")
    out = products.get("recovery_outcomes", lambda: outcomes.label_outcomes(decisions, failed, outcome_params), "policy_decisions")
    document = products.get("final_metrics", lambda: metrics.final_metrics(decisions, out).coalesce(1), "policy_decisions", "recovery_outcomes")
    sinks.write_metrics_json(document, os.path.join(out_dir, "final_metrics_json"))
    products.get("audit_log", lambda: audit.audit_table(failed, decisions, attempts_log), "policy_decisions", "attempts_log")

    def build_cases() -> DataFrame:
        universe = P.payments_universe(failed, P.successful_payments_scan(spark, sf_dir))
        return cases.payment_cases(universe, decisions, attempts_log, out)

    products.get("cases", build_cases, "policy_decisions", "attempts_log", "recovery_outcomes")

    if with_webhook:
        # entry B in batch form: the event stream of this data set, classified
        # against the recovery log so far, matched to the attempts just written
        log_dir, run_id = os.path.join(out_dir, "recovery_log"), hashlib.sha256(basis.encode()).hexdigest()[:16]

        def classify() -> DataFrame:
            env = W.envelopes_from_events(read_table(spark, sf_dir, "events", W.EVENT_COLUMNS), W.TEST_SECRET)
            guarded = W.guard_stage(env, W.TEST_SECRET)
            return W.classify_guarded(guarded, recovery_log.processed_ids(spark, log_dir, guarded, None, exclude=(run_id, 0)))

        results = products.get("webhook_results", classify)
        rec = W.recoveries(results)
        if "webhook_results" in products.built:
            recovery_log.write_epoch(rec, log_dir, run_id, 0)
        products.get("webhook_matches", lambda: W.match_recoveries(rec, attempts_log), "webhook_results", "attempts_log")
    return sinks.metrics_document(document)
