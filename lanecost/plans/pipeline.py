"""The whole analysis as one lazily built plan with written stage tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import baselines, candidates as cand, evidence, explain, factorised, reads, report, retrieval, rootcause
from ..operators.notes import compile_notes
from ..operators.weekly import weekly_route_metrics
from ..schemas import KEY, Decomposition, EvidencePolicy, RetrievalPolicy, WEEKLY_COLUMNS
from ..session import cut_lineage


def analyse(shipments: DataFrame, threshold: float = 20.0) -> DataFrame:
    """Shipments to flagged route-weeks: one shuffle of the raw rows, the rest is small."""
    weekly = weekly_route_metrics(shipments)
    return cand.candidate_rule(cand.percent_deviation(baselines.add_baselines(weekly)), threshold)


class Analysis:
    """Stages of one run.

    The raw shipments are scanned once for the weekly table and once, only when asked,
    for the category table. Both are written, as are compiled notes and decisions, so
    every later branch starts from a small stored table. ``categories`` announces that both will be
    asked for: what they need of the shipments is then written once, so the joins that
    made them run once.
    """

    def __init__(self, spark: SparkSession, shipments: DataFrame, raw_notes: DataFrame, *,
                 threshold: float = 20.0, evidence_policy: EvidencePolicy = EvidencePolicy(),
                 decomposition: Decomposition = Decomposition(),
                 retrieval_policy: RetrievalPolicy = RetrievalPolicy(), categories: bool = False):
        self.spark, self.raw_notes = spark, raw_notes
        self._shipments, self._categories = shipments, categories
        self.threshold, self.evidence_policy = threshold, evidence_policy
        self.decomposition, self.retrieval_policy = decomposition, retrieval_policy

    @cached_property
    def shipments(self) -> DataFrame:
        if not self._categories:
            return self._shipments
        return cut_lineage(self._shipments.select(
            *KEY, *rootcause.LENSES, "quantity_tonnes", "tonne_km", "freight_cost_inr"))

    @cached_property
    def metrics(self) -> DataFrame:
        return cut_lineage(analyse(self.shipments, self.threshold))

    @cached_property
    def weekly(self) -> DataFrame:
        return self.metrics.select(*WEEKLY_COLUMNS)

    @cached_property
    def candidates(self) -> DataFrame:
        return cand.candidates_only(self.metrics)

    @cached_property
    def routes(self) -> DataFrame:
        return self.metrics.select("route").distinct()

    @cached_property
    def notes(self) -> DataFrame:
        return cut_lineage(compile_notes(self.raw_notes, self.routes))

    @cached_property
    def recalled(self) -> DataFrame:
        return evidence.structured_recall(self.candidates, self.notes)

    @cached_property
    def decisions(self) -> DataFrame:
        """Verdicts without retrieval; ranks only break ties among full notes."""
        return cut_lineage(evidence.decide_verdict(
            self.candidates, self.notes, policy=self.evidence_policy))

    # --- with retrieval ---

    def sparse_hits(self) -> DataFrame:
        queries = evidence.candidate_query_text(self.candidates).withColumn(
            "query_id", F.struct(*KEY))
        hits = retrieval.tfidf_sparse(
            queries.select(cand.candidate_id(F.col("route"), F.col("route_type"), F.col("week_of")).alias("id"),
                           F.col("query_text").alias("text")),
            evidence.note_document_text(self.notes).select(
                F.col("note_id").alias("id"), F.col("document_text").alias("text")),
            policy=self.retrieval_policy)
        return hits

    def fused_hits(self, query_vectors: DataFrame | None = None, note_vectors: DataFrame | None = None) -> DataFrame:
        """Fused ranking keyed by candidate; the dense channel needs vectors."""
        sparse = self.sparse_hits()
        if query_vectors is not None:
            dense = retrieval.dense_cosine(query_vectors, note_vectors, policy=self.retrieval_policy)
        else:
            dense = sparse.limit(0)
        fused = retrieval.rank_fusion(sparse, dense, self.retrieval_policy)
        keys = self.candidates.select(
            *KEY, cand.candidate_id(F.col("route"), F.col("route_type"), F.col("week_of")).alias("query_id"))
        return fused.withColumnRenamed("doc_id", "note_id").join(keys, "query_id").drop("query_id")

    def review(self, hits: DataFrame) -> DataFrame:
        """Decisions whose ties are broken by the given fused hits."""
        return evidence.decide_verdict(self.candidates, self.notes, hits, self.evidence_policy)

    # --- results ---

    @cached_property
    def packets(self) -> DataFrame:
        return evidence.packet_notes(self.candidates, self.notes, self.decisions, self.evidence_policy)

    @cached_property
    def requests(self) -> DataFrame:
        return explain.grounded_request(self.candidates, self.decisions)

    @cached_property
    def request_keys(self) -> DataFrame:
        digests = explain.evidence_digest(explain.request_evidence(self.packets))
        return explain.request_key(self.requests, digests, "template", "none")

    @cached_property
    def reasons(self) -> DataFrame:
        """Verdict, reason and source: what the outputs need, without the request keys."""
        return explain.template_reason(self.decisions).withColumn("explanation_source", F.lit("template"))

    @cached_property
    def records(self) -> DataFrame:
        return explain.explanation_records(self.decisions, self.request_keys)

    @cached_property
    def assessed(self) -> DataFrame:
        """Every recalled pair through the gate: the audit, not needed for verdicts."""
        hits = self.recalled.withColumns({
            "fused_rank": F.lit(None).cast("int"), "dense_rank": F.lit(None).cast("int"),
            "sparse_rank": F.lit(None).cast("int"), "included_by_structured_recall": F.lit(True),
        }).drop("overlap_days")
        return evidence.evidence_gate(self.candidates, hits, self.notes, self.evidence_policy)

    @cached_property
    def reviewed(self) -> DataFrame:
        return report.review_output(self.metrics, self.decisions)

    @cached_property
    def final(self) -> DataFrame:
        return report.final_output(self.reviewed, self.reasons)

    @cached_property
    def view(self) -> DataFrame:
        return reads.anomaly_view(self.metrics, self.decisions, self.reasons)

    @cached_property
    def evidence_rows(self) -> DataFrame:
        return reads.evidence_rows(self.assessed, self.decisions, self.notes)

    def evidence_rows_of(self, *, route: str | None = None, week_from=None, week_to=None) -> DataFrame:
        """Evidence of some candidates: they are chosen before the join, so no other pair is made."""
        named = self.candidates
        for condition in (None if route is None else F.col("route") == route,
                          None if week_from is None else F.col("week_of") >= F.lit(week_from),
                          None if week_to is None else F.col("week_of") <= F.lit(week_to)):
            named = named if condition is None else named.where(condition)
        return reads.evidence_rows(factorised.audit_of(named, self.notes, self.evidence_policy), self.decisions, self.notes)

    # --- root causes ---

    @cached_property
    def unexplained(self) -> DataFrame:
        return rootcause.unexplained_candidates(self.metrics, self.decisions)

    @cached_property
    def references(self) -> DataFrame:
        return cut_lineage(rootcause.reference_week_join(self.unexplained, self.weekly))

    @cached_property
    def shares(self) -> DataFrame:
        return cut_lineage(rootcause.category_shares(self.shipments))

    @cached_property
    def contributions(self) -> DataFrame:
        return rootcause.mix_rate_decomposition(self.references, self.shares, self.decomposition)

    @cached_property
    def root_base(self) -> DataFrame:
        return rootcause.root_cause_base(self.unexplained, self.weekly, self.references, self.decomposition)

    @cached_property
    def analyses(self) -> DataFrame:
        contributions = cut_lineage(self.contributions)
        return rootcause.root_cause_analysis(
            self.root_base, contributions,
            rootcause.operational_leads(contributions, self.decomposition),
            rootcause.metric_comparison(self.references, self.weekly, self.decomposition))
