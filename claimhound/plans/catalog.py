"""Every analysis by name, as a function of a session and a folder of source tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimhound.operators import (
    audit,
    behaviour,
    financial,
    geography,
    kpi,
    networks,
    patients,
    patterns,
    payers,
    providers,
    queues,
    report,
    scoring,
    specialty,
    temporal,
)
from claimhound.sources.layout import bucketed_priority
from claimhound.sources.partials import quarter_partials, quarters, refreshed_quarters
from claimhound.sources.shared import load_claims, load_registry
from claimhound.sources.sketches import checked, sketch_partials, sketched_counts
from claimhound.streaming.replays import replayed_scores
from claimhound.streaming.scoring import scored_stream
from claimhound.streaming.state import CLAIM, deduplicated_arrivals, streamed_crowded_days

Query = Callable[[SparkSession, str], DataFrame]

CLAIMS_ONLY = {
    "q00_claims": lambda claims: claims,
    "q01b_claims_nulls": audit.claims_null_counts,
    "q01d_duplicate_claims": audit.duplicate_claim_ids,
    "q01d_near_duplicates": networks.near_duplicates,
    "q01f_overpayments": audit.overpayments,
    "q01g_unit_mismatches": audit.unit_mismatches,
    "q01h1_date_span": audit.date_span,
    "q01h2_claims_per_year": audit.claims_per_year,
    "q01i_fraud_type_nulls": audit.fraud_type_nulls,
    "q02b_claim_status": kpi.by_status,
    "q02c_network_status": kpi.by_network,
    "q03a_fraud_types": patterns.by_fraud_type,
    "q03b_type_by_specialty": patterns.type_by_specialty,
    "q03c_fraud_by_insurer": patterns.by_insurer,
    "q03d_weekend_split": patterns.weekend_split,
    "q03f_active_flags": patterns.by_flag_count,
    "q04e_provider_trend": providers.yearly_trend,
    "q04f_claims_per_patient": providers.claims_per_patient,
    "q05a_state_leaderboard": geography.leaderboard,
    "q05b_above_average_states": geography.above_average,
    "q05c_cross_state": geography.cross_state,
    "q05d_high_volume_states": geography.high_volume,
    "q06a_yearly_trend": temporal.yearly,
    "q06b_quarterly_trend": temporal.quarterly,
    "q06c_monthly_pattern": temporal.monthly,
    "q06d_rolling_quarters": temporal.rolling_quarters,
    "q06e_volume_spikes": temporal.volume_spikes,
    "q06e_turning_points": networks.turning_points,
    "q07a_exposure": financial.exposure,
    "q07b_specialty_gap": financial.specialty_gap,
    "q07d_overbilled_units": financial.overbilled_units,
    "q07e_insurer_pay_rate": financial.insurer_pay_rate,
    "q08a_crowded_days": behaviour.crowded_days,
    "q08b_patient_rings": behaviour.patient_rings,
    "q08b_ring_types": behaviour.patient_ring_types,
    "q08b_fraud_rings": networks.fraud_rings,
    "q08c_billing_outliers": behaviour.billing_outliers,
    "q08d_weekend_providers": behaviour.weekend_providers,
    "q09a_insurer_exposure": payers.exposure_report,
    "q09b_detection": payers.detection,
    "q09c_insurer_specialty": payers.specialty_matrix,
    "q10a_age_groups": patients.by_age_group,
    "q10b_gender": patients.by_gender,
    "q10c_repeat_fraud_patients": patients.repeat_fraud,
    "q11a_specialty_scorecard": specialty.scorecard,
    "q12a_flag_co_occurrence": scoring.co_occurrence,
    "q12b_score_bands": scoring.score_bands,
    "q12c_flag_count_validation": scoring.flag_count_validation,
    "r01_state_loss_ratio": report.state_loss_ratio,
    "r01_escalated_states": report.escalated_states,
    "r02_type_impact": report.type_impact,
    "r03_top_by_count": report.top_by_count,
    "r04_top_by_paid": report.top_by_paid,
    "r05_level_one": report.level_one,
    "r06_peer_benchmark": report.peer_benchmark,
    "r07_patient_mills": report.patient_mills,
    "r07_churning_runs": networks.churning_runs,
    "r08_weekday": report.by_weekday,
    "r09_fourth_quarter": report.fourth_quarter,
    "r10_recoverable_loss": report.recoverable_loss,
    "r11_leakage_ratio": report.leakage_ratio,
    "r12_top_provider_share": report.top_provider_share,
    "r13_cost_profile": report.cost_profile,
    "r14_weekend_review": report.weekend_review,
    "r15_unit_mismatch_holds": report.unit_mismatch_holds,
    "r16_kpi_scorecard": report.kpi_scorecard,
    "r17_quarterly_peers": report.quarterly_peer_benchmark,
    "r18_portfolio_savings": report.portfolio_savings,
    "r19_audit_coverage": report.audit_coverage,
}

REGISTRY_ONLY = {
    "q00_registry": lambda registry: registry,
    "q01c_registry_nulls": audit.registry_null_counts,
}

BOTH = {
    "q01a_row_counts": audit.row_counts,
    "q01e_orphan_providers": audit.orphan_providers,
    "q02a_dashboard": kpi.dashboard,
    "q03e_all_flag_claims": patterns.all_flag_claims,
    "q04a_provider_scorecard": providers.scorecard,
    "q04b_hit_list": providers.hit_list,
    "q04c_licensed_fraudulent": providers.licensed_fraudulent,
    "q04d_out_of_network": providers.out_of_network,
    "q07c_largest_fraud_claims": financial.largest_fraud_claims,
    "q11b_experience": specialty.by_experience,
    "q13a_priority_claims": queues.priority_claims,
    "q13b_intervention_queue": queues.intervention_queue,
    "r14_weekend_known_providers": report.weekend_known_providers,
}


#: Run the landed claims through a stream, a refresh or a table of another layout, and read what it left.
STREAMED = {
    "x01_streamed_scores": scored_stream,
    "x02_deduplicated_arrivals": deduplicated_arrivals,
    "x03_replayed_scores": replayed_scores,
    "x04_streamed_crowded_days": streamed_crowded_days,
    "x05_refreshed_quarters": refreshed_quarters,
    "x06_sketched_counts": sketched_counts,
    "x07_bucketed_priority": bucketed_priority,
}

#: What each of them comes to on two tables.
BATCH = {
    "x01_streamed_scores": queues.score_claims,
    "x02_deduplicated_arrivals": lambda claims, registry: claims.select(*CLAIM).distinct(),
    "x03_replayed_scores": queues.score_claims,
    "x04_streamed_crowded_days": lambda claims, registry, **p: behaviour.crowded_days(claims, **p),
    "x05_refreshed_quarters": lambda claims, registry: quarters(quarter_partials(claims)),
    "x06_sketched_counts": lambda claims, registry: checked(sketch_partials(claims), claims),
    "x07_bucketed_priority": queues.priority_claims,
}


def _on_claims(analysis) -> Query:
    return lambda spark, sf_dir: analysis(load_claims(spark, sf_dir))


def _on_registry(analysis) -> Query:
    return lambda spark, sf_dir: analysis(load_registry(spark, sf_dir))


def _on_both(analysis) -> Query:
    return lambda spark, sf_dir: analysis(
        load_claims(spark, sf_dir), load_registry(spark, sf_dir)
    )


def run(name: str, claims: DataFrame, registry: DataFrame, **params) -> DataFrame:
    """An analysis by name on a user's own two tables; ``params`` are its thresholds.

    The streams and refreshes answer from the claims given, as a batch; scores
    also from claims that are read as a stream, which the caller starts.
    """
    if name in CLAIMS_ONLY:
        return CLAIMS_ONLY[name](claims, **params)
    if name in REGISTRY_ONLY:
        return REGISTRY_ONLY[name](registry, **params)
    if name in STREAMED:
        return BATCH[name](claims, registry, **params)
    return BOTH[name](claims, registry, **params)


def queries() -> dict[str, Query]:
    found = {
        **{name: _on_claims(a) for name, a in CLAIMS_ONLY.items()},
        **{name: _on_registry(a) for name, a in REGISTRY_ONLY.items()},
        **{name: _on_both(a) for name, a in BOTH.items()},
        **STREAMED,
    }
    return dict(sorted(found.items()))
