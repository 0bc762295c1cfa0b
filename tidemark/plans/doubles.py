"""Columns of type double of each registered model; both sides of a comparison round them alike."""

DOUBLES: dict[str, str] = {
    "accuracy_by_lag": "mean_absolute_error median_absolute_error mean_absolute_error_working median_absolute_error_working mean_wis median_wis mean_wis_working median_wis_working",
    "accuracy_by_location": "mean_ae",
    "accuracy_by_origin": "mean_ae",
    "accuracy_by_revision_size": "mean_size mean_ae",
    "accuracy_overall": "mean_ae median_ae p90_ae gain_percent",
    "accuracy_working": "mean_ae median_ae p90_ae gain_percent",
    "alert_confusion": "sensitivity specificity ppv npv false_alert_rate",
    "alignment_rows": "q_error f_harm m_harm score realized_ae realized_regret harm",
    "archive_normalize": "value",
    "archive_report": "genuine_rate median_gap cadence",
    "attach_context": "truth latest log_delta_value_7dav_lag7 inv_log_lag",
    "attach_process": "truth latest process_shift_score",
    "attach_progress": "truth latest progress",
    "axis_resolution": "share",
    "build_cases": "truth latest",
    "calendar_features": "inv_log_lag",
    "carry_forward": "prediction q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99",
    "clip_experiment_window": "value",
    "cluster_bootstrap": "low high better_probability",
    "complete_test_rows": "truth latest log_delta_value_7dav_lag7 inv_log_lag",
    "completed_training": "latest target remaining",
    "completion_curve": "rate median_error q10 q90",
    "cross_location_search": "distance",
    "curve_scale": "curve_scale",
    "delayed_target": "target_value",
    "difficulty_vs_process": "mean_q_error mean_score mean_ae median_ae",
    "distribution_summary": "mean_wis coverage_50 width_50 missed_low_50 missed_high_50 coverage_80 width_80 missed_low_80 missed_high_80 coverage_95 width_95 missed_low_95 missed_high_95",
    "donor_forecast": "prediction absolute_error q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99",
    "donor_weights": "effective_donors largest_weight mean_remaining",
    "donors": "remaining state",
    "dual_alert_contrasts": "mean_difference low high",
    "ecdf_rank": "ecdf",
    "endpoint_offsets": "tau endpoint_offset",
    "episode_course": "step",
    "episode_curves": "remaining",
    "episode_summaries": "median_gap zero_share median_step median_abs_step mad_step",
    "external_predictions": "external",
    "fharm_discrimination": "mean_f_harm harm_frequency mean_wilson_width drift",
    "fill_lag_grid": "value",
    "flat_line_comparison": "saved mean_saved median_saved",
    "forecast_quality": "q_error f_harm f_harm_wilson_low f_harm_wilson_high",
    "fraction_value": "numerator denominator value",
    "genuine_events": "value",
    "genuine_rate": "share genuine_rate",
    "harm_severity": "m_harm",
    "harm_vs_process": "harm_frequency",
    "historical_scale": "center scale",
    "interval_calibration": "coverage coverage_error mean_width median_width missed_low missed_high mean_wis median_wis",
    "interval_calibration_by_lag": "coverage coverage_error mean_width median_width missed_low missed_high mean_wis median_wis",
    "interval_columns": "wis_working width_50 width_80 width_95",
    "issued_context_columns": "log_delta_value_7dav_lag7 inv_log_lag",
    "joint_alert_grid": "mean_ae harm_frequency",
    "location_curves": "curve position",
    "log_features": "log_value_7dav log_value_7dav_denom log_ratio",
    "mad_scale": "scale",
    "matched_cases": "absolute_error absolute_error_working wis wis_working true_remaining_revision",
    "mharm_severity": "coverage spearman lowest highest",
    "missingness": "fraction",
    "monitor_nondegeneracy": "q25 median q75 share_at_max unavailable stable watch re_diagnose",
    "nearest_threshold": "threshold",
    "non_crossing": "truth_working q0_5 q0_01 q0_025 q0_1 q0_25 q0_75 q0_9 q0_975 q0_99",
    "opposed_objectives": "qerr_ae qerr_regret qerr_harm fharm_harm",
    "pairwise_loss": "mean_difference median_difference win tie loss saved",
    "process_alert_validation": "mean_ae mean_regret mean_score",
    "process_attribution": "mean_score",
    "process_audit": "mean_ae mean_score",
    "process_context_join": "q_error realized_ae score",
    "process_daily": "volume reference_dates genuine_share zero_share mean_change mean_abs_change gap_days gap_flag",
    "process_profiles": "spacing genuine_rate median_revision median_abs_revision mad_revision",
    "process_shift": "process_shift_score",
    "process_states": "state",
    "profile_availability": "mean_ae median_ae p90_ae mean_wis median_wis p90_wis mean_regret median_regret p90_regret",
    "profile_standardize": "z",
    "prospective_calibration": "wis_working q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99",
    "qerr_discrimination": "mean_q_error mean_ae mean_regret harm_frequency spearman",
    "qerr_vs_width": "mean_width lowest highest ratio spearman_width spearman_within",
    "quantile_bins": "size",
    "quantile_calibration": "tau empirical",
    "quantile_higher": "q_higher",
    "reference_cadence": "cadence first_lag second_lag",
    "register_method": "prediction q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99",
    "reliability_coverage": "coverage gap mean_q_error mean_ae harm_frequency severity_available",
    "reliability_history": "q_error f_harm f_harm_wilson_low f_harm_wilson_high m_harm realized_ae realized_null_ae realized_regret",
    "reliability_reference": "error_reference regret_reference",
    "revision_deltas": "log_delta_value_7dav_lag7",
    "revision_gaps": "q25 median q75",
    "revision_profile": "share",
    "risk_group_validation": "mean_ae harm_frequency",
    "route_weights": "weight",
    "routing_audit_by_lag": "mean median",
    "same_location_search": "distance",
    "scan_archive": "value",
    "scan_mapped_archive": "value",
    "scan_triangles": "value",
    "similarity_routes": "distance weight",
    "single_location": "value",
    "sink_tables": "mean_ae",
    "sparse_scales": "d_profile d_course d_stage",
    "spearman": "rho",
    "stage_scale": "stage_scale",
    "standardize_predictions": "truth prediction truth_working prediction_working provisional_value provisional_working true_remaining_revision predicted_remaining_revision absolute_error absolute_error_working wis_working q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99 q0_01_working q0_025_working q0_1_working q0_25_working q0_5_working q0_75_working q0_9_working q0_975_working q0_99_working",
    "stratified_differences": "mean_difference win",
    "target_lag_asof": "rate median_error",
    "task_distance": "distance",
    "task_prototypes": "stage median_gap zero_share median_step median_abs_step mad_step",
    "to_raw_scale": "working from_log1p from_log from_identity",
    "trailing_mean_7": "value_7dav",
    "train_sets_global": "remaining",
    "train_sets_local": "latest target remaining",
    "triangle": "log_value_7dav log_value_target_7dav log_delta_value_7dav_lag7 inv_log_lag",
    "upper_order_statistic": "q_error",
    "weekly_normalize": "value",
    "weighted_quantiles": "truth latest q0_01 q0_025 q0_1 q0_25 q0_5 q0_75 q0_9 q0_975 q0_99",
    "wilson_interval": "low high",
    "wis": "wis_working wis",
}
