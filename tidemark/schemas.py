"""Schemas of the engine's relations."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_d, _i, _l, _s, _t, _b = DoubleType(), IntegerType(), LongType(), StringType(), TimestampType(), BooleanType()


def _schema(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


SESSIONS = _schema(
    scenario_id=_l, ev_idx=_i, token=_s, gt_slot=_i, arrival_s=_d, start_est_s=_d, session_end_s=_d, session_len_s=_i, pattern=ArrayType(_i),
    sensor_delay_s=_i, sensor_gain=_d, sensor_bias_a=_d, sensor_noise_std_a=_d, response_lag_s=_d, response_ramp=_d,
)
SLOT_INTERVALS = _schema(scenario_id=_l, slot=_i, start_s=_d, end_s=_d, pattern=ArrayType(_i), response_lag_s=_d, response_ramp=_d)
TELEMETRY = _schema(scenario_id=_l, ev_idx=_i, grid_idx=_i, event_s=_d, measurement_id=_i, value=_d, ingest_s=_d)
BLOCKED = _schema(scenario_id=_l, request_idx=_i, arrival_s=_d, active_sessions=_i, requested_s=_i, reason=_s, overlap_ratio=_d, long_ratio=_d)
LINKS = _schema(algorithm_id=_s, ev=_l, slot=_l, cost=_d, arrival=_l, decision_ts=_l, reason=_s, prefix_n=_l, candidates=_l, gt_in_candidates=_b, fallback=_b)
EVENTS = _schema(event_id=_l, ts=_t, user_id=_l, event_type=_s, value=_d, props=_s)
