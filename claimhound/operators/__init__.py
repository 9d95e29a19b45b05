"""The analyses: functions of the claims and registry DataFrames, thresholds as arguments."""
