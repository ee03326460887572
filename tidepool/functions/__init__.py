"""Part of tidepool: functions."""
