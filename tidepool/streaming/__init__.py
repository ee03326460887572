"""Part of tidepool: streaming."""
