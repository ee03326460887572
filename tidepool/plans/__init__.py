"""Part of tidepool: plans."""
