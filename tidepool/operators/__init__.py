"""Part of tidepool: operators."""
