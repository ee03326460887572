"""Part of tidepool: sources."""
