"""Tidemill: rollout analytics as DataFrame, window and higher-order-function queries."""
