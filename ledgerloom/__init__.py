"""Ledger rules on Spark: normalise, categorise, audit, discover, suggest, verify, reconcile and compare rule sets."""
