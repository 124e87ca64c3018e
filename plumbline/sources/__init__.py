"""Files, databases, and stores for baselines and rule sets."""
