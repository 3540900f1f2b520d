"""Preparing events, folds, models, metrics and attributions."""
