"""Compositions: feature choice, training, cross validation and tuning."""
