"""Structured Streaming: continuous retraining and prediction with the latest model."""
