"""Iterative analytics over dense numeric vectors, as ordinary Spark jobs."""

from vecloop.operators.kmeans import train_kmeans
from vecloop.operators.logistic import train_logistic
from vecloop.session import build_session

__all__ = ["build_session", "train_kmeans", "train_logistic"]
