"""Imports every module that registers queries."""

from tidewatch.operators import cleaning, evidence, geometry, indicators, ingestion, intervals, releases, runs, sequences, signals, spatial, statistics, submissions, surveillance, tracker, validation  # noqa: F401
from tidewatch.streaming import arrivals, persistence  # noqa: F401
