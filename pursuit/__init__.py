"""Pursuit: player-tracking analytics as Spark DataFrame operators."""
