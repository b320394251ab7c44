"""Spark jobs that build, score, audit and analyse logged multi-stage agent runs."""
