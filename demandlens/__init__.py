"""Skill-demand analytics as Spark DataFrame operators."""
