"""Tabular analytics and automated modelling as Spark DataFrame operators."""
