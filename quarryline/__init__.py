"""Quarryline: code-intelligence analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function; the physical strategy is left to Catalyst and AQE.
"""
