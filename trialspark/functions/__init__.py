"""Builders of SQL expression text: missing values, categories, geometry, Student t.

Expressions are passed around as SQL text and handed to Spark with ``selectExpr``
and ``expr``. The plan is the same as with column objects, but Spark parses one
string instead of receiving one call per operator, which matters for expressions
with dozens of terms.
"""
