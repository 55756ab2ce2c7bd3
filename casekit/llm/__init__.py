"""Training-data pipeline operators.

Thirteen operators for preparing text corpora, each a DataFrame -> DataFrame
function in its own module, and ``queries`` with one thin query per operator.
Nothing outside this package imports it (the driver entry adds its queries
only when it is there).
"""
