"""Training-data operators: one module per operator, and their registered queries.

Nothing outside this package imports it except the driver contract, which adds
its queries only where the package is present.
"""
