"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; ``queries.py`` lists what
``__spark_entry__.py`` adds when it is present.
"""
