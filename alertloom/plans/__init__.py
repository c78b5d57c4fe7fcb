"""Registered queries over the star-schema test tables, each with its SQL twin where one exists.

The tables hold no alerts, so ``inputs`` maps them to alerts, datasets and judge results by fixed
rules on their columns; all rows of a table take part.
"""
