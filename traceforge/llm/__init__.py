"""Operators for preparing training text: one module per operator, plus ``queries`` for the registered queries."""
