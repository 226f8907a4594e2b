"""Operators for preparing training text, each in a module of its own, with their queries.

Nothing outside this folder imports it. The functions that run inside Python workers travel with
the plan, as those of the whole package do.
"""
