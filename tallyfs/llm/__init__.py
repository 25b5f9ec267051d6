"""Operators for preparing training text at scale, and the queries over them.

Each operator is a module with its own general interface; ``queries`` holds
the registered ``opN_<name>`` queries. Nothing else in the library imports
this subpackage.
"""
