"""Scalar functions: Column in, Column out; also offered to SQL predicates."""

from netstate.functions import ip, text, timefn
from netstate.functions.register import register_sql_functions

__all__ = ["ip", "text", "timefn", "register_sql_functions"]
