from .text import FUNCTIONS, fn, register_functions, sql_call

__all__ = ["FUNCTIONS", "fn", "register_functions", "sql_call"]
