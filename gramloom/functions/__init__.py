"""Scalar functions: tail probabilities, rounding, text rendering."""

from gramloom.functions.numeric import significant
from gramloom.functions.tails import f_pvalue, f_tail, t_pvalue, t_tail

__all__ = ["significant", "t_pvalue", "f_pvalue", "t_tail", "f_tail"]
