from tillwise.functions.numeric import amount, cents, money, ratio_round
from tillwise.functions.temporal import as_date, month_start, seconds_between, whole_days

__all__ = [
    "amount",
    "as_date",
    "cents",
    "money",
    "month_start",
    "ratio_round",
    "seconds_between",
    "whole_days",
]
