"""A typed, nullable, ordered table engine on Spark SQL.

An operation checks names and types against the schema when it is called and
then extends a DataFrame plan. Row numbers, running aggregates over all rows,
local values and CSV inference need a job of their own while the plan is built;
what they cut goes to the shared checkpoint folder.
"""

from orrery.errors import *  # noqa: F403
from orrery.operators.frame import Frame
from orrery.operators.join import on, on_by, using, using_by, using_columns, using_columns_by
from orrery.operators.series import Series
from orrery.operators.sort import asc, by, desc
from orrery.plans.mask import Mask

__all__ = ["Frame", "Mask", "Series", "asc", "by", "desc", "on", "on_by", "using", "using_by", "using_columns", "using_columns_by"]
