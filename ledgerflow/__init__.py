"""ledgerflow: sales, replenishment and customer analytics as Spark DataFrame jobs.

Every operator is a function from DataFrames (plus explicit parameters such as an
``as_of`` date) to a lazy DataFrame.  Nothing is collected to the driver; Catalyst
plans the whole job and the caller decides on the action.
"""

from ledgerflow.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
