"""Frame-catalog analytics as Spark DataFrame operators.

A *frame* is one exposure of an astronomical camera: one row of capture
metadata, quality metrics and pointing.  Every operator takes DataFrames and
returns DataFrames; nothing is stored in the session.
"""

from nightledger.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
