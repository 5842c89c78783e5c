"""tidewater: a DataFrame-first engine for collections of sensor recordings.

Every operator takes and returns Spark DataFrames keyed by ``recording_id``
(or ``session_id``), so that a plan over one recording is the same plan as one
over a billion of them.
"""

__version__ = "0.1.0"
