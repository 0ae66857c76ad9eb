"""stayrisk: booking-cancellation analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; the heavy lifting
(scans, aggregates, windows, joins, model fitting) runs on Spark executors.
"""

__version__ = "0.1.0"
