"""Rate/quality analytics over fleets of media assets, as Spark DataFrame operators."""
