"""Training-data curation at table scale: DataFrame-to-DataFrame operators on Spark."""
