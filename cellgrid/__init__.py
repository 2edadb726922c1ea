"""cellgrid: imaging-transcriptomics analytics as Spark DataFrame operators."""
