"""Media-catalogue and pipeline-log analytics as Spark DataFrame operators."""
