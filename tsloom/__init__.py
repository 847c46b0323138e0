"""tsloom: transport-stream analytics expressed as Spark DataFrame plans."""
