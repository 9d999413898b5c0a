"""exposit: exposure analytics over comment corpora, as Spark DataFrame plans."""
