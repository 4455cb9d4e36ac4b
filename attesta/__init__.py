"""attesta: an evidence-auditing and corpus-processing engine on PySpark."""
