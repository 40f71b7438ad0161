"""ledgerloom: a Spark-first analytics engine for descriptive-record collections."""
