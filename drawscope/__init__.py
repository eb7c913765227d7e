"""drawscope: judge a districting plan against an ensemble of alternatives, on Spark."""
