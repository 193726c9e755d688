"""mediasieve: build, screen and evaluate labelled media corpora on Spark."""
