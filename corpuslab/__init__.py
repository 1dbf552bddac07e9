"""corpuslab: DataFrame operators for labelled, multilingual document collections."""
