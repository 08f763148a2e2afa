"""Job graphs: documents, validation and compilation to DataFrame plans."""
