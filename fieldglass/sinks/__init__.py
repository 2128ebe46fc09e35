"""Tables, JSON documents, label trees, and publication all at once."""
